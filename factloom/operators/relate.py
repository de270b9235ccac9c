"""Joins and aggregates over attribute relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def follow(rows: DataFrame, ref: str, target: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with the columns of the entity its `ref` column points at (`target` is keyed by e)."""
    key = "_ref_e"
    return rows.join(target.withColumnRenamed("e", key), F.col(f"`{ref}`") == F.col(key), how).drop(key)


def referrers(target: DataFrame, rel: DataFrame, name: str = "part") -> DataFrame:
    """`target` (e, …) with the entities whose `rel` value points at it, as column `name`."""
    return target.join(rel.select(F.col("e").alias(name), F.col("v").alias("e")), "e")


def star(relations: dict[str, DataFrame], optional: tuple[str, ...] = ()) -> DataFrame:
    """Relations of one entity joined on e; the `optional` ones keep entities that lack them."""
    out = None
    for name, rel in relations.items():
        side = rel.select("e", F.col("v").alias(name))
        out = side if out is None else out.join(side, "e", "left" if name in optional else "inner")
    return out


def distinct_counts(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Exact distinct counts of several columns per key in two shuffles.

    Each (key, column, value) is folded once before keys are counted, so no task sees all the
    rows of a hot key and nothing is expanded inside an aggregate.
    """
    tagged = rows.select(F.col(f"`{key}`"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.col(f"`{c}`").cast("string").alias("v")) for c, n in columns.items()])).alias("x"))
    once = tagged.where(F.col("x.v").isNotNull()).select(F.col(f"`{key}`"), "x.n", "x.v").groupBy(key, "n", "v").agg(F.lit(1))
    return once.groupBy(key).agg(*[F.count_if(F.col("n") == n).alias(n) for n in columns.values()])


def set_aggregate(rows: DataFrame, by: list[str], basis: list[str], *aggregates: Column) -> DataFrame:
    """Aggregate over the distinct combinations of the grouping and basis columns."""
    return rows.select(*by, *basis).distinct().groupBy(*by).agg(*aggregates)


def most_common(rows: DataFrame, by: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value per group, the greatest of equals, with its count."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", value)).alias(name), F.max("n").alias("n"))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(…, missing, extra): how many times each row is only in `left`, or only in `right`."""
    counted = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    net = counted.groupBy(*left.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return net.select(*left.columns, F.greatest("_n", F.lit(0)).alias("missing"),
                      F.greatest(-F.col("_n"), F.lit(0)).alias("extra"))


def with_default(rows: DataFrame, rel: DataFrame, name: str, default: Column) -> DataFrame:
    """`rows` with an attribute's value, or a default where the entity lacks it."""
    side = rel.select("e", F.col("v").alias(name))
    return rows.join(side, "e", "left").withColumn(name, F.coalesce(F.col(name), default))


def lacking(rows: DataFrame, rel: DataFrame) -> DataFrame:
    """Rows whose entity has no value of an attribute."""
    return rows.join(rel.select("e"), "e", "left_anti")


def carrier_identity(values: DataFrame, state: DataFrame) -> DataFrame:
    """(a, n): how many of the given values (v) each string attribute holds, most first."""
    held = state.where(F.col("v_string").isNotNull()).select("a", F.col("v_string").alias("v")).distinct()
    return held.join(values.select("v").distinct(), "v", "left_semi").groupBy("a").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "a")


def across(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entities of two stores that carry the same identity value: (key, left, right)."""
    return left.select(F.col("v").alias("key"), F.col("e").alias("left")).join(
        right.select(F.col("v").alias("key"), F.col("e").alias("right")), "key", "full")


def pull(state: DataFrame, attrs: DataFrame, text: Column) -> DataFrame:
    """(e, attribute, value): every attribute of each entity, a row per value.

    Long on purpose: an array or a map per entity would gather a hot entity's values in one row.
    """
    return state.join(attrs.select(F.col("id").alias("a"), "ident"), "a").select("e", F.col("ident").alias("attribute"), text.alias("value"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
