"""Running values over ordered keys that stay distributed when one key holds most of the rows.

A window partitioned by key puts a whole key in one task. `running` instead cuts the order column
into ranges of bounded size, runs the window inside (key, range), and carries each range's
aggregate into the ranges after it. The carried table has one row per (key, range), so its own
window is small however large the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import cut

#: Rows of one (key, range) window at most, on average over the order column's quantiles.
ROWS_PER_RANGE = 4_000_000
#: Bound on ranges, hence on the rows the carry window sees per key.
MAX_RANGES = 4096


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is sum, max or last (last non-null); `inclusive` counts the row itself."""

    kind: str
    value: Column
    inclusive: bool = True


def previous(*columns: str) -> Running:
    """The row before, as a struct (NULL on a key's first row)."""
    return Running("last", F.struct(*columns), inclusive=False)


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running], *,
            rows_per_range: int | None = None) -> DataFrame:
    """`df` with a column per running value, over rows of equal `keys` in `order`.

    The first order column must be numeric; rows equal on it stay in one range. One narrow job
    counts the rows; the plan is a single ordinary window when they fit one range.
    """
    limit = ROWS_PER_RANGE if rows_per_range is None else rows_per_range
    rows = df.select(order[0]).count()
    ranges = min(MAX_RANGES, -(-rows // limit))
    if ranges <= 1:
        spec = W.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[_local(r, spec).alias(n) for n, r in values.items()])

    ranged = _ranged(df, order[0], ranges)
    spec = W.partitionBy(*keys, "_range").orderBy(*order)
    local = ranged.select("*", *[_local(r, spec).alias(f"_local_{n}") for n, r in values.items()])

    position = F.struct(*order)
    summary = ranged.groupBy(*keys, "_range").agg(
        *[_total(r, position).alias(f"_total_{n}") for n, r in values.items()])
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(*keys, "_range", *[
        _carry(r, F.col(f"_total_{n}"), before).alias(f"_carry_{n}") for n, r in values.items()])

    left, right = local.alias("l"), carried.alias("c")
    match = F.col("l._range") == F.col("c._range")
    for k in keys:
        match = match & F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}"))
    return left.join(right, match, "left").select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[_combined(r, F.col(f"l._local_{n}"), F.col(f"c._carry_{n}")).alias(n) for n, r in values.items()])


def _ranged(df: DataFrame, column: str, ranges: int) -> DataFrame:
    number = df.withColumn("_number", F.col(column).cast("double"))
    cuts = number.approxQuantile("_number", [i / ranges for i in range(1, ranges)], 0.5 / ranges)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_number", outputCol="_range").transform(number)
    return bucketed.drop("_number")


def _local(r: Running, spec) -> Column:
    frame = spec.rowsBetween(W.unboundedPreceding, 0 if r.inclusive else -1)
    if r.kind == "sum":
        return F.sum(r.value).over(frame)
    if r.kind == "max":
        return F.max(r.value).over(frame)
    if r.kind == "last":
        return F.last(r.value, ignorenulls=True).over(frame)
    raise ValueError(f"no running value {r.kind}")


def _total(r: Running, position: Column) -> Column:
    if r.kind == "sum":
        return F.sum(r.value)
    if r.kind == "max":
        return F.max(r.value)
    return F.max_by(r.value, F.when(r.value.isNotNull(), position))


def _carry(r: Running, total: Column, before) -> Column:
    if r.kind == "sum":
        return F.sum(total).over(before)
    if r.kind == "max":
        return F.max(total).over(before)
    return F.last(total, ignorenulls=True).over(before)


def _combined(r: Running, local: Column, carry: Column) -> Column:
    if r.kind == "sum":
        return F.when(local.isNull() & carry.isNull(), None).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    if r.kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def numbered(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """`df` with dense numbers from `start` in the order of `keys`, without a single-task window.

    Rows are range-partitioned on the keys and numbered inside each partition; the partitions'
    counts give the offsets. The numbered rows are cut from their lineage so both passes agree.
    """
    raw = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_row", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_row", 33))
              .withColumn("_pos", F.col("_row") - F.shiftleft("_part", 33)))
    counts = raw.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition of `raw`, so this window is as small as the task count
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return raw.join(offsets, "_part").withColumn(name, F.lit(start) + F.col("_offset") + F.col("_pos")).drop(
        "_row", "_part", "_pos", "_offset")
