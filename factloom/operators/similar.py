"""Exact set-similarity joins by rare-element prefixes, with no pair tried that shares nothing rare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import set_similarity
from factloom.session import cut, written


def containing(left: DataFrame, right: DataFrame, fraction: float) -> DataFrame:
    """(l, r) such that at least `fraction` of the left set may lie in the right set.

    `left` is (l, items) and `right` is (r, items), arrays without repeats. If x of n items are
    shared, at least one of the n - ceil(fraction n) + 1 globally rarest of the left is, so only
    that prefix is indexed. Every pair that qualifies is produced; callers verify the score.
    """
    everything = left.select(F.explode("items").alias("item")).unionByName(right.select(F.explode("items").alias("item")))
    rarity = everything.groupBy("item").agg(F.count("*").alias("n"))
    spread = left.select("l", F.size("items").alias("size"), F.explode("items").alias("item")).join(rarity, "item")
    # a set's own items only: its size bounds the sort
    ordered = spread.groupBy("l", "size").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("o"))
    length = F.col("size") - F.ceil(F.col("size") * F.lit(fraction) - 1e-9) + 1
    prefix = ordered.select("l", F.explode(F.slice("o", F.lit(1), length.cast("int"))).alias("p")).select("l", F.col("p.item").alias("item"))
    index = right.select("r", F.explode("items").alias("item"))
    return prefix.join(index, "item").select("l", "r").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, score) of every pair of sets whose similarity is at least `least`."""
    left, right = cut(left), cut(right)
    pairs = containing(left, right, least)
    met = pairs.join(left.withColumnRenamed("items", "li"), "l").join(right.withColumnRenamed("items", "ri"), "r")
    return met.select("l", "r", set_similarity(F.col("li"), F.col("ri")).alias("score")).where(F.col("score") >= least)


def keyed(df: DataFrame, key: Column, items: Column, name: str) -> DataFrame:
    return df.select(key.alias(name), items.alias("items"))


def scored_once(rows: DataFrame, left: str, right: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """`rows` with `score` of two of its text columns; each distinct pair of texts is scored once, in a number of tasks of its own."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = written(rows.select(F.col(left).alias("_left"), F.col(right).alias("_right")).distinct())
    scored = written(pairs.repartition(tasks).withColumn("score", score(F.col("_left"), F.col("_right"))))
    same = F.col(left).eqNullSafe(F.col("_left")) & F.col(right).eqNullSafe(F.col("_right"))
    return rows.join(scored, same, "left").drop("_left", "_right")
