"""Scoring against ground truth: links, clusters, answers, coverage, closed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fields


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 3))


def links(stored: DataFrame, truth: DataFrame) -> DataFrame:
    """(system, stored, truth, correct, precision, recall) of identity links.

    `stored` and `truth` are (system, hub, value). A link is correct when the truth has the same
    value for that hub; each hub counts once.
    """
    kept = stored.groupBy("system").agg(F.count("*").alias("stored"))
    want = truth.select("system", "hub", "value").distinct()
    total = want.select("system", "hub").distinct().groupBy("system").agg(F.count("*").alias("truth"))
    right = stored.select("system", "hub", "value").distinct().join(want, ["system", "hub", "value"], "left_semi").select(
        "system", "hub").distinct().groupBy("system").agg(F.count("*").alias("correct"))
    out = total.join(kept, "system", "full").join(right, "system", "left").fillna(0, ["stored", "truth", "correct"])
    return out.select("system", "stored", "truth", "correct", ratio(F.col("correct"), F.col("stored")).alias("precision"),
                      ratio(F.col("correct"), F.col("truth")).alias("recall"))


def links_total(per_system: DataFrame) -> DataFrame:
    return per_system.agg(F.sum("stored").alias("stored"), F.sum("truth").alias("truth"), F.sum("correct").alias("correct")).select(
        "*", ratio(F.col("correct"), F.col("stored")).alias("precision"), ratio(F.col("correct"), F.col("truth")).alias("recall"))


def pairs_of(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2)


def cluster_pairs(predicted: DataFrame, truth: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """One row of pairwise scores of two clusterings (id, cluster), from group sizes alone.

    n members make n(n-1)/2 pairs, and the pairs both agree on are those within (predicted, truth)
    cells, so no pair is ever listed. `visible` (id) bounds the recall to members the sources show.
    """
    def count(df: DataFrame, by: list[str], name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0)).cast("long").alias("n")).select(
            F.lit(name).alias("name"), "n")
    both = predicted.select("id", F.col("cluster").alias("p")).join(truth.select("id", F.col("cluster").alias("t")), "id")
    parts = [count(predicted, ["cluster"], "marked"), count(truth, ["cluster"], "truth"), count(both, ["p", "t"], "correct")]
    if visible is None:
        seen_truth, seen_both = truth, both
    else:
        ids = visible.select("id").distinct()
        seen_truth, seen_both = truth.join(ids, "id", "left_semi"), both.join(ids, "id", "left_semi")
    parts += [count(seen_truth, ["cluster"], "visible"), count(seen_both, ["p", "t"], "found")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    out = rows.agg(*[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in ("truth", "visible", "marked", "correct", "found")])
    return out.select("truth", "visible", "marked", "correct", ratio(F.col("correct"), F.col("marked")).alias("precision"),
                      ratio(F.col("found"), F.col("visible")).alias("recall"))


def _gives_day(given: Column, day: Column) -> Column:
    """Written in any form, or as month/day alone."""
    yearless = F.regexp_replace(F.trim(given), r"(^|/)0", "$1") == F.date_format(day, "M/d")
    return F.array_contains(fields.days(given), day) | yearless


def _gives_number(given: Column, number: Column) -> Column:
    """Among the numbers of the text, or as its last part once spaces and dashes are dropped."""
    parts = F.split(given, "/")
    return F.array_contains(fields.numbers(given), number.try_cast("decimal(38,10)")) | (F.translate(F.element_at(parts, -1), " \t\n-", "") == number)


def _gives_name(given: Column, name: Column) -> Column:
    """Its letters, digits and points in one piece, case and other signs aside."""
    given, name = (F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9.]+", " ")) for c in (given, name))
    return given.contains(name)


def answer_matches(given: Column, expected: Column) -> Column:
    """Whether an answer gives what is expected, judged by the kind of thing that is: a day, a number, or a name."""
    kinds = [(r"\d{4}-\d\d-\d\d", _gives_day(given, expected.try_cast("date"))), (r"-?\d+(\.\d+)?", _gives_number(given, expected))]
    verdict = _gives_name(given, expected)
    for shape, judged in reversed(kinds):
        verdict = F.when(expected.rlike(f"^{shape}$"), judged).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def ever_had(hist: DataFrame, reference: DataFrame) -> DataFrame:
    """(value, reference, found): of the entities (value, e) that should once have had a value, how many did."""
    ever = hist.where(F.col("op") == "assert").select(F.col("v").alias("value"), "e").distinct()
    want = reference.select("value", "e").distinct()
    hit = want.join(ever.withColumn("_hit", F.lit(1)), ["value", "e"], "left")
    return hit.groupBy("value").agg(F.count("*").alias("reference"), F.count("_hit").alias("found"))


def coverage(in_file: DataFrame, in_store: DataFrame) -> DataFrame:
    """(kind, in_file, in_store): distinct keys (kind, v) of a source that a store also holds."""
    a = in_file.distinct()
    b = in_store.distinct().withColumn("_hit", F.lit(1))
    return a.join(b, ["kind", "v"], "left").groupBy("kind").agg(F.count("*").alias("in_file"), F.count("_hit").alias("in_store"))


def pairs_right(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(pairs, right): expected key pairs (a, b) the store links."""
    want = expected.select("a", "b").distinct()
    hit = found.select("a", "b").distinct().withColumn("_hit", F.lit(1))
    return want.join(hit, ["a", "b"], "left").agg(F.count("*").alias("pairs"), F.count("_hit").alias("right"))


def splits_and_twins(truth: DataFrame, stored: DataFrame) -> DataFrame:
    """One row (things, found, split, entities, twins, right) of where keys of true things lie in a store.

    `truth` is (key, thing), `stored` (key, e). A thing is split when its keys lie in several
    entities, an entity is a twin when it holds keys of several things; `right` counts the things
    with all their keys in one entity that holds nothing else's. Each (thing, entity) is folded
    once before anything is counted, so a thing with a third of all keys is no task's burden.
    """
    # dealt by key once: rows that repeat go where they meet the other side, and neither moves again
    tasks = 4 * int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = truth.select("key", "thing").repartition(tasks, "key").distinct()
    cells = keys.join(stored.select("key", "e").repartition(tasks, "key").distinct(), "key", "left").groupBy("thing", "e").agg(F.count("*").alias("n"))
    held = cells.where("e is not null")
    crowd = held.groupBy("e").agg(F.count("*").alias("things"))
    placed = held.join(crowd, "e").select("thing", F.lit(1).alias("here"), F.lit(0).alias("lost"), "things").unionByName(
        cells.where("e is null").select("thing", F.lit(0).alias("here"), F.lit(1).alias("lost"), F.lit(0).alias("things")))
    per_thing = placed.groupBy("thing").agg(F.sum("here").alias("here"), F.sum("lost").alias("lost"), F.max("things").alias("crowd"))
    here = F.col("here")
    things = per_thing.agg(F.count("*").alias("things"), F.count_if(here > 0).alias("found"), F.count_if(here > 1).alias("split"),
                           F.count_if((here == 1) & (F.col("lost") == 0) & (F.col("crowd") == 1)).alias("right"))
    entities = crowd.agg(F.count("*").alias("entities"), F.count_if(F.col("things") > 1).alias("twins"))
    names = ("things", "found", "split", "entities", "twins", "right")
    return things.unionByName(entities, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])


def closed_sample(seeds: DataFrame, tables: dict[str, tuple[DataFrame, str, str | None]]) -> dict[str, DataFrame]:
    """Every row of `tables` that names a seed (key), following references on.

    Each table is (rows, the column that names a key already kept, the column whose keys it adds).
    Tables are taken in order, so a later one may hang on keys an earlier one added.
    """
    keys = seeds.select("key").distinct()
    out = {}
    for name, (rows, needs, adds) in tables.items():
        kept = rows.join(keys.select(F.col("key").alias(needs)), needs, "left_semi")
        out[name] = kept
        if adds is not None:
            keys = keys.unionByName(kept.select(F.col(adds).cast(keys.schema["key"].dataType).alias("key"))).distinct()
    return out


def audit_sample(facts: DataFrame, name: Column, size: int, seed: int = 0, evidence: DataFrame | None = None) -> DataFrame:
    """A repeatable sample of facts to check by hand: the `size` smallest by a seeded hash of their `name`.

    With `evidence` (tx, evidence), each fact shows what its transaction rests on; only the sample
    is joined.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), name), 256)
    sample = facts.withColumn("_order", order).orderBy("_order").limit(size).drop("_order")
    return sample if evidence is None else sample.join(evidence, "tx", "left")
