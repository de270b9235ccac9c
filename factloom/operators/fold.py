"""Folds of the log: current and as-of state, history, provenance, business time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.model import VALUES, Attribute
from factloom.operators.ordered import Running, previous, running


def latest_key() -> Column:
    """One number that orders facts on a value by transaction, retracts before asserts.

    Its maximum is a fixed-width buffer, so Spark plans a hash aggregate with map-side partials.
    """
    return F.col("tx") * 2 + F.col("op").cast("long")


def state(facts: DataFrame, as_of: int | None = None) -> DataFrame:
    """Values that hold: each (e, a, value) whose latest fact up to `as_of` is an assert.

    The bound goes below the aggregate; `tx` is no grouping key, so it could not be pushed later.
    """
    if as_of is not None:
        facts = facts.where(F.col("tx") <= as_of)
    latest = facts.groupBy("e", "a", *VALUES).agg(F.max(latest_key()).alias("_k"))
    return latest.where(F.col("_k") % 2 == 1).select("e", "a", *VALUES, F.shiftright("_k", 1).alias("tx"))


def malformed(facts: DataFrame) -> DataFrame:
    """Facts that don't have exactly one typed value, with how many `values` they have."""
    return facts.where(~V.one_value()).withColumn("values", sum((F.col(c).isNotNull().cast("int") for c in VALUES), F.lit(0)))


def relation(facts: DataFrame, attribute: Attribute, as_of: int | None = None) -> DataFrame:
    """(e, v, tx) of one attribute, now or as of a transaction; only its typed column is read."""
    rows = facts.where(F.col("a") == attribute.id)
    if as_of is not None:
        rows = rows.where(F.col("tx") <= as_of)
    latest = rows.groupBy("e", F.col(attribute.column).alias("v")).agg(F.max(latest_key()).alias("_k"))
    return latest.where(F.col("_k") % 2 == 1).select("e", "v", F.shiftright("_k", 1).alias("tx"))


def history(facts: DataFrame, attribute: Attribute, as_of: int | None = None) -> DataFrame:
    """(e, v, tx, op) of every fact of one attribute; op is assert or retract."""
    rows = facts.where(F.col("a") == attribute.id)
    if as_of is not None:
        rows = rows.where(F.col("tx") <= as_of)
    return rows.select("e", F.col(attribute.column).alias("v"), "tx",
                       F.when(F.col("op"), "assert").otherwise("retract").alias("op"))


def wide(facts: DataFrame, attributes: list[Attribute], as_of: int | None = None) -> DataFrame:
    """One row per entity with a column per attribute, in one shuffle.

    For cardinality one the latest fact of (e, a) decides, because replacing a value writes the
    retract and the assert in one transaction and asserts sort last. Map-side partials bound what
    a hot entity sends. A `many` attribute has no bound on the values of one entity, so it is
    refused here: join its relation instead.
    """
    several = [a.ident for a in attributes if a.cardinality != "one"]
    if several:
        raise ValueError(f"{', '.join(several)}: read attributes of many values as relations")
    rows = facts.where(F.col("a").isin([a.id for a in attributes]))
    if as_of is not None:
        rows = rows.where(F.col("tx") <= as_of)
    # the value is NULL where the latest fact is a retract; without a struct in the buffer,
    # fixed-width attributes aggregate by hash
    out = rows.groupBy("e").agg(*[
        F.max_by(F.when(F.col("op"), F.col(a.column)), F.when(F.col("a") == a.id, latest_key())).alias(a.ident) for a in attributes])
    held = F.lit(False)
    for a in attributes:
        held = held | F.col(f"`{a.ident}`").isNotNull()
    return out.where(held)


def facts_text(folded: DataFrame, attrs: DataFrame) -> DataFrame:
    """(e, a, v, tx) with attribute names and canonical value text."""
    return folded.join(attrs.select(F.col("id").alias("a"), "ident"), "a").select(
        "e", F.col("ident").alias("a"), V.any_text().alias("v"), "tx")


def first_value(hist: DataFrame) -> DataFrame:
    """The first value ever asserted per entity."""
    return hist.where(F.col("op") == "assert").groupBy("e").agg(F.min_by("v", "tx").alias("v"),
                                                               F.min("tx").alias("tx"))


def slipped(current: DataFrame, hist: DataFrame) -> DataFrame:
    """(e, first, v): entities whose value is now later than the first recorded."""
    first = first_value(hist).select("e", F.col("v").alias("first"))
    return current.join(first, "e").where(F.col("v") > F.col("first")).select("e", "first", "v")


def timeline(hist: DataFrame, *, rows_per_range: int | None = None) -> DataFrame:
    """(e, tx, was, v): the values an entity asserted in order, each with the one before."""
    asserts = hist.where(F.col("op") == "assert").select("e", "tx", "v")
    out = running(asserts, ["e"], ["tx"], {"_before": previous("v")}, rows_per_range=rows_per_range)
    return out.select("e", "tx", F.col("_before.v").alias("was"), "v")


def known_by(hist: DataFrame, evidence: DataFrame, issued: DataFrame, before: datetime | Column) -> DataFrame:
    """(e, v, issued): what documents issued before an instant say.

    `evidence` is (tx, document), `issued` is (document, at). A transaction counts with its latest
    qualifying document; the latest issued value wins, then the latest transaction.
    """
    limit = before if isinstance(before, Column) else F.lit(before)
    backed = evidence.join(issued.where(F.col("at") < limit), "document").groupBy("tx").agg(F.max("at").alias("at"))
    said = hist.where(F.col("op") == "assert").join(backed, "tx")
    return said.groupBy("e").agg(F.max_by("v", F.struct("at", "tx")).alias("v"), F.max("at").alias("issued"))


def provenance(rel: DataFrame, actors: DataFrame, names: DataFrame, at: DataFrame) -> DataFrame:
    """(e, v, tx, actor, at): who recorded each value and when."""
    who = actors.select(F.col("e").alias("tx"), F.col("v").alias("_actor")).join(
        names.select(F.col("e").alias("_actor"), F.col("v").alias("actor")), "_actor")
    when = at.select(F.col("e").alias("tx"), F.col("v").alias("at"))
    return rel.join(who, "tx").join(when, "tx").select("e", "v", "tx", "actor", "at")


def since(facts: DataFrame, tx: DataFrame, attrs: DataFrame, marker_tx: int) -> DataFrame:
    """One row (facts, entities, attributes, transactions): what was written after a marker.

    Entities are those whose first fact is after it, outside transactions and attributes.
    """
    ids = tx.select(F.col("id").alias("e")).unionByName(attrs.select(F.col("id").alias("e")))
    per_entity = facts.groupBy("e").agg(F.min("tx").alias("first"),
                                        F.count_if(F.col("tx") > marker_tx).alias("facts"))
    entities = per_entity.where(F.col("first") > marker_tx).join(ids, "e", "left_anti")
    return one_row({
        "facts": per_entity.agg(F.coalesce(F.sum("facts"), F.lit(0))),
        "entities": entities.agg(F.count("*")),
        "attributes": facts.where((F.col("tx") > marker_tx) & (F.col("a") == 1)).agg(F.count_distinct("e")),
        "transactions": tx.where(F.col("id") > marker_tx).agg(F.count("*")),
    })


def one_row(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with a column per one-number DataFrame, by union and one aggregate."""
    parts = None
    for name, df in counts.items():
        part = df.toDF("n").select(F.lit(name).alias("name"), F.col("n").cast("long").alias("n"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(*[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in counts])


def same_state(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in which two states differ, as bags, with the side that has them; empty when equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right")))


def size_profile(facts: DataFrame, tx: DataFrame, attrs: DataFrame) -> DataFrame:
    """One row (facts, entities, transactions); entities exclude transactions and attributes."""
    ids = tx.select(F.col("id").alias("e")).unionByName(attrs.select(F.col("id").alias("e")))
    per_entity = facts.groupBy("e").agg(F.count("*").alias("n"))
    return one_row({
        "facts": per_entity.agg(F.sum("n")),
        "entities": per_entity.join(ids, "e", "left_anti").agg(F.count("*")),
        "transactions": tx.agg(F.count("*")),
    })


def last_before(tx: DataFrame, marks: DataFrame) -> DataFrame:
    """(mark, tx): the last transaction before each instant, for any number of marks.

    Transactions and marks are merged on one time line and the last transaction carried forward,
    so no mark meets every transaction.
    """
    line = tx.select(F.unix_micros("at").alias("t"), F.lit(1).alias("side"), F.col("id").alias("tx"),
                     F.lit(None).cast("timestamp").alias("mark"))
    # marks sort before transactions at the same instant: strictly earlier ones count
    line = line.unionByName(marks.select(F.unix_micros("mark").alias("t"), F.lit(0).alias("side"),
                                         F.lit(None).cast("long").alias("tx"), "mark"))
    line = line.withColumn("_one", F.lit(1))
    return running(line, ["_one"], ["t", "side"], {"last": Running("max", F.col("tx"))}).where("side = 0").select(
        "mark", F.col("last").alias("tx"))

