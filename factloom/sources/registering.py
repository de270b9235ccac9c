"""Vocabulary written to a store on disk: registration, evolution and packages, each as one transaction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import ingest, vocabulary
from factloom.session import cut
from factloom.sources import log
from factloom.store import FactLog

#: Problems shown in an error.
SHOWN = 20


class Refused(ValueError):
    """Vocabulary that cannot be written, with the reasons."""


def _refuse(problems: DataFrame) -> None:
    found = problems.limit(SHOWN).collect()
    if found:
        raise Refused("; ".join(" ".join("" if v is None else str(v) for v in p) for p in found))


def _write(store: FactLog, path: str, facts: DataFrame, rows: DataFrame, tx: int, actor: int, at: datetime) -> int:
    """Facts (without tx), the registry rows that go with them, and the transaction, by one entry on the version that was read."""
    spark = facts.sparkSession
    last = store.tx.agg(F.max("at")).first()[0]
    when = F.lit(at) if last is None else ingest.next_instant(F.lit(last), F.lit(at))
    stamps = spark.range(1).select(F.lit(tx).cast("long").alias("id"), F.lit(actor).cast("long").alias("actor"), when.alias("at"))
    log.append(path, tx, "registration", facts=ingest.stamp(facts, tx, actor, when), transactions=stamps, registry=rows, base=store.number)
    return tx


def _next(store: FactLog) -> int:
    """A number past every transaction and entity, which the manifest knows, and past every attribute."""
    return max(store.high or 0, store.attrs.agg(F.max("id")).first()[0] or 0) + 1


def register(spark: SparkSession, path: str, specs: DataFrame, actor: int, at: datetime) -> int | None:
    """Register `specs` (idx, ident, type, cardinality, unique, doc, distinct_from); the transaction, or None if all are known.

    All or nothing: problems and near matches with other attributes, unless declared distinct,
    refuse the batch. New attributes get ids past everything in the store.
    """
    store = FactLog.open(spark, path)
    specs = cut(specs.withColumn("unique", F.coalesce("unique", F.lit("none"))))
    _refuse(vocabulary.registration_errors(specs, store.attrs))
    new = specs.join(store.attrs.select("ident"), "ident", "left_anti")
    declared = new.select("ident", F.explode("distinct_from").alias("other"))
    _refuse(vocabulary.near_matches(new, store.attrs, declared))
    if new.isEmpty():
        return None
    tx = _next(store)
    fresh = cut(ingest.allocate(new, ["ident"], tx + 1).select("ident", F.col("e").alias("id")))
    facts = vocabulary.registration_facts(new, fresh.unionByName(store.attrs.select("ident", "id")), tx).drop("tx")
    rows = new.join(fresh, "ident").select("id", "ident", "type", "cardinality", F.col("unique").alias("uniq"), F.trim("doc").alias("doc"), F.lit(None).cast("long").alias("replaced_by"))
    return _write(store, path, facts, rows, tx, actor, at)


def evolve(spark: SparkSession, path: str, requests: DataFrame, actor: int, at: datetime) -> int | None:
    """Change attributes by `requests` (ident, field, value): cardinality, unique, doc or replaced_by (another attribute's ident); the transaction, or None.

    Held to the rules of evolution and replacement, as any write that names these facts; values that hold already change nothing.
    """
    store = FactLog.open(spark, path)
    by = F.col("field") == "replaced_by"
    _refuse(ingest.evolution_errors(requests.where(~by), store.attrs, store.state()))
    _refuse(vocabulary.replacement_errors(requests.where(by).select("ident", F.col("value").alias("other")), store.attrs))
    ids = store.attrs.select("ident", F.col("id").cast("string").alias("e"))
    held = store.attrs.alias("r").join(store.attrs.select(F.col("id").alias("replaced_by"), F.col("ident").alias("by")), "replaced_by", "left").select(
        "ident", F.create_map(F.lit("cardinality"), F.col("cardinality"), F.lit("unique"), F.col("uniq"), F.lit("doc"), F.col("doc"), F.lit("replaced_by"), F.col("by")).alias("held"))
    moved = requests.join(held, "ident").where(~F.col("value").eqNullSafe(F.element_at("held", F.col("field"))))
    other = ids.select(F.col("ident").alias("value"), F.col("e").alias("to"))
    rows = cut(moved.join(ids, "ident").join(other, "value", "left").select(
        F.monotonically_increasing_id().alias("idx"), "e", F.concat(F.lit("fs/"), F.col("field")).alias("a"), F.when(by, F.col("to")).otherwise(F.col("value")).alias("v"), F.lit("assert").alias("op")))
    if rows.isEmpty():
        return None
    plan = ingest.plan_write(rows, store.state(), store.log(), store.attrs, _next(store))
    _refuse(plan.errors)
    return log.commit(spark, path, plan, actor, at, store.number)


def install(spark: SparkSession, path: str, specs: DataFrame, actor: int, at: datetime) -> list[int]:
    """Install a package: its attributes evolved where they may be, then registered; the transactions, none if it is installed."""
    specs = cut(specs)
    actions = cut(vocabulary.install_diff(specs, FactLog.open(spark, path).attrs))
    _refuse(actions.where("action = 'conflict'"))
    wanted = specs.join(actions.where("action = 'evolve'"), "ident")
    requests = wanted.select("ident", F.inline(F.array(F.struct(F.lit("cardinality").alias("field"), F.col("cardinality").alias("value")),
                                                       F.struct(F.lit("unique").alias("field"), F.coalesce("unique", F.lit("none")).alias("value")))))
    known = FactLog.open(spark, path).attrs.select("ident", F.col("cardinality").alias("_c"), F.col("uniq").alias("_u"))
    moved = requests.join(known, "ident").where(F.col("value") != F.when(F.col("field") == "cardinality", F.col("_c")).otherwise(F.col("_u"))).select("ident", "field", "value")
    done = [evolve(spark, path, moved, actor, at)] if not moved.isEmpty() else []
    fresh = specs.join(actions.where("action = 'new'").select("ident"), "ident", "left_semi")
    done.append(register(spark, path, fresh, actor, at) if not fresh.isEmpty() else None)
    return [tx for tx in done if tx is not None]
