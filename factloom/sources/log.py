"""The fact log on disk: parquet partitioned by attribute, appended one batch at a time.

Layout under the store's path::

    fact/part=<id>/batch=<first tx>/a=<attribute>/*.parquet   facts, sorted by (e, tx) inside a file
    attr/part=<id>/batch=<n>/  tx/part=<id>/batch=<first tx>/   registry and transactions
    cur/part=<id>/batch=<last tx>/a=<attribute>/              snapshots of current state
    manifest/<number>.json                                  what each commit added and took away

A folder is written whole by one job, under an id of its own, and becomes part of the store by the
manifest entry that names it. An entry's file is created only where there is none, so of two
commits on the same state of the store one is refused; a job that broke off leaves a folder that no
entry names and no reader sees. Compaction and excision put folders in the places of others by one
entry, so a reader has all of the old ones or all of the new.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime
from typing import TYPE_CHECKING

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.model import ATTR_SCHEMA, FACT_SCHEMA, TX_SCHEMA, VALUES, Attribute
from factloom.operators import fold
from factloom.session import cut

if TYPE_CHECKING:
    from factloom.operators.ingest import Written

_BATCH = T.StructField("batch", T.LongType())
_PART = T.StructField("part", T.StringType())
TABLES = ("fact", "attr", "tx", "cur")
#: `news` are folders of facts that were not in the store before, `added` all folders that come, `removed` those that go.
ENTRY = "n long, kind string, added array<string>, removed array<string>, news array<string>, tx long, at long, high long"


class Conflict(RuntimeError):
    """The store was changed since the state that a commit was made for."""


@dataclass(frozen=True)
class Version:
    """The folders of a store at one moment: every read of one version sees the same facts.

    `number` is that of its manifest entry, `last` its last transaction, `at` that one's instant in
    microseconds, and `high` the greatest id of an entity, transactions included.
    """

    fact: tuple[str, ...] = ()
    attr: tuple[str, ...] = ()
    tx: tuple[str, ...] = ()
    cur: tuple[str, ...] = ()
    number: int = 0
    last: int = 0
    at: int | None = None
    high: int = 0


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def entries(spark: SparkSession, path: str) -> list[T.Row]:
    """The manifest in order: a row for each commit."""
    fs, where = _file_system(spark, f"{path}/manifest")
    if not fs.exists(where):
        return []
    return sorted(spark.read.schema(ENTRY).json(f"{path}/manifest").collect(), key=lambda r: r["n"])


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The store as it is now, or as it was after the manifest entry `number`."""
    live: dict[str, None] = {}
    last, at, high, n = 0, None, 0, 0
    for r in entries(spark, path):
        if number is not None and r["n"] > number:
            break
        for folder in r["removed"]:
            live.pop(folder, None)
        live.update(dict.fromkeys(r["added"]))
        n, last, high = r["n"], max(last, r["tx"] or 0), max(high, r["high"] or 0)
        at = r["at"] if at is None or (r["at"] or at) > at else at
    of = {t: tuple(f"{path}/{f}" for f in live if f.startswith(f"{t}/")) for t in TABLES}
    return Version(**of, number=n, last=last, at=at, high=max(high, last))


def publish(spark: SparkSession, path: str, kind: str, added: list[str], removed: list[str] | None = None, news: list[str] | None = None, *,
            base: int | None = None, tx: int | None = None, at: int | None = None, high: int | None = None) -> int:
    """Makes folders part of the store, all or none; the number of the entry.

    With `base`, only while that is the last entry; otherwise after whatever comes first.
    """
    relative = {k: [f.removeprefix(f"{path}/") for f in fs or []] for k, fs in (("added", added), ("removed", removed), ("news", news))}
    while True:
        fs, where = _file_system(spark, f"{path}/manifest")
        found = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")] if fs.exists(where) else []
        n = max(found, default=0)
        if base is not None and base != n:
            raise Conflict(f"the store is at entry {n} of its manifest, and the commit was made for {base}")
        body = json.dumps({"n": n + 1, "kind": kind, **relative, "tx": tx, "at": at, "high": high})
        final, draft = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{name}") for name in (f"{n + 1:020d}.json", f".{uuid.uuid4().hex}"))
        try:
            # an entry is whole when it can be seen: Spark's own atomic write of metadata, which fails where there is a file
            out = fs.create(draft, False)
            out.write(bytearray(body, "utf-8"))
            out.close()
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(draft, final, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return n + 1
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            if base is not None:
                raise Conflict(f"another commit took entry {n + 1}") from e


def _folder(path: str, table: str, batch: int) -> str:
    return f"{path}/{table}/part={uuid.uuid4().hex}/batch={batch}"


def _number(folder: str) -> int:
    return int(folder.rsplit("=", 1)[1])


def _read(spark: SparkSession, folder: str, schema: T.StructType, done: tuple[str, ...]) -> DataFrame:
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*done).select(*schema.fieldNames())


def scan(spark: SparkSession, path: str, *, attributes: list[Attribute] | None = None,
         as_of: int | None = None, at: Version | None = None) -> DataFrame:
    """Facts, of the given attributes only (pruned to their partitions) and up to a transaction."""
    facts = _read(spark, f"{path}/fact", FACT_SCHEMA, (at or version(spark, path)).fact)
    if attributes is not None:
        facts = facts.where(F.col("a").isin([x.id for x in attributes]))
    return facts if as_of is None else facts.where(F.col("tx") <= as_of)


def attributes(spark: SparkSession, path: str, at: Version | None = None) -> DataFrame:
    """The registry: the newest row of each attribute."""
    rows = _read(spark, f"{path}/attr", T.StructType([*ATTR_SCHEMA.fields, _BATCH]), (at or version(spark, path)).attr)
    names = ATTR_SCHEMA.fieldNames()
    return rows.groupBy("id").agg(F.max_by(F.struct(*names[1:]), "batch").alias("r")).select("id", "r.*")


def transactions(spark: SparkSession, path: str, at: Version | None = None) -> DataFrame:
    return _read(spark, f"{path}/tx", TX_SCHEMA, (at or version(spark, path)).tx)


def _write_facts(facts: DataFrame, folder: str, files: int | None = None) -> tuple[int, int]:
    """Facts as one folder; the greatest entity and transaction of them.

    Range-partitioned and sorted by (attribute, entity, transaction): ranges are balanced by rows,
    so a common attribute, or one hot entity of it, spreads over many tasks and files, rare
    attributes share one, and each file covers a narrow range of entities, which its statistics let
    a read skip.
    """
    order = ["a", "e", "tx"]
    ranged = facts.repartitionByRange(*order) if files is None else facts.repartitionByRange(files, *order)
    seen = Observation()
    ranged.sortWithinPartitions(*order).observe(seen, F.max("e").alias("e"), F.max("tx").alias("tx")).write.partitionBy("a").parquet(folder)
    return seen.get["e"] or 0, seen.get["tx"] or 0


def _replaced(spark: SparkSession, path: str, table: str, batch: int) -> list[str]:
    """The folders of a batch that is written again."""
    return [f for f in getattr(version(spark, path), table) if _number(f) == batch]


def append_facts(facts: DataFrame, path: str, batch: int, files: int | None = None) -> None:
    """Append one batch; a batch of the same number is replaced."""
    spark, folder = facts.sparkSession, _folder(path, "fact", batch)
    high, tx = _write_facts(facts, folder, files)
    publish(spark, path, "facts", [folder], _replaced(spark, path, "fact", batch), [folder], high=max(high, tx))


def append_attributes(attrs: DataFrame, path: str, batch: int) -> None:
    spark, folder = attrs.sparkSession, _folder(path, "attr", batch)
    attrs.coalesce(1).write.parquet(folder)
    publish(spark, path, "registry", [folder], _replaced(spark, path, "attr", batch))


def _write_transactions(tx: DataFrame, folder: str) -> tuple[int, int | None]:
    """Transactions as one folder; the last one and the last instant."""
    seen = Observation()
    tx.observe(seen, F.max("id").alias("id"), F.max(F.unix_micros("at")).alias("at")).write.parquet(folder)
    return seen.get["id"] or 0, seen.get["at"]


def append_transactions(tx: DataFrame, path: str, batch: int) -> None:
    spark, folder = tx.sparkSession, _folder(path, "tx", batch)
    last, at = _write_transactions(tx, folder)
    publish(spark, path, "transactions", [folder], _replaced(spark, path, "tx", batch), tx=last, at=at)


def append(path: str, batch: int, kind: str, *, facts: DataFrame, transactions: DataFrame, registry: DataFrame | None = None, base: int | None = None) -> None:
    """Facts with their transactions and registry rows as one batch, part of the store by one entry; see `publish` for `base`."""
    spark, added = facts.sparkSession, [_folder(path, t, batch) for t in ("fact", "tx")]
    high, _ = _write_facts(facts, added[0])
    last, at = _write_transactions(transactions, added[1])
    if registry is not None:
        added.append(_folder(path, "attr", batch))
        registry.select(*ATTR_SCHEMA.fieldNames()).coalesce(1).write.parquet(added[2])
    publish(spark, path, kind, added, news=added[:1], base=base, tx=last, at=at, high=max(high, last))


def _write_snapshot(state: DataFrame, folder: str) -> None:
    state.repartitionByRange("a", "e", "tx").sortWithinPartitions("a", "e").write.partitionBy("a").parquet(folder)


def _write_folded(facts: DataFrame, folder: str) -> None:
    """The state of facts as one folder, in one shuffle.

    Facts are dealt by ranges of what they are folded by, so ranges are sampled from what is read and
    not from the fold, the state is written where it is folded, and a hot entity still spreads.
    """
    dealt = facts.repartitionByRange("a", "e", *VALUES)
    fold.state(dealt).sortWithinPartitions("a", "e").write.partitionBy("a").parquet(folder)


def take_snapshot(spark: SparkSession, path: str, at: Version | None = None) -> None:
    """Snapshot of the current state of the store, at the last transaction of its manifest."""
    at = at or version(spark, path)
    folder = _folder(path, "cur", at.last)
    _write_folded(scan(spark, path, at=at), folder)
    publish(spark, path, "snapshot", [folder], _replaced(spark, path, "cur", at.last))


def write_state(state: DataFrame, path: str, tx: int) -> None:
    """Snapshot of current state at a transaction, the last of a batch."""
    spark, folder = state.sparkSession, _folder(path, "cur", tx)
    _write_snapshot(state, folder)
    publish(spark, path, "snapshot", [folder], _replaced(spark, path, "cur", tx))


def snapshot(spark: SparkSession, path: str, at: Version | None = None):
    """A reader of the newest snapshot and the batches after it; None where there is none.

    A value of the snapshot is an assert at its transaction, so one fold over the union is exact
    and costs the current state and the news, not the history.
    """
    at = at or version(spark, path)
    if not at.cur:
        return None
    newest = max(at.cur, key=_number)
    schema = T.StructType([f for f in FACT_SCHEMA.fields if f.name != "op"])
    news = tuple(p for p in at.fact if _number(p) > _number(newest))

    def read(wanted: list[Attribute] | None) -> tuple[DataFrame, bool]:
        rows = spark.read.schema(schema).option("basePath", newest).parquet(newest).select(*schema.fieldNames()).withColumn("op", F.lit(True))
        if news:
            rows = rows.unionByName(_read(spark, f"{path}/fact", FACT_SCHEMA, news))
        if wanted is not None:
            rows = rows.where(F.col("a").isin([x.id for x in wanted]))
        return rows, not news
    return read


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Current state from the newest snapshot and the batches after it."""
    rows, final = snapshot(spark, path)(None)
    return rows.drop("op") if final else fold.state(rows)


def compact(spark: SparkSession, path: str, target: str | None = None, files: int | None = None) -> None:
    """Rewrite the log as one batch with files sorted by (e, tx), and its state as a snapshot.

    With `target`, as a store of its own, for export; else in place, by one entry: a reader has the
    old folders or the new one, and what was committed meanwhile stays. If another compaction or an
    excision took a folder away meanwhile, Conflict is raised and nothing is changed. The old
    folders stay for readers of earlier versions until `vacuum`.
    """
    before, where = version(spark, path), target or path
    batch = max(map(_number, before.fact), default=0)
    added = [_folder(where, t, batch) for t in TABLES]
    high, tx = _write_facts(scan(spark, path, at=before), added[0], files)
    attributes(spark, path, before).coalesce(1).write.parquet(added[1])
    last, at = _write_transactions(transactions(spark, path, before), added[2])
    _write_folded(_read(spark, f"{where}/fact", FACT_SCHEMA, (added[0],)), added[3])
    if target is not None:
        publish(spark, target, "compact", added, tx=last, at=at, high=max(high, tx, before.high))
        return
    removed = [*before.fact, *before.attr, *before.tx, *before.cur]
    while True:
        now = version(spark, path)
        if not set(removed) <= {*now.fact, *now.attr, *now.tx, *now.cur}:
            raise Conflict("the store's folders were replaced during the compaction")
        try:
            publish(spark, path, "compact", added, removed, base=now.number, tx=last, at=at, high=max(high, tx))
            return
        except Conflict:
            continue


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that entries took out of the store; how many there were. Earlier versions cannot be read any more."""
    now = version(spark, path)
    live, gone = {*now.fact, *now.attr, *now.tx, *now.cur}, 0
    for folder in {f"{path}/{f}" for r in entries(spark, path) for f in r["removed"]} - live:
        fs, where = _file_system(spark, folder)
        gone += bool(fs.delete(where.getParent(), True))
    return gone


def commit(spark: SparkSession, path: str, write: Written, actor: int, at: datetime, base: int | None = None) -> int | None:
    """Append a planned write as one transaction; its number, or None where nothing changes.

    Refuses a write with errors. The transaction follows the last one, at a later instant; its
    number is past every entity and transaction, which the manifest knows. `base` is the number of
    the version that the write was planned on: if anything was committed since, or is while this
    one writes, Conflict is raised, nothing is committed and the write has to be planned again.
    Facts, transaction and, where the write changes attributes, their registry rows become part of
    the store by one entry.
    """
    from factloom.operators.ingest import OWN_TX, next_instant, stamp

    before = version(spark, path)
    if base is not None and base != before.number:
        raise Conflict(f"the store is at entry {before.number} of its manifest, and the write was planned on {base}")
    problems = write.errors.limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{p.code}: {p.message}" for p in problems))
    # facts about the transaction alone write nothing
    if not write.changes.where(F.col("e") != OWN_TX).take(1):
        return None
    tx = max(before.high, write.changes.agg(F.max("e")).first()[0] or 0) + 1
    when = F.lit(at) if before.at is None else next_instant(F.timestamp_micros(F.lit(before.at)), F.lit(at))
    stamps = spark.range(1).select(F.lit(tx).cast("long").alias("id"), F.lit(actor).cast("long").alias("actor"), when.alias("at"))
    append(path, tx, "commit", facts=stamp(write.changes, tx, actor, when), transactions=stamps, registry=write.registry, base=before.number)
    return tx


def excise(spark: SparkSession, path: str, erased: DataFrame, tx: int, at: datetime, actor: int) -> int:
    """Erase the facts of `erased` (e, and a or NULL for all attributes) in place; the number of excisions.

    Batches that hold such facts are written anew without them, and so is the newest snapshot; one
    entry puts all of these in the places of the old folders, which are then deleted. Each entity's
    excision is a transaction of its own, numbered from `tx`, that names the entity and the
    attributes, never values; kept tables read these facts as tombstones. Transactions, attributes
    and entities without facts are refused. A call that broke off before its entry has changed
    nothing; `settle` deletes what one that broke off after it has left.
    """
    from factloom.operators.ingest import excision_facts, excisions, missing_entities, without

    settle(spark, path)
    # what is erased may be read from the very files that go
    erased = cut(erased)
    before = version(spark, path)
    facts = scan(spark, path, at=before)
    protected = transactions(spark, path, before).select(F.col("id").alias("e")).unionByName(
        attributes(spark, path, before).select(F.col("id").alias("e")))
    if erased.join(protected, "e", "left_semi").take(1):
        raise ValueError("transactions and attributes cannot be excised")
    if missing_entities(erased, facts).take(1):
        raise ValueError("there is nothing to excise of an entity without facts")
    wanted = cut(excisions(erased, tx))
    stamps = wanted.select(F.col("tx").alias("id"), F.lit(actor).cast("long").alias("actor"),
                           F.timestamp_micros(F.unix_micros(F.lit(at)) + F.col("tx") - tx).alias("at")).distinct()
    dealt = _read(spark, f"{path}/fact", T.StructType([*FACT_SCHEMA.fields, _PART, _BATCH]), before.fact)
    whole = erased.where("a is null").select("e").distinct()
    some = erased.where("a is not null").select("e", "a").distinct()
    hit = dealt.join(whole, "e", "left_semi").select("part").unionByName(dealt.join(some, ["e", "a"], "left_semi").select("part")).distinct()
    # one row for each folder of the log at most
    parts = {r["part"] for r in hit.collect()}
    removed = [f for f in before.fact if f.split("/part=")[1].split("/")[0] in parts]
    added, high = [], 0
    for old in removed:
        added.append(_folder(path, "fact", _number(old)))
        _write_facts(without(_read(spark, f"{path}/fact", FACT_SCHEMA, (old,)), erased), added[-1])
    told = _folder(path, "fact", tx)
    high, last = _write_facts(excision_facts(wanted, stamps), told)
    added += [told, _folder(path, "tx", tx)]
    _, when = _write_transactions(stamps, added[-1])
    if before.cur:
        left = [*(f for f in before.fact if f not in removed), *added[:-1]]
        added.append(_folder(path, "cur", last))
        _write_folded(_read(spark, f"{path}/fact", FACT_SCHEMA, tuple(left)), added[-1])
    publish(spark, path, "excise", added, [*removed, *before.cur], [told], base=before.number, tx=last, at=when, high=max(high, last))
    settle(spark, path)
    return stamps.count()


def settle(spark: SparkSession, path: str) -> None:
    """Deletes what excisions took out of the store and is still there, with the folders that held it in earlier versions."""
    found = entries(spark, path)
    last = max((r["n"] for r in found if r["kind"] == "excise"), default=0)
    now = version(spark, path)
    live = {*now.fact, *now.attr, *now.tx, *now.cur}
    for folder in {f"{path}/{f}" for r in found if r["n"] <= last for f in r["removed"] if f.startswith(("fact/", "cur/"))} - live:
        fs, where = _file_system(spark, folder)
        if fs.exists(where):
            fs.delete(where.getParent(), True)

