"""Change feeds and incrementally kept state: current values, keyed fold, signatures.

Kept tables hold what a store's feed told them. An excision reaches them through its own facts,
which name the entity and the attributes: what was recorded of these before it is no longer read,
and is gone from the files once their pieces are written anew. Between an excision and the next
batch of the feed, readers given the store take its excisions from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.model import FACT_SCHEMA, KERNEL, VALUES, Attribute
from factloom.operators import fold
from factloom.streaming import feed

_ENTITY, _ATTRIBUTE = KERNEL["fs/excised_entity"], KERNEL["fs/excised_attribute"]


def changes(spark: SparkSession, path: str, attributes: list[Attribute] | None = None, *, entries_per_trigger: int | None = None) -> DataFrame:
    """A stream of the facts committed to a store, of all or some attributes; see `feed`."""
    reader = feed.registered(spark).readStream.format(feed.NAME)
    if attributes is not None:
        reader = reader.option("attributes", ",".join(str(a.id) for a in attributes))
    if entries_per_trigger is not None:
        reader = reader.option("entriesPerTrigger", str(entries_per_trigger))
    return reader.load(path)


def tombstones(facts: DataFrame) -> DataFrame:
    """(e, a, before): what excisions among `facts` (e, a, v_ref, …) erased, and the transaction it was recorded before; a is NULL for all attributes."""
    told = facts.where(F.col("a").isin(_ENTITY, _ATTRIBUTE)).groupBy(F.col("e").alias("before")).agg(
        F.max(F.when(F.col("a") == _ENTITY, F.col("v_ref"))).alias("e"), F.collect_set(F.when(F.col("a") == _ATTRIBUTE, F.col("v_ref"))).alias("of"))
    return told.where(F.col("e").isNotNull()).select("e", F.explode_outer("of").alias("a"), "before").groupBy("e", "a").agg(F.max("before").alias("before"))


def unerased(words: DataFrame, gone: DataFrame) -> DataFrame:
    """`words` (e, a, …, k) without what `gone` (e, a, before) erased."""
    tx = F.shiftright(F.col("w.k"), 1)
    whole, some = gone.where("a is null"), gone.where("a is not null")
    left = words.alias("w").join(whole.alias("g"), (F.col("w.e") == F.col("g.e")) & (tx < F.col("g.before")), "left_anti")
    return left.alias("w").join(some.alias("g"), (F.col("w.e") == F.col("g.e")) & (F.col("w.a") == F.col("g.a")) & (tx < F.col("g.before")), "left_anti")


def _erased(spark: SparkSession, words: DataFrame, store: str | None) -> DataFrame:
    """The tombstones among kept words, and those of the store they were fed from."""
    gone = tombstones(words)
    if store is not None:
        from factloom.sources import log

        facts = log.scan(spark, store)
        gone = gone.unionByName(tombstones(facts.where(F.col("op")))).groupBy("e", "a").agg(F.max("before").alias("before"))
    return gone


def latest(facts: DataFrame) -> DataFrame:
    """(e, a, value, k): the last word on each value, as a streaming aggregate.

    A maximum does not mind late or repeated facts; a value holds while k is odd. Run in update
    mode: each trigger emits the values it changed.
    """
    return facts.groupBy("e", "a", *VALUES).agg(F.max(fold.latest_key()).alias("k"))


def delta_path(target: str, batch: int) -> str:
    return f"{target}/delta/batch={batch}"


def _read(spark: SparkSession, target: str, name: str, schema) -> DataFrame:
    """Complete pieces of a kept table; a piece without its marker was never finished."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    if fs.exists(root):
        done = [s.getPath().toString() for s in fs.listStatus(root)
                if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


_LATEST = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in FACT_SCHEMA.fields if f.name not in ("tx", "op")]) + ", k bigint"


def keep_state(facts: DataFrame, target: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Keep current state under `target` as facts arrive.

    Each micro-batch is folded to its last word per value and written as its own piece, named by
    the batch id: a replayed batch overwrites its piece, so the state is exact after any restart,
    and the cost of a batch goes with the batch and not with the state. `current` folds the
    pieces; `merge` makes one of them.
    """
    def write(batch: DataFrame, number: int) -> None:
        latest(batch).sortWithinPartitions("a", "e").write.mode("overwrite").parquet(delta_path(target, number))
    return (facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current(spark: SparkSession, target: str, store: str | None = None) -> DataFrame:
    """(e, a, value, tx) that hold, from the kept pieces, without what was excised.

    With `store`, the path of the store that was followed, its excisions count although the feed
    has not brought them yet.
    """
    words = _read(spark, target, "delta", _LATEST)
    last = unerased(words, _erased(spark, words, store)).groupBy("e", "a", *VALUES).agg(F.max("k").alias("k"))
    return last.where(F.col("k") % 2 == 1).select("e", "a", *VALUES, F.shiftright("k", 1).alias("tx"))


def merge(spark: SparkSession, target: str, merged: str, store: str | None = None) -> None:
    """The kept pieces as one piece of a new target, values that no longer hold included so a late fact still counts; excised ones are not written."""
    words = _read(spark, target, "delta", _LATEST)
    unerased(words, _erased(spark, words, store)).groupBy("e", "a", *VALUES).agg(F.max("k").alias("k")).repartitionByRange("a", "e").sortWithinPartitions(
        "a", "e").write.parquet(delta_path(merged, 0))


_COUNTS = "sig array<bigint>, n bigint"
#: Parts of the entities by hash; a batch reads and writes those of its entities only.
BUCKETS = 64


def _batches(spark: SparkSession, target: str, name: str) -> dict[int, str]:
    """The finished batches of a kept table with their folders."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(f"{target}/{name}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    found = [s.getPath() for s in fs.listStatus(root)]
    return {int(p.getName().split("=")[1]): p.toString() for p in found if fs.exists(hadoop(p, "_SUCCESS"))}


def _bucket_folders(spark: SparkSession, folder: str) -> dict[int, str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    path = hadoop(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {int(s.getPath().getName().split("=")[1]): s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket=")}


def _live(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """The newest piece of each bucket, of batches before `before`."""
    live: dict[int, str] = {}
    for number, folder in sorted(_batches(spark, target, "words").items()):
        if before is None or number < before:
            live |= _bucket_folders(spark, folder)
    return live


def _words(spark: SparkSession, pieces: list[str]) -> DataFrame:
    return spark.read.schema(_LATEST).parquet(*pieces) if pieces else spark.createDataFrame([], _LATEST)


def _counted(words: DataFrame, sign: int) -> DataFrame:
    """(sig, n) of the entities that `words` describe, with a sign."""
    from factloom.operators.profile import entity_signatures

    return entity_signatures(words.where(F.col("k") % 2 == 1)).groupBy("sig").agg((F.count("*") * sign).alias("n"))


def keep_signatures(facts: DataFrame, target: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Keep signature counts as facts arrive: a batch costs the buckets of the entities it touches.

    The last words on each value lie in `BUCKETS` buckets of entities. A batch reads the newest
    piece of each bucket that it touches, folds its words in and writes the bucket anew; each
    touched entity's set before and after moves the counts, which every batch writes whole. So the
    cost of a batch does not grow with the batches before it. Entities that the batch says were
    excised lose what was recorded before, in the counts and in the files. A batch replayed
    starts from the pieces before it and overwrites its own; older pieces are deleted.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("e"), F.lit(BUCKETS)).cast("int")
        words = latest(batch).persist()
        gone = tombstones(words).persist()
        named = words.select("e").unionByName(gone.select("e")).distinct()
        # no more than there are buckets
        touched = {r[0] for r in named.select(bucket).distinct().collect()}
        pieces = _live(spark, target, number)
        known = _words(spark, [f for b, f in pieces.items() if b in touched])
        merged = unerased(known.unionByName(words.select(*known.columns)), gone).groupBy("e", "a", *VALUES).agg(F.max("k").alias("k"))
        merged.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "e").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/words/batch={number}")
        # a bucket of which nothing is left has an empty piece, which takes the place of the one before
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for b in touched:
            piece = hadoop(f"{target}/words/batch={number}/bucket={b}")
            piece.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(piece)
        after = _words(spark, list(_bucket_folders(spark, f"{target}/words/batch={number}").values()))
        moved = _counted(known.join(named, "e", "left_semi"), -1).unionByName(_counted(after.join(named, "e", "left_semi"), 1))
        counts = [f for n, f in sorted(_batches(spark, target, "signature").items()) if n < number][-1:]
        held = spark.read.schema(_COUNTS).parquet(*counts) if counts else spark.createDataFrame([], _COUNTS)
        held.unionByName(moved).groupBy("sig").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{target}/signature/batch={number}")
        _tidy(spark, target, number, touched)
        words.unpersist()
        gone.unpersist()
    return (facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _tidy(spark: SparkSession, target: str, number: int, touched: set[int]) -> None:
    """Deletes pieces that neither a reader nor a replay of the batch `number` needs."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    keep = set(_live(spark, target).values()) | set(_live(spark, target, number).values())
    for folder in _batches(spark, target, "words").values():
        pieces = _bucket_folders(spark, folder)
        fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for f in pieces.values():
            if f not in keep:
                fs.delete(hadoop(f), True)
        if not keep & set(pieces.values()):
            fs.delete(hadoop(folder), True)
    for n, folder in sorted(_batches(spark, target, "signature").items()):
        if n < number - 1:
            hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(folder), True)


def signature_counts(spark: SparkSession, target: str, store: str | None = None) -> DataFrame:
    """(sid, sig, entities) as of the last batch.

    With `store`, the path of the store that was followed, entities that it excised since are
    counted by what is left of them.
    """
    from factloom.operators.profile import signature_id

    counts = [f for _, f in sorted(_batches(spark, target, "signature").items())][-1:]
    held = spark.read.schema(_COUNTS).parquet(*counts) if counts else spark.createDataFrame([], _COUNTS)
    if store is not None:
        words = _words(spark, list(_live(spark, target).values()))
        gone = _erased(spark, words, store)
        asked = words.join(gone.select("e").distinct(), "e", "left_semi")
        held = held.unionByName(_counted(asked, -1)).unionByName(_counted(unerased(asked, gone), 1))
    return held.groupBy("sig").agg(F.sum("n").alias("entities")).where("entities > 0").select(signature_id(F.col("sig")).alias("sid"), "sig", "entities")
