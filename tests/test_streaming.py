import random
from datetime import datetime

import naive
from pyspark.sql import functions as F

from factloom.model import Attribute
from factloom.operators import fold, profile
from factloom.sources import log as disk
from factloom.streaming import jobs


def batches(seed=4):
    r = random.Random(seed)
    feed = naive.canonical_one([(r.randrange(1, 9), r.choice([1001, 1002]), r.choice("ab"), tx, r.random() < 0.7) for tx in range(200)])
    return [[f for f in feed if lo <= f[3] < lo + 50] for lo in range(0, 200, 50)], feed


def test_kept_state_equals_the_fold_after_every_append_and_replay(spark, tmp_path):
    parts, feed = batches()
    path, target, ck = (str(tmp_path / x) for x in ("store", "kept", "ck"))
    done = []
    for i, part in enumerate(parts):
        disk.append_facts(naive.facts(spark, part), path, i)
        done += part
        q = jobs.keep_state(jobs.changes(spark, path), target, ck)
        q.awaitTermination()
        want = sorted((*k, t) for k, t in naive.fold(done).items())
        assert naive.rows(jobs.current(spark, target), with_op=False) == want
    # a batch written again, as after a crash, changes nothing
    last = jobs.latest(naive.facts(spark, parts[-1]))
    last.write.mode("overwrite").parquet(jobs.delta_path(target, len(parts) - 1))
    assert naive.rows(jobs.current(spark, target), with_op=False) == want
    jobs.merge(spark, target, str(tmp_path / "merged"))
    assert naive.rows(jobs.current(spark, str(tmp_path / "merged")), with_op=False) == want


def test_kept_signatures_equal_a_recount(spark, tmp_path):
    parts, feed = batches(5)
    path, target, ck = (str(tmp_path / x) for x in ("store", "sig", "ck"))
    for i, part in enumerate(parts):
        disk.append_facts(naive.facts(spark, part), path, i)
        jobs.keep_signatures(jobs.changes(spark, path), target, ck).awaitTermination()
    want = profile.signature_counts(profile.entity_signatures(fold.state(naive.facts(spark, feed))))
    got = {tuple(r.sig): r.entities for r in jobs.signature_counts(spark, target).collect()}
    assert got == {tuple(r.sig): r.entities for r in want.collect()}


def test_change_feed_and_keyed_fold(spark, tmp_path):
    parts, feed = batches(6)
    path = str(tmp_path / "store")
    for i, part in enumerate(parts):
        disk.append_facts(naive.facts(spark, part), path, i)
    a = Attribute(1001, "prop/one", "string")
    q = jobs.changes(spark, path, [a]).writeStream.format("memory").queryName("feed_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("feed_rows").count() == sum(1 for f in feed if f[1] == 1001)
    q = jobs.latest(jobs.changes(spark, path, entries_per_trigger=1)).writeStream.format("memory").queryName("words").outputMode("update").start()
    q.processAllAvailable()
    assert len([p for p in q.recentProgress if p.numInputRows]) == len(parts)
    q.stop()
    last = spark.table("words").groupBy("e", "a", "v_string").agg(F.max("k").alias("k")).where("k % 2 = 1")
    assert sorted((r.e, r.a, r.v_string, r.k // 2) for r in last.collect()) == sorted((*k, t) for k, t in naive.fold(feed).items())


def excised(spark, path, rows, tx):
    disk.excise(spark, path, spark.createDataFrame(rows, "e long, a long"), tx, datetime(2024, 1, 1), 100)


def test_what_was_excised_leaves_kept_tables(spark, tmp_path):
    parts, feed = batches(7)
    path, state, sig = (str(tmp_path / x) for x in ("store", "kept", "sig"))

    def follow():
        for keep, target in ((jobs.keep_state, state), (jobs.keep_signatures, sig)):
            keep(jobs.changes(spark, path), target, f"{target}-ck").awaitTermination()

    def agree(store):
        want = fold.state(disk.scan(spark, path))
        assert naive.rows(jobs.current(spark, state, store), with_op=False) == naive.rows(want, with_op=False)
        got = {tuple(r.sig): (r.sid, r.entities) for r in jobs.signature_counts(spark, sig, store).collect()}
        assert got == {tuple(r.sig): (r.sid, r.entities) for r in profile.signature_counts(profile.entity_signatures(want)).collect()}
    for i, part in enumerate(parts[:3]):
        disk.append_facts(naive.facts(spark, part), path, i)
    follow()
    excised(spark, path, [(feed[0][0], None), (feed[1][0] if feed[1][0] != feed[0][0] else feed[0][0] % 8 + 1, 1001)], 500)
    # the excisions themselves are facts of the store, which the feed has not brought yet
    held = {r.e for r in jobs.current(spark, state, path).collect()}
    assert feed[0][0] not in held
    counted = sum(r.entities for r in jobs.signature_counts(spark, sig, path).collect())
    assert counted == len(held)
    follow()
    agree(path)
    agree(None)
    # what is told of an erased entity later is kept again
    disk.append_facts(naive.facts(spark, [(feed[0][0], 1001, "z", 600, True)]), path, 600)
    follow()
    agree(None)
    # nor do the files hold what was erased, once a later batch has come for that bucket
    words = spark.read.parquet(*(str(p) for p in (tmp_path / "sig" / "words").rglob("*.parquet")))
    assert words.where(f"e = {feed[0][0]} and k < 1200").count() == 0
    jobs.merge(spark, state, str(tmp_path / "merged"))
    assert spark.read.parquet(jobs.delta_path(str(tmp_path / "merged"), 0)).where(f"e = {feed[0][0]} and k < 1200").count() == 0


def test_feed_sees_committed_batches_once(spark, tmp_path):
    parts, feed = batches(8)
    path, ck = str(tmp_path / "store"), str(tmp_path / "ck")

    def read(name, checkpoint):
        out = str(tmp_path / name)
        jobs.changes(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return naive.rows(spark.read.parquet(out))
    disk.append_facts(naive.facts(spark, parts[0]), path, 0)
    assert read("out", ck) == naive.rows(naive.facts(spark, parts[0]))
    disk.append_facts(naive.facts(spark, parts[1]), path, 50)
    # a job that broke off: its folder has no entry
    disk._write_facts(naive.facts(spark, parts[3]), disk._folder(path, "fact", 60))
    disk.compact(spark, path)
    disk.append_facts(naive.facts(spark, parts[2]), path, 100)
    want = naive.rows(naive.facts(spark, [f for p in parts[:3] for f in p]))
    assert read("out", ck) == want
    assert read("out2", f"{ck}2") == want and naive.rows(disk.scan(spark, path)) == want
    excised(spark, path, [(feed[0][0], None)], 700)
    told = naive.rows(disk.scan(spark, path).where("tx >= 700"))
    assert sorted(read("out", ck), key=repr) == sorted([*want, *told], key=repr)
    assert sorted(read("out3", f"{ck}3"), key=repr) == sorted(naive.rows(disk.scan(spark, path)), key=repr)
