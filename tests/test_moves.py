"""What is moved or computed once."""

import re

from pyspark.sql import functions as F

from factloom.model import FACT_SCHEMA, SPARK_TYPE, kernel_attributes, registry
from factloom.operators import fold, score, wholes
from factloom.plans import graphs, world
from factloom.sources import log

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_wholes_move_once(spark):
    side = spark.createDataFrame([(1, 11, "a"), (1, 11, "a"), (1, 12, "b"), (1, 13, "b"), (1, 12, None)], "whole long, part long, key string")
    other = spark.createDataFrame([(2, 21, "a"), (2, 22, "b")], "whole long, part long, key string")
    out = wholes.votes(side, other, spark.createDataFrame([(1, 2)], "left long, right long"))
    assert [tuple(r) for r in out.collect()] == [(11, 21, 1)]
    assert not re.search(r"hashpartitioning\(whole#\w+, part#", plan(out))


def test_keys_of_true_things_move_once(spark):
    truth = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 2)], "key string, thing long")
    out = score.splits_and_twins(truth, spark.createDataFrame([("a", 7), ("b", 8), ("b", 8)], "key string, e long"))
    assert tuple(out.first()) == (2, 1, 1, 2, 0, 0)
    assert not re.search(r"hashpartitioning\(key#\w+, thing#", plan(out))


def test_events_of_other_attributes_are_left_out_before(spark):
    view = world.BY_IDENT["user/view"].id
    one = world.event_log(spark, SMALL, ["user/view"])
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r in world.event_log(spark, SMALL).collect() if r.a == view)


def test_the_steps_of_a_walk_are_written_before_it(spark, monkeypatch):
    seen = []
    real = graphs.written
    monkeypatch.setattr(graphs, "written", lambda df: seen.append(df.columns) or real(df))
    assert graphs.fixpoint(spark, SMALL).count() == world.table(spark, SMALL, "orders").count()
    assert seen == [["src", "dst"]]


def test_a_snapshot_is_folded_where_it_is_written(spark, tmp_path, monkeypatch):
    path, many = str(tmp_path / "store"), 500
    rows = [(1, 7, f"v{i}", i % 3 + 1, True) for i in range(many)] + [(1, 7, f"v{i}", 5, False) for i in range(0, many, 2)]
    rows += [(1, 7, f"v{i}", 5, True) for i in range(0, many, 4)] + [(2, 7, "x", 9, False), (2, 7, "x", 8, True), (3, 8, "y", 1, True), (3, 8, "y", 4, True)]
    none = [F.lit(None).cast(t).alias(f"v_{n}") for n, t in SPARK_TYPE.items() if n != "string"]
    facts = spark.createDataFrame(rows, "e long, a long, v_string string, tx long, op boolean").select("*", *none).select(*FACT_SCHEMA.fieldNames())
    log.append_facts(facts, path, 1)
    log.append_attributes(registry(spark, kernel_attributes()), path, 1)
    log.append_transactions(spark.createDataFrame([(9, 1, None)], "id long, actor long, at timestamp"), path, 1)
    want = sorted(map(tuple, fold.state(facts).collect()), key=repr)
    assert len(want) == many - many // 4 + 1

    seen = []
    real = fold.state
    monkeypatch.setattr(fold, "state", lambda *a: seen.append(real(*a)) or seen[-1])
    log.take_snapshot(spark, path)
    log.compact(spark, path, f"{path}-small")
    monkeypatch.undo()
    assert len(seen) == 2 and all(re.findall(r"Exchange (\w+)", plan(df)) == ["rangepartitioning"] for df in seen)
    assert log.version(spark, path).cur[0].endswith("batch=9")
    for at in (path, f"{path}-small"):
        assert sorted(map(tuple, log.read_state(spark, at).select(*seen[0].columns).collect()), key=repr) == want
