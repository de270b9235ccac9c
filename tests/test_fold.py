import random
from datetime import datetime, timezone

import naive
import pytest
from pyspark.sql import functions as F

from factloom.model import TX_SCHEMA, Attribute, kernel_attributes, registry
from factloom.operators import fold
from factloom.operators.ordered import Running, numbered, previous, running
from factloom.store import BeforeFirstTransaction, FactLog, NoZone, UnknownTransaction, capped

NAME = Attribute(1001, "prop/one", "string")
MANY = Attribute(1002, "prop/many", "string", "many")


def random_log(seed, n=300):
    """A canonical log: one value per (e, 1001), any number per (e, 1002)."""
    r = random.Random(seed)
    feed = [(r.randrange(1, 6), 1001, r.choice("abcd"), tx, r.random() < 0.7) for tx in range(n)]
    many = [(r.randrange(1, 6), 1002, r.choice("abcd"), tx, r.random() < 0.6) for tx in range(n)]
    return naive.canonical_one(feed) + naive.canonical_many(many)


@pytest.mark.parametrize("seed", range(4))
def test_state_is_the_naive_fold_now_and_at_any_point(spark, seed):
    log = random_log(seed)
    df = naive.facts(spark, log).repartition(5)
    for at in (None, 0, 57, 150, 299):
        want = sorted((*k, t) for k, t in naive.fold(log, at).items())
        assert naive.rows(fold.state(df, at), with_op=False) == want
        rel = sorted(tuple(x) for x in fold.relation(df, MANY, at).collect())
        assert rel == sorted((e, v, t) for (e, a, v), t in naive.fold(log, at).items() if a == 1002)
        pulled = {x.e: x["prop/one"] for x in fold.wide(df, [NAME], at).collect()}
        assert pulled == {e: v for (e, a, v) in naive.fold(log, at) if a == 1001}
    with pytest.raises(ValueError):
        fold.wide(df, [NAME, MANY])


def test_partition_count_does_not_matter(spark):
    log = random_log(9)
    df = naive.facts(spark, log)
    got = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(naive.rows(fold.state(df.repartition(int(n))), with_op=False))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_equal_decimals_are_one_value(spark):
    df = naive.facts(spark, [(1, 1, "1.0", 1, True), (1, 1, "1.00", 2, False), (2, 1, "0.10", 1, True)], "decimal")
    assert [(r.e, str(r.v_decimal.normalize())) for r in fold.state(df).collect()] == [(2, "0.1")]


def test_history_timeline_first_and_slipped(spark):
    a = Attribute(1, "order/status", "string")
    df = naive.facts(spark, [(5, 1, "open", 1, True), (5, 1, "open", 2, False), (5, 1, "paid", 2, True)])
    hist = fold.history(df, a)
    assert sorted((r.v, r.tx, r.op) for r in hist.collect()) == [("open", 1, "assert"), ("open", 2, "retract"), ("paid", 2, "assert")]
    assert [(r.was, r.v) for r in fold.timeline(hist).orderBy("tx").collect()] == [(None, "open"), ("open", "paid")]
    assert [(r.v, r.tx) for r in fold.first_value(hist).collect()] == [("open", 1)]
    assert [(r.first, r.v) for r in fold.slipped(fold.relation(df, a), hist).collect()] == [("open", "paid")]


def test_business_time_takes_the_latest_issued_not_the_latest_written(spark):
    hist = spark.createDataFrame([(1, "may", 10, "assert"), (1, "june", 11, "assert"), (1, "april", 12, "assert"), (2, "x", 13, "assert")], "e long, v string, tx long, op string")
    evidence = spark.createDataFrame([(10, 100), (11, 101), (12, 99)], "tx long, document long")
    issued = spark.createDataFrame([(100, datetime(2024, 5, 1)), (101, datetime(2024, 6, 1)), (99, datetime(2024, 4, 1))], "document long, at timestamp")
    known = fold.known_by(hist, evidence, issued, datetime(2024, 5, 15))
    assert [(r.e, r.v) for r in known.collect()] == [(1, "may")]


@pytest.mark.parametrize("per_range", [10**9, 40, 7])
def test_running_values_do_not_depend_on_ranges(spark, per_range):
    r = random.Random(3)
    data = [(r.choice("aab") + "x", i, r.randrange(100), r.choice([None, "p", "q"])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t long, n long, s string").repartition(6)
    out = running(df, ["k"], ["t"], {
        "total": Running("sum", F.col("n")), "most": Running("max", F.col("n"), inclusive=False),
        "last": Running("last", F.col("s")), "before": previous("s", "n")}, rows_per_range=per_range)
    state = {}
    want = []
    for k, t, n, s in data:
        total, most, last, before = state.get(k, (0, None, None, None))
        want.append((k, t, total + n, most, s if s is not None else last, before))
        state[k] = (total + n, n if most is None else max(most, n), s if s is not None else last, (s, n))
    got = [(x.k, x.t, x.total, x.most, x.last, None if x.before is None else tuple(x.before)) for x in out.collect()]
    assert sorted(got, key=lambda x: x[1]) == want


def test_numbers_are_dense_in_key_order(spark):
    df = spark.range(1000).selectExpr("CAST(id AS STRING) AS k").repartition(7)
    got = {r.k: r.n for r in numbered(df, ["k"], "n", 50).collect()}
    assert got == {k: 50 + i for i, k in enumerate(sorted(map(str, range(1000))))}


def store_of(spark, log):
    tx = spark.createDataFrame([(t, 7, datetime(2024, 1, 1 + t)) for t in range(1, 6)], TX_SCHEMA)
    return FactLog.of(naive.facts(spark, log), registry(spark, kernel_attributes() + [NAME, MANY]), tx)


def test_as_of_points(spark):
    s = store_of(spark, [])
    assert s.resolve(None) is None and s.resolve(3) == 3 and s.resolve("4") == 4
    assert s.resolve("2024-01-03T12:00:00+00:00") == 2
    assert s.resolve(datetime(2024, 1, 3, 1, tzinfo=timezone.utc)) == 2
    assert s.resolve("2024-01-03T00:00:00Z") == 2
    with pytest.raises(UnknownTransaction):
        s.resolve(99)
    with pytest.raises(NoZone):
        s.resolve("2024-01-03T12:00:00")
    with pytest.raises(BeforeFirstTransaction):
        s.resolve("2023-01-01T00:00:00Z")


def test_sql_reads_relations_history_and_facts(spark):
    log = [(1, 1001, "a", 1, True), (1, 1001, "a", 3, False), (1, 1001, "b", 3, True), (2, 1002, "x", 2, True), (2, 1002, "y", 2, True)]
    s = store_of(spark, log)
    assert [tuple(r) for r in s.sql('select e, v from "prop/one"').collect()] == [(1, "b")]
    assert [tuple(r) for r in s.sql('select e, v from "prop/one"', as_of=2).collect()] == [(1, "a")]
    assert s.sql('select * from history."prop/one" where op = \'retract\'').count() == 1
    assert sorted(tuple(r) for r in s.sql("select a, v from facts").collect()) == [("prop/many", "x"), ("prop/many", "y"), ("prop/one", "b")]
    with pytest.raises(ValueError):
        s.sql("drop table x")
    rows, more = capped(s.attr("prop/many"), 1)
    assert len(rows) == 1 and more


def test_last_before_and_since(spark):
    s = store_of(spark, [(21, 1001, "a", 1, True), (22, 1001, "b", 4, True)])
    marks = spark.createDataFrame([(datetime(2024, 1, 2),), (datetime(2024, 1, 4, 5),)], "mark timestamp")
    assert [(r.mark.day, r.tx) for r in fold.last_before(s.tx, marks).orderBy("mark").collect()] == [(2, None), (4, 3)]
    assert tuple(fold.since(s.log(), s.tx, s.attrs, 2).first()) == (1, 1, 0, 3)
    assert tuple(fold.size_profile(s.log(), s.tx, s.attrs).first()) == (2, 2, 5)
