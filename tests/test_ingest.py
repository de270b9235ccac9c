import random
import re
from datetime import datetime

import naive
import pytest
from pyspark.sql import functions as F

from factloom.model import TX_SCHEMA, Attribute, kernel_attributes, registry
from factloom.operators import fold, ingest
from factloom.sources import log as disk
from factloom.store import FactLog

ID = Attribute(1001, "shopify/order_id", "string", "one", "identity")
STATUS = Attribute(1002, "order/status", "string")
TAG = Attribute(1003, "order/tag", "string", "many")
PART = Attribute(1004, "core/part_of", "ref", "many")
SURE = Attribute(1005, "core/confidence", "decimal")
OLD = Attribute(1006, "order/state", "string", "one", "none", "", 1002)
ALL = kernel_attributes() + [ID, STATUS, TAG, PART, SURE, OLD]


@pytest.mark.parametrize("seed,per_range", [(0, None), (1, None), (2, 30), (3, 9)])
def test_canonical_logs_match_a_walk_of_the_feed(spark, seed, per_range):
    r = random.Random(seed)
    feed = []
    for tx in range(250):
        e = r.choice([1, 1, 1, 2, 3])
        if r.random() < 0.2:
            a, b = r.sample("abc", 2)
            feed += [(e, 7, a, tx, False), (e, 7, b, tx, True)]
        else:
            feed.append((e, 7, r.choice("abc"), tx, r.random() < 0.6))
    df = naive.facts(spark, feed).repartition(5)
    one = ingest.canonical_one(df, rows_per_range=per_range)
    assert naive.rows(one) == sorted(naive.canonical_one(feed))
    assert naive.rows(ingest.canonical_one(one)) == naive.rows(one)
    many = ingest.canonical_many(df, rows_per_range=per_range)
    assert naive.rows(many) == sorted(naive.canonical_many(feed))


def world(spark):
    rows = [(10, 1001, "A1", 1, True), (10, 1002, "open", 1, True), (10, 1003, "x", 1, True), (11, 1001, "A2", 1, True), (12, 1002, "open", 1, True)]
    facts = naive.facts(spark, rows)
    return facts, fold.state(facts), registry(spark, ALL)


def plan(spark, rows):
    facts, state, attrs = world(spark)
    proposed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx long, e string, a string, v string, op string")
    return ingest.plan_write(proposed, state, facts, attrs, 5000)


def changes(w):
    return sorted((r.e, r.a, r.v_string or r.v_ref or r.v_decimal, r.op, r.implied) for r in w.changes.collect())


def codes(w):
    return sorted({r.code for r in w.errors.collect()})


def test_replace_accumulate_and_unchanged(spark):
    w = plan(spark, [("10", "order/status", "paid", None), ("10", "order/tag", "y", None), ("10", "order/tag", "x", None), ("shopify/order_id=A2", "order/status", "open", None)])
    assert codes(w) == []
    assert changes(w) == [(10, 1002, "open", False, True), (10, 1002, "paid", True, False), (10, 1003, "y", True, False), (11, 1002, "open", True, False)]
    assert [r.idx for r in w.unchanged.collect()] == [2]


def test_lookup_creates_once_and_carries_its_value(spark):
    w = plan(spark, [("shopify/order_id=B9", "order/status", "open", None), ("shopify/order_id=B9", "order/tag", "t", None), ("tmp:line", "core/part_of", "shopify/order_id=B9", None)])
    assert codes(w) == []
    made = [(r.key, r.created, r.e) for r in w.lookups.collect()]
    assert made == [("B9", True, 5000)]
    assert changes(w) == [(5000, 1001, "B9", True, False), (5000, 1002, "open", True, False), (5000, 1003, "t", True, False), (5001, 1004, 5000, True, False)]


def test_every_problem_is_reported(spark):
    w = plan(spark, [("10", "order/nothing", "x", None), ("10", "Bad Name", "x", None), ("10", "core/confidence", "high", None), ("10", "fs/at", "x", None),
                     ("10", "fs/ident", "x", None), ("10", "fs/doc", "x", "retract"), ("10", "order/state", "x", None), ("10", "order/tag", "x", "maybe"),
                     ("77", "order/tag", "x", None), ("order/status=open", "order/tag", "x", None), ("shopify/order_id=ZZ", "order/tag", "x", "retract"),
                     ("10", "core/part_of", "tmp:nobody", None), ("12", "order/status", "a", None), ("12", "order/status", "b", None), ("12", "shopify/order_id", "A1", None)])
    assert codes(w) == sorted(["unknown", "ident", "value", "kernel", "registration", "schema", "deprecated", "op", "no such entity", "lookup",
                               "missing entity", "dangling", "several", "held"])


def test_asserting_and_retracting_one_value_conflicts(spark):
    assert codes(plan(spark, [("10", "order/tag", "q", None), ("10", "order/tag", "q", "retract")])) == ["both"]


def test_identity_freed_in_the_same_batch_may_be_claimed(spark):
    w = plan(spark, [("10", "shopify/order_id", "A1", "retract"), ("12", "shopify/order_id", "A1", None)])
    assert codes(w) == []
    assert codes(plan(spark, [("10", "shopify/order_id", "N", None), ("12", "shopify/order_id", "N", None)])) == ["claimed twice"]
    assert codes(plan(spark, [("10", "shopify/order_id", "n" * 600, None)])) == ["too long"]


def test_apply_then_diff_again_changes_nothing(spark):
    facts, state, attrs = world(spark)
    batch = naive.facts(spark, [(10, 1002, "paid", 0, True), (11, 1003, "z", 0, True), (10, 1003, "x", 0, False)]).drop("tx")
    ch = ingest.diff(batch, state, attrs)
    after = ingest.apply_changes(state, ch, F.lit(9).cast("long"))
    refolded = fold.state(facts.unionByName(ch.drop("implied").withColumn("tx", F.lit(9).cast("long"))))
    assert naive.rows(after, with_op=False) == naive.rows(refolded, with_op=False)
    assert ingest.diff(batch, after, attrs).count() == 0


def test_evolution_rules(spark):
    _, state, attrs = world(spark)
    req = spark.createDataFrame([("order/tag", "cardinality", "one"), ("order/status", "cardinality", "many"), ("order/status", "unique", "identity"),
                                 ("order/tag", "unique", "identity"), ("fs/doc", "doc", "x"), ("order/tag", "doc", " "), ("no/such", "doc", "x")], "ident string, field string, value string")
    got = sorted(tuple(r) for r in ingest.evolution_errors(req, attrs, state).collect())
    assert got == sorted([("order/tag", "one to many only"), ("order/status", "shared keys"), ("fs/doc", "kernel"), ("order/tag", "doc"), ("no/such", "unknown")])
    shared, sample = ingest.identity_candidate(state, 1002)
    assert [tuple(r) for r in shared.collect()] == [("open", 2, 10, 12)] and sample.count() == 1


def test_log_on_disk_round_trip_snapshot_and_excision(spark, tmp_path):
    path = str(tmp_path / "store")
    first = naive.facts(spark, [(1010, 1002, "open", 2000, True), (1010, 1003, "x", 2000, True), (1011, 1002, "open", 2000, True)])
    disk.append_facts(first, path, 2000)
    disk.append_attributes(registry(spark, ALL), path, 0)
    disk.append_transactions(spark.createDataFrame([(2000, 100, datetime(2024, 1, 1))], TX_SCHEMA), path, 2000)
    disk.write_state(fold.state(disk.scan(spark, path)), path, 2000)
    second = naive.facts(spark, [(1010, 1002, "open", 2001, False), (1010, 1002, "paid", 2001, True)])
    disk.append_facts(second, path, 2001)
    disk.append_transactions(spark.createDataFrame([(2001, 100, datetime(2024, 1, 2))], TX_SCHEMA), path, 2001)
    store = FactLog.open(spark, path)
    assert sorted((r.e, r.v) for r in store.attr("order/status").collect()) == [(1010, "paid"), (1011, "open")]
    assert sorted((r.e, r.v) for r in store.attr("order/status", as_of="2024-01-01T10:00:00Z").collect()) == [(1010, "open"), (1011, "open")]
    assert naive.rows(disk.read_state(spark, path), with_op=False) == naive.rows(store.state(), with_op=False)
    # a half-written batch is not read
    second.write.parquet(f"{path}/fact/batch=2002")
    import os
    os.remove(f"{path}/fact/batch=2002/_SUCCESS")
    assert store.log().count() == 5
    assert not store.has_snapshot()
    plan_text = store.attr("order/status", as_of=2001)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(a#\d+L? = 1002\)", plan_text)
    disk.compact(spark, path, str(tmp_path / "small"))
    assert FactLog.open(spark, str(tmp_path / "small")).log().count() == 5
    gone = spark.createDataFrame([(1010, 1002), (1011, None), (1011, 1002)], "e long, a long")
    assert disk.excise(spark, path, gone, 2003, datetime(2024, 1, 3), 100) == 2
    clean = FactLog.open(spark, path)
    assert {(r.e, r.a) for r in clean.log().where("e < 2000").collect()} == {(1010, 1003)}
    assert [(r.e, r.v) for r in clean.attr("fs/excised_entity").orderBy("e").collect()] == [(2003, 1010), (2004, 1011)]
    assert [(r.e, r.v) for r in clean.attr("fs/excised_attribute").collect()] == [(2003, 1002)]
    assert clean.attr("order/status", as_of=2000).count() == 0 and clean.has_snapshot()
    for bad in (2000, 1002, 4711):
        with pytest.raises(ValueError):
            disk.excise(spark, path, spark.createDataFrame([(bad, None)], "e long, a long"), 2009, datetime(2024, 1, 4), 100)


def test_stamps_and_next_instant(spark):
    ch = naive.facts(spark, [(1, 1002, "a", 0, True)]).drop("tx")
    got = {(r.e, r.a) for r in ingest.stamp(ch, 50, 100, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {(1, 1002), (50, 8), (50, 9)}
    t = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert spark.range(1).select(F.unix_micros(ingest.next_instant(t, t)) - F.unix_micros(t)).first()[0] == 1


def test_commit_writes_once_and_refuses_errors(spark, tmp_path):
    path = str(tmp_path / "store")
    disk.append_facts(naive.facts(spark, [(2010, 1001, "A1", 2000, True), (2010, 1002, "open", 2000, True)]), path, 2000)
    disk.append_attributes(registry(spark, ALL), path, 0)
    disk.append_transactions(spark.createDataFrame([(2000, 100, datetime(2024, 1, 1))], TX_SCHEMA), path, 2000)

    def write(rows):
        store = FactLog.open(spark, path)
        proposed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx long, e string, a string, v string, op string")
        plan = ingest.plan_write(proposed, store.state(), store.log(), store.attrs, 3000)
        return disk.commit(spark, path, plan, 100, datetime(2023, 1, 1))
    batch = [("shopify/order_id=A1", "order/status", "paid", None), ("shopify/order_id=B1", "order/status", "open", None)]
    tx = write(batch)
    assert tx > 3000 and write(batch) is None
    store = FactLog.open(spark, path)
    assert sorted((r.e, r.v) for r in store.attr("order/status").collect()) == [(2010, "paid"), (3000, "open")]
    assert [(r.id, str(r.at)) for r in store.tx.where("id > 2000").collect()] == [(tx, "2024-01-01 00:00:00.000001")]
    assert store.attr("order/status", as_of=2000).first().v == "open"
    with pytest.raises(ValueError):
        write([("2010", "order/nothing", "x", None)])


def told(w):
    return {r.idx: r.outcome for r in ingest.outcomes(w).collect()}


def test_every_row_is_answered(spark):
    w = plan(spark, [
        ("999", "order/status", "x", None), ("shopify/order_id=none", "order/status", "x", "retract"), ("tmp:a", "order/status", "x", None),
        ("10", "order/status", "a", None), ("10", "order/status", "b", None), ("11", "order/status", "q", None), ("11", "order/status", "q", "retract"),
        ("12", "shopify/order_id", "A1", None), ("10", "order/tag", "x", None), ("shopify/order_id=new", "order/status", "x", None), ("12", "order/status", "paid", None),
        ("tmp:b", "shopify/order_id", "twice", None), ("tmp:c", "shopify/order_id", "twice", None), ("what", "order/status", "x", None)])
    assert all(r.idx is not None for r in w.errors.collect())
    got = told(w)
    assert got == {0: "no such entity", 1: "missing entity", 2: "changed", 3: "several", 4: "several", 5: "both", 6: "both", 7: "held", 8: "unchanged", 9: "changed", 10: "changed",
                   11: "claimed twice", 12: "claimed twice", 13: "entity"}


def test_schema_facts_obey_the_rules(spark):
    rows = [("1002", "fs/cardinality", "many", None), ("1003", "fs/cardinality", "one", None), ("1002", "fs/cardinality", "banana", None)]
    assert [set(told(plan(spark, [r])).values()) for r in rows] == [{"changed"}, {"one to many only"}, {"one to many only"}]
    w = plan(spark, [("1002", "fs/replaced_by", "1003", None), ("1003", "fs/replaced_by", "1002", None)])
    assert set(told(w).values()) == {"cycle"}
    assert told(plan(spark, [("1002", "fs/replaced_by", "1002", None)])) == {0: "cycle"}
    assert told(plan(spark, [("1002", "fs/replaced_by", "8", None)])) == {0: "target"}
    assert told(plan(spark, [("tmp:n", "fs/cardinality", "many", None)])) == {0: "unknown"}
    assert told(plan(spark, [("1002", "fs/unique", "identity", None), ("1002", "fs/doc", " ", None)])) == {0: "shared keys", 1: "doc"}
    assert told(plan(spark, [("5", "fs/doc", "x", None)])) == {0: "kernel"}
    w = plan(spark, [("1003", "fs/replaced_by", "1002", None), ("1003", "fs/doc", "Old tags.", None)])
    assert told(w) == {0: "changed", 1: "changed"}
    assert [(r.id, r.cardinality, r.doc, r.replaced_by) for r in w.registry.collect()] == [(1003, "many", "Old tags.", 1002)]
    assert plan(spark, [("10", "order/status", "x", None)]).registry is None


def stored(spark, tmp_path):
    path = str(tmp_path / "store")
    disk.append_facts(naive.facts(spark, [(2010, 1001, "A1", 2000, True), (2010, 1002, "open", 2000, True), (2010, 1003, "t", 2000, True)]), path, 2000)
    disk.append_attributes(registry(spark, ALL), path, 0)
    disk.append_transactions(spark.createDataFrame([(2000, 100, datetime(2024, 1, 1))], TX_SCHEMA), path, 2000)
    return path


def test_schema_writes_reach_the_registry(spark, tmp_path):
    from factloom.operators import vocabulary
    from factloom.sources import registering

    path, at = stored(spark, tmp_path), datetime(2024, 2, 1)
    before = FactLog.open(spark, path)
    spec = spark.createDataFrame([(0, "ship/carrier", "string", "one", None, "Who carries a shipment.", [])], "idx int, ident string, type string, cardinality string, unique string, doc string, distinct_from array<string>")
    registering.register(spark, path, spec, 100, at)
    request = "ident string, field string, value string"
    tx = registering.evolve(spark, path, spark.createDataFrame([("order/tag", "replaced_by", "order/status"), ("ship/carrier", "cardinality", "many"), ("ship/carrier", "doc", "Who carries a shipment.")], request), 100, at)
    now = {r.ident: r for r in FactLog.open(spark, path).attrs.collect()}
    assert (now["order/tag"].replaced_by, now["ship/carrier"].cardinality) == (1002, "many")
    assert {r.ident: r.replaced_by for r in before.attrs.collect()}["order/tag"] is None
    assert registering.evolve(spark, path, spark.createDataFrame([("order/tag", "replaced_by", "order/status")], request), 100, at) is None
    for bad in (("order/tag", "colour", "red"), ("order/status", "replaced_by", "order/tag"), ("order/status", "replaced_by", "no/such"), ("order/tag", "cardinality", "one hundred")):
        with pytest.raises(registering.Refused):
            registering.evolve(spark, path, spark.createDataFrame([bad], request), 100, at)
    # the log's own facts tell the registered attribute as it is, and as it was
    facts = disk.scan(spark, path)
    assert [tuple(r) for r in vocabulary.registry_of(facts).where("ident = 'ship/carrier'").collect()] == [tuple(now["ship/carrier"])]
    assert vocabulary.registry_of(facts, tx - 1).where("ident = 'ship/carrier'").first().cardinality == "one"
    with pytest.raises(ValueError):
        proposed = spark.createDataFrame([(0, "2010", "order/tag", "u", None)], "idx long, e string, a string, v string, op string")
        store = FactLog.open(spark, path)
        disk.commit(spark, path, ingest.plan_write(proposed, store.state(), store.log(), store.attrs, 3000), 100, at)


def test_two_commits_on_one_version(spark, tmp_path):
    path = stored(spark, tmp_path)
    store = FactLog.open(spark, path)

    def planned(value):
        return ingest.plan_write(spark.createDataFrame([(0, "2010", "order/status", value, None)], "idx long, e string, a string, v string, op string"), store.state(), store.log(), store.attrs, 3000)
    a, b = planned("paid"), planned("lost")
    tx = disk.commit(spark, path, a, 100, datetime(2024, 2, 1), store.number)
    with pytest.raises(disk.Conflict):
        disk.commit(spark, path, b, 100, datetime(2024, 2, 1), store.number)
    with pytest.raises(disk.Conflict):
        disk.publish(spark, path, "commit", [], base=store.number)
    assert tx == 2011 and FactLog.open(spark, path).attr("order/status").first().v == "paid"
    assert store.attr("order/status").first().v == "open"


def test_compaction_in_place(spark, tmp_path):
    path = stored(spark, tmp_path)
    disk.append_facts(naive.facts(spark, [(2010, 1002, "open", 2001, False), (2010, 1002, "paid", 2001, True)]), path, 2001)
    old = FactLog.open(spark, path)
    before = naive.rows(old.log())
    disk.compact(spark, path)
    new = FactLog.open(spark, path)
    assert naive.rows(new.log()) == before == naive.rows(old.log())
    assert len(disk.version(spark, path).fact) == 1 and new.has_snapshot() and new.attr("order/status").first().v == "paid"
    assert new.attr("order/status", as_of=2000).first().v == "open" and new.high == old.high
    disk.append_facts(naive.facts(spark, [(2010, 1003, "later", 2002, True)]), path, 2002)
    assert FactLog.open(spark, path).state().count() == 4
    assert disk.vacuum(spark, path) > 0 and naive.rows(FactLog.open(spark, path).log().where("tx < 2002")) == before
    # a batch written again takes the place of its first writing
    disk.append_facts(naive.facts(spark, [(2010, 1003, "again", 2002, True)]), path, 2002)
    assert {r.v for r in FactLog.open(spark, path).attr("order/tag").collect()} == {"t", "again"}


def test_numbers_of_every_length_are_read_or_refused(spark):
    from factloom.functions import values
    texts = {"1": True, "-1.5": True, ".5": True, "1.": True, "+0012.3400": True, "1.5" + "0" * 30: True, "1." + "0" * 17 + "1": True, "1." + "0" * 18 + "1": False, "": False,
             ".": False, "1e-18": True, "1e-19": False, "1.5e-18": False, "0e-40": True, " 7 ": True, "x": False, "1" * 21: False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in rows.select("t", values.coerce("decimal", F.col("t")).isNotNull().alias("v")).collect()} == texts


def test_only_names_that_are_looked_up_meet_the_targets(spark, monkeypatch):
    one = Attribute(1001, "x/one", "string", "one", "identity")
    attrs = registry(spark, [*kernel_attributes(), one, Attribute(1002, "x/many", "string", "many"), Attribute(1003, "x/ref", "ref", "many")])
    facts = naive.facts(spark, [(i, 1001, f"k{i}", 1, True) for i in range(1, 9)])
    rows = [(i, str(1 + i % 8), "x/many", f"v{i}", "assert") for i in range(200)] + [(900, "x/one=k3", "x/ref", "x/one=k4", "assert"), (901, "tmp:a", "x/ref", "5", "assert"),
                                                                                  (902, "tmp:tx", "x/ref", "tmp:a", "assert"), (903, "x/one=new", "x/many", "n", "assert")]
    batch = spark.createDataFrame(rows, "idx long, e string, a string, v string, op string")
    seen = []
    plain = type(batch).join

    def join(self, other, on=None, how=None):
        if isinstance(on, str) and on in ("_e", "_v"):
            seen.append(self.count())
        return plain(self, other, on, how)
    monkeypatch.setattr(type(batch), "join", join)
    plan = ingest.plan_write(batch, fold.state(facts), facts, attrs, 500)
    found = {(r.e, r.a, r.v_ref) for r in plan.changes.where("v_ref is not null").collect()}
    assert seen == [3, 2]
    new = next(e for e, a, v in found if v == 5)
    assert (3, 1003, 4) in found and (-1, 1003, new) in found and plan.changes.where("a = 1002").count() == 201


def test_diff_with_a_fold_moves_the_state_once_and_keeps_no_row_that_changes_nothing(spark, monkeypatch):
    from factloom.plans import world, writing

    met, cut = [], ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda df: met.append(df) or cut(df))
    sf = "/root/testdata/sf0.001"
    log = world.facts(spark, sf, ["order/status", "order/number"])
    attrs = world.store(spark, sf).attrs
    assert ingest.diff(log.drop("tx"), fold.state(log), attrs, folded=True).count() == 0
    assert met[0].count() == 0
    plan = met[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange" not in plan[:plan.index("Union")] and plan.count("Exchange hashpartitioning") == 2
    state = writing.order_state(spark, sf)
    there, plain = (ingest.diff(writing.new_prices(spark, sf), state, attrs, folded=f) for f in (True, False))
    assert plain.count() > 0 and plain.exceptAll(there).isEmpty() and there.exceptAll(plain).isEmpty()


def test_loading_a_log_again_deals_no_fact_by_value(spark, monkeypatch):
    from factloom.plans import writing

    met, cut = [], ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda df: met.append(df) or cut(df))
    assert writing.reingest_noop(spark, "/root/testdata/sf0.001").count() == 0
    assert len(met) == 1 and "Exchange" not in met[0]._jdf.queryExecution().executedPlan().toString()


def typed(spark, rows):
    """Facts of rows (e, a, string, decimal, instant in microseconds, ref, tx, op)."""
    df = spark.createDataFrame(rows, "e long, a long, v_string string, d int, i long, v_ref long, tx long, op boolean")
    return df.select("*", F.col("d").cast("decimal(38,18)").alias("v_decimal"), F.lit(None).cast("boolean").alias("v_boolean"), F.lit(None).cast("date").alias("v_date"),
                     F.timestamp_micros("i").alias("v_instant")).select(*ingest.COLUMNS)


@pytest.mark.parametrize("seed,pieces", [(0, 1024), (1, 1024), (2, 1), (3, 3)])
def test_diff_with_a_log_is_the_diff_with_its_fold(spark, monkeypatch, seed, pieces):
    monkeypatch.setattr(ingest, "PIECES", pieces)
    r, attrs = random.Random(seed), registry(spark, ALL)

    def value():
        n = r.randrange(4)
        return r.choice([(f"v{n}", None, None, None), (None, n, None, None), (None, None, n, None), (None, None, None, n), (None,) * 4])
    log = [(r.randrange(1, 60), r.choice([1002, 1003, 1004, 1005]), *value(), r.randrange(1, 9), r.random() < 0.95) for _ in range(150)]
    for changed in (0, 0.05, 0.5):
        batch = [(*f[:2], *(value() if r.random() < changed else f[2:6]), 0, f[7] if r.random() >= changed else r.random() < 0.7) for f in log if r.random() >= changed]
        batch += [(*b[:6], 0, b[7]) for b in r.sample(batch, round(len(batch) * changed))]
        facts, asked = typed(spark, log).repartition(3), typed(spark, batch).drop("tx").repartition(2)
        want, got = ingest.diff(asked, fold.state(facts), attrs), ingest.diff_log(asked, facts, attrs)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_piece_is_the_same_only_where_its_facts_are(spark):
    def found(log, batch):
        return sorted(r.a for r in ingest.differing(typed(spark, [(e, a, *v, 0, op) for e, a, v, op in batch]).drop("tx"), typed(spark, [(e, a, *v, 5, op) for e, a, v, op in log])).collect())
    x, y = ("x", None, None, None), ("y", None, None, None)
    instant, ref, none = (None, None, 5, None), (None, None, None, 5), (None,) * 4
    log = [(1, 1002, x, True), (2, 1002, y, True), (3, 1003, x, True)]
    assert found(log, log) == [] and found(log, log[:2]) == [] and found(log, []) == []
    assert found(log, [log[0]] * 3 + log[1:]) == [1002]
    assert set(found(log, [(1, 1002, y, True), (2, 1002, x, True), log[2]])) == {1002}
    assert found([(1, 1004, instant, True)], [(1, 1004, ref, True)]) == [1004]
    assert found([(1, 1004, none, True)], [(1, 1004, ref, True)]) == [1004]
    retracted = [*log, (1, 1002, x, False)]
    assert found(retracted, retracted) == [1002]
