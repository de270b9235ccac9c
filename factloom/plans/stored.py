"""Queries that write a store to disk and read it back: planned writes, versions, snapshots, excision."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import Attribute, kernel_attributes, registry
from factloom.operators import fold, ingest, pattern
from factloom.operators.pattern import Var
from factloom.plans import world
from factloom.plans.registry import query
from factloom.session import cut, ensure_checkpoint_dir
from factloom.sources import log
from factloom.sources.mapping import union
from factloom.store import FactLog

EVIDENCE = Attribute(1900, "core/evidence", "string", "many", "none", "What a transaction rests on.")
ORDER_FACTS = ["order/status", "order/total", "order/customer", "order/number"]
FIRST_NEW = 90_000_000_000


def _attrs(spark: SparkSession) -> DataFrame:
    return registry(spark, [*kernel_attributes(), *world.ATTRIBUTES, EVIDENCE])


def mixed_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One proposed fact per order: changes, repeats, bad entities, bad references, too precise numbers, evidence."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    own = world.entity("order", key).cast("string")
    total = F.col("o_totalprice").cast(world.MONEY)
    kind = F.when(status == "P", "raise").when(status == "F", "repeat").otherwise(
        F.element_at(F.array(*map(F.lit, ("nonsense", "bad ref", "too precise", "lookup", "evidence"))), (key % 5 + 1).cast("int")))
    rows = world.table(spark, sf, "orders").select(key.alias("idx"), own.alias("own"), total.alias("total"), kind.alias("kind"))
    return rows.select(
        "idx", F.when(F.col("kind") == "nonsense", F.concat(F.lit("order "), "idx")).when(F.col("kind") == "lookup", F.concat(F.lit("order/number=O-"), "idx"))
        .when(F.col("kind") == "evidence", "tmp:tx").otherwise(F.col("own")).alias("e"),
        F.when(F.col("kind") == "bad ref", "order/customer").when(F.col("kind") == "lookup", "order/status").when(F.col("kind") == "evidence", "core/evidence")
        .otherwise("order/total").alias("a"),
        F.when(F.col("kind") == "raise", (F.col("total") + 1).cast("string")).when(F.col("kind") == "bad ref", "abc")
        .when(F.col("kind") == "too precise", F.concat("idx", F.lit(".0000000000000000001"))).when(F.col("kind") == "lookup", "X")
        .when(F.col("kind") == "evidence", F.concat(F.lit("order "), "idx")).otherwise(F.col("total").cast("string")).alias("v"),
        F.lit(None).cast("string").alias("op"))


def mixed_plan(spark: SparkSession, sf: str) -> ingest.Written:
    facts = world.facts(spark, sf, ORDER_FACTS)
    return ingest.plan_write(mixed_batch(spark, sf), fold.state(facts), facts, _attrs(spark), FIRST_NEW)


@query("plan_write_outcomes", """
SELECT o_orderkey AS idx, CASE WHEN o_orderstatus = 'P' THEN 'changed' WHEN o_orderstatus = 'F' THEN 'unchanged'
  ELSE CASE o_orderkey % 5 WHEN 0 THEN 'entity' WHEN 1 THEN 'value' WHEN 2 THEN 'value' ELSE 'changed' END END AS outcome FROM orders""")
def plan_write_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every proposed row: its error, unchanged, or changed. None is lost."""
    plan = mixed_plan(spark, sf)
    return mixed_batch(spark, sf).select("idx").join(ingest.outcomes(plan), "idx", "left").select("idx", "outcome")


@query("plan_write_changes", """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders)
SELECT 20000000000 + k AS e, 'order/total' AS a, CAST(t + 1 AS DOUBLE) AS n, CAST(NULL AS VARCHAR) AS s, true AS op, false AS implied FROM o WHERE s = 'P'
UNION ALL SELECT 20000000000 + k, 'order/total', CAST(t AS DOUBLE), NULL, false, true FROM o WHERE s = 'P'
UNION ALL SELECT 20000000000 + k, 'order/status', NULL, 'X', true, false FROM o WHERE s NOT IN ('P', 'F') AND k % 5 = 3
UNION ALL SELECT 20000000000 + k, 'order/status', NULL, s, false, true FROM o WHERE s NOT IN ('P', 'F') AND k % 5 = 3
UNION ALL SELECT -1, 'core/evidence', NULL, 'order ' || k, true, false FROM o WHERE s NOT IN ('P', 'F') AND k % 5 = 4""")
def plan_write_changes(spark: SparkSession, sf: str) -> DataFrame:
    changes = mixed_plan(spark, sf).changes
    names = _attrs(spark).select(F.col("id").alias("a"), F.col("ident"))
    return changes.join(names, "a").select("e", F.col("ident").alias("a"), F.col("v_decimal").cast("double").alias("n"), F.col("v_string").alias("s"), "op", "implied")


class Stored:
    """A store on disk: the orders as one batch with a snapshot, then a planned commit that changes some."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
        facts = world.facts(spark, sf, ORDER_FACTS)
        log.append_facts(facts, self.path, world.DAY_TX)
        log.append_attributes(_attrs(spark), self.path, 0)
        log.append_transactions(world.transactions(spark, sf), self.path, world.DAY_TX)
        log.take_snapshot(spark, self.path)
        self.before = FactLog.open(spark, self.path)

    def commit(self, proposed: DataFrame) -> int | None:
        store = FactLog.open(self.spark, self.path)
        plan = ingest.plan_write(proposed, store.state(), store.log(), store.attrs, FIRST_NEW)
        return log.commit(self.spark, self.path, plan, 100, datetime(2002, 1, 1), store.number)


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    """Part-shipped orders proposed as shipped, with one fact about the transaction."""
    rows = world.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("idx"), F.concat(F.lit("order/number=O-"), "o_orderkey").alias("e"), F.lit("order/status").alias("a"), F.lit("F").alias("v"), F.lit("assert").alias("op"))
    told = spark.range(1).select(F.lit(-1).cast("long").alias("idx"), F.lit("tmp:tx").alias("e"), F.lit("core/evidence").alias("a"), F.lit("carrier report").alias("v"), F.lit("assert").alias("op"))
    return rows.unionByName(told)


def five_ways(store: FactLog, moment: str) -> DataFrame:
    """Orders by status, counted from what every reading method returns."""
    status = store.attribute("order/status")
    ways = {
        "attr": store.attr("order/status").select("v"),
        "wide": store.wide(["order/status", "order/number"]).select(F.col("`order/status`").alias("v")),
        "state": store.state().where(F.col("a") == status.id).select(F.col("v_string").alias("v")),
        "sql": store.sql('select s.v from "order/status" s where s.v <> \'"order/status"\''),
        "pattern": pattern.pattern(store, Var("e"), "order/status", Var("v")).select("v"),
        "facts": store.facts().where("a = 'order/status'").select("v"),
    }
    return union([df.groupBy("v").agg(F.count("*").alias("orders")).select(F.lit(moment).alias("moment"), F.lit(way).alias("way"), F.col("v").alias("status"), "orders")
                  for way, df in ways.items()])


@query("stored_reads", """
WITH b AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1),
a AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS s, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT unnest(['attr', 'wide', 'state', 'sql', 'pattern', 'facts']) AS way)
SELECT 'before' AS moment, way, s AS status, n AS orders FROM w, b UNION ALL SELECT 'held' AS moment, way, s, n FROM w, b
UNION ALL SELECT m, way, s, n FROM w, a, (SELECT unnest(['refreshed', 'reopened', 'compacted']) AS m)""")
def stored_reads(spark: SparkSession, sf: str) -> DataFrame:
    """A store read in six ways: before a commit, after it by the same and by later openings, and compacted."""
    stored = Stored(spark, sf)
    out = [five_ways(stored.before, "before")]
    stored.commit(shipped(spark, sf))
    target = f"{stored.path}-compact"
    log.compact(spark, stored.path, target)
    out += [five_ways(stored.before, "held"), five_ways(stored.before.refresh(), "refreshed"), five_ways(FactLog.open(spark, stored.path), "reopened"),
            five_ways(FactLog.open(spark, target), "compacted")]
    return union(out)


@query("tx_evidence", """
SELECT 'F' AS v, 'carrier report' AS evidence, count(*) AS facts FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
UNION ALL SELECT 'P', 'carrier report', count(*) FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0""")
def tx_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The facts of a commit with what it was told to rest on: the evidence is a fact about the transaction."""
    stored = Stored(spark, sf)
    stored.commit(shipped(spark, sf))
    store = FactLog.open(spark, stored.path)
    evidence = store.attr("core/evidence").select(F.col("e").alias("tx"), F.col("v").alias("evidence"))
    return store.history("order/status").join(evidence, "tx").groupBy("v", "evidence").agg(F.count("*").alias("facts"))


@query("past_kept", """
SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY 1""")
def past_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A read as of the last transaction before a commit, made after the commit."""
    stored = Stored(spark, sf)
    last = stored.before.tx.agg(F.max("id")).first()[0]
    stored.commit(shipped(spark, sf))
    return FactLog.open(spark, stored.path).attr("order/status", as_of=last).groupBy(F.col("v").alias("status")).agg(F.count("*").alias("orders"))


@query("malformed_facts", """
SELECT 20000000000 + o_orderkey AS e, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS values FROM orders WHERE o_orderstatus IN ('P', 'O')""")
def malformed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with no value or several: orders' totals, with a status beside it for some, and without it for others."""
    both = F.when(F.col("a") == world.BY_IDENT["order/total"].id, F.lit(1))
    status = world.table(spark, sf, "orders").select(world.entity("order", "o_orderkey").alias("e"), F.col("o_orderstatus").alias("s"))
    facts = world.facts(spark, sf, ["order/total"]).join(status, "e").withColumn("v_string", F.when((F.col("s") == "P") & both.isNotNull(), F.col("s"))).withColumn(
        "v_decimal", F.when(F.col("s") != "O", F.col("v_decimal")))
    return fold.malformed(facts).select("e", F.col("values"))




@query("excised_store", """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey % 3 AS c FROM orders)
SELECT 'status' AS what, count(*) AS n FROM o WHERE c = 2 UNION ALL SELECT 'total', count(*) FROM o WHERE c > 0
UNION ALL SELECT 'past status', count(*) FROM o WHERE c = 2 UNION ALL SELECT 'state total', count(*) FROM o WHERE c > 0
UNION ALL SELECT 'entities named', count(*) FROM o WHERE c < 2 UNION ALL SELECT 'attributes named', count(*) FROM o WHERE c = 1
UNION ALL SELECT 'transactions', count(*) FROM o WHERE c < 2""")
def excised_store(spark: SparkSession, sf: str) -> DataFrame:
    """A store after a third of the orders was erased whole, and of another third the status only, in one call."""
    stored = Stored(spark, sf)
    third = F.col("o_custkey") % 3
    erased = world.table(spark, sf, "orders").where(third < 2).select(
        world.entity("order", "o_orderkey").alias("e"), F.when(third == 1, world.BY_IDENT["order/status"].id).cast("long").alias("a"))
    first = 95_000_000_000
    log.excise(spark, stored.path, erased, first, datetime(2002, 1, 2), 100)
    store = FactLog.open(spark, stored.path)
    last = stored.before.tx.agg(F.max("id")).first()[0]
    counts = {
        "status": store.attr("order/status"), "total": store.attr("order/total"), "past status": store.attr("order/status", as_of=last),
        "state total": store.state().where(F.col("a") == world.BY_IDENT["order/total"].id), "entities named": store.attr("fs/excised_entity").select("v").distinct(),
        "attributes named": store.attr("fs/excised_attribute").where(F.col("v") == world.BY_IDENT["order/status"].id), "transactions": store.tx.where(F.col("id") >= first)}
    return union([df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in counts.items()])


def package(spark: SparkSession, sf: str, cardinality: str) -> DataFrame:
    """A vocabulary with an attribute for each nation, each declared distinct from all others."""
    names = world.table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("geo/n"), "n_nationkey", F.lit("_"), F.regexp_replace(F.lower("n_name"), "[^a-z]", "_")).alias("ident"))
    # no more than there are nations
    every = F.array(*(F.lit(r.ident) for r in names.select("ident").collect()))
    return names.select(
        "idx", "ident", F.lit("string").alias("type"), F.lit(cardinality).alias("cardinality"), F.lit("none").alias("unique"),
        F.concat(F.lit("What is told of "), "ident", F.lit(".")).alias("doc"), F.array_remove(every, F.col("ident")).alias("distinct_from"))


@query("installed_package", """
SELECT 'registered' AS what, count(*) AS n FROM nation UNION ALL SELECT 'identity facts', count(*) FROM nation UNION ALL SELECT 'many after evolution', count(*) FROM nation
UNION ALL SELECT 'schema facts replaced', count(*) FROM nation UNION ALL SELECT 'transactions', 2 FROM (SELECT count(*) FROM region) UNION ALL SELECT 'refused', 1 FROM (SELECT count(*) FROM region)
UNION ALL SELECT 'orders read', count(*) FROM orders""")
def installed_package(spark: SparkSession, sf: str) -> DataFrame:
    """A package installed, installed again, evolved, and one of near names refused, in a store of orders."""
    from factloom.sources import registering

    stored = Stored(spark, sf)
    at = datetime(2002, 1, 1)
    first = registering.install(spark, stored.path, package(spark, sf, "one"), 100, at)
    again = registering.install(spark, stored.path, package(spark, sf, "one"), 100, at)
    evolved = registering.install(spark, stored.path, package(spark, sf, "many"), 100, at)
    near = package(spark, sf, "one").withColumn("ident", F.concat("ident", F.lit("s"))).withColumn("distinct_from", F.array().cast("array<string>"))
    try:
        registering.register(spark, stored.path, near, 100, at)
        refused = 0
    except registering.Refused:
        refused = 1
    store = FactLog.open(spark, stored.path)
    mine = store.attrs.where(F.col("ident").startswith("geo/"))
    schema = store.history("fs/cardinality")
    counts = {
        "registered": mine, "identity facts": store.attr("fs/ident").where(F.col("v").startswith("geo/")), "many after evolution": mine.where("cardinality = 'many'"),
        "schema facts replaced": schema.where((F.col("v") == "one") & (F.col("op") == "retract")), "transactions": spark.range(len(first) + len(again) + len(evolved)),
        "refused": spark.range(refused), "orders read": store.attr("order/status")}
    return union([df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in counts.items()])


@query("wrong_rows", """
SELECT o_orderkey AS idx, CASE o_orderkey % 7 WHEN 0 THEN 'no such entity' WHEN 1 THEN 'missing entity' WHEN 2 THEN 'dangling' WHEN 3 THEN 'several'
  WHEN 4 THEN CASE WHEN o_orderkey + 1 IN (SELECT o_orderkey FROM orders) THEN 'held' ELSE 'changed' END
  WHEN 5 THEN 'unchanged' ELSE 'changed' END AS outcome FROM orders
UNION ALL SELECT 1000000000 + o_orderkey, 'several' FROM orders WHERE o_orderkey % 7 = 3""")
def wrong_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What became of rows that are wrong together, or wrong by what the store holds: each error names its row."""
    key = F.col("o_orderkey")
    kind = key % 7
    own = world.entity("order", key).cast("string")
    orders = world.table(spark, sf, "orders")
    rows = orders.select(
        key.alias("idx"), F.when(kind == 0, F.concat(F.lit("7777"), own)).when(kind == 1, F.concat(F.lit("order/number=none "), key)).otherwise(own).alias("e"),
        F.when(kind == 2, "order/customer").when(kind == 4, "order/number").otherwise("order/status").alias("a"),
        F.when(kind == 2, F.concat(F.lit("tmp:"), key)).when(kind == 3, "X").when(kind == 4, F.concat(F.lit("O-"), key + 1)).when(kind == 5, F.col("o_orderstatus"))
        .when(kind == 1, F.col("o_orderstatus")).otherwise("Z").alias("v"),
        F.when(kind == 1, "retract").otherwise("assert").alias("op"))
    twice = orders.where(kind == 3).select((key + 1_000_000_000).alias("idx"), own.alias("e"), F.lit("order/status").alias("a"), F.lit("Y").alias("v"), F.lit("assert").alias("op"))
    batch = rows.unionByName(twice)
    facts = world.facts(spark, sf, ORDER_FACTS)
    plan = ingest.plan_write(batch, fold.state(facts), facts, _attrs(spark), FIRST_NEW)
    return batch.select("idx").join(ingest.outcomes(plan), "idx", "left").select("idx", "outcome")


def part_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """An attribute for each part, as registry rows."""
    key = F.col("p_partkey")
    return world.table(spark, sf, "part").select((key + 500_000_000).alias("id"), F.concat(F.lit("spec/p"), key).alias("ident"), F.lit("string").alias("type"), F.lit("one").alias("cardinality"),
                                                 F.lit("none").alias("uniq"), F.concat(F.lit("What is told of part "), key).alias("doc"), F.lit(None).cast("long").alias("replaced_by"))


def schema_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A proposed change to each part's attribute, three of eight not allowed."""
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 8
    return world.table(spark, sf, "part").select(
        key.alias("idx"), (key + 500_000_000).cast("string").alias("e"),
        F.when(kind.isin(0, 1, 7), "fs/cardinality").when(kind.isin(2, 3), "fs/unique").when(kind.isin(4, 5), "fs/replaced_by").otherwise("fs/doc").alias("a"),
        F.when(kind == 0, "many").when(kind == 1, "banana").when(kind == 7, "one").when(kind == 2, "identity").when(kind == 3, "sometimes")
        .when(kind == 4, F.lit(str(world.BY_IDENT["part/name"].id))).when(kind == 5, (key + 500_000_000).cast("string")).otherwise(F.concat(F.lit("New text of "), key)).alias("v"),
        F.lit("assert").alias("op"))


class Schemed(Stored):
    """A stored log of orders with an attribute for each part."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        super().__init__(spark, sf)
        log.append_attributes(part_attributes(spark, sf), self.path, 1)


@query("schema_outcomes", """
SELECT p_partkey AS idx, CASE p_partkey % 8 WHEN 1 THEN 'one to many only' WHEN 3 THEN 'none to identity only' WHEN 5 THEN 'cycle' ELSE 'changed' END AS outcome FROM part""")
def schema_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of proposed changes to attributes, each told by its row."""
    store = FactLog.open(spark, Schemed(spark, sf).path)
    return ingest.outcomes(ingest.plan_write(schema_batch(spark, sf), store.state(), store.log(), store.attrs, FIRST_NEW)).select("idx", "outcome")


@query("schema_writes", """
WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS c FROM part)
SELECT m AS moment, 'spec/p' || k AS ident, CASE WHEN m = 'after' AND c = 0 THEN 'many' ELSE 'one' END AS cardinality, CASE WHEN m = 'after' AND c = 2 THEN 'identity' ELSE 'none' END AS uniq,
  CASE WHEN m = 'after' AND c = 6 THEN 'New text of ' || k ELSE 'What is told of part ' || k END AS doc, CASE WHEN m = 'after' AND c = 4 THEN 'part/name' END AS replaced_by
FROM p, (SELECT unnest(['before', 'after']) AS m)""")
def schema_writes(spark: SparkSession, sf: str) -> DataFrame:
    """The registry before and after the allowed changes were committed as an ordinary write."""
    stored = Schemed(spark, sf)
    before = FactLog.open(spark, stored.path)
    stored.commit(schema_batch(spark, sf).where(~(F.col("idx") % 8).isin(1, 3, 5)))
    out = []
    for moment, store in (("before", before), ("after", before.refresh())):
        names = store.attrs.select(F.col("id").alias("replaced_by"), F.col("ident").alias("by"))
        out.append(store.attrs.where(F.col("ident").startswith("spec/")).join(names, "replaced_by", "left").select(
            F.lit(moment).alias("moment"), "ident", "cardinality", "uniq", "doc", F.col("by").alias("replaced_by")))
    return union(out)


@query("manifest_reads", """
WITH b AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT 'broken off' AS moment, s AS status, n AS orders FROM b UNION ALL SELECT m, s, n FROM a, (SELECT unnest(['committed', 'held while compacted', 'compacted', 'vacuumed']) AS m)
UNION ALL SELECT 'refused', NULL, 1 FROM (SELECT count(*) FROM orders)""")
def manifest_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by status around a job that broke off, two commits planned on one version, and a compaction in place.

    Each count is made before the folders that it reads are deleted.
    """
    stored = Stored(spark, sf)

    def counts(store: FactLog, moment: str) -> DataFrame:
        found = store.attr("order/status").groupBy(F.col("v").alias("status")).agg(F.count("*").alias("orders"))
        return found.select(F.lit(moment).alias("moment"), "status", "orders")
    # all facts again under other transactions, written and never committed
    world.facts(spark, sf, ["order/status"]).withColumn("v_string", F.lit("lost")).withColumn("tx", F.col("tx") + 1_000_000).write.partitionBy("a").parquet(
        f"{stored.path}/fact/part=broken/batch=99")
    out = [cut(counts(FactLog.open(spark, stored.path), "broken off"))]
    store = FactLog.open(spark, stored.path)
    first, second = (ingest.plan_write(shipped(spark, sf), store.state(), store.log(), store.attrs, FIRST_NEW) for _ in range(2))
    log.commit(spark, stored.path, first, 100, datetime(2002, 1, 1), store.number)
    try:
        log.commit(spark, stored.path, second, 100, datetime(2002, 1, 1), store.number)
        refused = 0
    except log.Conflict:
        refused = 1
    held = FactLog.open(spark, stored.path)
    out.append(cut(counts(held, "committed")))
    log.compact(spark, stored.path)
    out += [cut(counts(held, "held while compacted")), cut(counts(FactLog.open(spark, stored.path), "compacted"))]
    log.vacuum(spark, stored.path)
    out.append(counts(FactLog.open(spark, stored.path), "vacuumed"))
    return union([*out, spark.range(refused).select(F.lit("refused").alias("moment"), F.lit(None).cast("string").alias("status"), F.lit(1).cast("long").alias("orders"))])
