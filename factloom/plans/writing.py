"""Write-side checks and diffs of the tables against perturbed copies of themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import Attribute
from factloom.operators import fold, ingest
from factloom.plans import world
from factloom.plans.registry import query
from factloom.sources.mapping import as_facts, union

STATUS, TOTAL, SEGMENT, NAME = (world.BY_IDENT[i] for i in ("order/status", "order/total", "customer/segment", "customer/name"))


def proposal(df: DataFrame, e: Column, values: dict[Attribute, Column], op: Column | None = None) -> DataFrame:
    return as_facts(df, e, F.lit(0), values, op).drop("tx")


def new_prices(spark: SparkSession, sf: str) -> DataFrame:
    """A re-read of the orders in which part-shipped ones have become shipped and cost one more."""
    was = F.col("o_orderstatus")
    return proposal(world.table(spark, sf, "orders"), world.entity("order", "o_orderkey"), {
        STATUS: F.when(was == "P", "F").otherwise(was),
        TOTAL: F.col("o_totalprice").cast(world.MONEY) + F.when(was == "P", 1).otherwise(0)})


def order_state(spark: SparkSession, sf: str) -> DataFrame:
    return fold.state(world.facts(spark, sf, ["order/status", "order/total"]))


@query("upsert_diff", """
WITH p AS (SELECT 20000000000 + o_orderkey AS e, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders WHERE o_orderstatus = 'P')
SELECT e, 'order/status' AS a, 'P' AS v, false AS op, true AS implied FROM p UNION ALL SELECT e, 'order/status', 'F', true, false FROM p
UNION ALL SELECT e, 'order/total', CAST(CAST(t AS DOUBLE) AS VARCHAR), false, true FROM p
UNION ALL SELECT e, 'order/total', CAST(CAST(t + 1 AS DOUBLE) AS VARCHAR), true, false FROM p""")
def upsert_diff(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    changes = ingest.diff(new_prices(spark, sf), order_state(spark, sf), store.attrs, folded=True)
    a = F.when(F.col("a") == STATUS.id, "order/status").otherwise("order/total")
    return changes.select("e", a.alias("a"), F.coalesce("v_string", F.col("v_decimal").cast("double").cast("string")).alias("v"), "op", "implied")


@query("reingest_noop", "SELECT CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS a, true AS op WHERE false")
def reingest_noop(spark: SparkSession, sf: str) -> DataFrame:
    """Loading the whole store's facts again changes nothing."""
    log = world.facts(spark, sf)
    return ingest.diff_log(log.drop("tx"), log, world.store(spark, sf).attrs).select("e", "a", "op")


@query("apply_changes", """
SELECT o_orderstatus AS was, count(*) AS orders, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS moved FROM orders GROUP BY 1""")
def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Status after the diff is applied, against the status before, per former status."""
    store, state = world.store(spark, sf), order_state(spark, sf)
    after = ingest.apply_changes(state, ingest.diff(new_prices(spark, sf), state, store.attrs, folded=True), F.lit(999_999_999).cast("long"))
    now = after.where(F.col("a") == STATUS.id).select("e", F.col("v_string").alias("now"))
    was = state.where(F.col("a") == STATUS.id).select("e", F.col("v_string").alias("was"))
    return was.join(now, "e").groupBy("was").agg(F.count("*").alias("orders"), F.count_if(F.col("was") != F.col("now")).alias("moved"))


@query("validate", """
SELECT event_id AS idx, 'value' AS code FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'unknown' FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'ident' FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, 'kernel' FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 'value' FROM events WHERE event_type = 'click'""")
def validate(spark: SparkSession, sf: str) -> DataFrame:
    """Events as proposed text facts; every type of event but one breaks a rule."""
    kind = F.col("event_type")
    proposed = world.table(spark, sf, "events").select(
        F.col("event_id").alias("idx"), F.concat(F.lit("8"), F.col("user_id")).alias("e"),
        F.when(kind == "error", "order/placed_on").when(kind == "signup", "user/unheard_of").when(kind == "view", "User View")
        .when(kind == "click", "fs/at").otherwise("user/purchase").alias("a"),
        F.col("value").cast(world.MONEY).cast("string").alias("v"), F.lit("assert").alias("op"))
    return ingest.validate(proposed, world.store(spark, sf).attrs).select("idx", "code")


@query("lookup_resolve", """
SELECT c_name AS key, 10000000000 + c_custkey AS e, 'found' AS outcome FROM customer
UNION ALL SELECT s_name, NULL, 'create' FROM supplier UNION ALL SELECT n_name, NULL, 'missing' FROM nation""")
def lookup_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Customer, supplier and nation names looked up as customers; nations only by retractions."""
    store = world.store(spark, sf)
    a = F.lit(NAME.id).cast("long").alias("a")
    asks = union([
        world.table(spark, sf, "orders").join(world.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right")
        .select(a, F.col("c_name").alias("key"), F.lit(True).alias("asserted")),
        world.table(spark, sf, "supplier").select(a, F.col("s_name").alias("key"), F.lit(True).alias("asserted")),
        world.table(spark, sf, "nation").select(a, F.col("n_name").alias("key"), F.lit(False).alias("asserted"))])
    index = ingest.identity_index(fold.state(store.log(["customer/name"])), store.attrs)
    return ingest.resolve_lookups(asks, index).select("key", "e", "outcome")


@query("allocate", """
SELECT key, 5000000 + row_number() OVER (ORDER BY key) - 1 AS e FROM (SELECT DISTINCT 'C' || o_custkey || '/' || o_orderpriority AS key FROM orders)""")
def allocate(spark: SparkSession, sf: str) -> DataFrame:
    """New entity ids, dense in key order, for each customer and priority that orders name."""
    keys = world.table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey", F.lit("/"), "o_orderpriority").alias("key"))
    return ingest.allocate(keys, ["key"], 5_000_000).select("key", "e")


@query("batch_conflicts", """
SELECT 20000000000 + o_orderkey AS e, 'both' AS code FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 20000000000 + o_orderkey, 'several' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'X'""")
def batch_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    orders = world.table(spark, sf, "orders")
    e = world.entity("order", "o_orderkey")
    batch = union([proposal(orders, e, {STATUS: F.col("o_orderstatus")}),
                   proposal(orders.where("o_orderstatus = 'P'"), e, {STATUS: F.col("o_orderstatus")}, F.lit(False)),
                   proposal(orders.where("o_orderpriority = '1-URGENT'"), e, {STATUS: F.lit("X")})])
    return ingest.batch_conflicts(batch, world.store(spark, sf).attrs).select("e", "code")


@query("identity_conflicts", """
SELECT s_name AS key, 'held' AS code FROM supplier
UNION ALL SELECT n_name, 'claimed twice' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)""")
def identity_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers claim supplier names the store gives to others, and their nations' names twice over."""
    store = world.store(spark, sf)
    name = {NAME: F.col("name")}
    suppliers = world.table(spark, sf, "supplier")
    held = as_facts(suppliers.withColumn("name", F.col("s_name")), world.entity("supplier", "s_suppkey"), F.lit(1), name)
    index = ingest.identity_index(fold.state(held), store.attrs)
    customers = world.table(spark, sf, "customer")
    nations = customers.join(world.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("name", F.col("n_name"))
    claims = union([proposal(suppliers.withColumn("name", F.col("s_name")), world.entity("customer", "s_suppkey"), name),
                    proposal(nations, world.entity("customer", "c_custkey"), name)])
    return ingest.identity_conflicts(claims.withColumn("implied", F.lit(False)), index, store.attrs).select("key", "code")


@query("identity_candidate", """
SELECT p_name AS key, count(*) AS entities, 30000000000 + min(p_partkey) AS first, 30000000000 + max(p_partkey) AS last
FROM part GROUP BY 1 HAVING count(*) > 1""")
def identity_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Part names that more than one part carries: why the attribute cannot be an identity."""
    store = world.store(spark, sf)
    shared, _ = ingest.identity_candidate(fold.state(store.log(["part/name"])), world.BY_IDENT["part/name"].id)
    return shared


@query("missing_entities", """
SELECT 30000000000 + l_partkey AS e FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1""")
def missing_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that lines name and a store of the larger parts only does not know."""
    named = world.table(spark, sf, "lineitem").select(world.entity("part", "l_partkey").alias("e"))
    facts = as_facts(world.table(spark, sf, "part").where("p_size > 25"), world.entity("part", "p_partkey"), F.lit(1),
                     {world.BY_IDENT["part/name"]: F.col("p_name")})
    return ingest.missing_entities(named, facts)


@query("excise_asof", """
SELECT o_orderstatus AS status, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment <> 'BUILDING' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1""")
def excise_asof(spark: SparkSession, sf: str) -> DataFrame:
    """A past read after every order of one segment's customers was excised."""
    store = world.store(spark, sf)
    building = store.attr("customer/segment").where(F.col("v") == "BUILDING").select(F.col("e").alias("v"))
    erased = store.attr("order/customer").join(building, "v", "left_semi").select("e", F.lit(None).cast("long").alias("a"))
    kept = ingest.without(store.log(["order/status"]), erased)
    past = fold.relation(kept, STATUS, store.resolve("1998-12-31T12:00:00Z"))
    return past.groupBy(F.col("v").alias("status")).agg(F.count("*").alias("orders"))


@query("stamped", """
SELECT CAST(max(o_orderkey) + 1 AS BIGINT) AS tx, 2 * count(*) + 2 AS facts, 2 AS stamps FROM orders""")
def stamped(spark: SparkSession, sf: str) -> DataFrame:
    """Status and total of every order written as one transaction after the greatest order key."""
    tx = world.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    changes = as_facts(world.table(spark, sf, "orders"), world.entity("order", "o_orderkey"), F.lit(0), {
        STATUS: F.col("o_orderstatus"), TOTAL: F.col("o_totalprice").cast(world.MONEY)})
    facts = ingest.stamp(changes.drop("tx"), tx, 100, F.lit("2002-01-01").cast("timestamp"))
    return facts.groupBy("tx").agg(F.count("*").alias("facts"), F.count_if(F.col("e") == F.col("tx")).cast("int").alias("stamps"))


@query("unchanged_rows", """
SELECT o_orderstatus AS status, count(*) AS rows FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def unchanged_rows(spark: SparkSession, sf: str) -> DataFrame:
    batch = new_prices(spark, sf).where(F.col("a") == STATUS.id)
    changes = ingest.diff(batch, order_state(spark, sf), world.store(spark, sf).attrs)
    return ingest.unchanged(batch, changes).groupBy(F.col("v_string").alias("status")).agg(F.count("*").alias("rows"))
