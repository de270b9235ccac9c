"""Queries of operators that take a store with gaps, a registry in the log, or a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import codes, values
from factloom.model import KERNEL, SPARK_TYPE, VALUE_COLUMN
from factloom.operators import evidence, fold, pattern, profile, vocabulary
from factloom.operators.pattern import Var
from factloom.plans import world
from factloom.plans.registry import query
from factloom.store import FactLog


def gappy(spark: SparkSession, sf: str) -> FactLog:
    """The orders' facts, without the status of part-shipped ones."""
    facts = world.facts(spark, sf, ["order/status", "order/total"]).where("v_string is null or v_string <> 'P'")
    return FactLog.of(facts, world.store(spark, sf).attrs, world.transactions(spark, sf))


@query("without_status", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P'")
def without_status(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a total and no status."""
    store = gappy(spark, sf)
    rows = pattern.missing(pattern.pattern(store, Var("e"), "order/total", Var("t")), store, "e", "order/status")
    return rows.select((F.col("e") % world.WIDTH).alias("k"))


@query("status_or_else", """
SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 'unknown' ELSE o_orderstatus END AS s FROM orders""")
def status_or_else(spark: SparkSession, sf: str) -> DataFrame:
    store = gappy(spark, sf)
    rows = pattern.get_else(pattern.pattern(store, Var("e"), "order/total", Var("t")), store, "e", "order/status", "s", "unknown")
    return rows.select((F.col("e") % world.WIDTH).alias("k"), "s")


@query("bound_values", """
SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS twice FROM orders WHERE o_orderstatus = 'F'""")
def bound_values(spark: SparkSession, sf: str) -> DataFrame:
    """A computed value bound to a new variable, and one bound to a variable that has a value: rows that agree stay."""
    store = gappy(spark, sf)
    rows = pattern.conjunction(pattern.pattern(store, Var("e"), "order/total", Var("t")), pattern.pattern(store, Var("e"), "order/status", Var("s")))
    rows = pattern.bind(pattern.bind(rows, "twice", F.col("t") * 2), "s", F.lit("F"))
    return rows.select((F.col("e") % world.WIDTH).alias("k"), F.col("twice").cast("double").alias("twice"))


@query("reverse_pattern", """
SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_mktsegment = 'BUILDING'
 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0)""")
def reverse_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one segment whom an order with an even key refers to: a constant forwards, a test backwards."""
    found = pattern.match(world.store(spark, sf), {"customer/segment": "BUILDING", "^order/customer": lambda e: e % 2 == 0}, "e")
    return found.select((F.col("e") % world.WIDTH).alias("k")).distinct()


@query("unreferred_pattern", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def unreferred_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whom no open order refers to."""
    facts = world.facts(spark, sf, ["customer/name", "order/customer"])
    open_ = world.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(world.entity("order", "o_orderkey").alias("e"))
    customers = facts.where(F.col("a") == world.BY_IDENT["customer/name"].id)
    store = FactLog.of(customers.unionByName(facts.where(F.col("a") == world.BY_IDENT["order/customer"].id).join(open_, "e", "left_semi").select(*facts.columns)),
                       world.store(spark, sf).attrs, world.transactions(spark, sf))
    found = pattern.match(store, {"customer/name": Var("n"), "^order/customer": None}, "e")
    return found.select((F.col("e") % world.WIDTH).alias("k"))


@query("sql_literals", """
SELECT '"order/status"' AS said, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 2""")
def sql_literals(spark: SparkSession, sf: str) -> DataFrame:
    """A relation's quoted name inside a string literal, and in a comment, stays text."""
    return world.store(spark, sf).sql("""select '"order/status"' said, v s, count(*) n from "order/status" -- not "order/total"
        group by v""")


@query("omitted_signatures", """
WITH n AS (SELECT count(*) AS c FROM orders UNION ALL SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) UNION ALL SELECT count(*) FROM customer
  UNION ALL SELECT count(*) FROM part UNION ALL SELECT count(*) FROM supplier UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM region),
r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS i FROM n)
SELECT count(*) AS signatures, CAST(sum(c) AS BIGINT) AS entities FROM r WHERE i > 2""")
def omitted_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """What a list of the two most common signatures leaves out."""
    return profile.statistics(world.store(spark, sf), limit=2)["omitted"]


@query("container_codes", """
WITH c AS (SELECT p_partkey AS k, lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS s FROM part)
SELECT k, (10 + 12 * 2 + 13 * 4 + 32 * 8 + CAST(s[1] AS INT) * 16 + CAST(s[2] AS INT) * 32 + CAST(s[3] AS INT) * 64 + CAST(s[4] AS INT) * 128
  + CAST(s[5] AS INT) * 256 + CAST(s[6] AS INT) * 512) % 11 % 10 AS digit FROM c""")
def container_codes(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.lit("ABCU"), F.lpad((F.col("p_partkey") % 1_000_000).cast("string"), 6, "0"))
    return world.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), codes.container_check(code).cast("int").alias("digit"))


@query("signature_without_bare", """
SELECT 'order/status' AS a FROM orders WHERE o_orderstatus <> 'P' HAVING count(*) > 0 UNION ALL SELECT 'order/total' FROM orders WHERE o_orderstatus <> 'P' HAVING count(*) > 0""")
def signature_without_bare(spark: SparkSession, sf: str) -> DataFrame:
    """What every order carries, once those that carry one attribute only are left out."""
    found = profile.data_signature(profile.current(gappy(spark, sf).log()), bare=False)
    return found.join(world.store(spark, sf).attrs.select(F.col("id").alias("a"), "ident"), "a").select(F.col("ident").alias("a"))


def registrations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(facts, transactions): each order's customer registers an attribute named for the order, those of finished orders among the kernel's names; part-shipped ones are taken back."""
    orders = world.table(spark, sf, "orders")
    tx = (F.lit(5000) + F.col("o_orderkey")).cast("long")
    ident = F.concat(F.when(F.col("o_orderstatus") == "F", "fs/n").otherwise("order/n"), "o_orderkey")
    facts = orders.select(tx.alias("e"), F.lit(KERNEL["fs/ident"]).cast("long").alias("a"), *[
        (ident if t == "string" else F.lit(None)).cast(SPARK_TYPE[t]).alias(c) for t, c in VALUE_COLUMN.items()],
        tx.alias("tx"), (F.col("o_orderstatus") != "P").alias("op"))
    return facts, orders.select(tx.alias("id"), world.entity("customer", "o_custkey").alias("actor"), F.lit("2001-01-01").cast("timestamp").alias("at"))


@query("registered_by", """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'fs/n' ELSE 'order/n' END || o_orderkey AS ident, c_name AS actor FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'""")
def registered_by(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.registered_by(*registrations(spark, sf), world.store(spark, sf).attr("customer/name"))


@query("installed_packages", "SELECT DISTINCT c_name AS actor FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'")
def installed_packages(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.installed(vocabulary.registered_by(*registrations(spark, sf), world.store(spark, sf).attr("customer/name")))


@query("field_authority", """
SELECT lower(replace(p_brand, '#', '')) || '/k' || p_partkey AS ident, CASE WHEN p_size > 25 THEN p_type END AS system FROM part""")
def field_authority(spark: SparkSession, sf: str) -> DataFrame:
    """The authoritative system of each field: parts as fields, the type of the larger ones as their system."""
    parts = world.table(spark, sf, "part")
    attrs = parts.select(F.col("p_partkey").alias("id"), F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/k"), "p_partkey").alias("ident"))
    return vocabulary.field_authority(attrs, parts.where("p_size > 25").select(F.col("p_partkey").alias("e"), F.col("p_type").alias("v")))


@query("allowed_personal", """
SELECT 'person/k' || c_custkey AS ident, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS actor FROM customer WHERE c_mktsegment = 'BUILDING'""")
def allowed_personal(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes flagged as personal and who flagged them: customers as attributes, nations as actors."""
    rows = world.table(spark, sf, "customer")
    flags = rows.select(F.concat(F.lit("person/k"), "c_custkey").alias("ident"), F.col("c_custkey").alias("e"), (F.col("c_mktsegment") == "BUILDING").alias("v"))
    return evidence.allowed_personal(flags, rows.where("c_nationkey < 20").select(F.col("c_custkey").alias("e"), F.col("c_nationkey").alias("actor")))


@query("comparable_values", r"""
SELECT o_orderkey AS k, regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\.?0+$', '') AS total,
 strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d') AS day FROM orders WHERE o_totalprice >= 1""")
def comparable_values(spark: SparkSession, sf: str) -> DataFrame:
    """Totals as canonical text, and the local day one hour east of an instant."""
    instant = F.col("o_orderdate").cast("timestamp")
    return world.table(spark, sf, "orders").where("o_totalprice >= 1").select(
        F.col("o_orderkey").alias("k"), values.comparable(F.col("o_totalprice").cast(world.MONEY), "decimal").alias("total"),
        values.comparable(instant, "instant", "+01:00").alias("day"))


@query("texts_of_everything", """
SELECT 'customer' AS kind, count(*) * 3 AS n FROM customer UNION ALL SELECT 'order', count(*) * 5 FROM orders UNION ALL SELECT 'part', count(*) * 4 FROM part
UNION ALL SELECT 'supplier', count(*) * 2 FROM supplier UNION ALL SELECT 'nation', count(*) * 2 FROM nation UNION ALL SELECT 'region', count(*) FROM region
UNION ALL SELECT 'line', count(*) * 6 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def texts_of_everything(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the store as text, counted by the kind its attribute is about."""
    store = world.store(spark, sf)
    text = fold.facts_text(store.state(), store.attrs).where("v is not null")
    return text.groupBy(F.split_part("a", F.lit("/"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))
