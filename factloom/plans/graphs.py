"""Closures over references drawn from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.operators.ordered import previous, running
from factloom.plans import world
from factloom.plans.registry import query
from factloom.session import written

# Each order supersedes its customer's order before it.
PREVIOUS = """
WITH RECURSIVE prev AS (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders),
edge AS (SELECT src, dst FROM prev WHERE dst IS NOT NULL)"""


def order_chain(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): each order and its customer's order before it."""
    orders = world.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    rows = running(orders, ["o_custkey"], ["o_orderkey"], {"_last": previous("o_orderkey")})
    return rows.where(F.col("_last").isNotNull()).select(F.col("o_orderkey").alias("src"), F.col("_last.o_orderkey").alias("dst"))


@query("same_as_root", """
SELECT o_orderkey AS e, f AS root, false AS cyclic FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders) WHERE o_orderkey <> f""")
def same_as_root(spark: SparkSession, sf: str) -> DataFrame:
    return graph.chain_roots(order_chain(spark, sf))


@query("same_as_cycles", """
WITH first AS (SELECT min(o_orderkey) OVER (PARTITION BY o_custkey) AS f, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey FROM orders)
SELECT o_orderkey AS e, f AS root, true AS cyclic FROM first WHERE n > 1""")
def same_as_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The same chains closed into rings, each customer's first order pointing at the last."""
    orders = world.table(spark, sf, "orders")
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("src"), F.max("o_orderkey").alias("dst")).where("src <> dst")
    return graph.chain_roots(order_chain(spark, sf).unionByName(ends.select("src", "dst")))


@query("person_orders", """
SELECT min(o_orderkey) AS root, count(*) AS accounts, CAST(sum(n) AS BIGINT) AS lines FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def person_orders(spark: SparkSession, sf: str) -> DataFrame:
    """For every chain of orders: how many there are and how many lines they carry between them."""
    orders = world.table(spark, sf, "orders").select(F.col("o_orderkey").alias("e"))
    roots = graph.same_group(graph.chain_roots(order_chain(spark, sf)), orders)
    lines = world.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("e")).agg(F.count("*").alias("n"))
    return roots.join(lines, "e", "left").groupBy("root").agg(F.count("*").alias("accounts"), F.sum("n").alias("lines"))


@query("reachability", """
SELECT 'N' || n_nationkey AS start, 'R' || n_regionkey AS node FROM nation UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation
UNION ALL SELECT 'N' || n_nationkey, 'C' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE false
UNION ALL SELECT 'C' || c_custkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def reachability(spark: SparkSession, sf: str) -> DataFrame:
    """What every customer and nation reaches over zero or more references."""
    customers, nations = world.table(spark, sf, "customer"), world.table(spark, sf, "nation")

    def name(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column))
    edges = customers.select(name("C", "c_custkey").alias("src"), name("N", "c_nationkey").alias("dst")).unionByName(
        nations.select(name("N", "n_nationkey").alias("src"), name("R", "n_regionkey").alias("dst")))
    return graph.reachable(edges, edges.select(F.col("src").alias("start")))


@query("reachability_back", """
SELECT 'R' || n_regionkey AS start, 'N' || n_nationkey AS node FROM nation
UNION ALL SELECT 'R' || n_regionkey, 'S' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def reachability_back(spark: SparkSession, sf: str) -> DataFrame:
    """What points at each region over one or more references."""
    suppliers, nations = world.table(spark, sf, "supplier"), world.table(spark, sf, "nation")
    edges = suppliers.select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst")).unionByName(
        nations.select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst")))
    starts = nations.select(F.concat(F.lit("R"), "n_regionkey").alias("start")).distinct()
    return graph.reachable(edges, starts, at_least=1, reverse=True)


@query("fixpoint", PREVIOUS + """, walk AS (SELECT src AS e, 0 AS depth FROM prev WHERE dst IS NULL
  UNION ALL SELECT edge.src, depth + 1 FROM walk JOIN edge ON edge.dst = walk.e) SELECT e, depth FROM walk""")
def fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    """A recursive relation: how many orders of its customer came before each order."""
    edges = written(order_chain(spark, sf))
    firsts = world.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("e")).select("e", F.lit(0).alias("depth"))
    return graph.fixpoint(firsts, lambda newest: newest.join(edges, newest["e"] == edges["dst"]).select(
        F.col("src").alias("e"), (F.col("depth") + 1).alias("depth")))


@query("components", """
WITH RECURSIVE n AS (SELECT 'P' || p_partkey AS a, 'N' || p_brand || p_name AS b FROM part UNION ALL SELECT 'P' || p_partkey, 'S' || p_brand || p_type || p_size FROM part),
e AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
walk(a, b) AS (SELECT a, a FROM e UNION SELECT walk.a, e.b FROM walk JOIN e ON e.a = walk.b)
SELECT a AS e, min(b) AS root FROM walk GROUP BY 1""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Parts clustered with the names, and the types and sizes, that a brand sells them under."""
    parts = world.table(spark, sf, "part")
    me = F.concat(F.lit("P"), "p_partkey").alias("src")
    return graph.components(parts.select(me, F.concat(F.lit("N"), "p_brand", "p_name").alias("dst")).unionByName(
        parts.select(me, F.concat(F.lit("S"), "p_brand", "p_type", "p_size").alias("dst"))))


@query("linked_via", """
WITH deg AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT DISTINCT o_orderkey AS a, l_partkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def linked_via(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and the parts on their lines, linked through the line records between them."""
    rows = world.lines(spark, sf).select("l_orderkey", "l_linenumber", "part")
    line = world.entity("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    raw = world.table(spark, sf, "lineitem")
    line_raw = world.entity("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    edges = rows.select(line.alias("src"), world.entity("order", "l_orderkey").alias("dst")).unionByName(
        raw.select(line_raw.alias("src"), world.entity("part", "l_partkey").alias("dst")))
    pairs = raw.select(world.entity("order", "l_orderkey").alias("a"), world.entity("part", "l_partkey").alias("b"))
    found = graph.linked(pairs, edges)
    return found.select((F.col("a") % world.WIDTH).alias("a"), (F.col("b") % world.WIDTH).alias("b"))


@query("overmerged", """
SELECT min(o_orderkey) AS root, count(*) - 1 AS n FROM orders GROUP BY o_custkey HAVING count(*) > 4""")
def overmerged(spark: SparkSession, sf: str) -> DataFrame:
    return graph.overmerged(graph.chain_roots(order_chain(spark, sf)))


@query("backlinks", """
SELECT 'order/number' AS identity, count(*) AS n FROM orders UNION ALL
SELECT 'no identity', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def backlinks(spark: SparkSession, sf: str) -> DataFrame:
    """What points at customers and orders, by the identity of the record pointing."""
    store = world.store(spark, sf)
    edges = store.attr("order/customer").unionByName(store.attr("line/order")).select(F.col("e").alias("src"), F.col("v").alias("dst"))
    identity = store.attr("order/number").select("e", F.lit("order/number").alias("ident"))
    targets = store.attr("customer/name").select("e").unionByName(identity.select("e"))
    return graph.backlinks(targets, edges, identity)


@query("levels", """
SELECT 'region' AS kind, 0 AS level, count(*) AS n FROM region UNION ALL SELECT 'nation', 1, count(*) FROM nation
UNION ALL SELECT 'customer', 2, count(*) FROM customer UNION ALL SELECT 'order', 3, count(*) FROM orders""")
def levels(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of orders, customers, nations and regions in the graph of their references."""
    store = world.store(spark, sf)
    refs = store.log(["order/customer", "customer/nation", "nation/region"])
    edges = refs.select(F.col("e").alias("src"), F.col("v_ref").alias("dst"))
    nodes = edges.select(F.col("src").alias("e")).unionByName(edges.select(F.col("dst").alias("e")))
    out, _, _ = graph.levels(nodes, edges)
    kinds = {v: k for k, v in world.KIND.items()}
    kind = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)])[(F.col("e") / world.WIDTH).cast("int")]
    return out.groupBy(kind.alias("kind"), "level").agg(F.count("*").alias("n"))
