"""Business questions over attribute relations: stars, reference paths, sums, derived stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import codes
from factloom.operators import fold, relate
from factloom.plans import world
from factloom.plans.registry import query


def money(c: Column) -> Column:
    return c.cast("decimal(38,2)").cast("double")


@query("open_order_value", """
SELECT c_mktsegment AS segment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
       count(*) AS orders
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' GROUP BY 1""")
def open_order_value(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    orders = store.wide(["order/customer", "order/status", "order/total"])
    segment = store.attr("customer/segment").select("e", F.col("v").alias("segment"))
    return (relate.follow(orders.where(F.col("`order/status`") != "F"), "order/customer", segment)
            .groupBy("segment").agg(money(F.sum("`order/total`")).alias("value"), F.count("*").alias("orders")))


@query("in_transit", """
WITH line AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q
              FROM lineitem GROUP BY 1, 2)
SELECT p_brand AS brand, o_orderstatus AS status, r_name AS region, CAST(sum(q) AS DOUBLE) AS units
FROM line JOIN part ON p_partkey = part JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus IN ('O', 'P') GROUP BY 1, 2, 3""")
def in_transit(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    lines = store.wide(["line/order", "line/part", "line/quantity"])
    orders = store.wide(["order/customer", "order/status"]).where(F.col("`order/status`").isin("O", "P"))
    brand = store.attr("part/brand").select("e", F.col("v").alias("brand"))
    nation = store.attr("customer/nation").select("e", F.col("v").alias("nation"))
    region = store.attr("nation/region").select("e", F.col("v").alias("region_e"))
    name = store.attr("region/name").select("e", F.col("v").alias("region"))
    # dimensions shrink first: a customer's region is settled before any line moves
    where = relate.follow(relate.follow(nation, "nation", region), "region_e", name).select("e", "region")
    orders = relate.follow(orders, "order/customer", where).select("e", F.col("order/status").alias("status"), "region")
    out = relate.follow(relate.follow(lines, "line/order", orders), "line/part", brand)
    return out.groupBy("brand", "status", "region").agg(money(F.sum("`line/quantity`")).alias("units"))


@query("in_transit_asof", """
SELECT 'O-' || o_orderkey AS number, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS placed_on
FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1998-07-01'""")
def in_transit_asof(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    rows = store.wide(["order/number", "order/status", "order/placed_on"], as_of="1998-06-30T12:00:00+00:00")
    return rows.where(F.col("`order/status`").isin("O", "P")).select(
        F.col("order/number").alias("number"), F.col("order/status").alias("status"),
        F.col("order/placed_on").cast("string").alias("placed_on"))


@query("quarter_totals", """
SELECT count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-04-01' AND o_orderdate < TIMESTAMP '1997-07-01'""")
def quarter_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.store(spark, sf).wide(["order/placed_on", "order/total"])
    return rows.where(F.col("`order/placed_on`").between(F.lit("1997-04-01").cast("date"), F.lit("1997-06-30").cast("date"))
                      ).agg(F.count("*").alias("orders"), money(F.sum("`order/total`")).alias("value"))


@query("inspections", """
WITH line AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS supp, min(l_shipdate) AS d FROM lineitem GROUP BY 1, 2)
SELECT s_name AS supplier, o_orderstatus AS result, count(*) AS n FROM line
JOIN supplier ON s_suppkey = supp JOIN orders ON o_orderkey = l_orderkey
WHERE d >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""")
def inspections(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    lines = store.wide(["line/order", "line/supplier", "line/shipped_on"])
    lines = lines.where(F.col("`line/shipped_on`") >= F.lit("1997-01-01").cast("date"))
    name = store.attr("supplier/name").select("e", F.col("v").alias("supplier"))
    status = store.attr("order/status").select("e", F.col("v").alias("result"))
    # counted per (supplier, result) entity first, so names join the few groups, not the lines
    counts = relate.follow(lines, "line/order", status).groupBy("line/supplier", "result").agg(F.count("*").alias("n"))
    return relate.follow(counts, "line/supplier", name).select("supplier", "result", "n")


@query("crosswalk", """
SELECT c_name AS customer, c_mktsegment AS segment, n_name AS nation, r_name AS region
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    hub = store.wide(["customer/name", "customer/segment", "customer/nation"])
    nation = store.wide(["nation/name", "nation/region"])
    region = store.wide(["region/name"])
    nation = relate.follow(nation, "nation/region", region, how="left")
    return relate.follow(hub, "customer/nation", nation, how="left").select(
        F.col("customer/name").alias("customer"), F.col("customer/segment").alias("segment"),
        F.col("nation/name").alias("nation"), F.col("region/name").alias("region"))


@query("open_value", """
WITH line AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS supp, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q,
                     sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p FROM lineitem GROUP BY 1, 2)
SELECT s_name AS supplier, o_orderpriority_status AS status, CAST(sum(q * p) AS DOUBLE) AS value FROM line
JOIN (SELECT o_orderkey, o_orderstatus AS o_orderpriority_status FROM orders) ON o_orderkey = l_orderkey
JOIN supplier ON s_suppkey = supp WHERE o_orderpriority_status <> 'F' GROUP BY 1, 2""")
def open_value(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    lines = store.wide(["line/order", "line/supplier", "line/quantity", "line/price"])
    status = store.attr("order/status").where(F.col("v") != "F").select("e", F.col("v").alias("status"))
    name = store.attr("supplier/name").select("e", F.col("v").alias("supplier"))
    # operands narrowed so the product keeps four exact fraction digits
    worth = F.col("`line/quantity`").cast("decimal(16,2)") * F.col("`line/price`").cast("decimal(16,2)")
    sums = relate.follow(lines, "line/order", status).groupBy("line/supplier", "status").agg(F.sum(worth).alias("value"))
    return relate.follow(sums, "line/supplier", name).select("supplier", "status", F.col("value").cast("double").alias("value"))


@query("provenance", """
SELECT 'O-' || o_orderkey AS number, o_orderstatus AS v, 100000 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS tx,
       r_name AS actor, strftime(o_orderdate, '%Y-%m-%d') AS at
FROM orders JOIN region ON r_regionkey = date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 5""")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    actors = store.tx.select(F.col("id").alias("e"), F.col("actor").alias("v"))
    at = store.tx.select(F.col("id").alias("e"), F.col("at").alias("v"))
    said = fold.provenance(store.attr("order/status"), actors, store.attr("region/name"), at)
    number = store.attr("order/number").select("e", F.col("v").alias("number"))
    return said.join(number, "e").select("number", "v", "tx", "actor", F.date_format("at", "yyyy-MM-dd").alias("at"))


@query("derived_stock", """
WITH line AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp,
                     sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, min(l_shipdate) AS d FROM lineitem GROUP BY 1, 2),
ordered AS (SELECT part, supp, sum(q) AS units FROM line GROUP BY 1, 2),
sailed AS (SELECT part, supp, sum(q) AS units FROM line WHERE d < TIMESTAMP '1999-01-01' GROUP BY 1, 2),
place AS (SELECT s_name AS place, sum(o.units - coalesce(s.units, 0)) AS units FROM ordered o
          LEFT JOIN sailed s ON s.part = o.part AND s.supp = o.supp JOIN supplier ON s_suppkey = o.supp GROUP BY 1),
water AS (SELECT 'on the water' AS place, sum(units) AS units FROM sailed)
SELECT place, CAST(units AS DOUBLE) AS units FROM place WHERE units > 0
UNION ALL SELECT place, CAST(units AS DOUBLE) FROM water WHERE units > 0""")
def derived_stock(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    lines = store.wide(["line/part", "line/supplier", "line/quantity", "line/shipped_on"])
    gone = F.col("`line/shipped_on`") < F.lit("1999-01-01").cast("date")
    q = F.col("`line/quantity`").cast("decimal(18,2)")
    # ordered and sailed come from the same lines, so one aggregate gives both and their difference
    per_supplier = lines.groupBy("line/supplier").agg(
        F.sum(q).alias("ordered"), F.coalesce(F.sum(F.when(gone, q)), F.lit(0)).alias("sailed"))
    name = store.attr("supplier/name").select("e", F.col("v").alias("place"))
    left = relate.follow(per_supplier, "line/supplier", name).select("place", (F.col("ordered") - F.col("sailed")).alias("units"))
    water = per_supplier.agg(F.sum("sailed").alias("units")).select(F.lit("on the water").alias("place"), "units")
    return left.unionByName(water).where("units > 0").select("place", money(F.col("units")).alias("units"))


@query("list_questions", """
SELECT c_name AS customer, count(DISTINCT part) AS parts, count(DISTINCT supp) AS suppliers, count(DISTINCT o_orderkey) AS orders
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2)
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def list_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts, suppliers and orders each customer's lines name."""
    store = world.store(spark, sf)
    lines = store.wide(["line/order", "line/part", "line/supplier"])
    who = store.attr("order/customer").select("e", F.col("v").alias("customer_e"))
    owned = relate.follow(lines, "line/order", who)
    name = store.attr("customer/name").select("e", F.col("v").alias("customer"))
    # distinct per value first, so one customer with many lines stays spread
    counts = relate.distinct_counts(owned, "customer_e", {"line/part": "parts", "line/supplier": "suppliers", "line/order": "orders"})
    return relate.follow(counts, "customer_e", name).select("customer", "parts", "suppliers", "orders")


@query("closed_that_sold", """
SELECT DISTINCT s_name AS supplier FROM supplier WHERE s_suppkey IN
 (SELECT supp FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2)
  JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
INTERSECT SELECT s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name IN ('ASIA', 'EUROPE')""")
def closed_that_sold(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of two regions that also sold on a part-shipped order: a set intersection."""
    store = world.store(spark, sf)
    lines = store.wide(["line/order", "line/supplier"])
    p_orders = store.attr("order/status").where(F.col("v") == "P").select(F.col("e").alias("line/order"))
    sold = lines.join(p_orders, "line/order", "left_semi").select(F.col("line/supplier").alias("e")).distinct()
    asia = store.attr("region/name").where(F.col("v").isin("ASIA", "EUROPE")).select("e")
    nation = relate.follow(store.attr("nation/region").withColumnRenamed("v", "region"), "region", asia).select("e")
    there = relate.follow(store.attr("supplier/nation").withColumnRenamed("v", "nation"), "nation", nation).select("e")
    return store.attr("supplier/name").join(sold.intersect(there), "e", "left_semi").select(F.col("v").alias("supplier"))


@query("po_value", """
SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, count(DISTINCT l_linenumber) AS lines,
 CAST(min(q) AS DOUBLE) AS least, CAST(max(q) AS DOUBLE) AS most FROM
 (SELECT l_orderkey, l_linenumber, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS l_extendedprice, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def po_value(spark: SparkSession, sf: str) -> DataFrame:
    lines = world.store(spark, sf).wide(["line/order", "line/price", "line/quantity"])
    q = F.col("`line/quantity`")
    return lines.groupBy((F.col("`line/order`") % world.WIDTH).alias("k")).agg(
        money(F.sum("`line/price`")).alias("value"), F.count("*").alias("lines"), money(F.min(q)).alias("least"), money(F.max(q)).alias("most"))


@query("shop_questions", """
SELECT c_custkey AS customer, count(DISTINCT o_orderkey) AS invoices, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS cancelled,
 count(DISTINCT p_brand) AS products FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def shop_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices, cancelled ones and products of each customer, from a sheet that writes customers as
    decimals, invoices with a C when cancelled, and products in mixed case."""
    orders, parts = world.table(spark, sf, "orders"), world.table(spark, sf, "part")
    sheet = world.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat("o_custkey", F.lit(".0")).alias("customer"),
        F.concat(F.when(F.col("o_orderstatus") == "P", "C").otherwise(""), "o_orderkey").alias("invoice"),
        F.when(F.col("p_size") > 25, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("product"))
    rows = sheet.select(codes.whole_number_id(F.col("customer")).cast("long").alias("customer"), "invoice",
                        F.when(F.col("invoice").startswith("C"), F.col("invoice")).alias("cancelled"), codes.normal_code(F.col("product")).alias("product"))
    return relate.distinct_counts(rows, "customer", {"invoice": "invoices", "cancelled": "cancelled", "product": "products"})
