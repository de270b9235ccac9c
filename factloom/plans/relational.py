"""Joins, aggregates, ranking, predicates and patterns over attribute relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import evidence, fold, pattern, relate
from factloom.operators.ordered import Running, running
from factloom.operators.pattern import Var
from factloom.plans import world
from factloom.plans.business import money
from factloom.plans.registry import query
from factloom.plans.temporal import WALK, event_store, quotes

LINE = "line AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p, min(l_shipdate) AS d FROM lineitem GROUP BY 1, 2)"


@query("predicates", """
SELECT 20000000000 + o_orderkey AS e FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 250000.50
 AND CAST(o_orderdate AS DATE) <> DATE '1996-02-29' AND o_orderstatus NOT IN ('P') AND o_orderstatus < 'P'""")
def predicates(spark: SparkSession, sf: str) -> DataFrame:
    return pattern.match(world.store(spark, sf), {
        "order/total": lambda c: c >= F.lit("250000.50").cast("decimal(38,18)"),
        "order/placed_on": lambda c: c != F.lit("1996-02-29").cast("date"),
        "order/status": lambda c: ~c.isin("P") & (c < "P")}).select("e")


@query("string_predicates", """
SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'red') OR contains(p_name, 'ring') OR (p_brand LIKE 'Brand#1%' AND regexp_full_match(p_type, '[A-Z]+L'))""")
def string_predicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.store(spark, sf).wide(["part/name", "part/brand", "part/type"])
    name, brand, kind = (F.col(f"`part/{c}`") for c in ("name", "brand", "type"))
    return rows.where(name.startswith("red") | name.contains("ring") | (brand.like("Brand#1%") & kind.rlike("^[A-Z]+L$"))).select(
        (F.col("e") % world.WIDTH).alias("k"))


@query("arithmetic", """
WITH """ + LINE + """ SELECT 70000000000 + l_orderkey * 10 + l_linenumber AS e, CAST(p / q AS DOUBLE) > 1000 AS dear,
 date_diff('day', CAST(o_orderdate AS DATE), CAST(d AS DATE)) AS days, CAST(p - q AS DOUBLE) AS net FROM line JOIN orders ON o_orderkey = l_orderkey""")
def arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    lines = store.wide(["line/order", "line/quantity", "line/price", "line/shipped_on"])
    placed = store.attr("order/placed_on").select("e", F.col("v").alias("placed"))
    p, q = F.col("`line/price`").cast("decimal(18,2)"), F.col("`line/quantity`").cast("decimal(18,2)")
    return relate.follow(lines, "line/order", placed).select(
        "e", (p / q > 1000).alias("dear"), F.date_diff("line/shipped_on", "placed").cast("long").alias("days"), money(p - q).alias("net"))


@query("ref_forward", """
SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def ref_forward(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    name = store.attr("nation/name").select("e", F.col("v").alias("nation"))
    return relate.follow(store.wide(["customer/segment", "customer/nation"]), "customer/nation", name).groupBy(
        F.col("customer/segment").alias("segment"), "nation").agg(F.count("*").alias("n"))


@query("ref_reverse", """
SELECT n_name AS nation, c_name AS customer FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def ref_reverse(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    nations = store.attr("nation/name").select("e", F.col("v").alias("nation"))
    held = relate.referrers(nations, store.attr("customer/nation"), "c").select("nation", F.col("c").alias("e"))
    return held.join(store.attr("customer/name").select("e", F.col("v").alias("customer")), "e").select("nation", "customer")


@query("optional_attribute", """
SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size > 25 THEN CAST(p_size AS BIGINT) END AS size FROM part""")
def optional_attribute(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    big = store.attr("part/size").where(F.col("v") > 25)
    rows = relate.star({"name": store.attr("part/name"), "size": big}, optional=("size",))
    return rows.select((F.col("e") % world.WIDTH).alias("k"), "name", F.col("size").cast("long").alias("size"))


@query("set_agg", """
WITH """ + LINE + """ SELECT o_orderstatus AS status, CAST(sum(q) AS DOUBLE) AS units FROM
 (SELECT DISTINCT o_orderstatus, part, q FROM line JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""")
def set_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities added once per distinct (status, part, quantity)."""
    out = relate.set_aggregate(status_lines(spark, sf), ["status"], ["part", "q"], F.sum("q").alias("units"))
    return out.select("status", money(F.col("units")).alias("units"))


@query("bag_agg", """
WITH """ + LINE + """ SELECT o_orderstatus AS status, CAST(sum(q) AS DOUBLE) AS units, count(*) AS n FROM line JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def bag_agg(spark: SparkSession, sf: str) -> DataFrame:
    return status_lines(spark, sf).groupBy("status").agg(money(F.sum("q")).alias("units"), F.count("*").alias("n"))


def status_lines(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    status = store.attr("order/status").select("e", F.col("v").alias("status"))
    return relate.follow(store.wide(["line/order", "line/part", "line/quantity"]), "line/order", status).select(
        "status", F.col("line/part").alias("part"), F.col("line/quantity").cast(world.MONEY).alias("q"))


@query("empty_aggregate", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS value")
def empty_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.store(spark, sf).attr("order/total").where(F.col("v") < 0)
    return rows.agg(F.count("*").alias("n"), money(F.sum("v")).alias("value"))


@query("filtered_aggregate", """
SELECT o_custkey AS customer, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'P') AS part_shipped,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus <> 'F') AS DOUBLE) AS open FROM orders GROUP BY 1""")
def filtered_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.store(spark, sf).wide(["order/customer", "order/status", "order/total"])
    status = F.col("`order/status`")
    return rows.groupBy((F.col("`order/customer`") % world.WIDTH).alias("customer")).agg(
        F.count("*").alias("orders"), F.count_if(status == "P").alias("part_shipped"),
        money(F.sum(F.when(status != "F", F.col("`order/total`")))).alias("open"))


@query("distinct_list", """
SELECT c_nationkey AS nation, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1""")
def distinct_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.store(spark, sf).wide(["customer/nation", "customer/segment"])
    kept = F.array_sort(F.collect_set("customer/segment"))
    return rows.groupBy((F.col("`customer/nation`") % world.WIDTH).cast("int").alias("nation")).agg(
        F.array_join(kept, ",").alias("segments"), F.size(kept).cast("long").alias("n"))


@query("mode", """
WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT nation, arg_max(s, n * 1000 + ascii(s)) AS segment, max(n) AS n FROM c GROUP BY 1""")
def mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.store(spark, sf).wide(["customer/nation", "customer/segment"]).select(
        (F.col("`customer/nation`") % world.WIDTH).cast("int").alias("nation"), F.col("customer/segment").alias("segment"))
    return relate.most_common(rows, ["nation"], "segment").select("nation", F.col("mode").alias("segment"), "n")


@query("group_sizes", """
SELECT n AS size, count(*) AS groups FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return world.store(spark, sf).attr("order/customer").groupBy("v").agg(F.count("*").alias("size")).groupBy("size").agg(
        F.count("*").alias("groups"))


@query("namespace_counts", """
WITH """ + LINE + """ SELECT 'customer' AS namespace, 3 * count(*) AS facts FROM customer UNION ALL SELECT 'nation', 2 * count(*) FROM nation
UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', 2 * count(*) FROM supplier UNION ALL SELECT 'part', 4 * count(*) FROM part
UNION ALL SELECT 'order', 5 * count(*) FROM orders UNION ALL SELECT 'line', 6 * count(*) FROM line""")
def namespace_counts(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    per = store.log().groupBy("a").agg(F.count("*").alias("n"))
    return per.join(store.attrs.select(F.col("id").alias("a"), "ident"), "a").groupBy(
        F.split_part("ident", F.lit("/"), F.lit(1)).alias("namespace")).agg(F.sum("n").alias("facts"))


@query("lead_time", """
WITH """ + LINE + """, days AS (SELECT o_orderstatus AS status, date_diff('day', CAST(o_orderdate AS DATE), CAST(d AS DATE)) AS n FROM line JOIN orders ON o_orderkey = l_orderkey)
SELECT status, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(n, 0.95) AS DOUBLE) AS p95, CAST(max(n) AS BIGINT) AS longest FROM days GROUP BY 1""")
def lead_time(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    orders = store.wide(["order/placed_on", "order/status"])
    rows = relate.follow(store.wide(["line/order", "line/shipped_on"]), "line/order", orders)
    days = F.date_diff("line/shipped_on", "order/placed_on")
    # counted per distinct day first: percentiles take frequencies, so a group is a few hundred rows
    counted = rows.groupBy(F.col("order/status").alias("status"), days.alias("n")).agg(F.count("*").alias("f"))
    return counted.groupBy("status").agg(
        F.expr("percentile(n, 0.5D, f)").alias("median"), F.expr("percentile(n, 0.95D, f)").alias("p95"),
        F.max("n").cast("long").alias("longest"))


@query("monthly", """
SELECT strftime(ts - INTERVAL 5 HOUR, '%Y-%m') AS month, event_type AS channel, count(*) AS n FROM events GROUP BY 1, 2""")
def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Events per New York month and kind; standard time is five hours behind in winter."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return world.table(spark, sf, "events").groupBy(F.date_format(local, "yyyy-MM").alias("month"), F.col("event_type").alias("channel")).agg(
        F.count("*").alias("n"))


@query("returning_share", """
SELECT count(*) AS orders, count(*) - count(DISTINCT o_custkey) AS returning, round((count(*) - count(DISTINCT o_custkey)) / count(*), 6) AS share FROM orders""")
def returning_share(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by customers who had ordered before: all but the first of each."""
    per = world.store(spark, sf).attr("order/customer").groupBy("v").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("orders"), F.sum(F.col("n") - 1).alias("returning")).withColumn(
        "share", F.round(F.col("returning") / F.col("orders"), 6))


@query("distinct_on", """
SELECT o_custkey AS customer, o_orderkey AS last, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's latest order, whole."""
    rows = world.store(spark, sf).wide(["order/customer", "order/placed_on", "order/total"])
    last = rows.groupBy((F.col("`order/customer`") % world.WIDTH).alias("customer")).agg(
        F.max_by(F.struct("e", F.col("order/total").alias("total")), F.struct("order/placed_on", "e")).alias("r"))
    return last.select("customer", (F.col("r.e") % world.WIDTH).alias("last"), money(F.col("r.total")).alias("total"))


@query("order_limit", """
SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders
ORDER BY status DESC NULLS FIRST, k LIMIT 50""")
def order_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.store(spark, sf).attr("order/status").select((F.col("e") % world.WIDTH).alias("k"), F.nullif("v", F.lit("P")).alias("status"))
    return rows.orderBy(F.col("status").desc_nulls_first(), "k").limit(50)


@query("union_all", """
SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation""")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    parts = [store.attr(a).select(F.col("v").alias("name")) for a in ("customer/name", "supplier/name", "nation/name", "nation/name")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("bag_diff", """
WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders), b AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS s FROM orders),
n AS (SELECT k, s, sum(n) AS n FROM (SELECT k, s, 1 AS n FROM a UNION ALL SELECT k, s, -1 FROM b) GROUP BY 1, 2)
SELECT k, s, CAST(greatest(n, 0) AS BIGINT) AS missing, CAST(greatest(-n, 0) AS BIGINT) AS extra FROM n WHERE n <> 0""")
def bag_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.store(spark, sf).wide(["order/customer", "order/status"]).select(
        (F.col("`order/customer`") % world.WIDTH).alias("k"), F.col("order/status").alias("s"))
    changed = rows.withColumn("s", F.when(F.col("s") == "P", "F").otherwise(F.col("s")))
    return relate.bag_difference(rows, changed)


@query("bare_records", """
SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT min(l_partkey) FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def bare_records(spark: SparkSession, sf: str) -> DataFrame:
    """Parts no line refers to."""
    store = world.store(spark, sf)
    used = store.attr("line/part").select(F.col("v").alias("e"))
    return relate.lacking(store.attr("part/name"), used).select((F.col("e") % world.WIDTH).alias("k"))


@query("entity_pull", """
SELECT 10000000000 + c_custkey AS e, 'customer/name' AS attribute, c_name AS value FROM customer
UNION ALL SELECT 10000000000 + c_custkey, 'customer/nation', CAST(50000000000 + c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 10000000000 + c_custkey, 'customer/segment', c_mktsegment FROM customer""")
def entity_pull(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    state = fold.state(store.log(["customer/name", "customer/nation", "customer/segment"]))
    return relate.pull(state, store.attrs, V.any_text())


@query("nested_pull", """
SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def nested_pull(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer with the record of its nation nested, and of its region in that."""
    store = world.store(spark, sf)
    region = store.wide(["region/name"]).select("e", F.struct(F.col("region/name").alias("name")).alias("region"))
    nation = relate.follow(store.wide(["nation/name", "nation/region"]), "nation/region", region).select(
        "e", F.struct(F.col("nation/name").alias("name"), "region").alias("nation"))
    out = relate.follow(store.wide(["customer/name", "customer/nation"]), "customer/nation", nation)
    return out.select(F.col("customer/name").alias("customer"), F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


@query("evidence_join", """
SELECT o_orderkey AS document, count(*) AS facts, CAST(sum(v) AS DOUBLE) AS value FROM
 (SELECT l_partkey, l_orderkey, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1, 2)
 JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def evidence_join(spark: SparkSession, sf: str) -> DataFrame:
    """What each document backs: its facts and their value."""
    hist, cited, _ = quotes(spark, sf)
    return evidence.backed(hist, cited).groupBy((F.col("document") % world.WIDTH).alias("document")).agg(
        F.count("*").alias("facts"), money(F.sum("v")).alias("value"))


@query("pattern", """
SELECT 'order/status' AS a, 'P' AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'part/size', '7', count(*) FROM part WHERE p_size = 7 HAVING count(*) > 0
UNION ALL SELECT 'line/quantity', '7', count(*) FROM (SELECT sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE q = 7
UNION ALL SELECT 'customer/segment', 'BUILDING', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'""")
def any_attribute(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern with a variable attribute: which attributes hold a few given texts, how often."""
    rows = pattern.pattern(world.store(spark, sf), Var("e"), Var("a"), Var("v"))
    return rows.where(F.col("v").isin("P", "7", "BUILDING")).groupBy("a", "v").agg(F.count("*").alias("n"))


@query("conjunction", """
SELECT c_name AS customer, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_mktsegment = 'BUILDING'""")
def conjunction(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    rows = pattern.conjunction(
        pattern.pattern(store, Var("o"), "order/status", "P"), pattern.pattern(store, Var("o"), "order/customer", Var("c")),
        pattern.pattern(store, Var("c"), "customer/segment", "BUILDING"), pattern.pattern(store, Var("c"), "customer/name", Var("customer")))
    return rows.select("customer", (F.col("o") % world.WIDTH).alias("k"))


@query("not_join", """
SELECT c_name AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def not_join(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    held = pattern.conjunction(pattern.pattern(store, Var("o"), "order/customer", Var("c")), pattern.pattern(store, Var("o"), "order/status", "P"))
    return pattern.exclude(pattern.pattern(store, Var("c"), "customer/name", Var("customer")), held, ["c"]).select("customer")


@query("or_join", """
SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def or_join(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    first = pattern.conjunction(pattern.pattern(store, Var("o"), "order/customer", Var("c")), pattern.pattern(store, Var("o"), "order/status", "P"))
    second = pattern.pattern(store, Var("c"), "customer/segment", "BUILDING")
    return pattern.either(first, second, variables=["c"]).select((F.col("c") % world.WIDTH).alias("c"))


@query("get_else", """
SELECT p_partkey AS k, coalesce(CAST(min(q) AS BIGINT), -1) AS least FROM part LEFT JOIN
 (SELECT min(l_partkey) AS part, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) ON part = p_partkey GROUP BY 1""")
def get_else(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's smallest line quantity, or -1 where no line names it."""
    store = world.store(spark, sf)
    least = store.wide(["line/part", "line/quantity"]).groupBy(F.col("line/part").alias("e")).agg(F.min("line/quantity").alias("v"))
    rows = relate.with_default(store.attr("part/name").select("e"), least, "least", F.lit(-1))
    return rows.select((F.col("e") % world.WIDTH).alias("k"), F.col("least").cast("long").alias("least"))


@query("missing_attribute", """
SELECT 80000000000 + user_id AS e FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase' AND CAST(regexp_extract(props, '[0-9]+') AS INT) % 4 <> 0) = 0""")
def missing_attribute(spark: SparkSession, sf: str) -> DataFrame:
    """Users of whom no purchase was ever recorded."""
    store = event_store(spark, sf)
    users = world.table(spark, sf, "events").select(world.entity("user", "user_id").alias("e")).distinct()
    return pattern.exclude(users, pattern.pattern(store, Var("e"), "user/purchase", source="log"))


@query("nested_pattern", """
WITH """ + LINE + """ SELECT o_orderkey AS k, n_name AS nation, CAST(q AS DOUBLE) AS quantity FROM line JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE o_orderstatus IN ('O', 'P') AND r_name = 'ASIA' AND q > 60""")
def nested_pattern(spark: SparkSession, sf: str) -> DataFrame:
    rows = pattern.match(world.store(spark, sf), {
        "order/status": lambda c: c.isin("O", "P"),
        "order/customer": {"customer/nation": {"nation/name": Var("nation"), "nation/region": {"region/name": "ASIA"}}},
        "^line/order": {"as": "l", "line/quantity": lambda c: c > 60}}, "o")
    held = world.store(spark, sf).attr("line/quantity").select(F.col("e").alias("l"), F.col("v").alias("quantity"))
    return rows.join(held, "l").select((F.col("o") % world.WIDTH).alias("k"), "nation", money(F.col("quantity")).alias("quantity"))


@query("log_pattern", WALK + """SELECT e, count(DISTINCT v) AS n FROM canon WHERE a = 'user/view' AND NOT op
AND tx > (SELECT max(1000000 + event_id) FROM events WHERE ts <= TIMESTAMP '2024-01-15') GROUP BY 1""")
def log_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Retracted views after the first half of the month, by user."""
    store = event_store(spark, sf)
    mark = store.resolve("2024-01-15T00:00:00Z")
    rows = pattern.pattern(store, Var("e"), "user/view", Var("v"), lambda c: c > mark, "retract", source="log")
    return pattern.find(rows, ["e"], {"n": F.count("*")})


@query("find_aggregates", """
SELECT c_mktsegment AS segment, count(DISTINCT c_nationkey) AS nations, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def find_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rows = pattern.match(world.store(spark, sf), {
        "order/total": Var("total"), "order/customer": {"as": "c", "customer/segment": Var("segment"), "customer/nation": Var("nation")}}, "o")
    bag = pattern.find(rows, ["segment"], {"value": money(F.sum("total"))})
    nations = pattern.find(rows, ["segment"], {"nations": F.count("*")}, basis=["nation"])
    return bag.join(nations, "segment").select("segment", "nations", "value")


@query("sql_relations", """
SELECT n_name AS nation, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2""")
def sql_relations(spark: SparkSession, sf: str) -> DataFrame:
    return world.store(spark, sf).sql("""
        select nn.v as nation, st.v as status, count(*) as n from "order/status" st join "order/customer" oc on oc.e = st.e
        join "customer/nation" cn on cn.e = oc.v join "nation/name" nn on nn.e = cn.v group by 1, 2""", as_of="1998-12-31T00:00:00+00:00")


@query("forward_only", """
WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS rank FROM events),
m AS (SELECT *, max(rank) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r)
SELECT user_id, event_id, CAST(rank AS INT) AS rank FROM m WHERE seen IS NULL OR rank > seen""")
def forward_only(spark: SparkSession, sf: str) -> DataFrame:
    """Events that move a user further along a ranked list of kinds than any before."""
    ranks = F.create_map(*[F.lit(x) for i, t in enumerate(["signup", "view", "click", "purchase", "error"], 1) for x in (t, i)])
    rows = world.table(spark, sf, "events").select("user_id", "event_id", ranks[F.col("event_type")].alias("rank"))
    return evidence.forward_only(rows, ["user_id"], ["event_id"], "rank")


@query("reply_context", """
WITH t AS (SELECT conv_id, turn, role, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS island,
 max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations)
SELECT t.conv_id, t.turn, t.island, q.text AS question FROM t JOIN conversations q ON q.conv_id = t.conv_id AND q.turn = t.asked WHERE t.role = 'assistant'""")
def reply_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each reply with the message of the other side it is read against."""
    rows = world.table(spark, sf, "conversations")
    return evidence.reply_context(rows, ["conv_id"], "turn", F.col("role") == "user", "text").where("role = 'assistant'").where(
        F.col("asked").isNotNull()).select("conv_id", "turn", "island", F.col("asked").alias("question"))


@query("running_totals", """
SELECT user_id, event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS total FROM events""")
def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.table(spark, sf, "events").select("user_id", "event_id", F.col("value").cast(world.MONEY).alias("x"))
    return running(rows, ["user_id"], ["event_id"], {"total": Running("sum", F.col("x"))}).select("user_id", "event_id", money(F.col("total")).alias("total"))


@query("top_per_group", """
SELECT o_custkey AS customer, o_orderkey AS k, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's three largest orders; Spark limits groups before it shuffles them."""
    rows = world.store(spark, sf).wide(["order/customer", "order/total"]).select(
        (F.col("`order/customer`") % world.WIDTH).alias("customer"), (F.col("e") % world.WIDTH).alias("k"), F.col("order/total").alias("t"))
    spec = W.partitionBy("customer").orderBy(F.desc("t"), "k")
    return rows.withColumn("n", F.row_number().over(spec)).where("n <= 3").select("customer", "k", "n")


@query("carrier_identity", """
SELECT 'customer/name' AS a, count(*) AS n FROM customer UNION ALL SELECT 'supplier/name', count(*) FROM supplier""")
def carrier_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Which attributes hold the names of customers and suppliers."""
    store = world.store(spark, sf)
    names = world.table(spark, sf, "customer").select(F.col("c_name").alias("v")).unionByName(world.table(spark, sf, "supplier").select(F.col("s_name").alias("v")))
    state = fold.state(store.log(["customer/name", "supplier/name", "nation/name", "part/name", "order/number"]))
    return relate.carrier_identity(names, state).join(store.attrs.select(F.col("id").alias("a"), "ident"), "a").select(F.col("ident").alias("a"), "n")
