"""Queries of whole records: nested pulls, crosswalks, linking through wholes, closed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import Attribute, kernel_attributes, registry
from factloom.operators import closure, crosswalk, layouts, pull, relate, score, wholes
from factloom.plans import world
from factloom.plans.graphs import order_chain
from factloom.plans.registry import query
from factloom.session import written
from factloom.sources.mapping import as_facts, union
from factloom.store import FactLog

REPLACES = Attribute(1950, "order/replaces", "ref", "one", "none", "Order of the same customer that an order replaces.")


@query("pulled_orders", """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS k, 'O-' || o_orderkey AS number, o_orderstatus AS status, c_name AS customer, c_mktsegment AS segment, n_name AS nation, r_name AS region,
 CAST(count(l_linenumber) AS INT) AS lines, string_agg(p_name || ' x' || CAST(CAST(q AS INT) AS VARCHAR), ', ' ORDER BY l_linenumber) AS parts
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = part
GROUP BY ALL""")
def pulled_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as one record: its customer with nation and region, and its lines with their parts."""
    store = world.store(spark, sf)
    shape = ["order/number", "order/status",
             {"order/customer": ["customer/name", "customer/segment", {"customer/nation": ["nation/name", {"nation/region": ["region/name"]}]}]},
             {"~line/order": ["line/quantity", {"line/part": ["part/name"]}]}]
    r = pull.nested(store, shape, store.attr("order/number")).select("record.*")
    nation = F.col("`order/customer`")["customer/nation"]
    part = F.transform("`~line/order`", lambda x: F.concat(x["line/part"]["part/name"], F.lit(" x"), x["line/quantity"].cast("int")))
    return r.select(
        (F.col("id") % world.WIDTH).alias("k"), F.col("`order/number`").alias("number"), F.col("`order/status`").alias("status"),
        F.col("`order/customer`")["customer/name"].alias("customer"), F.col("`order/customer`")["customer/segment"].alias("segment"),
        nation["nation/name"].alias("nation"), nation["nation/region"]["region/name"].alias("region"),
        F.coalesce(F.size(F.filter("`~line/order`", lambda x: x["id"].isNotNull())), F.lit(0)).alias("lines"), F.array_join(part, ", ").alias("parts"))


def replaced_orders(spark: SparkSession, sf: str) -> FactLog:
    """Orders that each replace their customer's order before; the first of each customer replaces the last, which closes a ring."""
    orders = world.table(spark, sf, "orders")
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("src"), F.max("o_orderkey").alias("dst"))
    ring = order_chain(spark, sf).unionByName(ends.select("src", "dst"))
    replaces = as_facts(ring, world.entity("order", "src"), F.lit(world.DAY_TX), {REPLACES: world.entity("order", "dst")})
    facts = union([world.facts(spark, sf, ["order/status", "order/total"]), replaces])
    return FactLog.of(facts, registry(spark, [*kernel_attributes(), *world.ATTRIBUTES, REPLACES]), world.transactions(spark, sf))


@query("pulled_rings", """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s, coalesce(lag(o_orderkey) OVER w, max(o_orderkey) OVER (PARTITION BY o_custkey)) AS p
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT a.k, a.s AS status, b.k AS first, CASE WHEN b.k <> a.k THEN b.s END AS first_status, CASE WHEN b.k <> a.k THEN c.k END AS second,
 CASE WHEN b.k <> a.k AND c.k <> a.k THEN c.s END AS second_status, CASE WHEN b.k <> a.k AND c.k <> a.k THEN d.k END AS third,
 CASE WHEN b.k <> a.k AND c.k <> a.k AND d.k <> a.k THEN d.s END AS third_status
FROM r a JOIN r b ON b.k = a.p JOIN r c ON c.k = b.p JOIN r d ON d.k = c.p""")
def pulled_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Three orders back along rings of replaced orders, ended where a ring closes."""
    store = replaced_orders(spark, sf)
    r = pull.nested(store, ["order/status", {"order/replaces": 3}], store.attr("order/status")).select("record.*")
    first = F.col("`order/replaces`")
    second, third = first["order/replaces"], first["order/replaces"]["order/replaces"]
    return r.select((F.col("id") % world.WIDTH).alias("k"), F.col("`order/status`").alias("status"), *[
        c for name, at in (("first", first), ("second", second), ("third", third))
        for c in ((at["id"] % world.WIDTH).alias(name), at["order/status"].alias(f"{name}_status"))])


@query("pulled_rows", """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS t, coalesce(lag(o_orderkey) OVER w, max(o_orderkey) OVER (PARTITION BY o_custkey)) AS p
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
w AS (SELECT k AS root, k AS e, 0 AS d FROM r UNION ALL SELECT a.k, b.k, 1 FROM r a JOIN r b ON b.k = a.p WHERE b.k <> a.k
  UNION ALL SELECT a.k, c.k, 2 FROM r a JOIN r b ON b.k = a.p JOIN r c ON c.k = b.p WHERE b.k <> a.k AND c.k <> a.k)
SELECT d AS depth, 'order/status' AS attribute, s AS value, count(*) AS n, CAST(0 AS BIGINT) AS cut, CAST(sum(root) AS BIGINT) AS roots FROM w JOIN r ON k = e GROUP BY ALL
UNION ALL SELECT d, 'order/replaces', 'a reference', count(*), count(*) FILTER (WHERE p = root), CAST(sum(root) AS BIGINT) FROM w JOIN r ON k = e GROUP BY ALL
UNION ALL SELECT d, 'order/total', 'an amount', count(*), 0, CAST(sum(root) AS BIGINT) FROM w JOIN r ON k = e GROUP BY ALL""")
def pulled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Everything about every order, and about the two it replaces, a row a value, counted by depth."""
    store = replaced_orders(spark, sf)
    found = pull.rows(store, store.attr("order/status"), 2)
    told = F.when(F.col("attribute") == "order/replaces", "a reference").when(F.col("attribute") == "order/total", "an amount").otherwise(F.col("value"))
    return found.groupBy((F.size("path") - 1).alias("depth"), "attribute", told.alias("value")).agg(
        F.count("*").alias("n"), F.count_if("cut").alias("cut"), F.sum(F.col("root") % world.WIDTH).alias("roots"))


#: Ids of a part: its own, and what its lines lead to.
_ON_ORDER = ("~line/part", "line/order")
_BUYER = (*_ON_ORDER, "order/customer")
_SELLER = ("~line/part", "line/supplier")
PART_SYSTEMS: dict[str, crosswalk.System] = {
    "name": ((), "part/name"), "brand": ((), "part/brand"), "type": ((), "part/type"),
    "order_no": (_ON_ORDER, "order/number"), "status": (_ON_ORDER, "order/status"),
    "buyer": (_BUYER, "customer/name"), "buyer_nation": ((*_BUYER, "customer/nation"), "nation/name"),
    "buyer_region": ((*_BUYER, "customer/nation", "nation/region"), "region/name"),
    "seller": (_SELLER, "supplier/name"), "seller_nation": ((*_SELLER, "supplier/nation"), "nation/name"),
    "seller_region": ((*_SELLER, "supplier/nation", "nation/region"), "region/name"),
}
_PART_IDS = """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2),
x AS (SELECT part AS hub, 'O-' || o_orderkey AS order_no, o_orderstatus AS status, c_name AS buyer, cn.n_name AS buyer_nation, cr.r_name AS buyer_region,
   s_name AS seller, sn.n_name AS seller_nation, sr.r_name AS seller_region
 FROM l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region cr ON cr.r_regionkey = cn.n_regionkey
 JOIN supplier ON s_suppkey = supp JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN region sr ON sr.r_regionkey = sn.n_regionkey),
ids AS (SELECT DISTINCT hub, system, value FROM x UNPIVOT (value FOR system IN (order_no, status, buyer, buyer_nation, buyer_region, seller, seller_nation, seller_region))
 UNION ALL SELECT p_partkey, 'name', p_name FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part)
"""


@query("crosswalk_systems", _PART_IDS + """
SELECT hub, """ + ", ".join(f"min(value) FILTER (WHERE system = '{s}') AS {s}, count(*) FILTER (WHERE system = '{s}') AS {s}_n" for s in PART_SYSTEMS) + """
FROM ids GROUP BY hub""")
def crosswalk_systems(spark: SparkSession, sf: str) -> DataFrame:
    """A row a part over eleven systems, eight of them through its lines."""
    known = crosswalk.ids(world.store(spark, sf), PART_SYSTEMS)
    return crosswalk.table(known, PART_SYSTEMS).withColumn("hub", F.col("hub") % world.WIDTH)


@query("crosswalk_from_names", _PART_IDS + """
SELECT given, system, count(*) AS n, min(value) AS least, max(value) AS greatest
FROM (SELECT DISTINCT g.value AS given, k.system, k.value FROM ids g JOIN ids k ON k.hub = g.hub WHERE g.system = 'name' AND (k.system <> 'name' OR k.value <> g.value))
GROUP BY 1, 2""")
def crosswalk_from_names(spark: SparkSession, sf: str) -> DataFrame:
    """From the name of every part to its ids in the other systems."""
    given = world.table(spark, sf, "part").select(F.lit("name").alias("system"), F.col("p_name").alias("value"))
    return crosswalk.translated(world.store(spark, sf), PART_SYSTEMS, given).groupBy("given", "system").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query("closed_sample_limited", """
WITH RECURSIVE line AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k, l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem),
up AS (SELECT 'nation' AS st, CAST(n_nationkey AS BIGINT) AS s, 'region' AS tt, CAST(n_regionkey AS BIGINT) AS t, NULL AS most FROM nation
 UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey, 20 FROM customer UNION ALL SELECT 'supplier', s_suppkey, 'nation', s_nationkey, 0 FROM supplier
 UNION ALL SELECT 'orders', o_orderkey, 'customer', o_custkey, 3 FROM orders UNION ALL SELECT DISTINCT 'lineitem', k, 'orders', o, 2 FROM line
 UNION ALL SELECT DISTINCT 'lineitem', k, 'part', p, 0 FROM line UNION ALL SELECT DISTINCT 'lineitem', k, 'supplier', s, 0 FROM line),
edge AS (SELECT st AS a, s AS x, tt AS b, t AS y FROM up UNION ALL SELECT tt, t, st, s FROM
  (SELECT *, row_number() OVER (PARTITION BY st, tt, t ORDER BY sha256(CAST(s AS VARCHAR))) AS n FROM up) WHERE most IS NULL OR n <= most),
reach AS (SELECT 'region' AS kind, CAST(2 AS BIGINT) AS k UNION SELECT b, y FROM reach JOIN edge ON a = kind AND x = k),
kept AS (SELECT 'region' AS name, r_regionkey AS k FROM region UNION ALL SELECT 'nation', n_nationkey FROM nation UNION ALL SELECT 'customer', c_custkey FROM customer
 UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'orders', o_orderkey FROM orders
 UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber FROM lineitem)
SELECT name, count(*) AS n, CAST(sum(kept.k) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS dangling FROM kept JOIN reach ON kind = name AND reach.k = kept.k GROUP BY name""")
def closed_sample_limited(spark: SparkSession, sf: str) -> DataFrame:
    """One region with its nations, 20 customers of a nation, 3 orders of each, 2 lines of each, and all that these name."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    tables = {name: (world.table(spark, sf, name).withColumn(key, F.col(key).cast("long")), key) for name, key in keys.items()}
    tables["lineitem"] = (world.table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "line")
    names = [closure.Reference("nation", "n_regionkey", "region", None), closure.Reference("customer", "c_nationkey", "nation", 20),
             closure.Reference("supplier", "s_nationkey", "nation"), closure.Reference("orders", "o_custkey", "customer", 3),
             closure.Reference("lineitem", "l_orderkey", "orders", 2), closure.Reference("lineitem", "l_partkey", "part"),
             closure.Reference("lineitem", "l_suppkey", "supplier")]
    sample = closure.closed_sample(tables, names, {"region": spark.range(2, 3).select(F.col("id").alias("key"))})
    sample = {name: written(rows) for name, rows in sample.items()}
    lost = closure.dangling(sample, tables, names).groupBy(F.col("table").alias("name")).agg(F.sum("n").alias("dangling"))
    out = None
    for name, rows in sample.items():
        part = rows.agg(F.count("*").alias("n"), F.sum(tables[name][1]).alias("keys")).select(F.lit(name).alias("name"), "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out.join(lost, "name", "left").select("name", "n", "keys", F.coalesce("dangling", F.lit(0)).alias("dangling"))


_PROFORMA = layouts.Layout(
    "proforma", ("PROFORMA INVOICE", r"(?m)^Your PO:", r"Item \| Qty \| Amount"),
    {"order": r"(?m)^Your PO: *(\S+)", "total": r"(?m)^Total: *([0-9.]+)", "day": r"(?m)^Date: *(\S+)"},
    layouts.Rows(r"(?m)^(\d+) \| ([0-9.]+) \| ([0-9.]+)$", ("item", "quantity", "amount"), after=r"Item \| Qty \| Amount\n", before=r"\nTotal"),
    required=("order", "total"), least=2)
_COMMERCIAL = layouts.Layout(
    "commercial", ("COMMERCIAL INVOICE", r"(?m)^Invoice for O-", r"pcs of item"),
    {"order": r"Invoice for (O-\d+)", "total": r"Sum due ([0-9.]+)", "day": r"of (\d{4}-\d\d-\d\d)"},
    layouts.Rows(r"([0-9.]+) pcs of item (\d+) at ([0-9.]+);", ("quantity", "item", "amount")), required=("order", "total"), least=2)
FORMS = [_PROFORMA, _COMMERCIAL]


def printed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """(k, text): a form of every order, by its status: one of two layouts, or a note of neither; urgent ones lack their total."""
    def number(c: str) -> Column:
        return F.format_string("%.2f", F.col(c))
    lines = world.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("item"), F.sum(world.cents("l_quantity")).alias("q"), F.sum(world.cents("l_extendedprice")).alias("p"))
    lines = lines.withColumn("q", F.col("q") / 100).withColumn("p", F.col("p") / 100)
    told = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", F.concat_ws(" | ", F.col("item").cast("string"), number("q"), number("p")).alias("a"),
        F.concat(number("q"), F.lit(" pcs of item "), F.col("item").cast("string"), F.lit(" at "), number("p"), F.lit(";")).alias("b")))).alias("x"))
    orders = world.table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).join(told, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    plain = F.col("o_orderpriority") != "1-URGENT"
    total = number("o_totalprice")
    name = F.concat(F.lit("O-"), "o_orderkey")
    proforma = F.concat(F.lit("PROFORMA INVOICE\nYour PO: "), name, F.lit("\nDate: "), "day", F.lit("\n7 | 1.00 | 1.00\nItem | Qty | Amount\n"),
                        F.coalesce(F.array_join(F.col("x.a"), "\n"), F.lit("")), F.lit("\nTotal"), F.when(plain, F.concat(F.lit(": "), total)).otherwise(""), F.lit("\n8 | 1.00 | 1.00"))
    commercial = F.concat(F.lit("COMMERCIAL INVOICE\nInvoice for "), name, F.lit(" of "), "day", F.lit("\n"),
                          F.coalesce(F.array_join(F.col("x.b"), " "), F.lit("")), F.when(plain, F.concat(F.lit(" Sum due "), total)).otherwise(""))
    text = F.when(F.col("o_orderstatus") == "O", proforma).when(F.col("o_orderstatus") == "F", commercial).otherwise(F.concat(F.lit("Note on "), name))
    return orders.select(F.col("o_orderkey").alias("k"), text.alias("text"))


_PRINTED = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS item, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p FROM lineitem GROUP BY 1, 2),
o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'proforma' WHEN 'F' THEN 'commercial' END AS layout, o_orderpriority <> '1-URGENT' AS plain,
  o_totalprice AS total, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
"""


@query("layout_fields", _PRINTED + """
SELECT k, layout, 'O-' || k AS "order", CASE WHEN plain THEN total END AS total, day FROM o WHERE layout IS NOT NULL""")
def layout_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Order, total and day of every printed form."""
    found = layouts.fields(layouts.read(printed_orders(spark, sf), "text", FORMS), "k")
    one = found.groupBy("k", "layout").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("order", "total", "day")])
    return one.withColumn("total", F.col("total").cast("double"))


@query("layout_rows", _PRINTED + """
SELECT k, layout, CAST(row_number() OVER (PARTITION BY k ORDER BY n) AS INT) AS row, item, CAST(q AS DOUBLE) AS quantity, CAST(p AS DOUBLE) AS amount FROM l JOIN o USING (k) WHERE layout IS NOT NULL""")
def layout_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every item row of the forms' tables, and nothing from outside these."""
    found = layouts.table_rows(layouts.read(printed_orders(spark, sf), "text", FORMS), "k", ("item", "quantity", "amount"))
    return found.select("k", "layout", "row", F.col("item").cast("long"), F.col("quantity").cast("double"), F.col("amount").cast("double"))


@query("layout_review", _PRINTED + """
SELECT k, layout, 'no layout' AS reason, CAST(NULL AS VARCHAR) AS field FROM o WHERE layout IS NULL
UNION ALL SELECT k, layout, 'missing', 'total' FROM o WHERE layout IS NOT NULL AND NOT plain
UNION ALL SELECT k, layout, 'no rows', NULL FROM o WHERE layout IS NOT NULL AND k NOT IN (SELECT k FROM l)""")
def layout_review(spark: SparkSession, sf: str) -> DataFrame:
    """Forms that a person has to look at, and why."""
    docs = printed_orders(spark, sf)
    return layouts.review(layouts.read(docs, "text", FORMS), "k", "text", FORMS)


_PAGES = [layouts.Layout("article", ("<article>", "<h1>", "<footer>"), {"title": "<title>([^<]*)</title>", "lang": '<html lang="([a-z-]+)"', "heading": "<h1>([^<]*)</h1>"},
                         layouts.Rows('<a href="([^"]*)">([^<]*)</a>', ("target", "label")), required=("title", "heading"), least=2),
          layouts.Layout("listing", ("<table", "<tr"), {"title": "<title>([^<]*)</title>"}, least=1)]


@query("layout_pages", """
SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading, regexp_extract(html, '<html lang="([a-z-]+)"', 1) AS lang,
 regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)[i] AS target, trim(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)[i]) AS label, CAST(i AS INT) AS row
FROM (SELECT *, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) + 1)) AS i FROM pages)""")
def layout_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of every page beside each of its links."""
    read = layouts.read(world.table(spark, sf, "pages").select("page_id", "html"), "html", _PAGES)
    rows = read.where("layout = 'article'").select("page_id", F.col("fields")["heading"].alias("heading"), F.col("fields")["lang"].alias("lang"), F.posexplode("rows").alias("at", "x"))
    return rows.select("page_id", "heading", "lang", F.col("x")["target"].alias("target"), F.col("x")["label"].alias("label"), (F.col("at") + 1).alias("row"))


#: Lines of orders twice: as they are, and as a store that merges the second line of some orders into
#: the first, and keeps the ship day of large lines apart.
_TWO_STORES = """
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS item, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p, min(l_shipdate) AS d FROM lineitem GROUP BY 1, 2),
a AS (SELECT o AS whole, o * 10 + n AS part, unnest(['i' || item, 'p' || p, 'd' || strftime(d, '%Y-%m-%d')]) AS key, n, q FROM l),
b AS (SELECT whole + 5 AS whole, CASE WHEN whole % 3 = 0 AND n = 2 THEN part - 1 ELSE part END + CASE WHEN q > 45 AND key LIKE 'd%' THEN 1000000000000 ELSE 0 END AS part, key FROM a),
x AS (SELECT whole, key, min(part) AS part FROM (SELECT DISTINCT whole, part, key FROM a) GROUP BY 1, 2 HAVING count(*) = 1),
y AS (SELECT whole, key, min(part) AS part FROM (SELECT DISTINCT whole, part, key FROM b) GROUP BY 1, 2 HAVING count(*) = 1),
c0 AS (SELECT x.part AS l, y.part AS r, count(DISTINCT x.key) AS votes FROM x JOIN y ON y.whole = x.whole + 5 AND y.key = x.key GROUP BY 1, 2)"""
_ROUNDS = "".join(f""",
m{i} AS (SELECT l, r, votes FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY votes DESC, l, r) AS i, row_number() OVER (PARTITION BY r ORDER BY votes DESC, l, r) AS j FROM c{i}) WHERE i = 1 AND j = 1),
c{i + 1} AS (SELECT * FROM c{i} WHERE l NOT IN (SELECT l FROM m{i}) AND r NOT IN (SELECT r FROM m{i}))""" for i in range(4))


def two_stores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, part, key) of either store, and the orders (left, right) they share by number."""
    lines = written(world.lines(spark, sf).drop("supplier"))
    keys = F.explode(F.array(F.concat(F.lit("i"), "part"), F.concat(F.lit("p"), "price"), F.concat(F.lit("d"), F.date_format("shipped_on", "yyyy-MM-dd"))))
    here = lines.select(F.col("l_orderkey").alias("whole"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("part"), keys.alias("key"), "l_linenumber", "quantity")
    merged = F.when((F.col("whole") % 3 == 0) & (F.col("l_linenumber") == 2), F.col("part") - 1).otherwise(F.col("part"))
    apart = F.when((F.col("quantity") > 45) & F.col("key").startswith("d"), F.lit(1_000_000_000_000)).otherwise(F.lit(0))
    there = here.select((F.col("whole") + 5).alias("whole"), (merged + apart).alias("part"), "key")
    numbers = world.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("O-"), "o_orderkey").alias("v"))
    shared = relate.across(numbers.select(F.col("o_orderkey").alias("e"), "v"), numbers.select((F.col("o_orderkey") + 5).alias("e"), "v"))
    return here.select("whole", "part", "key"), there, shared.where("left is not null and right is not null").select("left", "right")


@query("linked_by_wholes", _TWO_STORES + _ROUNDS + "\n" + " UNION ALL ".join(f"SELECT l AS left, r AS right, votes FROM m{i}" for i in range(4)))
def linked_by_wholes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of two stores without ids of their own, linked one to one through the orders they are part of."""
    return wholes.assign(wholes.votes(*two_stores(spark, sf)))


@query("splits_and_twins", _TWO_STORES + """,
cell AS (SELECT DISTINCT a.part AS thing, b.part AS e FROM a JOIN b ON b.whole = a.whole + 5 AND b.key = a.key),
crowd AS (SELECT e, count(*) AS things FROM cell GROUP BY 1),
per AS (SELECT thing, count(*) AS k, max(things) AS crowd FROM cell JOIN crowd USING (e) GROUP BY 1)
SELECT (SELECT count(*) FROM per) AS things, (SELECT count(*) FROM per) AS found, (SELECT count(*) FROM per WHERE k > 1) AS split, (SELECT count(*) FROM crowd) AS entities,
 (SELECT count(*) FROM crowd WHERE things > 1) AS twins, (SELECT count(*) FROM per WHERE k = 1 AND crowd = 1) AS right,
 (SELECT count(DISTINCT part) FROM a) AS pairs, (SELECT count(DISTINCT part) FROM a JOIN b USING (part)) AS pairs_right""")
def splits_and_twins(spark: SparkSession, sf: str) -> DataFrame:
    """What the second store did to the lines of the first: split, merged with others, or kept; and pairs it links rightly."""
    here, there, _ = two_stores(spark, sf)
    told = score.splits_and_twins(here.select(F.concat_ws(":", "whole", "key").alias("key"), F.col("part").alias("thing")),
                                  there.select(F.concat_ws(":", F.col("whole") - 5, "key").alias("key"), F.col("part").alias("e")))
    want = here.select(F.col("part").alias("a"), F.col("part").alias("b"))
    pairs = score.pairs_right(want, there.select(F.col("part").alias("a"), F.col("part").alias("b"))).select("pairs", F.col("right").alias("pairs_right"))
    both = told.unionByName(pairs, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("identities_by_wholes", """
WITH l AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k, l_orderkey FROM lineitem)
SELECT 'order/number' AS ident, 'x/number' AS found, (SELECT count(DISTINCT o_orderkey) FROM orders) AS n, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS shared,
 'x/line' AS of_parts, (SELECT count(*) FROM l JOIN orders ON o_orderkey = l_orderkey) AS parts""")
def identities_by_wholes(spark: SparkSession, sf: str) -> DataFrame:
    """Which attribute of another store is the order number, and by what the parts of orders are known there."""
    orders, lines = world.table(spark, sf, "orders"), world.lines(spark, sf)
    number = F.concat(F.lit("O-"), "o_orderkey")
    known = orders.select(F.lit("order/number").alias("ident"), number.alias("v"))
    held = orders.select(F.lit("x/number").alias("ident"), F.when(F.col("o_orderstatus") != "P", number).otherwise(F.col("o_orderpriority")).alias("v")).unionByName(
        orders.select(F.lit("x/status").alias("ident"), F.col("o_orderstatus").alias("v")))
    line, order, buyer = F.concat(F.lit("l"), F.col("l_orderkey") * 10 + F.col("l_linenumber")), F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    part_of = lines.select(line.alias("part"), F.concat(F.lit("o"), "l_orderkey").alias("whole")).unionByName(orders.select(order.alias("part"), buyer.alias("whole")))
    kinds = wholes.in_wholes(part_of).where(F.col("part").startswith("l") & F.col("whole").startswith("o")).join(
        orders.select(order.alias("whole"), F.lit("order/number").alias("whole_kind")), "whole").select("part", "whole_kind")
    carried = lines.select(line.alias("e"), F.lit("x/line").alias("ident")).unionByName(lines.where("quantity > 25").select(line.alias("e"), F.lit("x/pallet").alias("ident")))
    named = wholes.identity_of_parts(kinds, carried).select(F.col("whole_kind").alias("ident"), F.col("ident").alias("of_parts"), F.col("n").alias("parts"))
    return wholes.same_attribute(known, held).join(named, "ident").select("ident", "found", "n", "shared", "of_parts", "parts")
