"""Statistics, profiles and vocabulary checks over the tables' facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.model import SPARK_TYPE, VALUE_COLUMN, Attribute, registry
from factloom.operators import fold, profile, similar, vocabulary
from factloom.plans import world
from factloom.plans.registry import query
from factloom.sources.mapping import union
from factloom.store import FactLog
from factloom.plans.temporal import EVERY, LAST, WALK, named

LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2)"
SIGS = """
SELECT 'order/customer,order/number,order/placed_on,order/status,order/total' AS signature, count(*) AS entities FROM orders
UNION ALL SELECT 'line/order,line/part,line/price,line/quantity,line/shipped_on,line/supplier', count(*) FROM """ + LINES + """
UNION ALL SELECT 'customer/name,customer/nation,customer/segment', count(*) FROM customer
UNION ALL SELECT 'part/brand,part/name,part/size,part/type', count(*) FROM part
UNION ALL SELECT 'supplier/name,supplier/nation', count(*) FROM supplier
UNION ALL SELECT 'nation/name,nation/region', count(*) FROM nation UNION ALL SELECT 'region/name', count(*) FROM region"""


def rows_of(spark: SparkSession, sf: str) -> DataFrame:
    return profile.folded(world.store(spark, sf).state(), None)


RANKED = "s AS (" + SIGS + "), r AS (SELECT *, 's' || row_number() OVER (ORDER BY entities DESC, signature) AS label FROM s)"


@query("signatures", "WITH " + RANKED + " SELECT label, signature, entities FROM r")
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.statistics(world.store(spark, sf))["signatures"]
    return found.select("label", F.array_join("idents", ",").alias("signature"), "entities")


@query("ref_links", "WITH " + RANKED + """, l AS (
SELECT 'order/customer' AS attribute, 'order' AS f, 'customer' AS t, count(*) AS count FROM orders UNION ALL SELECT 'line/order', 'line', 'order', count(*) FROM """ + LINES + """
UNION ALL SELECT 'line/part', 'line', 'part', count(*) FROM """ + LINES + """ UNION ALL SELECT 'line/supplier', 'line', 'supplier', count(*) FROM """ + LINES + """
UNION ALL SELECT 'customer/nation', 'customer', 'nation', count(*) FROM customer UNION ALL SELECT 'supplier/nation', 'supplier', 'nation', count(*) FROM supplier
UNION ALL SELECT 'nation/region', 'nation', 'region', count(*) FROM nation)
SELECT attribute, a.label AS source, b.label AS target, count FROM l JOIN r a ON split_part(a.signature, '/', 1) = f JOIN r b ON split_part(b.signature, '/', 1) = t""")
def ref_links(spark: SparkSession, sf: str) -> DataFrame:
    return profile.statistics(world.store(spark, sf))["refs"]


@query("wide_registry", """
WITH f AS (SELECT o_orderkey AS e, 5000 + o_orderkey % 1500 AS a FROM orders UNION ALL SELECT o_orderkey, 5000 + o_custkey % 7 FROM orders
  UNION ALL SELECT o_orderkey, 77777 FROM orders WHERE o_orderstatus = 'P'),
s AS (SELECT e, string_agg(DISTINCT CAST(a AS VARCHAR), ',' ORDER BY CAST(a AS VARCHAR)) AS signature FROM f GROUP BY e)
SELECT signature, count(*) AS entities FROM s GROUP BY signature""")
def wide_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures over 1,500 attributes and one that is not registered."""
    orders, value = world.table(spark, sf, "orders"), F.lit("x")

    def facts(rows: DataFrame, a) -> DataFrame:
        return rows.select(F.col("o_orderkey").alias("e"), a.cast("long").alias("a"), *[(value if t == "string" else F.lit(None)).cast(SPARK_TYPE[t]).alias(c) for t, c in VALUE_COLUMN.items()],
                           F.lit(1).cast("long").alias("tx"), F.lit(True).alias("op"))
    log = union([facts(orders, 5000 + F.col("o_orderkey") % 1500), facts(orders, 5000 + F.col("o_custkey") % 7), facts(orders.where("o_orderstatus = 'P'"), F.lit(77777))])
    attrs = registry(spark, [Attribute(5000 + i, f"wide/a{i}", "string", "many") for i in range(1500)])
    counts = profile.statistics(FactLog.of(log, attrs, world.transactions(spark, sf)))["counts"]
    return counts.select(F.array_join(F.array_sort(F.transform("sig", lambda a: a.cast("string"))), ",").alias("signature"), "entities")


@query("attr_usage", """
SELECT 'line/item' AS ident, count(*) AS entities, count(*) * 2 AS n, 'line/part,line/supplier' AS includes FROM """ + LINES + """
UNION ALL SELECT 'order/status', count(*), count(*), '' FROM orders UNION ALL SELECT 'order/total', count(*), count(*), '' FROM orders""")
def attr_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage after two attributes were deprecated, one by way of the other, for a third."""
    from dataclasses import replace

    changed = {"line/supplier": 1018, "line/part": 2000}
    attributes = [replace(a, replaced_by=changed.get(a.ident)) for a in world.ATTRIBUTES]
    attributes = [a if a.ident != "line/supplier" else replace(a, replaced_by=world.BY_IDENT["line/part"].id) for a in attributes]
    attrs = registry(spark, [*attributes, Attribute(2000, "line/item", "ref", "many", "none", "What a line is about.")])
    state = fold.state(world.facts(spark, sf, ["line/part", "line/supplier", "order/status", "order/total"]))
    final = profile.final_attributes(attrs)
    out = profile.usage(profile.folded(state, final), attrs, final)
    return out.select("ident", "entities", F.col("values").alias("n"), F.array_join("includes", ",").alias("includes"))


@query("cooccur", """
WITH s AS (""" + SIGS + """), x AS (SELECT unnest(string_split(signature, ',')) AS a, signature, entities FROM s)
SELECT x.a, y.a AS b, CAST(sum(x.entities) AS BIGINT) AS entities FROM x JOIN x y ON y.signature = x.signature AND y.a > x.a GROUP BY 1, 2""")
def cooccur(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    pairs = profile.cooccurrence(profile.statistics(store)["counts"])
    names = store.attrs.select("id", "ident")
    out = pairs.join(names.select(F.col("id").alias("a"), F.col("ident").alias("x")), "a").join(
        names.select(F.col("id").alias("b"), F.col("ident").alias("y")), "b")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "entities")


@query("data_signature", WALK + LAST.format(tx=EVERY) + """, who AS (SELECT DISTINCT e FROM held WHERE a = 'user/purchase')
SELECT a FROM held WHERE e IN (SELECT e FROM who) AND a <> 'user/purchase' GROUP BY a HAVING count(DISTINCT e) = (SELECT count(*) FROM who)""")
def data_signature(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes that every user with a current purchase value also holds, other than it."""
    state = fold.state(world.event_log(spark, sf))
    holders = state.where(F.col("a") == world.BY_IDENT["user/purchase"].id).select("e")
    return named(profile.data_signature(state, holders)).where("a <> 'user/purchase'")


@query("jaccard", """
WITH x(name, score, missing, extra, entities) AS (
 SELECT 'sale', 2.0/6, 1, 3, count(*) FROM orders UNION ALL SELECT 'who', 2.0/3, 0, 1, count(*) FROM customer
 UNION ALL SELECT 'item', 2.0/6, 0, 4, count(*) FROM """ + LINES + """)
SELECT name, CAST(round(score, 6) AS DOUBLE) AS score, missing, extra, entities FROM x""")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Each signature's closest recorded shape; signatures that share nothing with one are not listed."""
    ids = {i: a.id for i, a in world.BY_IDENT.items()}
    shapes = spark.createDataFrame([("who", [ids["customer/name"], ids["customer/nation"]]), ("sale", [ids["order/number"], ids["order/customer"], 7777]),
                                    ("item", [ids["line/part"], ids["line/order"]])], "name string, attributes array<bigint>")
    counts = profile.statistics(world.store(spark, sf))["counts"]
    return profile.closest_shape(counts, shapes).join(counts, "sid").select("name", F.round("score", 6).alias("score"), "missing", "extra", "entities")


@query("shape_members", """
SELECT 'dated' AS name, count(*) AS members FROM orders UNION ALL SELECT 'moved', count(*) FROM """ + LINES)
def shape_members(spark: SparkSession, sf: str) -> DataFrame:
    ids = {i: a.id for i, a in world.BY_IDENT.items()}
    shapes = spark.createDataFrame([("dated", [ids["order/placed_on"], ids["order/status"]]), ("moved", [ids["line/shipped_on"], ids["line/part"]])],
                                   "name string, attributes array<bigint>")
    log = world.store(spark, sf).log(["order/placed_on", "order/status", "line/shipped_on", "line/part"])
    return profile.shape_members(profile.current(log), shapes).groupBy("name").agg(F.count("*").alias("members"))


@query("column_profile", """
WITH c AS (SELECT 'o_orderkey' AS col, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
 UNION ALL SELECT 'o_orderstatus', CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
SELECT col AS "column", count(*) AS rows, count(*) FILTER (WHERE trim(v) = '') AS blank, count(DISTINCT v) FILTER (WHERE trim(v) <> '') AS "values",
 count(DISTINCT v) FILTER (WHERE trim(v) <> '') = count(*) AS identifier FROM c GROUP BY 1""")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.table(spark, sf, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")))
    return profile.column_profile(rows, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("holder", """
SELECT 'customers' AS kind, 'customer/name' AS attribute, count(*) AS found FROM customer UNION ALL SELECT 'suppliers', 'supplier/name', count(*) FROM supplier
UNION ALL SELECT 'nations', 'nation/name', count(DISTINCT n_name) FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def holder(spark: SparkSession, sf: str) -> DataFrame:
    """Which identity attribute holds each source's values, and how many."""
    sources, held = id_sets(spark, sf)
    return profile.overlaps(sources, held)


def id_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    store = world.store(spark, sf)

    def kind(name: str, df: DataFrame, column: str) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), F.col(column).alias("v"))
    customers, nations = world.table(spark, sf, "customer"), world.table(spark, sf, "nation")
    used = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    sources = kind("customers", customers, "c_name").unionByName(kind("suppliers", world.table(spark, sf, "supplier"), "s_name")).unionByName(
        kind("nations", used, "n_name"))
    held = None
    for a in ("customer/name", "supplier/name", "nation/name", "region/name"):
        side = store.attr(a).select(F.lit(a).alias("attribute"), "v")
        held = side if held is None else held.unionByName(side)
    return sources, held


@query("id_coverage", """
WITH src AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_name) WHEN c_mktsegment = 'MACHINERY' THEN c_name || '?' ELSE c_name END AS v FROM customer),
held AS (SELECT c_name AS v FROM customer)
SELECT 'customers' AS kind, (SELECT count(*) FROM src) AS in_source, 'customer/name' AS attribute, (SELECT count(*) FROM held) AS in_store,
 (SELECT count(*) FROM src WHERE v IN (SELECT v FROM held)) AS found, (SELECT count(*) FROM src WHERE lower(v) IN (SELECT lower(v) FROM held)) AS found_ignoring_case,
 (SELECT count(*) FROM src WHERE v NOT IN (SELECT v FROM held)) AS missing, (SELECT count(*) FROM held WHERE v NOT IN (SELECT v FROM src)) AS not_in_source""")
def id_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names of which one segment's were lower-cased and another's misspelt."""
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    v = F.when(seg == "BUILDING", F.lower(name)).when(seg == "MACHINERY", F.concat(name, F.lit("?"))).otherwise(name)
    sources = world.table(spark, sf, "customer").select(F.lit("customers").alias("kind"), v.alias("v"))
    return profile.id_coverage(sources, id_sets(spark, sf)[1])


@query("embedded_ids", """
SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids FROM orders JOIN customer ON c_custkey = o_custkey""")
def embedded_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Customer numbers inside composite order references."""
    refs = world.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("/O-"), "o_orderkey").alias("v"))
    ids = world.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"))
    return profile.embedded_ids(refs, ids, r"c\d{9}").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("bareness", """
SELECT 'region/name' AS ident, count(*) AS entities, count(*) AS bare FROM region UNION ALL SELECT 'customer/name', count(*), 0 FROM customer
UNION ALL SELECT 'supplier/name', count(*), 0 FROM supplier UNION ALL SELECT 'nation/name', count(*), 0 FROM nation UNION ALL SELECT 'order/number', count(*), 0 FROM orders""")
def bareness(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    return profile.bareness(store.state(), store.attrs)


@query("split_records", """
SELECT user_id AS u, CASE WHEN bool_or(event_type = 'view') THEN 'view' ELSE 'purchase' END AS has FROM events
WHERE event_type IN ('view', 'purchase') AND value < 3 GROUP BY 1 HAVING count(DISTINCT event_type) = 1""")
def split_records(spark: SparkSession, sf: str) -> DataFrame:
    """Users with a low-valued view but no such purchase, or the reverse."""
    view, purchase = world.BY_IDENT["user/view"].id, world.BY_IDENT["user/purchase"].id
    low = world.table(spark, sf, "events").where("event_type IN ('view', 'purchase') AND value < 3").select(
        F.col("user_id").alias("e"), F.when(F.col("event_type") == "view", view).otherwise(purchase).alias("a"))
    return profile.split_records(low, view, purchase).select(F.col("e").alias("u"), F.when(F.col("has") == view, "view").otherwise("purchase").alias("has"))


@query("fingerprint", """
WITH h AS (SELECT sha256('doc/' || doc_id || chr(0) || text) AS h FROM documents),
s AS (SELECT count(*) AS files, """ + ", ".join(f"sum(CAST('0x' || substring(h, {1 + 8 * i}, 8) AS BIGINT)) AS p{i}" for i in range(8)) + """ FROM h)
SELECT sha256(concat_ws(',', """ + ", ".join(f"p{i}" for i in range(8)) + """)) AS fingerprint, files FROM s""")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    docs = world.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    return profile.fingerprint(docs, "path", F.encode("text", "UTF-8"))


@query("trgm_similarity", """
WITH w AS (SELECT p_partkey AS k, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS a,
   list_filter(regexp_split_to_array(lower(p_type || ' ' || p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM part),
t AS (SELECT k, list_distinct(flatten(list_transform(a, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS a,
   list_distinct(flatten(list_transform(b, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS b FROM w)
SELECT k, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS score FROM t""")
def trgm_similarity(spark: SparkSession, sf: str) -> DataFrame:
    long = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    return world.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.round(text.similarity(F.col("p_name"), long), 9).alias("score"))


def trigram_sql(text_sql: str) -> str:
    """DuckDB: the ordered trigrams of a text."""
    return (f"flatten(list_transform(list_filter(regexp_split_to_array(lower({text_sql}), '[^a-z0-9]+'), lambda x: x <> ''), "
            "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))")


def extent_sql(wanted: str, ordered: str) -> str:
    """DuckDB: the best similarity of a trigram set with any extent of an ordered list."""
    return (f"coalesce(list_max(flatten(list_transform(range(1, len({ordered}) + 1), lambda s: list_transform(range(s, len({ordered}) + 1), "
            f"lambda t: len(list_intersect({wanted}, {ordered}[s:t])) / len(list_distinct(list_concat({wanted}, {ordered}[s:t]))))))), 0)")


@query("word_similarity", "WITH t AS (SELECT p_partkey AS k, list_distinct(" + trigram_sql("p_name") + ") AS a, " + trigram_sql("p_type || ' ' || p_name || ' ' || p_brand") + """ AS b FROM part)
SELECT k, round(""" + extent_sql("a", "b") + ", 9) AS score FROM t")
def word_similarity(spark: SparkSession, sf: str) -> DataFrame:
    long = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    rows = world.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", long.alias("long"))
    return similar.scored_once(rows, "p_name", "long", text.word_similarity).select("k", F.round("score", 9).alias("score"))


@query("similar_names", """
WITH w AS (SELECT DISTINCT p_name AS n FROM part),
t AS (SELECT n, list_distinct(flatten(list_transform(string_split(n, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM w)
SELECT a.n AS l, b.n AS r, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) AS score
FROM t a JOIN t b ON a.n <> b.n WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.5""")
def similar_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every two part names that share half of their trigrams."""
    names = world.table(spark, sf, "part").select("p_name").distinct()
    left = names.select(F.col("p_name").alias("l"), text.trigrams(F.col("p_name")).alias("items"))
    pairs = similar.similar_pairs(left, left.withColumnRenamed("l", "r"), 0.5)
    return pairs.where("l <> r").select("l", "r", F.round("score", 9).alias("score"))


def part_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute specs named after the distinct part names and types."""
    rows = world.table(spark, sf, "part").select("p_type", "p_name").distinct()
    return rows.select(F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("ident"),
                       F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("stock")).alias("doc"))


@query("near_match", """
WITH s AS (SELECT DISTINCT lower(p_type) || '/' || replace(p_name, ' ', '_') AS ident, p_name || ' ' || lower(p_type) || ' stock' AS doc FROM part),
c AS (SELECT ident, doc FROM s UNION SELECT 'part/' || replace(p_name, ' ', '_'), 'Stock of any ' || p_name FROM part),
t AS (SELECT ident, split_part(ident, '/', 1) AS ns, string_split(split_part(ident, '/', 2), '_') AS w, """ + trigram_sql("replace(split_part(ident, '/', 2), '_', '')") + """ AS g,
 list_distinct(""" + trigram_sql("doc") + """) AS d FROM c),
n AS (SELECT DISTINCT list_distinct(a.g) AS x, b.g AS y FROM t a CROSS JOIN t b), m AS (SELECT x, y, """ + extent_sql("x", "y") + """ AS v FROM n),
p AS (SELECT a.ident, b.ident AS other, greatest(m1.v, m2.v) AS name_score, len(list_intersect(a.d, b.d)) / len(list_distinct(list_concat(a.d, b.d))) AS doc_score,
 a.ns = b.ns AS same, list_has_all(a.w, b.w) OR list_has_all(b.w, a.w) AS nested FROM t a JOIN s ON s.ident = a.ident JOIN t b ON a.ident <> b.ident
 JOIN m m1 ON m1.x = list_distinct(a.g) AND m1.y = b.g JOIN m m2 ON m2.x = list_distinct(b.g) AND m2.y = a.g)
SELECT ident, other, round(name_score, 3) AS name_score, round(doc_score, 3) AS doc_score FROM p
WHERE (name_score >= 0.6 AND (same OR doc_score >= 0.3)) OR (same AND nested) OR doc_score >= 0.6""")
def near_match(spark: SparkSession, sf: str) -> DataFrame:
    """A spec per name and type of part, screened against each other and against one per name."""
    specs = part_specs(spark, sf)
    names = world.table(spark, sf, "part").select("p_name").distinct()
    attrs = names.select(F.concat(F.lit("part/"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("ident"),
                         F.concat_ws(" ", F.lit("Stock of any"), "p_name").alias("doc"), F.lit(None).cast("long").alias("replaced_by"))
    return vocabulary.near_matches(specs, attrs)


@query("attribute_search", """
WITH s AS (SELECT DISTINCT lower(p_type) || '/' || replace(p_name, ' ', '_') AS ident, p_name || ' ' || lower(p_type) || ' stock' AS doc FROM part),
t AS (SELECT ident, doc, list_distinct(""" + trigram_sql("'red ring'") + ") AS q, " + trigram_sql("ident") + " AS i, " + trigram_sql("doc") + """ AS d FROM s),
r AS (SELECT ident, 'decimal' AS type, 'one' AS cardinality, doc, CAST(NULL AS BIGINT) AS replaced_by, greatest(""" + extent_sql("q", "i") + ", " + extent_sql("q", "d") + """) AS score FROM t),
top AS (SELECT * FROM r ORDER BY score DESC, ident LIMIT 10) SELECT ident, type, cardinality, doc, replaced_by, round(score, 3) AS score FROM top WHERE score >= 0.2""")
def attribute_search(spark: SparkSession, sf: str) -> DataFrame:
    attrs = part_specs(spark, sf).select(F.xxhash64("ident").alias("id"), "ident", F.lit("decimal").alias("type"), F.lit("one").alias("cardinality"), "doc",
                                         F.lit(None).cast("long").alias("replaced_by"))
    return vocabulary.search(attrs, "red ring")


@query("install_diff", """
WITH s AS (SELECT DISTINCT lower(p_type) || '/' || replace(p_name, ' ', '_') AS ident, p_type, p_name FROM part)
SELECT ident, CASE WHEN p_type = 'ECONOMY' THEN 'new' WHEN p_type = 'SMALL' THEN 'evolve' WHEN p_type = 'LARGE' THEN 'conflict' ELSE 'existing' END AS action FROM s""")
def install_diff(spark: SparkSession, sf: str) -> DataFrame:
    specs = part_specs(spark, sf)
    kind = F.split_part("ident", F.lit("/"), F.lit(1))
    attrs = specs.where(kind != "economy").select("ident", F.lit("decimal").alias("type"), F.when(kind == "large", "many").otherwise("one").alias("cardinality"),
                                                  F.lit("none").alias("uniq"))
    package = specs.select("ident", F.lit("decimal").alias("type"), F.lit("one").alias("cardinality"),
                           F.when(kind == "small", "identity").otherwise("none").alias("unique"))
    return vocabulary.install_diff(package, attrs)


@query("registration_errors", """
WITH s AS (SELECT DISTINCT lower(p_type) || '/' || replace(p_name, ' ', '_') AS ident, p_type FROM part)
SELECT ident, 'type' AS code FROM s WHERE p_type = 'ECONOMY' UNION ALL SELECT ident, 'registered otherwise' FROM s WHERE p_type = 'LARGE'
UNION ALL SELECT ident, 'doc' FROM s WHERE p_type = 'PROMO' UNION ALL SELECT ident, 'boolean identity' FROM s WHERE p_type = 'MEDIUM'""")
def registration_errors(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.split_part("ident", F.lit("/"), F.lit(1))
    specs = part_specs(spark, sf).withColumn("idx", F.xxhash64("ident"))
    attrs = specs.where(kind == "large").select("ident", F.lit("string").alias("type"), F.lit("one").alias("cardinality"), F.lit("none").alias("uniq"))
    batch = specs.select("idx", "ident", F.when(kind == "economy", "float").when(kind == "medium", "boolean").otherwise("decimal").alias("type"),
                         F.lit("one").alias("cardinality"), F.when(kind == "medium", "identity").alias("unique"),
                         F.when(kind == "promo", " ").otherwise(F.col("doc")).alias("doc"), F.array().cast("array<string>").alias("distinct_from"))
    return vocabulary.registration_errors(batch, attrs).join(specs, "idx").select("ident", "code")


@query("unfilled", "SELECT unnest(['user/view', 'user/click', 'user/purchase', 'user/signup', 'user/error']) AS ident")
def unfilled(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes the order world registers and never fills: those of the event log."""
    store = world.store(spark, sf)
    return vocabulary.unfilled(store.attrs, store.state())
