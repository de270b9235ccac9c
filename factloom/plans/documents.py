"""Documents, evidence and statement checks over the provided texts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fields
from factloom.functions import values as V
from factloom.operators import evidence, resolve, score
from factloom.plans import world
from factloom.plans.business import money
from factloom.plans.registry import query
from factloom.plans.temporal import WALK, event_store, quotes


@query("doc_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def doc_hash(spark: SparkSession, sf: str) -> DataFrame:
    return world.table(spark, sf, "documents").select("doc_id", evidence.content_hash(F.col("text")).alias("hash"))


@query("doc_copies", """
SELECT sha256(lang || chr(31) || text) AS hash, min('doc/' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS path, count(*) AS copies FROM documents GROUP BY lang, text""")
def doc_copies(spark: SparkSession, sf: str) -> DataFrame:
    docs = world.table(spark, sf, "documents").withColumn("path", F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    return resolve.copies(docs, [F.col("lang"), F.col("text")], "path")


@query("document_coverage", """
SELECT count(*) AS files, count(label.doc_id) AS recorded, count(*) FILTER (WHERE quality = 1) AS named, count(*) FILTER (WHERE toxic = 0) AS dated
FROM documents d LEFT JOIN labels label ON label.doc_id = d.doc_id""")
def document_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents taken as recorded: a good one's URL names its file, a clean one is dated."""
    docs, labels = world.table(spark, sf, "documents"), world.table(spark, sf, "labels")
    key = F.concat(F.lit("h"), "doc_id").alias("hash")
    files = docs.select(key, F.concat(F.lit("file-"), "doc_id").alias("name"))
    url = F.when(F.col("quality") == 1, F.concat(F.lit("folder/file-"), "doc_id")).otherwise("elsewhere")
    recorded = labels.select(key, url.alias("url"), F.when(F.col("toxic") == 0, F.lit("2024-01-01").cast("timestamp")).alias("at"))
    return evidence.document_coverage(files, recorded)


@query("evidence_coverage", """
SELECT source AS actor, count(*) AS transactions, count(l.doc_id) AS cited, count(*) FILTER (WHERE quality = 1) AS with_confidence
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE lang <> 'de' GROUP BY 1""")
def evidence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A transaction per document, its source the actor; German ones only touch the schema."""
    docs, labels = world.table(spark, sf, "documents"), world.table(spark, sf, "labels")
    tx = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("actor"))
    facts = docs.select(F.col("doc_id").alias("tx"), F.when(F.col("lang") == "de", 1).otherwise(1000).alias("a"))
    return evidence.coverage(tx, facts, labels.select(F.col("doc_id").alias("tx")), labels.where("quality = 1").select(F.col("doc_id").alias("tx")), [1, 2, 3, 4, 5])


@query("issue_dates", """
SELECT event_type AS kind, count(*) AS n, count(*) FILTER (WHERE CAST(ts - INTERVAL 5 HOUR AS DATE) = CAST(ts AS DATE)) AS right, count(*) AS right_in_utc FROM events GROUP BY 1""")
def issue_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Event instants read as New York days against their UTC days."""
    rows = world.table(spark, sf, "events")
    documents = rows.select(F.col("event_id").alias("document"), F.col("ts").cast("timestamp").alias("at"))
    truth = rows.select(F.col("event_id").alias("document"), F.col("event_type").alias("kind"), F.to_date("ts").alias("day"))
    return evidence.issue_dates(documents, truth, "America/New_York")


@query("statement_recall", """
WITH q AS (SELECT l_partkey, l_orderkey, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1, 2)
SELECT o_orderpriority AS field, count(*) AS statements, count(*) FILTER (WHERE o_orderstatus <> 'P') AS found, count(*) FILTER (WHERE o_orderstatus = 'F') AS cited
FROM q JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def statement_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted prices as statements: part-shipped orders' were never written, open ones' cite nothing."""
    hist, cited, _ = quotes(spark, sf)
    orders = world.table(spark, sf, "orders").select((F.lit(10_000_000) + F.col("o_orderkey")).alias("tx"), "o_orderstatus", F.col("o_orderpriority").alias("p"))
    rows = hist.join(orders, "tx").withColumn("field", F.concat_ws("|", "p", "tx")).withColumn("value", V.decimal_text(F.col("v")))
    statements = rows.join(cited, "tx").select("e", "field", "value", "document")
    written = rows.where("o_orderstatus <> 'P'").select("e", "field", "value", "tx")
    backing = cited.join(orders.where("o_orderstatus = 'F'").select("tx"), "tx", "left_semi")
    out = evidence.statement_recall(statements, written, backing)
    return out.groupBy(F.split_part("field", F.lit("|"), F.lit(1)).alias("field")).agg(
        F.sum("statements").alias("statements"), F.sum("found").alias("found"), F.sum("cited").alias("cited"))


@query("line_match", """
WITH a AS (SELECT l_orderkey AS form, l_quantity AS q, count(*) AS want, count(*) FILTER (WHERE l_returnflag <> 'R') AS have FROM lineitem GROUP BY 1, 2)
SELECT form, CAST(sum(want) AS BIGINT) AS labelled, CAST(sum(least(want, have)) AS BIGINT) AS found FROM a GROUP BY 1""")
def line_match(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each order labelled by quantity, found among the lines that were not returned."""
    rows = world.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("form"), F.col("l_quantity").alias("q"), "l_returnflag")
    return evidence.matched_lines(rows, rows.where("l_returnflag <> 'R'"), "form", ["q"])


@query("pii_scan", """
WITH s AS (SELECT DISTINCT v FROM (SELECT upper(c_name) AS v FROM customer UNION ALL SELECT text FROM conversations UNION ALL SELECT 'a' || c_custkey || '@shop.example' FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT count(*) FILTER (WHERE lower(v) IN (SELECT lower(c_name) FROM customer)) AS personal_values, count(*) FILTER (WHERE regexp_full_match(v, '[^@\\s:<>]+@[^@\\s]+\\.[a-z]+')) AS email_shaped FROM s""")
def pii_scan(spark: SparkSession, sf: str) -> DataFrame:
    customers = world.table(spark, sf, "customer")
    strings = customers.select(F.upper("c_name").alias("v")).unionByName(world.table(spark, sf, "conversations").select(F.col("text").alias("v"))).unionByName(
        customers.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("a"), "c_custkey", F.lit("@shop.example")).alias("v")))
    return evidence.personal_values(strings, customers.select(F.col("c_name").alias("v")))


@query("found_emails", """
SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.+''-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+')) AS email FROM documents""")
def found_emails(spark: SparkSession, sf: str) -> DataFrame:
    """Every address in the whole text of every document."""
    return evidence.found_in_text(world.table(spark, sf, "documents").select("doc_id", "text"), "text", evidence.EMAIL, "email").select("doc_id", "email")


@query("lines_vs_totals", """
SELECT o_orderkey AS document, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS lines,
 coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) = CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE sum(CAST(l_extendedprice AS DECIMAL(18,2))) END, false) AS agrees
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_totalprice""")
def lines_vs_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' lines against a printed total: right but for part-shipped orders, which print the order's own."""
    lines = world.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_extendedprice").cast(world.MONEY).alias("amount"))
    sums = lines.groupBy("document").agg(F.sum("amount").alias("s"))
    orders = world.table(spark, sf, "orders").select(F.col("o_orderkey").alias("document"), "o_orderstatus", F.col("o_totalprice").cast(world.MONEY).alias("t"))
    printed = orders.join(sums, "document", "left").select("document", F.when(F.col("o_orderstatus") == "P", F.col("t")).otherwise(F.col("s")).alias("total"))
    return evidence.totals(lines, printed, "document").select("document", money(F.col("lines")).alias("lines"), "agrees")


@query("extract", """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z-]+)"', 1) AS lang,
 CAST(len(regexp_extract_all(html, '<a href="[^"]*"')) AS INT) AS links, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
 CASE WHEN regexp_matches(html, '<article') THEN 'article' WHEN regexp_matches(html, '<table') THEN 'table' ELSE 'other' END AS layout FROM pages""")
def extract(spark: SparkSession, sf: str) -> DataFrame:
    """Fields read from page markup by pattern, with the layout that routes a page."""
    html = F.col("html")
    return world.table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, '<html lang="([a-z-]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(html, F.lit('(<a href="[^"]*")'), F.lit(1))).alias("links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.when(html.rlike("<article"), "article").when(html.rlike("<table"), "table").otherwise("other").alias("layout"))


@query("next_date", """
SELECT event_id, strftime(CASE WHEN make_date(year(ts), m, d) >= CAST(ts AS DATE) THEN make_date(year(ts), m, d) ELSE make_date(year(ts) + 1, m, d) END, '%Y-%m-%d') AS day
FROM (SELECT *, 1 + user_id % 12 AS m, 1 + event_id % 28 AS d FROM events)""")
def next_date(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that give a month and day, in either form, and the next such day after each."""
    m, d = 1 + F.col("user_id") % 12, 1 + F.col("event_id") % 28
    said = F.when(F.col("event_type") == "view", F.concat(m.cast("string"), F.lit("月"), d.cast("string"), F.lit("号"))).otherwise(F.concat(F.lit("by "), m, F.lit("/"), d))
    month, day = evidence.month_and_day(F.col("said"))
    return world.table(spark, sf, "events").withColumn("said", said).select("event_id", evidence.next_day(F.col("ts"), month, day).cast("string").alias("day"))


@query("candidate_labels", """
SELECT p_partkey AS k, p_type IN ('PROMO', 'STANDARD') AS candidate FROM part""")
def candidate_labels(spark: SparkSession, sf: str) -> DataFrame:
    kind, name = F.col("p_type"), F.replace("p_name", F.lit(" "), F.lit(""))
    label = F.when(kind == "PROMO", F.concat(F.lit("POL/"), name, F.lit("/Governor/WV/Dem"))).when(
        kind == "STANDARD", F.concat(name, F.lit(", bill - TN Senate"))).when(kind == "ECONOMY", F.concat(name, F.lit(" for Governor-R"))).otherwise(name)
    return world.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), fields.candidate_label(label).alias("candidate"))


@query("issue_order", """
SELECT l_partkey AS part, CAST(v AS DOUBLE) AS value, strftime(issued, '%Y-%m-%d') AS issued FROM (
 SELECT l_partkey, v, o_orderdate AS issued, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM
  (SELECT l_partkey, l_orderkey, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1, 2) JOIN orders ON o_orderkey = l_orderkey) WHERE n = 1""")
def issue_order(spark: SparkSession, sf: str) -> DataFrame:
    hist, cited, issued = quotes(spark, sf)
    rows = hist.join(cited, "tx").join(issued, "document").select("e", F.col("v").alias("value"), F.col("at").alias("issued"), "tx")
    return evidence.apply_in_issue_order(rows, ["e"]).select((F.col("e") % world.WIDTH).alias("part"), money(F.col("value")).alias("value"),
                                                            F.date_format("issued", "yyyy-MM-dd").alias("issued"))


@query("completion", """
SELECT l_orderkey AS order_key, bool_and(sent >= q) AS complete FROM (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q,
 coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F'), 0) AS sent FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def completion(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose every line has shipped in full."""
    q = F.col("l_quantity").cast(world.MONEY).alias("quantity")
    rows = world.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line"), q, "l_linestatus")
    ordered = rows.groupBy("order_key", "line").agg(F.sum("quantity").alias("quantity"))
    return evidence.complete(ordered, rows.where("l_linestatus = 'F'"), "order_key", "line")


@query("conflicts", """
SELECT l_orderkey AS subject, l_linenumber AS field, count(DISTINCT l_partkey) AS "values", min(l_partkey) AS first, max(l_partkey) AS last
FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1""")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("field"), F.col("l_partkey").alias("value"))
    return evidence.conflicting(rows, ["subject", "field"])


@query("ever_status", WALK + """
SELECT r.value, count(*) AS reference, count(c.e) AS found FROM (SELECT DISTINCT CAST(floor(value) AS BIGINT) AS value, 80000000000 + user_id AS e FROM events WHERE event_type = 'purchase') r
LEFT JOIN (SELECT DISTINCT v, e FROM canon WHERE a = 'user/purchase' AND op) c ON c.v = r.value AND c.e = r.e GROUP BY 1""")
def ever_status(spark: SparkSession, sf: str) -> DataFrame:
    """Of users with a purchase event of a value, how many ever held that value."""
    hist = event_store(spark, sf).history("user/purchase").withColumn("v", F.col("v").cast("long"))
    reference = world.table(spark, sf, "events").where("event_type = 'purchase'").select(F.floor("value").alias("value"), world.entity("user", "user_id").alias("e"))
    return score.ever_had(hist, reference)


@query("withdraw", """
SELECT 80000000000 + user_id AS e FROM events WHERE event_type = 'signup' AND CAST(regexp_extract(props, '[0-9]+') AS INT) % 4 <> 0 GROUP BY 1""")
def withdraw(spark: SparkSession, sf: str) -> DataFrame:
    """Every user whose history holds an attribute that may no longer be kept."""
    return evidence.withdraw(event_store(spark, sf).history("user/signup"), world.BY_IDENT["user/signup"].id).select("e")
