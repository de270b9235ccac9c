"""Codes, crosswalks, duplicates and scores over keys drawn from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import codes, fields
from factloom.operators import fold, relate, resolve, score
from factloom.operators.graph import chain_roots
from factloom.plans import world
from factloom.plans.business import money
from factloom.plans.graphs import order_chain
from factloom.plans.registry import query

# Codes of parts as four systems spell them, chosen by brand.
SPELT = """
CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN lower(code) || ' ' WHEN p_brand IN ('Brand#4', 'Brand#5') THEN code || '-FBA'
 WHEN p_brand IN ('Brand#6', 'Brand#7') THEN replace(code, '-', ' ') || '.' WHEN p_brand IN ('Brand#8', 'Brand#9') THEN 'SIZE 4 TO 6'
 WHEN p_brand = 'Brand#10' THEN '#REF!' ELSE code END"""
CODES = "codes AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, 'PRT-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code FROM part)"


def part_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with their house code and the spelling another system gives it."""
    parts = world.table(spark, sf, "part").withColumn("code", F.concat(F.lit("PRT-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))
    brand, code = F.col("p_brand"), F.col("code")
    return parts.withColumn("spelt", F.when(brand.isin("Brand#1", "Brand#2", "Brand#3"), F.concat(F.lower(code), F.lit(" ")))
                            .when(brand.isin("Brand#4", "Brand#5"), F.concat(code, F.lit("-FBA")))
                            .when(brand.isin("Brand#6", "Brand#7"), F.concat(F.replace(code, F.lit("-"), F.lit(" ")), F.lit(".")))
                            .when(brand.isin("Brand#8", "Brand#9"), "SIZE 4 TO 6").when(brand == "Brand#10", "#REF!").otherwise(code))


@query("norm_code", "WITH " + CODES + ", s AS (SELECT p_partkey, " + SPELT + """ AS spelt FROM codes)
SELECT p_partkey AS k, upper(rtrim(regexp_replace(spelt, '\\s+', '', 'g'), '.')) AS code, regexp_replace(CAST(CAST(p_partkey AS DOUBLE) AS VARCHAR), '\\.0$', '') AS id FROM s""")
def norm_code(spark: SparkSession, sf: str) -> DataFrame:
    return part_codes(spark, sf).select(F.col("p_partkey").alias("k"), codes.normal_code(F.col("spelt")).alias("code"),
                                        codes.whole_number_id(F.concat(F.col("p_partkey").cast("string"), F.lit(".0"))).alias("id"))


@query("junk_ids", "WITH " + CODES + ", s AS (SELECT " + SPELT + """ AS code FROM codes UNION ALL SELECT p_name FROM codes UNION ALL SELECT upper(p_brand) || 'BRAND' || p_size FROM codes)
SELECT code, count(*) AS n FROM s WHERE code = '' OR code = '#REF!' OR contains(upper(code), ' TO ') OR NOT regexp_matches(code, '[0-9]')
 OR (length(split_part(upper(code), '-', 1)) > 3 AND (length(upper(code)) - length(replace(upper(code), split_part(upper(code), '-', 1), ''))) / length(split_part(upper(code), '-', 1)) > 1) GROUP BY 1""")
def junk_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = part_codes(spark, sf)
    mixed = rows.select(F.col("spelt").alias("code")).unionByName(rows.select(F.col("p_name").alias("code"))).unionByName(
        rows.select(F.concat(F.upper("p_brand"), F.lit("BRAND"), "p_size").alias("code")))
    return resolve.screen(mixed, "code")


@query("multi_key", """
SELECT o_orderkey AS k, trim(u) AS ref FROM (SELECT o_orderkey, unnest(string_split('PO-' || o_custkey || ' / ' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'PO-' || o_orderkey END, ' / ')) AS u FROM orders) WHERE trim(u) <> ''""")
def multi_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = world.table(spark, sf, "orders")
    field = F.concat(F.lit("PO-"), "o_custkey", F.lit(" / "), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("PO-"), "o_orderkey")))
    return orders.select(F.col("o_orderkey").alias("k"), F.explode(codes.references(field)).alias("ref"))


@query("row_key", """
SELECT l_orderkey || '/' || l_linenumber AS key, count(*) AS rows, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units FROM lineitem GROUP BY 1""")
def row_key(spark: SparkSession, sf: str) -> DataFrame:
    """Line items keyed by the IDs they name; rows that repeat a key are one record."""
    return world.table(spark, sf, "lineitem").groupBy(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key")).agg(
        F.count("*").alias("rows"), money(F.sum(F.col("l_quantity").cast(world.MONEY))).alias("units"))


@query("tier_match", "WITH " + CODES + ", s AS (SELECT p_partkey, code, " + SPELT + """ AS spelt FROM codes),
k AS (SELECT *, regexp_replace(regexp_replace(upper(trim(spelt)), '-FBA$', ''), '[^A-Z0-9]', '', 'g') AS key FROM s)
SELECT p_partkey AS record, p_partkey AS hub, CASE WHEN spelt = code THEN 'exact' ELSE 'normalized' END AS tier, CASE WHEN spelt = code THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence
FROM k WHERE spelt = code OR key = replace(code, '-', '')""")
def tier_match(spark: SparkSession, sf: str) -> DataFrame:
    """Spelt codes matched to house codes; the last two of a code are never swapped here."""
    rows = part_codes(spark, sf)
    found, _ = resolve.tiered(rows.select(F.col("p_partkey").alias("id"), "code"), rows.select(F.col("p_partkey").alias("id"), F.col("spelt").alias("code")))
    return found


@query("tier_review", "WITH " + CODES + ", s AS (SELECT " + SPELT + " AS code FROM codes) SELECT code, count(*) AS n FROM s WHERE code IN ('#REF!', 'SIZE 4 TO 6') GROUP BY 1")
def tier_review(spark: SparkSession, sf: str) -> DataFrame:
    rows = part_codes(spark, sf)
    _, left = resolve.tiered(rows.select(F.col("p_partkey").alias("id"), "code"), rows.select(F.col("p_partkey").alias("id"), F.col("spelt").alias("code")))
    return left.groupBy("code").agg(F.count("*").alias("n"))


@query("one_to_one", """
SELECT p_name AS record, count(DISTINCT p_brand) AS hubs, min(p_brand) AS first, max(p_brand) AS last FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.claimed_twice(world.table(spark, sf, "part").select(F.col("p_name").alias("record"), F.col("p_brand").alias("hub")))


@query("hub_spelling", "WITH " + CODES + ", s AS (SELECT code FROM codes UNION ALL SELECT " + SPELT + """ FROM codes)
SELECT replace(code, '-', '') AS key, code AS spelling, count(*) AS n FROM s WHERE regexp_full_match(code, 'PRT-[0-9]{9}') GROUP BY 1, 2""")
def hub_spelling(spark: SparkSession, sf: str) -> DataFrame:
    rows = part_codes(spark, sf)
    both = rows.select("code").unionByName(rows.select(F.col("spelt").alias("code")))
    return resolve.hub_spelling(both, r"^PRT-\d{9}$")


@query("spellings", "WITH " + CODES + ", s AS (SELECT code, p_name FROM codes UNION ALL SELECT " + SPELT + """ , p_name FROM codes)
SELECT upper(trim(code)) AS key, count(DISTINCT code) AS spellings FROM s WHERE code NOT IN ('#REF!', 'SIZE 4 TO 6') GROUP BY 1 HAVING count(DISTINCT code) > 1""")
def spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Codes written in more than one case whose descriptions agree."""
    rows = part_codes(spark, sf)
    both = rows.select("code", F.col("p_name").alias("description")).unionByName(rows.select(F.col("spelt").alias("code"), F.col("p_name").alias("description")))
    return resolve.spelled_differently(both.where(~F.col("code").isin("#REF!", "SIZE 4 TO 6")), F.upper(F.trim("code")))


@query("code_union", "WITH " + CODES + ", s AS (SELECT code FROM codes UNION SELECT " + SPELT + """ FROM codes)
SELECT upper(rtrim(regexp_replace(code, '\\s+', '', 'g'), '.')) AS key, count(*) AS spellings FROM s WHERE code NOT IN ('#REF!', 'SIZE 4 TO 6') GROUP BY 1""")
def code_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = part_codes(spark, sf)
    return resolve.product_codes([rows.select("code"), rows.select(F.col("spelt").alias("code"))])


@query("shared_ids", """
SELECT l_orderkey AS key, count(DISTINCT l_suppkey) AS owners, min(l_suppkey) AS first, max(l_suppkey) AS last FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that more than one supplier ships for."""
    return resolve.shared(world.table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey").withColumnRenamed("l_orderkey", "key")


# Addresses derived from customers: every customer of a nation and segment writes from one mailbox in one of its spellings.
ADDRESS = """CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'A.b.' || c_nationkey || '+x' || c_custkey || '@GMAIL.com'
  WHEN c_mktsegment = 'FURNITURE' THEN 'a.b.' || c_nationkey || '+y@shop.example' ELSE 'ab' || c_custkey || '@shop.example' END"""


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    seg, n, k = F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey")
    address = F.when(seg.isin("BUILDING", "MACHINERY"), F.concat(F.lit("A.b."), n, F.lit("+x"), k, F.lit("@GMAIL.com"))).when(
        seg == "FURNITURE", F.concat(F.lit("a.b."), n, F.lit("+y@shop.example"))).otherwise(F.concat(F.lit("ab"), k, F.lit("@shop.example")))
    return world.table(spark, sf, "customer").withColumn("address", address)


@query("norm_mailbox", """
SELECT c_custkey AS k, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ab' || c_nationkey || '@gmail.com'
 WHEN c_mktsegment = 'FURNITURE' THEN 'a.b.' || c_nationkey || '@shop.example' ELSE 'ab' || c_custkey || '@shop.example' END AS mailbox FROM customer""")
def norm_mailbox(spark: SparkSession, sf: str) -> DataFrame:
    return addresses(spark, sf).select(F.col("c_custkey").alias("k"), codes.normal_mailbox(F.col("address")).alias("mailbox"))


DUPES = """WITH RECURSIVE ev AS (
  SELECT c_custkey AS c, 'm' || CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ab' || c_nationkey || '@gmail.com'
    WHEN c_mktsegment = 'FURNITURE' THEN 'a.b.' || c_nationkey || '@shop.example' ELSE 'ab' || c_custkey || '@shop.example' END AS k FROM customer
  UNION ALL SELECT c_custkey, 'n' || c_nationkey || '/' || CAST(floor(c_acctbal / 1000) AS BIGINT) FROM customer),
first AS (SELECT k, min(c) AS o FROM ev GROUP BY 1), edge AS (SELECT c AS a, o AS b FROM ev JOIN first USING (k) WHERE c <> o),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
walk(a, b) AS (SELECT a, a FROM sym UNION SELECT walk.a, sym.b FROM walk JOIN sym ON sym.a = walk.b),
root AS (SELECT a, min(b) AS r FROM walk GROUP BY 1)"""


def duplicate_evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = addresses(spark, sf)
    mail = rows.select(F.col("c_custkey").alias("account"), codes.normal_mailbox(F.col("address")).alias("key"), F.lit("mailbox").alias("rule"), F.lit(0.9).alias("confidence"))
    place = rows.select(F.col("c_custkey").alias("account"), F.concat_ws("/", "c_nationkey", F.floor(F.col("c_acctbal") / 1000)).alias("key"),
                        F.lit("name and address").alias("rule"), F.lit(0.7).alias("confidence"))
    return mail.unionByName(place), rows.select(F.col("c_custkey").alias("account"), F.col("c_custkey").alias("first_seen"))


@query("dup_accounts", DUPES + " SELECT a AS e, r AS root FROM root WHERE a <> r")
def dup_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who share a normalised mailbox, or a nation and balance band, tied to the first."""
    evidence, accounts = duplicate_evidence(spark, sf)
    return resolve.same_as(resolve.duplicate_edges(evidence, accounts), accounts).select("e", "root")


@query("dup_rules", """
WITH ev AS (SELECT c_custkey AS c, 'mailbox' AS rule, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ab' || c_nationkey || '@gmail.com'
    WHEN c_mktsegment = 'FURNITURE' THEN 'a.b.' || c_nationkey || '@shop.example' ELSE 'ab' || c_custkey || '@shop.example' END AS k FROM customer
  UNION ALL SELECT c_custkey, 'name and address', c_nationkey || '/' || CAST(floor(c_acctbal / 1000) AS BIGINT) FROM customer),
first AS (SELECT rule, k, min(c) AS o FROM ev GROUP BY 1, 2), edge AS (SELECT c, o, min(rule) AS rule FROM ev JOIN first USING (rule, k) WHERE c <> o GROUP BY 1, 2)
SELECT rule, count(*) AS pairs FROM edge GROUP BY 1""")
def dup_rules(spark: SparkSession, sf: str) -> DataFrame:
    counts, _ = resolve.rule_audit(resolve.duplicate_edges(*duplicate_evidence(spark, sf)))
    return counts


@query("survivor_view", """
SELECT min(o_orderkey) AS e, count(*) AS n FROM orders GROUP BY o_custkey""")
def survivor_view(spark: SparkSession, sf: str) -> DataFrame:
    """Orders re-keyed to the first order of their chain."""
    rows = world.table(spark, sf, "orders").select(F.col("o_orderkey").alias("e"))
    return resolve.survivors(rows, chain_roots(order_chain(spark, sf))).groupBy("e").agg(F.count("*").alias("n"))


@query("person_key", """
SELECT person, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'own-' || o_custkey WHEN o_orderstatus = 'F' THEN 'via-' || c_nationkey
 ELSE CAST(min(o_orderkey) OVER (PARTITION BY o_custkey) AS VARCHAR) END AS person FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1""")
def person_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = world.table(spark, sf, "orders")
    joined = orders.join(world.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = F.col("o_orderkey").alias("e")
    own = joined.where("o_orderstatus = 'P'").select(e, F.concat(F.lit("own-"), "o_custkey").alias("v"))
    via = joined.where("o_orderstatus = 'F'").select(e, F.concat(F.lit("via-"), "c_nationkey").alias("v"))
    return resolve.person_key(orders.select(e), own, via, chain_roots(order_chain(spark, sf))).groupBy("person").agg(F.count("*").alias("n"))


@query("org_variants", """
WITH n AS (SELECT DISTINCT p_name || CASE WHEN p_type = 'PROMO' THEN ' Co., Ltd.' WHEN p_type = 'SMALL' THEN ' of ' || lower(p_type) ELSE '' END AS name FROM part),
k AS (SELECT name, array_to_string(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w NOT IN ('', 'co', 'ltd')), ' ') AS key FROM n)
SELECT a.name, b.name AS variant FROM (SELECT key, min(name) AS name FROM k GROUP BY 1) a JOIN k b ON a.name <> b.name AND (a.key = b.key OR starts_with(b.key, a.key || ' '))""")
def org_variants(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_type")
    end = F.when(kind == "PROMO", " Co., Ltd.").when(kind == "SMALL", F.concat(F.lit(" of "), F.lower(kind))).otherwise("")
    return resolve.organisation_variants(world.table(spark, sf, "part").select(F.concat("p_name", end).alias("name")))


@query("check_digit", """
WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 11, '7') AS body FROM part),
d AS (SELECT p_partkey, body, list_transform(range(1, 12), lambda i: CAST(substring(body, i, 1) AS INT)) AS g FROM b),
s AS (SELECT p_partkey, body, list_sum(list_transform(g, lambda x, i: CASE WHEN i % 2 = 1 THEN 3 * x ELSE x END)) AS u,
  list_sum(list_transform(g, lambda x, i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END ELSE x END)) AS l FROM d)
SELECT p_partkey AS k, CAST((10 - u % 10) % 10 AS INT) AS upc, CAST((10 - l % 10) % 10 AS INT) AS luhn FROM s""")
def check_digit(spark: SparkSession, sf: str) -> DataFrame:
    body = F.lpad(F.col("p_partkey").cast("string"), 11, "7")
    return world.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), codes.upc_check(body).alias("upc"), codes.luhn_check(body).alias("luhn"))


@query("field_readers", """
SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END AS amount,
 'o' || o_orderkey || 'x' AS id, 'order ' || o_orderkey AS name FROM orders""")
def field_readers(spark: SparkSession, sf: str) -> DataFrame:
    """Order fields printed as a form prints them and read back by kind."""
    total = F.format_number(F.col("o_totalprice").cast(world.MONEY), 2)
    printed = world.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.concat(F.lit("Issued "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" by us")).alias("day"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("($"), total, F.lit(")"))).otherwise(F.concat(F.lit(" $ "), total)).alias("amount"),
        F.concat(F.lit("O-"), "o_orderkey", F.lit(" X")).alias("id"), F.concat(F.lit("POL/Order, "), "o_orderkey", F.lit(" (123)")).alias("name"))
    return printed.select("k", fields.first_day(F.col("day")).cast("string").alias("day"), money(fields.amount(F.col("amount"))).alias("amount"),
                          fields.plain_id(F.col("id")).alias("id"), fields.plain_name(F.col("name")).alias("name"))


@query("precision_recall", "WITH " + CODES + ", s AS (SELECT p_partkey, p_type AS system, code, " + SPELT + """ AS spelt FROM codes),
c AS (SELECT system, count(*) AS stored, count(*) AS truth, count(*) FILTER (WHERE spelt = code) AS correct FROM s GROUP BY 1)
SELECT system, stored, truth, correct, round(correct / stored, 3) AS precision, round(correct / truth, 3) AS recall FROM c""")
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Spelt codes taken as links and scored against the house codes, per type of part."""
    rows = part_codes(spark, sf).select(F.col("p_type").alias("system"), F.col("p_partkey").alias("hub"), "spelt", "code")
    return score.links(rows.select("system", "hub", F.col("spelt").alias("value")), rows.select("system", "hub", F.col("code").alias("value")))


@query("pairwise_pr", """
WITH m AS (SELECT c_custkey AS id, c_nationkey || c_mktsegment AS p, CAST(c_nationkey AS VARCHAR) AS t, c_acctbal >= 0 AS seen FROM customer),
x AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM m GROUP BY t)) AS truth, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM m WHERE seen GROUP BY t)) AS visible,
 (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM m GROUP BY p)) AS marked, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM m WHERE seen GROUP BY p)) AS found)
SELECT CAST(truth AS BIGINT) AS truth, CAST(visible AS BIGINT) AS visible, CAST(marked AS BIGINT) AS marked, CAST(marked AS BIGINT) AS correct, CAST(1.0 AS DOUBLE) AS precision, round(found / visible, 3) AS recall FROM x""")
def pairwise_pr(spark: SparkSession, sf: str) -> DataFrame:
    """Customers clustered by nation and segment, scored against clusters by nation."""
    rows = world.table(spark, sf, "customer")
    k = F.col("c_custkey").alias("id")
    return score.cluster_pairs(rows.select(k, F.concat("c_nationkey", "c_mktsegment").alias("cluster")), rows.select(k, F.col("c_nationkey").cast("string").alias("cluster")),
                               rows.where("c_acctbal >= 0").select(k))


@query("answers", """
SELECT o_orderkey AS k, o_orderstatus <> 'P' AS number, o_orderstatus <> 'F' AS day, true AS name FROM orders""")
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers written by hand from orders, judged against their values."""
    total = F.col("o_totalprice").cast(world.MONEY)
    rows = world.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), total.cast("string").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit("About $"), F.format_number(total + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0), 2), F.lit(" in all")).alias("said"),
        F.date_format(F.when(F.col("o_orderstatus") == "F", F.date_add("o_orderdate", 1)).otherwise(F.col("o_orderdate")), "MMM d, yyyy").alias("on"),
        F.concat(F.lit("It is: "), F.upper("o_orderpriority"), F.lit("!")).alias("which"), F.col("o_orderpriority").alias("priority"))
    return rows.select("k", score.answer_matches(F.col("said"), F.col("total")).alias("number"), score.answer_matches(F.col("on"), F.col("day")).alias("day"),
                       score.answer_matches(F.col("which"), F.col("priority")).alias("name"))


@query("closed_sample", """
WITH c AS (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def closed_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every order and line that hangs on one region's customers."""
    seeds = world.table(spark, sf, "nation").where("n_regionkey = 2").select(F.concat(F.lit("n"), "n_nationkey").alias("key"))
    tables = score.closed_sample(seeds, {
        "customer": (world.table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("up"), F.concat(F.lit("c"), "c_custkey").alias("me")), "up", "me"),
        "orders": (world.table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("up"), F.concat(F.lit("o"), "o_orderkey").alias("me")), "up", "me"),
        "lineitem": (world.table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("up")), "up", None)})
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("key_coverage", """
SELECT 'customer' AS kind, count(DISTINCT o_custkey) AS in_file, count(DISTINCT o_custkey) FILTER (WHERE c_mktsegment <> 'BUILDING') AS in_store FROM orders JOIN customer ON c_custkey = o_custkey""")
def key_coverage(spark: SparkSession, sf: str) -> DataFrame:
    file = world.table(spark, sf, "orders").select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("v"))
    store = world.table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("v"))
    return score.coverage(file, store)


@query("across_stores", """
SELECT c_name AS key, c_custkey AS left, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey + 5 END AS right FROM customer""")
def across_stores(spark: SparkSession, sf: str) -> DataFrame:
    rows = world.table(spark, sf, "customer")
    one = rows.select(F.col("c_custkey").alias("e"), F.col("c_name").alias("v"))
    two = rows.where("c_mktsegment <> 'BUILDING'").select((F.col("c_custkey") + 5).alias("e"), F.col("c_name").alias("v"))
    return relate.across(one, two)


@query("audit_sample", """
WITH f AS (SELECT 20000000000 + o_orderkey AS e, 'order/status' AS a, o_orderstatus AS v, CAST(o_orderdate AS DATE) AS d FROM orders
  UNION ALL SELECT 20000000000 + o_orderkey, 'order/number', 'O-' || o_orderkey, CAST(o_orderdate AS DATE) FROM orders)
SELECT e, a, v, strftime(d, '%Y-%m-%d') AS evidence FROM f ORDER BY sha256('7:' || e || ' ' || a || ' ' || v) LIMIT 50""")
def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty facts about orders, each with the day its transaction stands for."""
    store = world.store(spark, sf)
    rows = fold.facts_text(store.log(["order/status", "order/number"]), store.attrs)
    evidence = store.tx.select(F.col("id").alias("tx"), F.date_format("at", "yyyy-MM-dd").alias("evidence"))
    return score.audit_sample(rows, F.concat_ws(" ", "e", "a", "v"), 50, 7, evidence).select("e", "a", "v", "evidence")
