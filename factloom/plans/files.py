"""Queries that write the provided tables as files of each kind and read these back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans import world
from factloom.plans.registry import query
from factloom.session import ensure_checkpoint_dir
from factloom.sources import nested, tabular, texts
from factloom.store import capped


def _new(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _csv(df: DataFrame, sep: str = ",") -> str:
    path = _new(df.sparkSession)
    df.write.csv(path, header=True, sep=sep, quote='"', escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def _json(df: DataFrame, compression: str = "none") -> str:
    path = _new(df.sparkSession)
    df.write.json(path, compression=compression)
    return path


def _gid(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"gid://shop/{kind}/"), key)


def _money(amount: Column) -> Column:
    return F.struct(F.struct(amount.cast("decimal(18,2)").cast("string").alias("amount"), F.lit("USD").alias("currencyCode")).alias("shopMoney"))


def _us(day: str) -> Column:
    return F.date_format(day, "MM/dd/yyyy")


@query("read_bulk_orders", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS total, CAST(o_custkey AS VARCHAR) AS customer_id,
 strftime(o_orderdate, '%Y-%m-%d') AS day, count(l_orderkey) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def read_bulk_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and their lines mixed in bulk JSON files, parted again and joined."""
    orders = world.table(spark, sf, "orders").select(
        _gid("Order", F.col("o_orderkey")).alias("id"), F.concat(F.lit("#"), "o_orderkey").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("createdAt"),
        F.col("o_orderstatus").alias("displayFinancialStatus"), _money(F.col("o_totalprice")).alias("totalPriceSet"), F.struct(_gid("Customer", F.col("o_custkey")).alias("id")).alias("customer"))
    lines = world.table(spark, sf, "lineitem").select(
        _gid("LineItem", F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("id"), F.col("l_partkey").cast("string").alias("sku"), F.col("l_quantity").cast("int").alias("quantity"),
        _money(F.col("l_extendedprice")).alias("originalUnitPriceSet"), _gid("Order", F.col("l_orderkey")).alias("__parentId"))
    head, rows = nested.shop_orders(spark, _json(orders.unionByName(lines, allowMissingColumns=True)))
    sums = rows.groupBy("order_id").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"), F.sum("unit_price").alias("amount"))
    return head.join(sums, "order_id", "left").select(
        "order_id", F.col("financial_status").alias("status"), F.col("total").cast("double"), "customer_id", F.date_format("created", "yyyy-MM-dd").alias("day"),
        F.coalesce("lines", F.lit(0)).alias("lines"), "quantity", F.col("amount").cast("double"))


@query("read_bulk_products", """
SELECT p_brand AS product_id, p_brand AS title, count(*) AS variants, count(DISTINCT p_partkey) AS skus, CAST(sum(p_size) AS BIGINT) AS stock, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS price
FROM part GROUP BY p_brand""")
def read_bulk_products(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as products with their parts as variants."""
    part = world.table(spark, sf, "part")
    products = part.select(_gid("Product", F.col("p_brand")).alias("id"), F.col("p_brand").alias("title")).distinct()
    variants = part.select(_gid("ProductVariant", F.col("p_partkey")).alias("id"), F.col("p_partkey").cast("string").alias("sku"), F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("price"),
                           F.col("p_size").alias("inventoryQuantity"), _gid("Product", F.col("p_brand")).alias("__parentId"))
    head, rows = nested.shop_products(spark, _json(products.unionByName(variants, allowMissingColumns=True)))
    sums = rows.groupBy("product_id").agg(F.count("*").alias("variants"), F.count_distinct("sku").alias("skus"), F.sum("stock").alias("stock"), F.sum("price").cast("double").alias("price"))
    return head.select("product_id", "title").join(sums, "product_id")


@query("read_marketplace_orders", """
SELECT 'O-' || l_orderkey AS order_id, o_orderstatus AS status, CAST(l_partkey AS VARCHAR) AS sku, CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price,
 strftime(o_orderdate, '%Y-%m-%d') AS day, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def read_marketplace_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A tab-separated report of every order line; what has no column of its own is in `others`."""
    rows = world.table(spark, sf, "lineitem").join(world.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    path = _csv(rows.select(
        F.concat(F.lit("O-"), "l_orderkey").alias("amazon-order-id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("purchase-date"), F.col("o_orderstatus").alias("order-status"),
        F.col("l_partkey").alias("sku"), F.lit("").alias("asin"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("item-price"),
        F.lit("USD").alias("currency"), F.col("l_returnflag").alias("return-flag")), sep="\t")
    return tabular.amazon_orders(spark, path).select("order_id", "status", "sku", "quantity", F.col("price").cast("double"), F.date_format("purchased", "yyyy-MM-dd").alias("day"),
                                                     F.col("others")["return-flag"].alias("flag"))


@query("read_marketplace_stock", """
SELECT CAST(p_partkey AS VARCHAR) AS sku, 'X' || p_partkey AS fnsku, p_name AS name, CAST(p_retailprice AS DOUBLE) AS price, p_size AS inbound, p_type AS type,
 'FBA' || p_partkey AS shipment_id, p_size + 1 AS expected FROM part""")
def read_marketplace_stock(spark: SparkSession, sf: str) -> DataFrame:
    """Stock and inbound reports of every part, joined again."""
    part = world.table(spark, sf, "part")
    stock = _csv(part.select(
        F.col("p_partkey").alias("sku"), F.concat(F.lit("X"), "p_partkey").alias("fnsku"), F.lit("").alias("asin"), F.col("p_name").alias("product-name"), F.lit("New").alias("condition"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("your-price"), F.col("p_size").alias("afn-inbound-shipped-quantity"), F.col("p_type").alias("kind")), sep="\t")
    inbound = _csv(part.select(
        F.concat(F.lit("FBA"), "p_partkey").alias("Shipment ID"), F.col("p_partkey").alias("Shipment name"), F.lit("ONT8").alias("Ship to"), F.lit("CLOSED").alias("Status"), F.lit(1).alias("SKUs"),
        (F.col("p_size") + 1).alias("Units expected"), F.col("p_size").alias("Units located")))
    sent = tabular.amazon_inbound(spark, inbound).select("shipment_id", F.col("name").alias("sku"), "expected")
    return tabular.amazon_inventory(spark, stock).join(sent, "sku").select(
        "sku", "fnsku", "name", F.col("price").cast("double"), "inbound", F.col("others")["kind"].alias("type"), "shipment_id", "expected")


@query("read_warehouse", """
SELECT 'R' || l_orderkey || '-' || l_linenumber AS receipt_no, CAST(l_partkey AS VARCHAR) AS item_code, CAST(l_quantity AS INT) AS received, strftime(l_shipdate, '%Y-%m-%d') AS received_on,
 'PO-' || l_orderkey || '+PO-' || l_partkey AS refs, count(*) AS n, 'T' || l_orderkey AS tracking, p_size AS on_hand, p_brand AS warehouse
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def read_warehouse(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts of every line, outbound rows of every order, stock of every part, from a warehouse's files."""
    lines, part = world.table(spark, sf, "lineitem"), world.table(spark, sf, "part")
    receipts = _csv(lines.select(
        F.concat(F.lit("R"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("Receipt #"), F.lit("").alias("ASN #"), F.lit("").alias("Container #"),
        F.concat(F.lit("PO-"), "l_orderkey", F.lit(" / PO-"), "l_partkey").alias("Reference"), _us("l_shipdate").alias("Received Date"), F.col("l_partkey").alias("Item Code"), F.lit("").alias("Client SKU"),
        F.lit("").alias("Description"), F.col("l_quantity").cast("int").alias("Expected"), F.col("l_quantity").cast("int").alias("Received"), F.lit(0).alias("Damaged"), F.col("l_orderkey").alias("Order")))
    outbound = _csv(lines.select("l_orderkey").distinct().select(
        F.lit("01/31/1996").alias("Ship Date"), F.col("l_orderkey").alias("Order Reference"), F.lit("").alias("Item Code"), F.lit("").alias("Client SKU"), F.lit(1).alias("Qty"), F.lit("").alias("Carrier"),
        F.concat(F.lit("T"), "l_orderkey").alias("Tracking #")))
    stock = _csv(part.select(
        F.col("p_partkey").alias("Item Code"), F.lit("").alias("Client SKU"), F.col("p_name").alias("Description"), F.lit("").alias("UPC"), F.col("p_brand").alias("Warehouse"), F.col("p_size").alias("On Hand"),
        *[F.lit(0).alias(c) for c in ("Allocated", "Available", "Damaged")], F.lit("").alias("Last Receipt Date")))
    sent = tabular.warehouse_outbound(spark, outbound).where("shipped_on = date'1996-01-31'").select("order_reference", "tracking")
    held = tabular.warehouse_stock(spark, stock).select("item_code", "on_hand", "warehouse")
    rows = tabular.warehouse_receipts(spark, receipts).withColumn("order_reference", F.col("others")["Order"])
    return rows.join(sent, "order_reference").join(held, "item_code").groupBy(
        "receipt_no", "item_code", "received", F.date_format("received_on", "yyyy-MM-dd").alias("received_on"), F.array_join("references", "+").alias("refs"), "tracking", "on_hand", "warehouse").agg(F.count("*").alias("n"))


@query("read_vendors", """
SELECT 'V' || s_suppkey AS vendor, 'S' || s_suppkey AS code, s_name AS company, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance, CAST(s_nationkey AS VARCHAR) AS nation, s_name || ' Ltd.' AS legal FROM supplier""")
def read_vendors(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger's vendor list, amounts with thousands separators, beside the legal names stated for its codes."""
    supplier = world.table(spark, sf, "supplier")
    code = F.concat(F.lit("V"), "s_suppkey")
    listed = _csv(supplier.select(code.alias("Vendor"), F.col("s_name").alias("Company name"), F.lit("USD").alias("Currency"), F.lit("30").alias("Terms"), F.lit("").alias("Email"),
                                  F.format_number("s_acctbal", 2).alias("Open balance"), F.col("s_nationkey").alias("Nation")))
    stated = _csv(supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("supplier_code"), F.concat("s_name", F.lit(" Ltd.")).alias("legal_name"),
                                  code.alias("quickbooks_vendor"), F.lit("").alias("wechat_contact")))
    return tabular.vendors(spark, listed).join(tabular.vendor_truth(spark, stated).withColumnRenamed("ledger_name", "vendor"), "vendor").select(
        "vendor", "code", "company", F.col("balance").cast("double"), F.col("others")["Nation"].alias("nation"), F.col("legal_name").alias("legal"))


@query("read_csv", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(trim(coalesce(text, ''))) AS text, CAST(length(trim(coalesce(text, ''))) AS INT) AS n FROM documents""")
def read_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, line breaks and quotes among them, through CSV files."""
    path = _csv(world.table(spark, sf, "documents").select("doc_id", "text"))
    return tabular.read_csv(spark, path).select("doc_id", F.sha2("text", 256).alias("text"), F.length("text").alias("n"))


@query("read_column_values", """
SELECT CAST(o_custkey AS VARCHAR) AS v FROM orders UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer""")
def read_column_values(spark: SparkSession, sf: str) -> DataFrame:
    """The values of one column over files whose headers differ."""
    path = _new(spark)
    world.table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), "o_orderkey").write.csv(f"{path}/a", header=True)
    world.table(spark, sf, "customer").select("c_name", F.col("c_custkey").alias("customer"), "c_mktsegment").write.csv(f"{path}/b", header=True)
    return tabular.column_values(spark, f"{path}/*/*.csv", "customer")


@query("read_chat", """
SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 1000 + turn), '%Y-%m-%d %H:%M:%S') AS sent, role AS sender,
 sha256(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS text FROM conversations""")
def read_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of every conversation through chat exports."""
    path = _new(spark)
    sent = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("conv_id") * 1000 + F.col("turn"))
    said = world.table(spark, sf, "conversations").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    said.select(F.concat(F.date_format(sent, "yyyy-MM-dd HH:mm:ss "), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))).write.text(path)
    return texts.chat(spark, path, "UTC").select(F.date_format("sent", "yyyy-MM-dd HH:mm:ss").alias("sent"), "sender", F.sha2("text", 256).alias("text"))


@query("read_forms", """
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS line, l_partkey, l_extendedprice FROM lineitem)
SELECT 'O-' || o_orderkey AS form, CAST(-1 AS INT) AS line, 'status' AS field, o_orderstatus AS text FROM orders UNION ALL SELECT 'O-' || o_orderkey, -1, 'priority', o_orderpriority FROM orders
UNION ALL SELECT 'O-' || l_orderkey, CAST(line AS INT), 'part', CAST(l_partkey AS VARCHAR) FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def read_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated forms of every order, gzipped, as their fields and the fields of their lines."""
    def cell(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("text"))
    lines = world.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))).alias("l"))
    forms = world.table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("O-"), "o_orderkey").alias("filename"), F.array(cell("status", F.col("o_orderstatus")), cell("priority", F.col("o_orderpriority"))).alias("annotations"),
        F.transform("l", lambda x: F.array(cell("part", x["l_partkey"]))).alias("line_items"))
    fields, rows = nested.labelled_forms(spark, _json(forms, "gzip"))
    return fields.select("form", F.lit(-1).alias("line"), "field", "text").unionByName(rows)


@query("read_truth", """
SELECT 'link' AS kind, 'C' || c_custkey AS a, 'name' AS b, c_name AS c FROM customer UNION ALL SELECT 'link', 'C' || c_custkey, 'segment', c_mktsegment FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'pair', 'O-' || o_orderkey, CAST(o_custkey AS VARCHAR), NULL FROM orders
UNION ALL SELECT 'statement', 'O-' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus FROM orders
UNION ALL SELECT 'shape', p_brand, string_agg(DISTINCT p_type, '+' ORDER BY p_type), NULL FROM part GROUP BY p_brand""")
def read_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Links, pairs, statements and shapes as truth files give them."""
    customer, orders = world.table(spark, sf, "customer"), world.table(spark, sf, "orders")
    number = F.concat(F.lit("O-"), "o_orderkey")
    links = tabular.truth_links(spark, _csv(customer.select(F.concat(F.lit("C"), "c_custkey").alias("sku"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))))
    pairs = tabular.duplicate_pairs(spark, _csv(orders.select(number.alias("customer_id"), F.col("o_custkey").alias("same_person_as"))))
    stated = nested.statements(spark, _json(orders.select(
        F.lit("mail").alias("source"), number.alias("ref"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), number.alias("subject"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))))
    shapes = nested.shapes(spark, _json(world.table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.sort_array(F.collect_set("p_type")).alias("attributes"))))
    none = F.lit(None).cast("string").alias("c")
    return links.select(F.lit("link").alias("kind"), F.col("hub").alias("a"), F.col("system").alias("b"), F.col("value").alias("c")).unionByName(
        pairs.select(F.lit("pair").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), none)).unionByName(
        stated.select(F.lit("statement").alias("kind"), F.col("ref").alias("a"), F.date_format("at", "yyyy-MM-dd").alias("b"), F.col("value").alias("c"))).unionByName(
        shapes.select(F.lit("shape").alias("kind"), F.col("name").alias("a"), F.array_join("attributes", "+").alias("b"), none))


@query("report_written", """
SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1""")
def report_written(spark: SparkSession, sf: str) -> DataFrame:
    """A report over all orders as written, in both forms, where these agree."""
    counts = world.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    as_json, as_csv = _new(spark), _new(spark)
    tabular.write_report(counts, as_json)
    tabular.write_report(counts, as_csv, "csv")
    other = tabular.read_csv(spark, as_csv).select("status", F.col("n").cast("long"))
    return spark.read.schema("status string, n long").json(as_json).join(other, ["status", "n"])


@query("capped_answers", """
SELECT CAST(most AS INT) AS most, CAST(least(most, (SELECT count(*) FROM customer)) AS INT) AS shown, (SELECT count(*) FROM customer) > most AS more
FROM (SELECT unnest([0, 10, 100000000]) AS most)""")
def capped_answers(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of a relation a display gets under a few caps, and whether it is told of more."""
    rel = world.store(spark, sf).attr("customer/name").select("e")
    told = [(most, *((len(rows), more) for rows, more in [capped(rel, most)])) for most in (0, 10, 100_000_000)]
    return spark.createDataFrame([(most, *rest) for most, rest in told], "most int, shown int, more boolean")
