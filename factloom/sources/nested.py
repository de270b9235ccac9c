"""JSON sources: bulk exports that mix parents and children, labelled forms, stated truth, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MONEY = "struct<shopMoney:struct<amount:string,currencyCode:string>>"
ORDERS = f"""id string, name string, createdAt string, processedAt string, updatedAt string, cancelledAt string, cancelReason string,
  displayFinancialStatus string, displayFulfillmentStatus string, currencyCode string, sourceName string, discountCodes array<string>,
  subtotalPriceSet {_MONEY}, totalPriceSet {_MONEY}, totalTaxSet {_MONEY}, totalShippingPriceSet {_MONEY}, totalRefundedSet {_MONEY},
  customer struct<id:string,email:string,firstName:string,lastName:string,phone:string>, email string,
  shippingAddress struct<name:string,address1:string,city:string,provinceCode:string,zip:string,countryCodeV2:string>,
  sku string, title string, variantTitle string, quantity int, originalUnitPriceSet {_MONEY}, totalDiscountSet {_MONEY}, vendor string,
  variant struct<id:string>, __parentId string"""
PRODUCTS = """id string, title string, handle string, vendor string, productType string, status string, createdAt string,
  sku string, barcode string, price string, inventoryQuantity int, __parentId string"""


def last_id(gid: Column) -> Column:
    """The number at the end of a global id."""
    return F.substring_index(gid, "/", -1)


def _amount(name: str) -> Column:
    return F.col(f"{name}.shopMoney.amount").try_cast("decimal(18,2)")


def shop_orders(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Orders and their lines from one bulk file; a row with a parent is a line."""
    rows = spark.read.schema(ORDERS).json(path)
    orders = rows.where("__parentId IS NULL").select(
        last_id(F.col("id")).alias("order_id"), "name", F.col("createdAt").try_cast("timestamp").alias("created"),
        F.col("displayFinancialStatus").alias("financial_status"), F.col("displayFulfillmentStatus").alias("fulfillment_status"),
        F.col("currencyCode").alias("currency"), F.col("sourceName").alias("source"), _amount("totalPriceSet").alias("total"),
        *(F.col(f"{x}At").try_cast("timestamp").alias(x) for x in ("processed", "updated", "cancelled")), F.col("cancelReason").alias("cancel_reason"),
        _amount("subtotalPriceSet").alias("subtotal"), _amount("totalTaxSet").alias("tax"), _amount("totalShippingPriceSet").alias("shipping"),
        _amount("totalRefundedSet").alias("refunded"), F.col("discountCodes").alias("discount_codes"), F.col("customer.phone").alias("customer_phone"),
        last_id(F.col("customer.id")).alias("customer_id"), F.col("customer.email").alias("customer_email"), F.col("email").alias("order_email"),
        F.lower(F.trim(F.concat_ws(" ", "customer.firstName", "customer.lastName"))).alias("customer_name"), "shippingAddress")
    lines = rows.where("__parentId IS NOT NULL").select(
        last_id(F.col("id")).alias("line_id"), last_id(F.col("__parentId")).alias("order_id"), "sku", "name", "title", F.col("variantTitle").alias("variant_title"), "vendor", "quantity",
        _amount("originalUnitPriceSet").alias("unit_price"), _amount("totalDiscountSet").alias("discount"), last_id(F.col("variant.id")).alias("variant_id"))
    return orders, lines


def shop_products(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Products and their variants from one bulk file."""
    rows = spark.read.schema(PRODUCTS).json(path)
    products = rows.where("__parentId IS NULL").select(last_id(F.col("id")).alias("product_id"), "title", "handle", "vendor",
                                                       F.col("productType").alias("type"), "status")
    variants = rows.where("__parentId IS NOT NULL").select(
        last_id(F.col("id")).alias("variant_id"), last_id(F.col("__parentId")).alias("product_id"), "sku", "title", "barcode",
        F.col("price").try_cast("decimal(18,2)").alias("price"), F.col("inventoryQuantity").alias("stock"))
    return products, variants


def account_evidence(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence (account, key, rule, confidence) and accounts (account, first_seen) from shop orders,
    from every mailbox and address an account ever used."""
    from factloom.functions.codes import normal_mailbox

    who = orders.where(F.col("customer_id").isNotNull())
    mail = who.select(F.col("customer_id").alias("account"), F.explode(F.array("customer_email", "order_email")).alias("m")).where(
        F.col("m").contains("@")).select("account", normal_mailbox(F.col("m")).alias("key"), F.lit("mailbox").alias("rule"), F.lit(0.9).alias("confidence"))
    home = who.where(F.lower("shippingAddress.name") == F.col("customer_name")).select(
        F.col("customer_id").alias("account"),
        F.concat_ws("|", F.lower("shippingAddress.name"), F.lower("shippingAddress.address1"), "shippingAddress.zip").alias("key"),
        F.lit("name and address").alias("rule"), F.lit(0.7).alias("confidence"))
    seen = who.groupBy(F.col("customer_id").alias("account")).agg(F.min("created").alias("first_seen"))
    return mail.unionByName(home).distinct(), seen


def labelled_forms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(form, field, text) and (form, line, field, text) of annotated forms, gzipped JSON lines.

    Each record has a file name, annotations of (field, spans of text) and grouped line items.
    """
    schema = """filename string, annotations array<struct<field:string,text:string>>,
      line_items array<array<struct<field:string,text:string>>>"""
    rows = spark.read.schema(schema).json(path)
    fields = rows.select(F.col("filename").alias("form"), F.inline("annotations")).select("form", "field", "text")
    lines = rows.select(F.col("filename").alias("form"), F.posexplode("line_items").alias("line", "cells")).select("form", "line", F.inline("cells"))
    return fields, lines.select("form", "line", "field", "text")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(source, ref, at, subject, field, value): what documents state."""
    return spark.read.schema("source string, ref string, at string, subject string, field string, value string").json(path).withColumn(
        "at", F.col("at").try_cast("timestamp"))


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(name, attributes): recorded shapes, one JSON object per shape."""
    return spark.read.schema("name string, attributes array<string>").json(path)
