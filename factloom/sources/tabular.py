"""Delimited files: a generic reader and the exports of marketplaces, warehouses and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import codes
from factloom.sources import quoted


def read_csv(spark: SparkSession, path: str | list[str], *, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Every column as trimmed text, blanks for nulls, a byte-order mark and blanks off the header.

    Files with other headers are read by the names in their own and united by name; a column that
    a file lacks is blank there. Large files are read in splits, also where quoted fields hold line
    breaks; `multi_line` False spares the search for these where there are none.
    """
    parts = [_read_alike(spark, files, sep, multi_line) for files in quoted.alike(spark, path, sep) or [quoted.Alike(path, "", 0, [])]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.fillna("")


def _read_alike(spark: SparkSession, files: quoted.Alike, sep: str, multi_line: bool) -> DataFrame:
    raw = spark.read.csv(files.path, header=True, sep=sep, multiLine=multi_line, quote='"', escape='"')
    names = [c.lstrip("\ufeff").strip() for c in raw.columns]
    df = quoted.read(spark, files, names, sep) if multi_line else raw.toDF(*names)
    return df.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names if c])


def column_values(spark: SparkSession, glob: str, column: str) -> DataFrame:
    """(v): distinct non-blank values of one column over a set of files."""
    return read_csv(spark, glob).select(F.col(f"`{column}`").alias("v")).where("v <> ''").distinct()


def _others(df: DataFrame, *taken: str) -> Column:
    """The columns of a file that no typed column is read from, by their own names; blank ones are left out."""
    rest = [c for c in df.columns if c not in taken]
    cells = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(f"`{c}`") for c in rest))) if rest else F.create_map().cast("map<string,string>")
    return F.map_filter(cells, lambda _, v: v != "").alias("others")


def amazon_orders(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated order report; one row per order line, with every further column in `others`."""
    df = read_csv(spark, path, sep="\t")
    return df.select(F.col("`amazon-order-id`").alias("order_id"), F.col("`purchase-date`").try_cast("timestamp").alias("purchased"),
                     F.col("`order-status`").alias("status"), F.col("sku"), F.col("asin"), F.col("quantity").try_cast("int").alias("quantity"),
                     F.col("`item-price`").try_cast("decimal(18,2)").alias("price"), F.col("currency"),
                     _others(df, "amazon-order-id", "purchase-date", "order-status", "sku", "asin", "quantity", "item-price", "currency"))


def amazon_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated stock report; one row per seller SKU, with every further column in `others`."""
    df = read_csv(spark, path, sep="\t")
    return df.select("sku", "fnsku", "asin", F.col("`product-name`").alias("name"), F.col("condition"),
                     F.col("`your-price`").try_cast("decimal(18,2)").alias("price"),
                     F.col("`afn-inbound-shipped-quantity`").try_cast("int").alias("inbound"),
                     _others(df, "sku", "fnsku", "asin", "product-name", "condition", "your-price", "afn-inbound-shipped-quantity"))


def amazon_inbound(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    return df.select(F.col("`Shipment ID`").alias("shipment_id"), F.col("`Shipment name`").alias("name"), F.col("`Ship to`").alias("ship_to"),
                     F.col("Status").alias("status"), F.col("SKUs").try_cast("int").alias("skus"),
                     F.col("`Units expected`").try_cast("int").alias("expected"), F.col("`Units located`").try_cast("int").alias("located"),
                     _others(df, "Shipment ID", "Shipment name", "Ship to", "Status", "SKUs", "Units expected", "Units located"))


def _us_day(name: str):
    return F.try_to_timestamp(F.col(f"`{name}`"), F.lit("MM/dd/yyyy")).cast("date")


def warehouse_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipts; `references` lists the codes a field like "PO-1 / PO-2" names."""
    df = read_csv(spark, path)
    return df.select(F.col("`Receipt #`").alias("receipt_no"), F.col("`ASN #`").alias("asn"), F.col("`Container #`").alias("container"),
                     codes.references(F.col("Reference")).alias("references"), _us_day("Received Date").alias("received_on"),
                     F.col("`Item Code`").alias("item_code"), F.col("`Client SKU`").alias("client_sku"), F.col("Description").alias("description"),
                     *[F.col(c).try_cast("int").alias(c.lower()) for c in ("Expected", "Received", "Damaged")],
                     _others(df, "Receipt #", "ASN #", "Container #", "Reference", "Received Date", "Item Code", "Client SKU", "Description", "Expected", "Received", "Damaged"))


def warehouse_stock(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    return df.select(F.col("`Item Code`").alias("item_code"), F.col("`Client SKU`").alias("client_sku"), F.col("Description").alias("description"),
                     F.col("UPC").alias("upc"), F.col("Warehouse").alias("warehouse"), F.col("`On Hand`").try_cast("int").alias("on_hand"),
                     *[F.col(c).try_cast("int").alias(c.lower()) for c in ("Allocated", "Available", "Damaged")],
                     _us_day("Last Receipt Date").alias("last_receipt_on"),
                     _others(df, "Item Code", "Client SKU", "Description", "UPC", "Warehouse", "On Hand", "Allocated", "Available", "Damaged", "Last Receipt Date"))


def warehouse_outbound(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    return df.select(_us_day("Ship Date").alias("shipped_on"), F.col("`Order Reference`").alias("order_reference"),
                     F.col("`Item Code`").alias("item_code"), F.col("`Client SKU`").alias("client_sku"),
                     F.col("Qty").try_cast("int").alias("quantity"), F.col("Carrier").alias("carrier"), F.col("`Tracking #`").alias("tracking"),
                     _others(df, "Ship Date", "Order Reference", "Item Code", "Client SKU", "Qty", "Carrier", "Tracking #"))


def vendors(spark: SparkSession, path: str) -> DataFrame:
    """A ledger's vendor list. Only this file of a ledger export is read: the rest is accounting."""
    df = read_csv(spark, path)
    return df.select(F.col("Vendor").alias("vendor"), F.col("`Company name`").alias("company"), F.col("Currency").alias("currency"),
                     F.col("Terms").alias("terms"), F.col("Email").alias("email"),
                     F.replace(F.col("`Open balance`"), F.lit(","), F.lit("")).try_cast("decimal(18,2)").alias("balance"),
                     _others(df, "Vendor", "Company name", "Currency", "Terms", "Email", "Open balance"))


def truth_links(spark: SparkSession, path: str, key: str = "sku") -> DataFrame:
    """(system, hub, value) of a crosswalk file: one row per non-blank cell beside the key."""
    df = read_csv(spark, path)
    cells = F.array(*[F.struct(F.lit(c).alias("system"), F.col(f"`{c}`").alias("value")) for c in df.columns if c != key])
    return df.select(F.col(key).alias("hub"), F.inline(cells)).where("value <> ''").select("system", "hub", "value")


def vendor_truth(spark: SparkSession, path: str) -> DataFrame:
    """(code, legal_name, ledger_name, contact): under which names each supplier code goes."""
    return read_csv(spark, path).where("supplier_code <> ''").select(
        F.col("supplier_code").alias("code"), "legal_name", F.col("quickbooks_vendor").alias("ledger_name"), F.col("wechat_contact").alias("contact"))


def duplicate_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path).select(F.col("customer_id").alias("src"), F.col("same_person_as").alias("dst"))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A score table as JSON lines or CSV."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small score table as markdown; refuses one that is not small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write it instead")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
