"""The provided tables as a fact log.

Entities are numbered kind * 10^10 + key; a line item's key is (order, line number), and rows that
repeat it are one line. A day of order or ship dates is a transaction; each event is one too.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import Attribute, kernel_attributes, registry
from factloom.sources.mapping import as_facts, union
from factloom.store import FactLog

KIND = {"customer": 1, "order": 2, "part": 3, "supplier": 4, "nation": 5, "region": 6, "line": 7, "user": 8,
        "document": 9, "message": 10}
WIDTH = 10_000_000_000
FIRST_DAY = "1995-01-01"
DAY_TX = 100_000
EVENT_TX = 1_000_000
MONEY = "decimal(18,2)"

_DEFINITIONS: list[tuple[str, str, str, str, str]] = [
    ("customer/name", "string", "one", "identity", "Account name of a customer."),
    ("customer/nation", "ref", "one", "none", "Nation a customer belongs to."),
    ("customer/segment", "string", "one", "none", "Market segment of a customer."),
    ("nation/name", "string", "one", "identity", "Name of a nation."),
    ("nation/region", "ref", "one", "none", "Region a nation lies in."),
    ("region/name", "string", "one", "identity", "Name of a region."),
    ("supplier/name", "string", "one", "identity", "Account name of a supplier."),
    ("supplier/nation", "ref", "one", "none", "Nation a supplier belongs to."),
    ("part/name", "string", "one", "none", "Descriptive name of a part."),
    ("part/brand", "string", "one", "none", "Brand a part is sold under."),
    ("part/type", "string", "one", "none", "Type of a part."),
    ("part/size", "decimal", "one", "none", "Size of a part."),
    ("order/number", "string", "one", "identity", "Number of an order."),
    ("order/customer", "ref", "one", "none", "Customer who placed an order."),
    ("order/status", "string", "one", "none", "Status of an order: O, P or F."),
    ("order/total", "decimal", "one", "none", "Total price of an order."),
    ("order/placed_on", "date", "one", "none", "Day an order was placed."),
    ("line/order", "ref", "one", "none", "Order a line is part of."),
    ("line/part", "ref", "one", "none", "Part a line orders."),
    ("line/supplier", "ref", "one", "none", "Supplier of a line."),
    ("line/quantity", "decimal", "one", "none", "Quantity of a line."),
    ("line/price", "decimal", "one", "none", "Extended price of a line."),
    ("line/shipped_on", "date", "one", "none", "First day a line shipped."),
    ("user/view", "decimal", "one", "none", "Last value of a user's view event."),
    ("user/click", "decimal", "one", "none", "Last value of a user's click event."),
    ("user/purchase", "decimal", "one", "none", "Last value of a user's purchase event."),
    ("user/signup", "decimal", "one", "none", "Last value of a user's signup event."),
    ("user/error", "decimal", "one", "none", "Last value of a user's error event."),
]
ATTRIBUTES: list[Attribute] = [Attribute(1000 + i, *d) for i, d in enumerate(_DEFINITIONS)]
BY_IDENT: dict[str, Attribute] = {a.ident: a for a in ATTRIBUTES}
EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


# Schemas of the provided tables: no file is opened to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def entity(kind: str, key: str | Column) -> Column:
    return F.lit(KIND[kind] * WIDTH) + (F.col(key) if isinstance(key, str) else key).cast("long")


def day_tx(day: Column) -> Column:
    return F.lit(DAY_TX) + F.date_diff(day, F.lit(FIRST_DAY).cast("date"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by their key: measures added up, the smallest part, supplier and ship day kept."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"),
        from_cents(F.sum(cents("l_quantity"))).alias("quantity"), from_cents(F.sum(cents("l_extendedprice"))).alias("price"),
        F.min("l_shipdate").cast("date").alias("shipped_on"))


def cents(column: str) -> Column:
    """A double with two decimals as whole cents: exact sums in a long buffer."""
    return F.floor(F.col(column) * 100 + 0.5)


def from_cents(total: Column) -> Column:
    return (total.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as proposed facts: whole-number values, asserts unless k is a multiple of four."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        entity("user", "user_id").alias("e"), "event_type", F.floor("value").cast("decimal(18,0)").alias("v"),
        (F.lit(EVENT_TX) + F.col("event_id")).alias("tx"), (k % 4 != 0).alias("op"))


def _group(spark: SparkSession, sf_dir: str, kind: str, wanted: set[str]) -> list[DataFrame]:
    """Facts of one kind of entity, restricted to the wanted attributes."""
    day0 = F.lit(DAY_TX)

    def facts(df: DataFrame, e: Column, tx: Column, values: dict[str, Column]) -> list[DataFrame]:
        mine = {BY_IDENT[n]: v for n, v in values.items() if n in wanted}
        return [as_facts(df, e, tx, mine)] if mine else []

    if kind == "customer":
        return facts(table(spark, sf_dir, "customer"), entity("customer", "c_custkey"), day0, {
            "customer/name": F.col("c_name"), "customer/nation": entity("nation", "c_nationkey"),
            "customer/segment": F.col("c_mktsegment")})
    if kind == "nation":
        return facts(table(spark, sf_dir, "nation"), entity("nation", "n_nationkey"), day0, {
            "nation/name": F.col("n_name"), "nation/region": entity("region", "n_regionkey")})
    if kind == "region":
        return facts(table(spark, sf_dir, "region"), entity("region", "r_regionkey"), day0,
                     {"region/name": F.col("r_name")})
    if kind == "supplier":
        return facts(table(spark, sf_dir, "supplier"), entity("supplier", "s_suppkey"), day0, {
            "supplier/name": F.col("s_name"), "supplier/nation": entity("nation", "s_nationkey")})
    if kind == "part":
        return facts(table(spark, sf_dir, "part"), entity("part", "p_partkey"), day0, {
            "part/name": F.col("p_name"), "part/brand": F.col("p_brand"), "part/type": F.col("p_type"),
            "part/size": F.col("p_size")})
    if kind == "order":
        day = F.col("o_orderdate").cast("date")
        return facts(table(spark, sf_dir, "orders"), entity("order", "o_orderkey"), day_tx(day), {
            "order/number": F.concat(F.lit("O-"), F.col("o_orderkey")),
            "order/customer": entity("customer", "o_custkey"), "order/status": F.col("o_orderstatus"),
            "order/total": F.col("o_totalprice").cast(MONEY), "order/placed_on": day})
    if kind == "line":
        key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return facts(lines(spark, sf_dir), entity("line", key), day_tx(F.col("shipped_on")), {
            "line/order": entity("order", "l_orderkey"), "line/part": entity("part", "part"),
            "line/supplier": entity("supplier", "supplier"), "line/quantity": F.col("quantity"),
            "line/price": F.col("price"), "line/shipped_on": F.col("shipped_on")})
    raise KeyError(kind)


def facts(spark: SparkSession, sf_dir: str, idents: list[str] | None = None) -> DataFrame:
    """The log of all or the named attributes; each table involved is scanned once."""
    wanted = {a.ident for a in ATTRIBUTES if not a.ident.startswith("user/")} if idents is None else set(idents)
    kinds = sorted({i.split("/")[0] for i in wanted} - {"user"})
    parts = [df for k in kinds for df in _group(spark, sf_dir, k, wanted)]
    if any(i.startswith("user/") for i in wanted):
        parts.append(event_log(spark, sf_dir).where(F.col("a").isin([BY_IDENT[i].id for i in wanted])))
    return union(parts)


def raw_feed(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    """The event feed, or its events of some types, as raw facts, not yet canonical."""
    rows = feed(spark, sf_dir) if types is None else feed(spark, sf_dir).where(F.col("event_type").isin(types))
    a = None
    for t in EVENT_TYPES:
        hit = F.col("event_type") == t
        a = F.when(hit, BY_IDENT[f"user/{t}"].id) if a is None else a.when(hit, BY_IDENT[f"user/{t}"].id)
    from factloom.sources.mapping import typed_values
    return rows.select("e", a.cast("long").alias("a"), *typed_values(BY_IDENT["user/view"], F.col("v")), "tx", "op")


def event_log(spark: SparkSession, sf_dir: str, idents: list[str] | None = None) -> DataFrame:
    """The event feed made canonical: what a store would hold after writing it in order.

    Attributes don't touch each other, so those that are not wanted are left out before.
    """
    from factloom.operators.ingest import canonical_one

    types = None if idents is None else [t for t in EVENT_TYPES if f"user/{t}" in idents]
    return canonical_one(raw_feed(spark, sf_dir, types))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction per day that placed an order or shipped a line; its actor is the region
    named by the day's remainder, so provenance joins have somewhere to go."""
    placed = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    shipped = lines(spark, sf_dir).select(F.col("shipped_on").alias("day"))
    first = spark.range(1).select(F.lit(FIRST_DAY).cast("date").alias("day"))
    days = placed.unionByName(shipped).unionByName(first).distinct()
    number = F.date_diff("day", F.lit(FIRST_DAY).cast("date"))
    return days.select(day_tx(F.col("day")).cast("long").alias("id"),
                       (F.lit(KIND["region"] * WIDTH) + number % 5).alias("actor"),
                       F.col("day").cast("timestamp").alias("at"))


def store(spark: SparkSession, sf_dir: str) -> FactLog:
    def read(attributes):
        return facts(spark, sf_dir, None if attributes is None else [a.ident for a in attributes])
    return FactLog(read, registry(spark, kernel_attributes() + ATTRIBUTES), lambda: transactions(spark, sf_dir),
                     known=kernel_attributes() + ATTRIBUTES)
