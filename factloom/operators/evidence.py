"""Documents and evidence: coverage, statements, extraction, ordering rules, personal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.fields import make_day
from factloom.operators.ordered import Running, running

# Shapes of the values a scan for personal data looks for.
EMAIL = r"[\w.+'-]+@[\w-]+(?:\.[\w-]+)+"
EMAIL_ONLY = r"^[^@\s:<>]+@[^@\s]+\.[a-z]+$"
PHONE = r"\(?\b\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b"


def backed(hist: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with the document their transaction cites: `evidence` is (tx, document)."""
    return hist.join(evidence, "tx")


def coverage(tx: DataFrame, facts: DataFrame, evidence: DataFrame, confidence: DataFrame, schema_attrs: list[int]) -> DataFrame:
    """Per actor (actor, transactions, cited, with_confidence): how much of its writing names a document.

    Transactions that only describe the schema don't count.
    """
    wrote = facts.where(~F.col("a").isin(schema_attrs)).select(F.col("tx").alias("id")).distinct()
    cited = evidence.select(F.col("tx").alias("id"), F.lit(1).alias("c")).distinct()
    sure = confidence.select(F.col("tx").alias("id"), F.lit(1).alias("s")).distinct()
    rows = tx.join(wrote, "id", "left_semi").join(cited, "id", "left").join(sure, "id", "left")
    return rows.groupBy("actor").agg(F.count("*").alias("transactions"), F.count("c").alias("cited"), F.count("s").alias("with_confidence"))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def document_coverage(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row (files, recorded, named, dated) of `files` (hash, name) against documents (hash, url, at)."""
    met = files.join(recorded, "hash", "left")
    return met.agg(F.count("*").alias("files"), F.count(F.when(F.col("url").isNotNull() | F.col("at").isNotNull(), 1)).alias("recorded"),
                   F.count_if(F.col("url").endswith(F.col("name"))).alias("named"), F.count("at").alias("dated"))


def issue_dates(documents: DataFrame, truth: DataFrame, zone: str) -> DataFrame:
    """(kind, n, right, right_in_utc): issue instants that fall on the true local day, per kind."""
    met = truth.join(documents, "document", "left")
    local = F.to_date(F.from_utc_timestamp("at", zone))
    return met.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(local == F.col("day")).alias("right"),
                                   F.count_if(F.to_date("at") == F.col("day")).alias("right_in_utc"))


def statement_recall(statements: DataFrame, hist: DataFrame, evidence: DataFrame) -> DataFrame:
    """(field, statements, found, cited): statements whose value is on the right entity anywhere in
    history, and in a transaction that cites their document.

    `statements` is (e, field, value, document) and `hist` (e, field, value, tx), values as canonical
    text. History is reduced to distinct values, and to distinct (value, document), before it meets
    the statements, so repeats on either side never multiply.
    """
    key = ["e", "field", "value"]
    found = hist.select(*key).distinct().withColumn("_found", F.lit(1))
    cited = hist.join(evidence, "tx").select(*key, "document").distinct().withColumn("_cited", F.lit(1))
    met = statements.join(found, key, "left").join(cited, [*key, "document"], "left")
    return met.groupBy("field").agg(F.count("*").alias("statements"), F.count("_found").alias("found"), F.count("_cited").alias("cited"))


def matched_lines(labelled: DataFrame, held: DataFrame, form: str, key: list[str]) -> DataFrame:
    """(form, labelled, found): labelled lines that a record of the form matches, each record once.

    Lines and records of one form with one key are interchangeable, so the smaller of the two
    counts is matched; no pairing is needed.
    """
    by = [form, *key]
    a = labelled.groupBy(*by).agg(F.count("*").alias("want"))
    b = held.groupBy(*by).agg(F.count("*").alias("have"))
    met = a.join(b, by, "left").withColumn("hit", F.least("want", F.coalesce("have", F.lit(0))))
    return met.groupBy(form).agg(F.sum("want").alias("labelled"), F.sum("hit").alias("found"))


def personal_values(strings: DataFrame, personal: DataFrame) -> DataFrame:
    """(personal_values, email_shaped): stored strings equal, but for case, to a personal column's
    value longer than four characters; and strings that are an address and nothing more."""
    values = personal.where(F.length("v") > 4).select(F.lower("v").alias("k")).distinct().withColumn("_hit", F.lit(1))
    rows = strings.select("v").distinct().withColumn("k", F.lower("v")).join(values, "k", "left")
    return rows.agg(F.count("_hit").alias("personal_values"), F.count_if(F.col("v").rlike(EMAIL_ONLY)).alias("email_shaped"))


def found_in_text(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """One row per match of a pattern in whole texts."""
    hits = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    return df.withColumn(name, F.explode(hits))


def totals(lines: DataFrame, printed: DataFrame, by: str) -> DataFrame:
    """(document, lines, total, agrees): the sum of a document's lines against its printed total.

    `lines` has an amount column, `printed` a total column.
    """
    sums = lines.groupBy(by).agg(F.sum("amount").alias("lines"))
    return printed.join(sums, by, "left").select(by, "lines", "total", F.coalesce(F.col("lines") == F.col("total"), F.lit(False)).alias("agrees"))


def next_day(after: Column, month: Column, day: Column) -> Column:
    """The next such day on or after an instant's day, for a date written without a year."""
    # eight years on reach the next 29 February from any day
    days = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: make_day(F.year(after) + i, month, day))
    return F.array_min(F.filter(days, lambda x: x >= F.to_date(after)))


def month_and_day(text: Column) -> tuple[Column, Column]:
    """Month and day of "3/8" or "3月8号" in a message; NULL where there is none."""
    pattern = r"(\d{1,2})\s*[/月]\s*(\d{1,2})"
    found = text.rlike(pattern)
    return (F.when(found, F.regexp_extract(text, pattern, 1).try_cast("int")),
            F.when(found, F.regexp_extract(text, pattern, 2).try_cast("int")))


def forward_only(rows: DataFrame, keys: list[str], order: list[str], rank: str, *, rows_per_range: int | None = None) -> DataFrame:
    """Rows whose rank is above every earlier one of their key: a status that never moves back."""
    out = running(rows, keys, order, {"_seen": Running("max", F.col(rank), inclusive=False)}, rows_per_range=rows_per_range)
    return out.where(F.col("_seen").isNull() | (F.col(rank) > F.col("_seen"))).drop("_seen")


def reply_context(messages: DataFrame, chat: list[str], order: str, ours: Column, text: str, *,
                  rows_per_range: int | None = None) -> DataFrame:
    """Messages with the number of ours so far (`island`) and the last one's text (`asked`)."""
    return running(messages, chat, [order], {
        "island": Running("sum", ours.cast("long")), "asked": Running("last", F.when(ours, F.col(text)))}, rows_per_range=rows_per_range)


def complete(ordered: DataFrame, shipped: DataFrame, order: str, line: str) -> DataFrame:
    """(order, complete): whether the shipped quantities of every line add up to the ordered one."""
    sent = shipped.groupBy(line).agg(F.sum("quantity").alias("_sent"))
    rows = ordered.join(sent, line, "left")
    return rows.groupBy(order).agg(F.every(F.coalesce("_sent", F.lit(0)) >= F.col("quantity")).alias("complete"))


def conflicting(statements: DataFrame, by: list[str]) -> DataFrame:
    """(…, values, first, last): subjects and fields on which documents disagree.

    Distinct values are folded first, so a subject with many equal statements stays small.
    """
    once = statements.select(*by, "value").distinct()
    return once.groupBy(*by).agg(F.count("*").alias("values"), F.min("value").alias("first"), F.max("value").alias("last")).where(
        F.col("values") > 1)


def apply_in_issue_order(statements: DataFrame, by: list[str]) -> DataFrame:
    """(…, value, issued): the value of the latest document on each field; older never replaces newer."""
    return statements.groupBy(*by).agg(F.max_by("value", F.struct("issued", "tx")).alias("value"), F.max("issued").alias("issued"))


def allowed_personal(flags: DataFrame, provenance: DataFrame) -> DataFrame:
    """(ident, actor): attributes flagged as personal and who flagged them."""
    return flags.where("v").join(provenance.select("e", "actor"), "e", "left").select("ident", "actor")


def withdraw(hist: DataFrame, attribute: int) -> DataFrame:
    """(e, a) to excise when an attribute's allowance is withdrawn: every entity that ever held it."""
    return hist.select("e").distinct().withColumn("a", F.lit(attribute).cast("long"))
