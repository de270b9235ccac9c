"""Document folders, mailboxes and chat exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.ordered import Running, running
from factloom.session import written

MESSAGE = "path string, message_id string, sent timestamp, subject string, sender string, recipients string, body string"


def folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, hash, length, content): every file of a folder with the SHA-256 of its bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("hash"), "length", "content")


def _parse(path: str, raw: bytes) -> tuple:
    """One message's headers and plain body."""
    from email import message_from_bytes, policy
    from email.utils import parsedate_to_datetime

    m = message_from_bytes(raw, policy=policy.default)
    try:
        sent = parsedate_to_datetime(m["Date"])
        sent = pd.Timestamp(sent).tz_convert("UTC").tz_localize(None) if sent.tzinfo else pd.Timestamp(sent)
    except (TypeError, ValueError):
        sent = pd.NaT
    part = m.get_body(preferencelist=("plain",))
    try:
        body = part.get_content() if part is not None else ""
    except (LookupError, UnicodeDecodeError):
        body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    to = ", ".join(str(m[h]) for h in ("To", "Cc", "Bcc") if m[h])
    return path, m["Message-ID"] and str(m["Message-ID"]).strip(), sent, str(m["Subject"] or ""), str(m["From"] or ""), to, body


def messages(files: DataFrame) -> DataFrame:
    """Messages of `files` (path, content), one message per file, parsed batch by batch in the tasks."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in MESSAGE.split(", ")]
        for batch in batches:
            yield pd.DataFrame([_parse(p, bytes(c)) for p, c in zip(batch["path"], batch["content"])], columns=names)
    return files.select("path", "content").mapInPandas(parse, MESSAGE)


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files: Spark splits the file at its "From " lines, tasks parse the pieces.

    A piece is one message, so a file of any size is read in parallel and never whole.
    """
    pieces = spark.read.text(path, lineSep="\nFrom ").withColumn("path", F.input_file_name())
    body = F.regexp_replace("value", r"^(From )?[^\n]*\n", "")
    # a stuffed ">From " line of a body gets its text back
    content = F.encode(F.regexp_replace(body, r"(?m)^>(>*From )", "$1"), "UTF-8").alias("content")
    return messages(pieces.where(F.length(F.trim("value")) > 0).select("path", content))


def chat(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """(path, number, sent, sender, text): messages of chat exports.

    A message starts at a line that opens with a time stamp, in the exporter's zone, and runs to
    the next. Files are read by line in parallel blocks; a running count of openings in (block,
    line) order numbers the messages of a file from 1, however long the file.
    """
    stamp = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
    lines = written(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value"))
    counted = running(lines, ["path"], ["block", "row"], {"number": Running("sum", F.col("value").rlike(f"^{stamp} ").cast("long"))})
    said = counted.where("number > 0").groupBy("path", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("l"))
    head = F.element_at("l", 1)["value"]
    local = F.try_to_timestamp(F.substring(head, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    body = F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["value"]), "\n")
    return said.select("path", "number", F.to_utc_timestamp(local, zone).alias("sent"),
                       F.trim(F.expr("substring(element_at(l, 1).value, 21)")).alias("sender"),
                       F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))
