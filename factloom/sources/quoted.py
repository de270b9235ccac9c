"""Delimited files with line breaks in quotes, read in splits.

Spark's own reader gives such a file to one task, since a split cannot know whether it starts inside
quotes. One look at the lines tells the files in which no line ends in quotes: their lines are records
where they are, and none is shuffled.

In the others every line is first a map of that one bit: the state it ends in if it starts outside
quotes, and if it starts inside. Maps compose, so each run of lines is a map too, and a file's runs, a
row each, give the state every run starts in. Then every line knows its own. Records within a run are
parsed where they are; only the parts of those that go over its ends are brought together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from factloom.session import cut

#: Lines that hold no record: nothing, or what a carriage return leaves of it.
BLANK = ["", "\r"]
#: A run of lines is a window's group and held by one task: 2 to this power at most, however large a split.
RUN_BITS = 12


def _ends_inside(line: Column, sep: str, inside: bool) -> Column:
    """Whether a line ends in quotes, by its cells: a quote opens at the start of a cell only, and a doubled one is two."""
    def after(state: Column, cell: Column) -> Column:
        quotes = F.length(cell) - F.length(F.replace(cell, F.lit('"'), F.lit("")))
        return F.when(state | cell.startswith('"'), state != (quotes % 2 == 1)).otherwise(F.lit(False))
    return F.when(~line.contains('"'), F.lit(inside)).otherwise(F.aggregate(F.split(line, re.escape(sep), -1), F.lit(inside), after))


def _before(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`rows`, maps (f0, f1), with (g0, g1): the state before each if the first of its group starts outside, and inside.

    What a run of maps does is what its last constant map gives, flipped by every swap after that one.
    """
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("f0") == F.col("f1")
    counted = rows.withColumn("_swaps", F.count_if(F.col("f0") & ~F.col("f1")).over(upto))
    seen = counted.withColumn("_last", F.last(F.when(constant, F.struct(F.col("f0").alias("state"), F.col("_swaps").alias("swaps"))), ignorenulls=True).over(past)).withColumn(
        "_swaps", F.coalesce(F.lag("_swaps").over(Window.partitionBy(*by).orderBy(*order)), F.lit(0)))
    flipped = (F.col("_swaps") - F.coalesce("_last.swaps", F.lit(0))) % 2 == 1
    return seen.select(*rows.columns, *((F.coalesce("_last.state", F.lit(start)) != flipped).alias(f"g{int(start)}") for start in (False, True)))


def _through(state: Column) -> Column:
    return F.when(state, F.col("f1")).otherwise(F.col("f0"))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, "\r$", "")


@dataclass(frozen=True)
class Alike:
    """Files that start with the same line: how many have records of one line only, and which have longer ones."""

    path: str | list[str]
    head: str
    plain: int
    longer: list[str]


def alike(spark: SparkSession, path: str | list[str], sep: str = ",") -> list[Alike]:
    """The files of a path by their first line that is not blank, in its order; the path itself where all are alike.

    Files without such a line have no records and are in none.
    """
    line = F.col("value")
    full = ~line.isin(BLANK)
    # a set of two truths instead of one `or`: with it Spark aggregates in objects, and does not sort every line for the text it keeps of one
    files = _lines(spark, path).groupBy("file").agg(
        F.min_by(F.when(full, line), F.when(full, F.struct("at", "n"))).alias("head"),
        F.array_contains(F.collect_set(_ends_inside(line, sep, False)), True).alias("longer")).where("head is not null")
    # names are only gathered of files that are read by them
    found = cut(files.withColumn("head", _bare(F.col("head"))))
    heads = found.groupBy("head").agg(F.count_if(~F.col("longer")).alias("plain"), F.sort_array(F.collect_list(F.when(F.col("longer"), F.col("file")))).alias("longer")).orderBy("head").collect()
    if len(heads) < 2:
        return [Alike(path, h.head, h.plain, h.longer) for h in heads]
    named = {r.head: [unquote(f) for f in r.files] for r in found.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()}
    return [Alike(named[h.head], h.head, h.plain, h.longer) for h in heads]


def records(spark: SparkSession, path: str | list[str], sep: str = ",", only: list[str] | None = None) -> DataFrame:
    """(file, number, record): the records of every file, or of some, as text, counted from 1; the first is its header.

    Lines end in a line feed, with or without a carriage return; within quotes both are kept as they
    are. Blank lines between records are none. A quote that is never closed makes the rest of its
    file one record, as it does in Spark's reader. An empty file has no records.
    """
    line = F.col("value")
    lines = _lines(spark, path)
    if only is not None:
        lines = lines.where(F.col("file").isin(only))
    # lines of a split are numbered through
    lines, run = lines.withColumn("run", F.shiftright("n", RUN_BITS)), ["file", "at", "run"]
    maps = _before(lines.withColumn("f0", _ends_inside(line, sep, False)).withColumn("f1", _ends_inside(line, sep, True)), run, ["n"])
    full = ~line.isin(BLANK)
    runs = maps.groupBy(*run).agg(
        F.max_by(F.struct(_through(F.col("g0")).alias("f0"), _through(F.col("g1")).alias("f1")), "n").alias("f"),
        F.count_if(~F.col("g0") & full).alias("n0"), F.count_if(~F.col("g1") & full).alias("n1")).select(*run, "f.*", "n0", "n1")
    # a row a run: a file's start outside quotes
    placed = _before(runs, ["file"], ["at", "run"]).select(*run, F.col("g0").alias("_inside"), F.when(F.col("g0"), F.col("n1")).otherwise(F.col("n0")).alias("_n"))
    placed = placed.withColumn("_first", F.sum("_n").over(Window.partitionBy("file").orderBy("at", "run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    known = maps.join(placed, run).withColumn("inside", F.when(F.col("_inside"), F.col("g1")).otherwise(F.col("g0")))
    begins = ~F.col("inside") & full
    # a line that goes on with a record of an earlier run counts as that one: none has begun in its own
    number = F.col("_first") + F.count_if(begins).over(Window.partitionBy(*run).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    numbered = known.select(*run, "n", "value", number.alias("number"), "inside", _through(F.col("inside")).alias("open")).where(F.col("inside") | full)

    def joined(*order: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"]), "\n").alias("value")
    # a run's lines are together already; only what it has of records that go over its ends is shuffled again
    parts = numbered.groupBy(*run, "number").agg(joined("n"), (F.bool_or(~F.col("inside")) & F.bool_or(~F.col("open"))).alias("whole"))
    over = parts.where("not whole").groupBy("file", "number").agg(joined("at", "run"))
    return parts.where("whole").select("file", "number", "value").unionByName(over).select("file", "number", _bare(F.col("value")).alias("record"))


def _bodies(spark: SparkSession, files: Alike, sep: str) -> DataFrame:
    """(record): the records of files that start alike, without their headers."""
    head, line = F.lit(files.head), _bare(F.col("value"))
    lines = _lines(spark, files.path)
    plain = lines.where(~F.col("file").isin(files.longer)) if files.longer else lines
    # a record is none where it is the header, so that what is asked of it is never asked of that, in whatever order
    found = plain.where(~F.col("value").isin(BLANK) & (line != head)).select(F.when(line != head, line).alias("record"))
    # lines like the header are alike, so all but one a file are records, whichever came first
    again = plain.where(line == head).count() - files.plain
    if again > 0:
        found = found.unionByName(spark.range(again).select(head.alias("record")))
    if files.longer:
        found = found.unionByName(records(spark, files.path, sep, files.longer).where("number > 1").select("record"))
    return found


def read(spark: SparkSession, files: Alike, names: list[str], sep: str = ",") -> DataFrame:
    """The cells of files that start alike, as text by `names`; null where a record is too short."""
    cells = StructType([StructField(f"_{i}", StringType()) for i in range(len(names))])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    found = _bodies(spark, files, sep).select(F.from_csv("record", cells.simpleString(), options).alias("cells"))
    return found.select(*(F.col(f"cells._{i}").alias(name) for i, name in enumerate(names)))
