"""Samples of several tables in which no reference dangles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut, is_empty, written


@dataclass(frozen=True)
class Reference:
    """Rows of `table` name rows of `target` in `column`.

    `most` bounds how many rows that name one sampled target row the sample takes along: None for
    all of them, 0 for none, in which case only the other direction is followed.
    """

    table: str
    column: str
    target: str
    most: int | None = 0


def closed_sample(tables: dict[str, tuple[DataFrame, str]], references: list[Reference], seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of each table (rows, its key column) such that every sampled reference has its target in the sample.

    `seeds` (key) start the sample. Two things are repeated until nothing is new. Upward, whatever a
    sampled row names is sampled, without bound. Downward, of the rows that name a sampled row of the
    target, up to `most` are: the first by the SHA-256 of their key as text, so that the choice is the
    same in every run and does not depend on the round. Rows that come in for another reason do not
    count against it. Rows that share a key come together. A reference that is null, or names a row that its target does not have, is followed
    nowhere; so in the sample it dangles only where it dangles in the table.

    Each table is scanned once for each reference, keys and references alone, into narrow tables
    that the rounds join with the keys that are new, and once for the result. Of a hot target, each
    task passes at most `most` rows on. Keys may be of any type; rows whose key is null are not
    sampled. Extra columns are kept. Empty tables give empty samples.
    """
    for r in references:
        if r.table not in tables or r.target not in tables:
            raise ValueError(f"no table of the sample: {r.table} or {r.target}")
        if r.most is not None and r.most < 0:
            raise ValueError("a bound is a number of rows")
    keyed = {name: rows.where(F.col(key).isNotNull()) for name, (rows, key) in tables.items()}
    if set(seeds) - set(tables):
        raise ValueError("seeds of a table that is not there")
    up = [written(_links(keyed[r.table], tables[r.table][1], r.column, keyed[r.target], tables[r.target][1])) for r in references]
    down = [links if r.most is None else None if r.most == 0 else written(_first(links, r.most)) for r, links in zip(references, up)]
    newest = {name: cut(keyed[name].select(F.col(tables[name][1]).alias("key")).join(s.select("key"), "key", "left_semi").distinct())
              for name, s in seeds.items()}
    seen: dict[str, list[DataFrame]] = {name: [df] for name, df in newest.items()}
    while newest:
        found: dict[str, list[DataFrame]] = {}
        for i, r in enumerate(references):
            if r.table in newest:
                found.setdefault(r.target, []).append(
                    up[i].join(newest[r.table].select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key")))
            if r.target in newest and down[i] is not None:
                found.setdefault(r.table, []).append(down[i].join(
                    newest[r.target].select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key")))
        newest = {}
        for name, parts in found.items():
            rows = _union(parts).distinct()
            if name in seen:
                rows = rows.join(_union(seen[name]), "key", "left_anti")
            rows = cut(rows)
            if not is_empty(rows):
                newest[name] = rows
                seen.setdefault(name, []).append(rows)
                if len(seen[name]) >= 8:
                    seen[name] = [cut(_union(seen[name]))]
    out = {}
    for name, (rows, key) in tables.items():
        kept = _union(seen[name]) if name in seen else rows.select(F.col(key).alias("key")).where(F.lit(False))
        out[name] = keyed[name].join(kept.select(F.col("key").alias(key)), key, "left_semi")
    return out


def dangling(sample: dict[str, DataFrame], tables: dict[str, tuple[DataFrame, str]], references: list[Reference]) -> DataFrame:
    """(table, column, n): references of a sample whose target its table has and the sample lacks."""
    out = None
    for r in references:
        key = tables[r.target][1]
        named = sample[r.table].select(F.col(r.column).alias("k")).where("k is not null")
        lost = named.join(tables[r.target][0].select(F.col(key).alias("k")), "k", "left_semi").join(
            sample[r.target].select(F.col(key).alias("k")), "k", "left_anti")
        part = lost.agg(F.count("*").alias("n")).select(F.lit(r.table).alias("table"), F.lit(r.column).alias("column"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def _links(rows: DataFrame, key: str, column: str, target: DataFrame, target_key: str) -> DataFrame:
    """(src, dst), each once: references whose target is there."""
    named = rows.select(F.col(key).alias("src"), F.col(column).alias("dst")).where("dst is not null")
    return named.join(target.select(F.col(target_key).alias("dst")), "dst", "left_semi").distinct()


def _first(links: DataFrame, most: int) -> DataFrame:
    """The first `most` links of each target.

    Spark limits such a window before its exchange where `most` is small; past that bound hash parts
    of a target are limited first, so a hot one is still spread.
    """
    limited = int(links.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    order = links.withColumn("_order", F.sha2(F.col("src").cast("string"), 256))
    if most > limited:
        parted = order.withColumn("_part", F.pmod(F.xxhash64("src"), F.lit(256)))
        order = _limit(parted, ["dst", "_part"], most).drop("_part")
    return _limit(order, ["dst"], most).select("src", "dst")


def _limit(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_order", "src")))
    return numbered.where(F.col("_n") <= most).drop("_n")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
