"""Sharding by histogram sort: near-equal bytes in every shard, one exchange, native expressions only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together and a hot text can be
split between shards by id. Splitters are found without sorting. Each round counts exact bytes and
rows in cells between evenly spaced probes; cells that hold a wanted splitter and more bytes than
the tolerance, and cells with too many rows for a task, are probed again, more finely (by hash
until a cell holds one hash, then by id). When no cell is left to refine, each shard ends at the
cell boundary nearest to its share of the bytes, every cell's first slot is known, and the rows are
exchanged once, by cell. A splitter that falls into equal texts moves to their nearer edge, if that
is within a small share of a shard or one of these rows; only larger groups are split.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.session import written

SHARDS = 40
#: A row's size is the UTF-8 bytes of its text plus this.
ROW_BYTES = 16
#: Share of a shard's bytes by which a splitter may miss its place.
TOLERANCE = 0.001
#: A splitter moves to the edge of a group of equal texts within GROUP_TOLERANCE of a shard, or within one of
#: the group's rows if that is under MOST_MOVED of a shard.
GROUP_TOLERANCE, MOST_MOVED = 0.01, 0.25
#: Probes of the first round, and of a cell in later rounds.
FIRST_BITS, PROBES = 12, 256
#: A cell is refined while it has more than this share of all rows (and over MOST_ROWS).
ROW_SHARE, MOST_ROWS = 1 / 500, 1000
_WIDE = "decimal(38,0)"


@dataclass
class _Cell:
    """A range of keys: its path of probe numbers, exact counts, and the least and greatest key in it."""

    path: tuple[int, ...]
    size: int
    rows: int
    ends: tuple[int, int, int, int]  # least and greatest hash, least and greatest id

    @property
    def one_hash(self) -> bool:
        return self.ends[0] == self.ends[1]

    @property
    def atomic(self) -> bool:
        return self.one_hash and self.ends[2] == self.ends[3]

    @property
    def span(self) -> tuple[int, int]:
        return self.ends[2:] if self.one_hash else self.ends[:2]


def sized(docs: DataFrame) -> DataFrame:
    """`docs` as a struct `row` with what sharding needs: _hash, _id, size and text_crc32 of the whole text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("_hash"), F.col("doc_id").cast("long").alias("_id"),
                       (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def _at(depth: int) -> list[str]:
    return [f"_c{i}" for i in range(depth)]


def _probed(rows: DataFrame, refined: list[list[_Cell]]) -> DataFrame:
    """`rows` with the probe number of every round: _c0, _c1, ...; -1 where the cell was not refined."""
    out = rows.withColumn("_c0", F.shiftright("_hash", 64 - FIRST_BITS).cast("int"))
    key = F.struct("_hash", F.coalesce("_id", F.lit(-(1 << 63))).alias("_id"))
    for depth, cells in enumerate(refined, 1):
        # bounded: each cell listed holds a splitter or at least ROW_SHARE of the rows
        table = out.sparkSession.createDataFrame(
            [(*c.path, c.one_hash, str(c.span[0]), str(c.span[1] - c.span[0] + 1)) for c in cells],
            ", ".join(f"{c} int" for c in _at(depth)) + ", _by_id boolean, _low string, _wide string")
        value = F.when(F.col("_by_id"), key["_id"]).otherwise(key["_hash"]).cast(_WIDE)
        number = F.floor((value - F.col("_low").cast(_WIDE)).cast("double") * PROBES / F.col("_wide").cast("double")).cast("int")
        out = out.join(F.broadcast(table), _at(depth), "left").withColumn(
            f"_c{depth}", F.coalesce(F.least(number, F.lit(PROBES - 1)), F.lit(-1))).drop("_by_id", "_low", "_wide")
    return out


def _counted(probed: DataFrame, depth: int) -> list[_Cell]:
    known = F.coalesce("_id", F.lit(-(1 << 63)))
    rows = probed.groupBy(*_at(depth)).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("_hash").alias("h0"), F.max("_hash").alias("h1"),
                                            F.min(known).alias("i0"), F.max(known).alias("i1")).collect()
    return sorted((_Cell(tuple(r[c] for c in _at(depth)), r["size"], r["rows"], (r["h0"], r["h1"], r["i0"], r["i1"])) for r in rows), key=lambda c: c.path)


def _marks(cells: list[_Cell], shards: int) -> list[int]:
    """Where each splitter belongs, in bytes below it times `shards`: at its share, or at the edge of a group near there."""
    total, below = sum(c.size for c in cells), 0
    marks = [k * total for k in range(1, shards)]
    # equal texts are one cell, or a run of cells of one hash
    for _, group in groupby(enumerate(cells), lambda at: ("hash", at[1].ends[0]) if at[1].one_hash else ("cell", at[0])):
        held = [c for _, c in group]
        size, rows = sum(c.size for c in held), sum(c.rows for c in held)
        low, high = below * shards, (below + size) * shards
        below += size
        if not held[0].one_hash:
            continue
        most = max(GROUP_TOLERANCE * total, min(size / rows * shards, MOST_MOVED * total))
        for i in range(bisect_right(marks, low), bisect_left(marks, high)):
            edge = low if marks[i] - low <= high - marks[i] else high
            if abs(edge - marks[i]) <= most:
                marks[i] = edge
    return marks


def _to_refine(cells: list[_Cell], shards: int, tolerance: float) -> list[_Cell]:
    total, count = sum(c.size for c in cells), sum(c.rows for c in cells)
    marks, out, below = _marks(cells, shards), [], 0
    for c in cells:
        # splitters wanted strictly inside the cell
        inside = bisect_right(marks, below * shards) < bisect_right(marks, (below + c.size - 1) * shards)
        if not c.atomic and (inside and c.size > tolerance * total / shards or c.rows > max(MOST_ROWS, ROW_SHARE * count)):
            out.append(c)
        below += c.size
    return out


def _placed(cells: list[_Cell], shards: int) -> list[tuple[int, int]]:
    """(shard, first slot) of each cell in key order."""
    below, bounds = 0, [0]
    for c in cells:
        below += c.size
        bounds.append(below * shards)
    first, at = [], 0
    for mark in _marks(cells, shards):
        while at < len(cells) and abs(bounds[at + 1] - mark) < abs(bounds[at] - mark):
            at += 1
        first.append(at)
    out, shard, slot = [], 0, 0
    for i, c in enumerate(cells):
        while shard < shards - 1 and first[shard] <= i:
            shard, slot = shard + 1, 0
        out.append((shard, slot))
        slot += c.rows
    return out


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(row, size, text_crc32, shard, slot): every row of `docs` as a struct, with its shard and its place there.

    Slots count from 0 without gaps in key order. Sizes of shards differ from an equal share by the
    tolerances, or by the rows at a boundary if these are larger. Equal texts share a shard unless a
    splitter falls so far into them that they have to be split, by id; rows that repeat both text and
    id are one key and stay together. A null text counts as empty, a null id comes first. An empty
    table gives no rows.
    """
    rows = sized(docs)
    keys = written(rows.select("_hash", "_id", "size"))
    refined: list[list[_Cell]] = []
    while True:
        cells = _counted(_probed(keys, refined), len(refined) + 1)
        again = _to_refine(cells, shards, tolerance)
        if not again:
            break
        refined.append(again)
    depth = len(refined) + 1
    table = docs.sparkSession.createDataFrame([(*c.path, *at) for c, at in zip(cells, _placed(cells, shards), strict=True)],
                                              ", ".join(f"{c} int" for c in _at(depth)) + ", shard int, _first long")
    # bounded: one row a cell, by the probes of each round
    placed = _probed(rows, refined).join(F.broadcast(table), _at(depth)).repartition(*_at(depth))
    order: list[Column] = [F.col("_hash"), F.col("_id").asc_nulls_first()]
    slot = F.col("_first") + F.row_number().over(Window.partitionBy(*_at(depth)).orderBy(*order)) - 1
    return placed.select("row", "size", "text_crc32", "shard", slot.alias("slot"))
