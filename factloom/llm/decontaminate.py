"""Benchmark decontamination: test items found inside documents by MinHash containment search.

An item is contained in a document that holds at least `CONTAINMENT` of its distinct five-word
shingles. Items are partitioned by size, and each size has its own sketch length: the item's
smallest shingle hashes (a bottom-k MinHash), where k is one more than the shingles a containing
document may lack. So every containing document holds at least one shingle of the sketch, however
long it is, and the search misses nothing; a partition is skipped for a document with fewer
shingles than its smallest item needs. What the search finds is verified by exact containment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.batches import WordHashes, pieces, received, sent, shingles, texts

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Item text of one pass. More items take more passes over the documents, each broadcasting its own.
PASS_BYTES = 16 << 20


@dataclass
class Item:
    item_id: int | None
    words: int
    shingles: frozenset[bytes]
    need: int


@dataclass
class Partition:
    """Items of one shingle length and size class: their sketch hashes, sorted, and whose each is."""

    words: int
    least_need: int
    hashes: np.ndarray
    items: np.ndarray


def _lines(words: list[bytes], k: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))


def index(rows: list[tuple[int | None, str | None]], containment: float = CONTAINMENT) -> tuple[list[Item], list[Partition]]:
    """The items of `rows` (item_id, text) and their size partitions; items without words are left out."""
    items: list[Item] = []
    entries: dict[tuple[int, int], list[tuple[int, int]]] = {}
    memo = WordHashes()
    for item_id, text in rows:
        words = (text or "").encode().lower().split()
        if not words:
            continue
        k = min(SHINGLE_WORDS, len(words))
        held = frozenset(_lines(words, k))
        need = max(1, int(np.ceil(containment * len(held) - 1e-9)))
        hashes = np.unique(shingles(memo.of(words), k))
        for h in hashes[:len(held) - need + 1].tolist():
            entries.setdefault((k, len(held).bit_length()), []).append((h, len(items)))
        items.append(Item(item_id, k, held, need))
    partitions = []
    for (k, _), found in sorted(entries.items()):
        found.sort()
        numbers = np.array([i for _, i in found])
        partitions.append(Partition(k, min(items[i].need for i in numbers), np.array([h for h, _ in found], np.uint64), numbers))
    return items, partitions


def _candidates(hashes: dict[int, np.ndarray], counts: dict[int, int], partitions: list[Partition]) -> list[int]:
    """The items of which a sketch hash is among `hashes`, of those small enough for the document."""
    out: set[int] = set()
    for p in partitions:
        h = hashes[p.words]
        if counts[p.words] < p.least_need or not len(h):
            continue
        at = np.minimum(np.searchsorted(p.hashes, h), len(p.hashes) - 1)
        hit = np.unique(h[p.hashes[at] == h])
        for a, b in zip(np.searchsorted(p.hashes, hit), np.searchsorted(p.hashes, hit, "right"), strict=True):
            out.update(p.items[a:b].tolist())
    return sorted(out)


def _passes(benchmark: DataFrame, containment: float, pass_bytes: int) -> Iterator[tuple[list[Item], list[Partition]]]:
    """The indexes of the passes: each gathers about `pass_bytes` of item text."""
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // pass_bytes) or 1
    for n in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        yield index([(r["item_id"], r["text"]) for r in part.collect()], containment)


HITS = "array<struct<item_id: long, n_shingles: long, n_found: long, first_word: long, last_word: long>>"


def _searched(docs: DataFrame, held: tuple[list[Item], list[Partition]]) -> DataFrame:
    """(row, hits): each row as a struct, with the items it contains."""
    shipped = sent(docs, held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, partitions = received(shipped)
        lengths = sorted({p.words for p in partitions})
        # one bit a hash: most shingles of a document are in no sketch
        sieve = np.zeros(1 << 20, bool)
        for p in partitions:
            sieve[p.hashes >> np.uint64(44)] = True
        memo = WordHashes()
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "n_shingles", "n_found", "first_word", "last_word")]))
        for batch in pieces(batches):
            out = []
            for text in texts(batch):
                words = text.lower().split()
                every = memo.of(words)
                hashes, counts = {}, {}
                for k in lengths:
                    h = shingles(every, k)
                    hashes[k], counts[k] = h[sieve[h >> np.uint64(44)]], len(h)
                hits = []
                for i in _candidates(hashes, counts, partitions):
                    item = items[i]
                    at = [j for j, s in enumerate(_lines(words, item.words)) if s in item.shingles]
                    n = len({b" ".join(words[j:j + item.words]) for j in at})
                    if n >= item.need:
                        hits.append({"item_id": item.item_id, "n_shingles": len(item.shingles), "n_found": n, "first_word": at[0], "last_word": at[-1] + item.words})
                out.append(hits)
            yield pa.record_batch({"row": batch.column("row"), "hits": pa.array(out, kind)})
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(search, f"row {rows.schema['row'].dataType.simpleString()}, hits {HITS}")


def contained(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, first_word, last_word) of every document and item it contains.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; an item of fewer than five words is one
    shingle of all of them. `first_word` and `last_word` (exclusive) bound the item's shingles in
    the document. Null texts hold nothing; repeated rows and null ids give their rows each. An
    empty table on either side gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for held in _passes(benchmark, containment, pass_bytes):
        found = _searched(rows, held).select(F.col("row.doc_id").alias("doc_id"), F.inline("hits"))
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`docs` without the rows that contain an item; all other rows and every column stay."""
    for held in _passes(benchmark, containment, pass_bytes):
        docs = _searched(docs, held).where(F.size("hits") == 0).select("row.*")
    return docs
