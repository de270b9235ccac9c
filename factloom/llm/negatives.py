"""Hard-negative mining through an inverted multi-index.

Vectors are whole numbers and a score is an inner product. The two halves of a vector have a
codebook each, and a pair of codes is a cell. Each task indexes its rows in blocks: the rows of a
block lie cell by cell, and each code of either half has a radius, the largest distance of a row's
half from it. For an anchor with halves p and q no row of cell (i, j) scores more than
(p.c_i + |p| r_i) + (q.c_j + |q| r_j). A heap yields the cells in the order of these sums (the
multi-sequence algorithm); the search stops once the sum certifies that no cell left can change any
window of the anchor, and passes over cells whose least possible score lies above them all.

No row is shuffled: a task sends only what it found for each anchor, at most a window's length.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.batches import received, sent
from factloom.llm.vectors import PASS_QUERIES, binary, blocks, codebook, coded, commonest_length, finite, integers, matrix, passes, sample, unpacked
from factloom.session import written

#: Codes of each half; cells are pairs of them.
CODES = 16
_ROUNDING = 1e-9


class Window:
    """The first `most` (score, id) of those with least <= score <= highest: larger scores first, then smaller ids."""

    def __init__(self, least: int, highest: int, most: int) -> None:
        self.least, self.highest, self.most = least, highest, most
        self.found: list[tuple[int, int]] = []

    @property
    def floor(self) -> int:
        """The least score that could still enter."""
        return -self.found[-1][0] if len(self.found) == self.most else self.least

    def offer(self, score: int, name: int) -> None:
        if self.floor <= score <= self.highest:
            insort(self.found, (-score, name))
            del self.found[self.most:]


class Block:
    """Rows of one block, cell by cell, with the radii of the codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> None:
        half = x.shape[1] // 2
        halves = (x[:, :half].astype(np.float64), x[:, half:].astype(np.float64))
        codes = [coded(h, b) for h, b in zip(halves, books, strict=True)]
        self.books, self.radii = books, []
        for h, b, c in zip(halves, books, codes, strict=True):
            radius = np.full(len(b), -np.inf)
            np.maximum.at(radius, c, np.linalg.norm(h - b[c], axis=1))
            self.radii.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        # products of doubles are exact while they stay below 2^53
        self.most = int(np.abs(x).max(initial=0))
        self.whole, self.x = x[order].astype(np.int64), x[order].astype(np.float64)
        self.start = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1)).tolist()

    def bounds(self, anchor: np.ndarray) -> list[tuple[list[float], list[float], list[int]]]:
        """(upper, lower bound of the half score, code) of the codes with rows, by descending upper bound, for each half."""
        out, at = [], 0
        for book, radius in zip(self.books, self.radii, strict=True):
            half = anchor[at:at + book.shape[1]].astype(np.float64)
            at += book.shape[1]
            used = np.flatnonzero(np.isfinite(radius))
            length = np.linalg.norm(half)
            middle, reach = book[used] @ half, length * radius[used]
            # more than the products are rounded by
            reach += _ROUNDING * length * (np.linalg.norm(book[used], axis=1) + radius[used]) + 0.5
            order = np.argsort(-(middle + reach), kind="stable")
            out.append(((middle + reach)[order].tolist(), (middle - reach)[order].tolist(), used[order].tolist()))
        return out

    def scores(self, anchor: np.ndarray, most: int, a: int, b: int) -> np.ndarray:
        if self.most * most * len(anchor) < 1 << 53:
            return (self.x[a:b] @ anchor.astype(np.float64)).astype(np.int64)
        return self.whole[a:b] @ anchor

    def search(self, anchor: np.ndarray, windows: list[Window], wanted: Callable[[np.ndarray], np.ndarray]) -> int:
        """Offers the rows that `wanted` says (by slices of labels and ids) to the anchor's windows; the number of cells visited."""
        (up1, low1, code1), (up2, low2, code2) = self.bounds(anchor)
        highest, most, visited = max(w.highest for w in windows), int(np.abs(anchor).max(initial=0)), 0
        heap, width = [(-(up1[0] + up2[0]), 0, 0)], len(self.books[1])
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < min(w.floor for w in windows):
                break
            if j + 1 < len(up2):
                heapq.heappush(heap, (-(up1[i] + up2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(up1):
                heapq.heappush(heap, (-(up1[i + 1] + up2[0]), i + 1, 0))
            cell = code1[i] * width + code2[j]
            a, b = self.start[cell], self.start[cell + 1]
            if a == b or low1[i] + low2[j] > highest:
                continue
            visited += 1
            scores = self.scores(anchor, most, a, b)
            hit = (scores >= min(w.floor for w in windows)) & (scores <= highest)
            if not hit.any():
                continue
            at = np.flatnonzero(hit & wanted(slice(a, b)))
            # the best first, so that few others get into a window
            at = at[np.lexsort((self.ids[a + at], -scores[at]))]
            for w in windows:
                inside = at[(scores[at] <= w.highest) & (scores[at] >= w.floor)][:w.most]
                for s, name in zip(scores[inside].tolist(), self.ids[a + inside].tolist(), strict=True):
                    w.offer(s, name)
        return visited


def _books(vectors: DataFrame, dims: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(sample(vectors, "x")), "<i4").reshape(-1, dims)
    half = dims // 2
    return codebook(x[:, :half], codes), codebook(x[:, half:], codes, seed=2)


def _searched(vectors: DataFrame, books: tuple, anchors: list[tuple], dims: int, negatives: bool) -> DataFrame:
    """(anchor, window, score, vec_id) of each task's best rows for the windows of each of `anchors`.

    An anchor is (id, label, vector, [(least, highest, most)]); its rows are those of other labels,
    or of its own one without those of its own id.
    """
    shipped = sent(vectors, (books, anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = received(shipped)
        windows = [[Window(*w) for w in a[3]] for a in asked]
        for batch in blocks(batches):
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            block = Block(ids, labels, unpacked(batch.column("x"), "<i4", dims), held)

            for (name, label, vector, _), mine in zip(asked, windows, strict=True):
                def wanted(at: slice, name=name, label=label, block=block) -> np.ndarray:
                    return block.labels[at] != label if negatives else (block.labels[at] == label) & (block.ids[at] != name)
                block.search(np.frombuffer(vector, "<i4").astype(np.int64), mine, wanted)
        rows = [(n, k, -s, name) for n, mine in enumerate(windows) for k, w in enumerate(mine) for s, name in w.found]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                              names=["anchor", "window", "score", "vec_id"])
    return vectors.mapInArrow(run, "anchor int, window int, score long, vec_id long")


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first `most` of what the tasks found for each window, with ranks; each task sent no more than that."""
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def whole(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, label, x) with each component floor(scale * x), packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "x": binary(integers(matrix(batch.column("embedding"), dims), scale))})
    return rows.where(finite("embedding", dims)).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, "vec_id long, label long, x binary")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, scale: int = 256, share: tuple[int, int] = (80, 100),
         codes: int = CODES, pass_anchors: int = PASS_QUERIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the anchors among `rows`.

    `rows` is (vec_id, label, embedding). Rows with a null id, label or vector, a null or non-finite
    component, or another number of components than most rows, take no part. Each component x becomes
    floor(scale * x); a score is an inner product, larger ones first, then smaller ids. Anchors are
    the rows whose id is divisible by `every`. Their positives are the first rows of their label
    without those of their own id; for each, the negatives are the first rows of other labels with
    share[0] * positive <= share[1] * negative <= share[1] * positive. An anchor without positives
    and a positive without negatives give no row, an empty table none at all. Repeated rows count
    each, as anchors too. Further columns are ignored. A component of 2^27 or more is an error.

    Codebooks are fitted on at most 20,000 vectors; every row is indexed and the results are exact.
    Anchors are broadcast in passes of `pass_anchors`, each two scans of the rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null")
    dims = commonest_length(rows.where(finite("embedding")), "embedding")
    if dims is None:
        return spark.createDataFrame([], RESULT)
    vectors = written(whole(rows, dims, scale))
    books = _books(vectors, dims, codes)
    out = None
    low, high = share
    for held in passes(vectors.where(F.col("vec_id") % every == 0), ["vec_id", "label", "x"], pass_anchors):
        lowest = np.iinfo(np.int64).min
        anchors = [(r["vec_id"], r["label"], r["x"], [(lowest, -lowest - 1, positives)]) for r in held]
        # a pass has at most `positives` of these for each of its anchors
        best = _first(_searched(vectors, books, anchors, dims, False), positives).orderBy("anchor", "rank").collect()
        windows: dict[int, list] = {}
        for r in best:
            windows.setdefault(r["anchor"], []).append(r)
        asked = [(*anchors[n][:3], [(-(-low * r["score"] // high), r["score"], negatives) for r in rs]) for n, rs in windows.items()]
        if not asked:
            continue
        pairs = [(k, w, asked[k][0], r["vec_id"], r["score"]) for k, rs in enumerate(windows.values()) for w, r in enumerate(rs)]
        named = spark.createDataFrame(pairs, "anchor int, window int, anchor_id long, positive_id long, positive_score long")
        found = _first(_searched(vectors, books, asked, dims, True), negatives).join(named, ["anchor", "window"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)
