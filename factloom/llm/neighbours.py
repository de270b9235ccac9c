"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Nearness is the cosine, so vectors are scaled to length 1, where it falls as their distance grows.
They are rotated at random, after which the first few components are a fair sample of a distance.
Each row is in the list of its nearest centroid and kept with its rotated vector in blocks of
columns. A query probes the lists of its nearest centroids. Within a list, column block by column
block, partial distances are added up; after t of d columns a candidate is abandoned if
partial > (t / d) * (1 + e / sqrt(t))^2 * r, where r is the squared distance of the last of the
nearest so far: were it nearer than r, its partial distance would hardly ever be so large. What is
left is scored exactly, in double precision and with the original vectors.

No row is shuffled: each task indexes its rows in blocks and sends its nearest for each query.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.batches import received, sent
from factloom.llm.vectors import PASS_QUERIES, binary, blocks, codebook, coded, commonest_length, finite, matrix, passes, sample, unpacked
from factloom.session import written

#: Inverted lists, and the share of them that a query probes.
LISTS, PROBED = 64, 0.65
#: Columns added up between two tests, and the deviations allowed by a test.
COLUMNS, DEVIATIONS = 16, 2.1
SEED = 13
#: A distance that rounding alone can make.
_ROUNDING = 1e-6


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows that depend on the row alone, not on where it stands: equal rows have equal sums."""
    return np.ascontiguousarray(x).sum(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.sqrt(row_sums(y * y))[:, None]


def cosines(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosine of each row of `x` with `query`."""
    scale, scales = np.abs(query).max(), np.abs(x).max(axis=1, keepdims=True)
    q, y = query / scale, x / scales
    return row_sums(y * q) / (math.sqrt(row_sums((q * q)[None, :])[0]) * np.sqrt(row_sums(y * y)))


class Index:
    """Rotation and centroids, fitted on a sample."""

    def __init__(self, vectors: np.ndarray, lists: int, seed: int = SEED) -> None:
        self.rotation = rotation(vectors.shape[1], seed)
        self.centroids = codebook(unit(vectors) @ self.rotation, lists, seed=seed)

    def probes(self, queries: np.ndarray, share: float) -> np.ndarray:
        """The nearest lists of each rotated query, nearest first."""
        near = queries @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)
        return np.argsort(-near, axis=1, kind="stable")[:, :max(1, math.ceil(share * len(self.centroids)))]


class Block:
    """Rows of one block, list by list, their rotated vectors in blocks of columns."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, index: Index) -> None:
        turned = unit(x) @ index.rotation
        at = coded(turned, index.centroids)
        order = np.argsort(at, kind="stable")
        self.ids, self.x = ids[order], x[order]
        turned = turned[order].astype(np.float32)
        self.columns = [np.ascontiguousarray(turned[:, c:c + COLUMNS]) for c in range(0, turned.shape[1], COLUMNS)]
        self.start = np.searchsorted(at[order], np.arange(len(index.centroids) + 1)).tolist()

    def search(self, name: int, query: np.ndarray, turned: list[np.ndarray], lists: list[int], found: list[tuple[float, int]], most: int) -> int:
        """Adds what the lists hold to the `most` nearest (-cosine, id) of the query; the columns looked at."""
        dims, looked = len(query), 0
        for at in lists:
            a, b = self.start[at], self.start[at + 1]
            if a == b:
                continue
            radius = 2.0 + 2.0 * found[-1][0] if len(found) == most else math.inf
            left = np.arange(a, b)
            partial, seen = np.zeros(b - a, np.float32), 0
            for block, part in zip(self.columns, turned, strict=True):
                apart = (block[a:b] if not seen else block[left]) - part
                partial = partial + np.einsum("ij,ij->i", apart, apart)
                seen += block.shape[1]
                looked += apart.size
                slack = 1.0 if seen == dims else (1 + DEVIATIONS / math.sqrt(seen))**2
                near = partial <= radius * slack * seen / dims + _ROUNDING
                if not near.all():
                    left, partial = left[near], partial[near]
                if not len(left):
                    break
            left = left[self.ids[left] != name]
            if not len(left):
                continue
            scores = cosines(query, self.x[left])
            for k in np.lexsort((self.ids[left], -scores))[:most].tolist():
                insort(found, (-float(scores[k]), int(self.ids[left[k]])))
            del found[most:]
        return looked


def _searched(vectors: DataFrame, index: Index, queries: list[tuple[int, bytes]], dims: int, most: int, share: float) -> DataFrame:
    shipped = sent(vectors, (index, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = received(shipped)
        plain = np.frombuffer(b"".join(x for _, x in asked), "<f8").reshape(-1, dims)
        turned = unit(plain) @ held.rotation
        lists = held.probes(turned, share).tolist()
        parts = [[row[c:c + COLUMNS] for c in range(0, dims, COLUMNS)] for row in turned.astype(np.float32)]
        found: list[list[tuple[float, int]]] = [[] for _ in asked]
        for batch in blocks(batches):
            block = Block(batch.column("vec_id").to_numpy(), unpacked(batch.column("x"), "<f8", dims), held)
            for n, (name, _) in enumerate(asked):
                block.search(name, plain[n], parts[n], lists[n], found[n], most)
        rows = [(n, -s, name) for n, mine in enumerate(found) for s, name in mine]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 3, (pa.int32(), pa.float64(), pa.int64()), strict=True)],
                              names=["query", "score", "vec_id"])
    return vectors.mapInArrow(run, "query int, score double, vec_id long")


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(rows: DataFrame, every: int = 50, most: int = 5, lists: int = LISTS, probed: float = PROBED, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the rows of largest cosine found for each query among `rows` (vec_id, embedding).

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the
    query's own id. Nearest first, then smaller ids. Rows with a null id or vector, a vector of
    zeros, a null or non-finite component, or another number of components than most rows, take no
    part. A query with fewer candidates than `most` in the lists it probes gets those from all
    lists. Repeated rows count each, as queries too; an empty table gives no rows; further columns
    are ignored.

    Rotation and lists are fitted on at most 20,000 vectors; every row is in a list. Queries are
    broadcast in passes of `pass_queries`, each a scan of the rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    dims = commonest_length(rows, "embedding")
    if dims is None:
        return spark.createDataFrame([], RESULT)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "x": binary(matrix(batch.column("embedding"), dims))})
    vectors = written(rows.where(F.size("embedding") == dims).mapInArrow(packed, "vec_id long, x binary"))
    index = Index(np.frombuffer(b"".join(sample(vectors, "x")), "<f8").reshape(-1, dims), lists)
    out = None
    for held in passes(vectors.where(F.col("vec_id") % every == 0), ["vec_id", "x"], pass_queries):
        queries = [(r["vec_id"], r["x"]) for r in held]
        found = written(_first(_searched(vectors, index, queries, dims, most, probed), most))
        # as many rows as the pass has queries; few have too few neighbours in their lists
        enough = {r["query"] for r in found.groupBy("query").count().where(F.col("count") >= most).select("query").collect()}
        again = [n for n in range(len(queries)) if n not in enough]
        if again:
            rest = _first(_searched(vectors, index, [queries[n] for n in again], dims, most, 1.0), most)
            numbers = spark.createDataFrame(list(enumerate(again)), "query int, _n int")
            rest = rest.join(numbers, "query").withColumn("query", F.col("_n")).drop("_n")
            found = found.where(~F.col("query").isin(again)).unionByName(rest) if len(again) < len(queries) else rest
        names = spark.createDataFrame([(n, q[0]) for n, q in enumerate(queries)], "query int, query_id long")
        found = found.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


def _first(found: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
