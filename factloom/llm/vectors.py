"""Helpers of the operators on vectors: which rows take part, matrices of Arrow batches, query passes, index fitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.ordered import numbered
from factloom.session import written

#: Integer components are below this, so that squared distances of 64 components fit in 63 bits.
MOST_COMPONENT = 1 << 27
#: Vectors that an index is fitted on at most; every row is indexed.
SAMPLE_VECTORS = 20_000
#: Queries of one pass over the rows, so at most this many are broadcast at once.
PASS_QUERIES = 16_384
#: Rows that a task indexes and searches at once.
BLOCK_ROWS = 1 << 16


def finite(vector: str, dims: int | None = None) -> Column:
    """Whether a vector has components, `dims` of them if given, none null or non-finite."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.size(v) > 0 if dims is None else F.size(v) == dims
    return v.isNotNull() & F.coalesce(size & good, F.lit(False))


def commonest_length(rows: DataFrame, vector: str) -> int | None:
    """The number of components most rows have (of several, the smallest); None for an empty table."""
    found = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return None if found is None else found["d"]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column of lists, none of them null, as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly."""
    out = np.floor(x * scale)
    if len(out) and np.abs(out).max() >= MOST_COMPONENT:
        raise ValueError(f"a component of {scale} times a vector is {MOST_COMPONENT} or more: its distances would not fit in a long")
    return out.astype(np.int32)


def binary(x: np.ndarray) -> pa.Array:
    """A row of bytes for each row of the matrix."""
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """The matrix that `binary` was given."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks of `rows` and a last one; no block is empty."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def passes(queries: DataFrame, order: list[str], most: int = PASS_QUERIES) -> Iterator[list]:
    """The rows of `queries` in `order`, at most `most` at a time."""
    dealt = written(numbered(queries, order, "_n"))
    count = dealt.count()
    for first in range(0, count, most):
        # a pass is bounded by `most`
        yield dealt.where((F.col("_n") >= first) & (F.col("_n") < first + most)).orderBy("_n").collect()


def sample(rows: DataFrame, column: str, most: int = SAMPLE_VECTORS) -> list[bytes]:
    """Packed vectors of about `most` rows (vec_id, `column`) chosen by their hash, repeated vectors once; twice as many at most."""
    count = rows.count()
    if count > most:
        part = F.shiftrightunsigned(F.xxhash64("vec_id", column), 1) / F.lit(float(1 << 63))
        rows = rows.where(part < most / count)
    return sorted({bytes(r[0]) for r in rows.select(column).limit(2 * most).collect()})


def codebook(x: np.ndarray, size: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """At most `size` centroids of the sampled vectors, by Lloyd's rounds from rows drawn with `seed`."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:size]].astype(np.float64)
    for _ in range(rounds):
        at = coded(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def coded(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid."""
    return (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)
