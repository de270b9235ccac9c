"""Helpers shared by the operators: Arrow batches cut to a bounded size, word hashes, shingles.

Words are `[^\x20\x09-\x0D]+` of the UTF-8 bytes; `bytes.split()` splits on exactly those characters.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

#: Text bytes handled at once inside a task; a single longer text is handled alone.
PIECE_BYTES = 4 << 20
#: Entries of a worker's word memo before it starts anew.
MEMO_WORDS = 300_000
_PRIME = 0x9E3779B97F4A7C15
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of about `most` bytes of `column`, at least one row each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths) // most
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def sent(df: DataFrame, value) -> Broadcast:
    """`value` for the tasks that map `df`, with its classes; its size must be bounded by the caller."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def received(held: Broadcast):
    return pickle.loads(held.value)


def made_once(held: Broadcast, make):
    """`make` of the value, made by a worker's first task and kept with the broadcast for its others; its memos must be bounded."""
    if not hasattr(held, "made"):
        held.made = make(received(held))
    return held.made


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each row; a null text is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, remembered in a memo of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """`x` with every output bit dependent on every input bit (a bijection of 64-bit values)."""
    x = (x ^ (x >> np.uint64(33))) * _MIX_A
    x = (x ^ (x >> np.uint64(33))) * _MIX_B
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the `k` consecutive word hashes from each position: polynomials mod 2^64, built by doubling."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    out, have, power = None, 0, hashes
    span = 1
    while True:
        if k & span:
            if out is None:
                out = power[:len(hashes) - span + 1]
            else:
                n = len(hashes) - have - span + 1
                out = out[:n] * np.uint64(pow(_PRIME, span, 1 << 64)) + power[have:have + n]
            have += span
        if have == k:
            return mixed(out)
        power = power[:len(power) - span] * np.uint64(pow(_PRIME, span, 1 << 64)) + power[span:]
        span *= 2


def signed(x: np.ndarray) -> np.ndarray:
    """The 64-bit values as Spark's signed longs."""
    return x.astype(np.uint64, copy=False).view(np.int64)
