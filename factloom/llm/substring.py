"""Substring dedup: passages of at least `WINDOW` words that an earlier document holds are removed.

The reference is the corpus itself, so it has no size bound and is not broadcast whole. It is cut
into shards by content instead, and each shard meets only the passages that can match in it: every
window of words is dealt to its minimizer, the smallest hash of its `ANCHOR`-word shingles, and
consecutive windows of one minimizer travel as one run. Equal windows have equal minimizers, so
they meet in one shard. Equal runs are collapsed to their smallest document by their hash; the
distinct runs of a minimizer, in the order of their documents, are then streamed through the
suffix automaton of the runs before them: its matching statistics say for each position how long a
passage of an earlier document ends there, and spans over the threshold are removed. A minimizer
with more distinct runs than `MOST_RUNS` (many near copies of one passage) is resolved window by
window instead, by a minimum over equal windows, which is pre-aggregated and splits over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from factloom.llm.batches import WordHashes, pieces, shingles, signed, texts
from factloom.session import written

WINDOW = 50
ANCHOR = 12
MOST_RUNS = 256
SPANS = "array<struct<start: int, n: int>>"


class SuffixAutomaton:
    """All factors of the sequences added, each from the root on, over any hashable symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, symbol, target: int) -> int:
        """The state for the factors of `target` that are as long as a step from `at` allows."""
        twin = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = twin
            at = self.link[at]
        return twin

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            target = self.next[last].get(symbol)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            if at >= 0:
                target = self.next[at][symbol]
                self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, symbol, target)
            last = new

    def matching(self, sequence) -> list[int]:
        """For each position, the length of the longest factor held that ends there."""
        out, state, length = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state_next = self.next[state].get(symbol)
            if state_next is None:
                state, length = 0, 0
            else:
                state, length = state_next, length + 1
            out.append(length)
        return out


def minimizers(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each run of consecutive windows with one minimizer."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, width, have = shingles(hashes, anchor), window - anchor + 1, 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[starts], starts, np.diff(np.r_[starts, len(least)])


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): what a row is known by, its id and the hash of its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def _runs(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, th, key, run, start, n): the minimizer runs of each text; `run` hashes its words, beside `key` with 64 bits more."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches):
            where, keys, runs, starts, sizes = [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                hashes = memo.of(text.split())
                key, start, n = minimizers(hashes, window, anchor)
                where.append(np.full(len(key), i))
                keys.append(key)
                starts.append(start)
                sizes.append(n)
                raw = hashes.tobytes()
                runs += [xxh3_64_intdigest(raw[8 * a:8 * (a + c + window - 1)]) for a, c in zip(start.tolist(), n.tolist(), strict=True)]
            at = np.concatenate(where)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(at)), "th": batch.column("th").take(pa.array(at)), "key": pa.array(signed(np.concatenate(keys))),
                "run": pa.array(np.array(runs, np.uint64).view(np.int64)), "start": pa.array(np.concatenate(starts).astype(np.int32)), "n": pa.array(np.concatenate(sizes).astype(np.int32))})
    return rows.where("doc_id is not null and text is not null").mapInArrow(cut, "doc_id long, th long, key long, run long, start int, n int")


def _streamed(contested: DataFrame, window: int) -> DataFrame:
    """(key, run, spans) of the contested runs (key, run, first, words): the (start, n) of their covered windows."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, waiting, doc = None, SuffixAutomaton(), [], None
        for batch in batches:
            keys, runs, spans = [], [], []
            for k, run, first, words in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "first", "words")), strict=True):
                sequence = np.frombuffer(words, np.int64).tolist()
                if k != key:
                    key, automaton, waiting, doc = k, SuffixAutomaton(), [], first
                if first != doc:
                    for held in waiting:
                        automaton.add(held)
                    waiting, doc = [], first
                if len(automaton.link) > 1:
                    found = np.array(automaton.matching(sequence))[window - 1:] >= window
                    edges = np.flatnonzero(np.diff(np.r_[False, found, False].astype(np.int8)))
                    if len(edges):
                        keys.append(k)
                        runs.append(run)
                        spans.append([{"start": a, "n": b - a} for a, b in edges.reshape(-1, 2).tolist()])
                waiting.append(sequence)
            yield pa.record_batch({"key": pa.array(keys, pa.int64()), "run": pa.array(runs, pa.int64()),
                                   "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))})
    return contested.repartition("key").sortWithinPartitions("key", "first").mapInArrow(match, f"key long, run long, spans {SPANS}")


def _words_of(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, run, first, runs, words): the word hashes of each wanted run, read from its first document."""
    asked = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "run", "start", "n", "runs")).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches):
            out: dict[str, list] = {"key": [], "run": [], "first": [], "runs": [], "words": []}
            for doc, text, asked in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("asked").to_pylist(), strict=True):
                raw = memo.of(text.split()).tobytes()
                for x in asked:
                    out["key"].append(x["key"])
                    out["run"].append(x["run"])
                    out["first"].append(doc)
                    out["runs"].append(x["runs"])
                    out["words"].append(raw[8 * x["start"]:8 * (x["start"] + x["n"] + window - 1)])
            yield pa.record_batch({"key": pa.array(out["key"], pa.int64()), "run": pa.array(out["run"], pa.int64()), "first": pa.array(out["first"], pa.int64()),
                                   "runs": pa.array(out["runs"], pa.int64()), "words": pa.array(out["words"], pa.binary())})
    # repeated rows hold the same runs: one is enough
    return rows.join(asked, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "text", "asked").mapInArrow(
        read, "key long, run long, first long, runs long, words binary")


def _by_window(hot: DataFrame, window: int) -> DataFrame:
    """Like `_streamed` for minimizers with many distinct runs: the smallest document of each equal window."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, at, ids = [], [], []
            for i, words in enumerate(batch.column("words").to_pylist()):
                n = len(words) // 8 - window + 1
                lines += [xxh3_128_digest(words[8 * a:8 * (a + window)]) for a in range(n)]
                at.append(np.full(n, i))
                ids.append(np.arange(n, dtype=np.int32))
            take = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
            yield pa.record_batch({"key": batch.column("key").take(take), "run": batch.column("run").take(take), "first": batch.column("first").take(take),
                                   "window": pa.array(lines, pa.binary()), "start": pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))})
    each = hot.select("key", "run", "first", "words").mapInArrow(windows, "key long, run long, first long, window binary, start int")
    least = each.groupBy("window").agg(F.min("first").alias("least"))
    # one row a run again: no longer than the run
    return each.join(least, "window").where("least < first").groupBy("key", "run").agg(F.collect_list(F.struct("start", F.lit(1).alias("n"))).alias("spans"))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, th, spans): for each row with repeats, the (start, n) windows that a smaller doc_id holds.

    `th` is xxhash64 of the text. Windows are judged on the input. Rows without id or text, and
    texts of fewer than `window` words, neither have repeats nor count as a reference; rows that
    repeat an id are one document as a reference. An empty table gives no rows.
    """
    rows = _rows(docs)
    every = written(_runs(rows, window, anchor))
    # most minimizers are of one document, and go before anything wider is shuffled
    shared = every.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    runs = written(every.join(shared, "key", "left_semi"))
    # the smallest document of each distinct run, with the place to read it from
    firsts = written(runs.groupBy("key", "run").agg(F.min(F.struct("doc_id", "th", "start", "n")).alias("f")).select("key", "run", "f.*"))
    runs_of = firsts.groupBy("key").agg(F.count("*").alias("runs")).where("runs > 1")
    words = written(_words_of(rows, firsts.join(runs_of, "key"), window))
    met = written(_streamed(words.where(F.col("runs") <= MOST_RUNS), window).unionByName(_by_window(words.where(F.col("runs") > MOST_RUNS), window)))
    # all of a run that an earlier document holds, and the parts found in the document that holds it first
    whole = runs.join(firsts.select("key", "run", F.col("doc_id").alias("first")), ["key", "run"])
    later = whole.where("doc_id > first").select("doc_id", "th", F.array(F.struct("start", "n")).alias("spans"))
    first = whole.where("doc_id = first").select("doc_id", "th", "key", "run", F.col("start").alias("at"))
    parts = first.join(met, ["key", "run"]).select("doc_id", "th", F.transform(
        "spans", lambda s: F.struct((F.col("at") + s["start"]).alias("start"), s["n"].alias("n"))).alias("spans"))
    return later.unionByName(parts).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut(docs: DataFrame, columns: str, cut, window: int, anchor: int) -> DataFrame:
    """`cut(batch, words of each row, mask of the words to remove)` over all rows and their repeats."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    # the text crosses the shuffle once, inside its row
    joined = rows.join(repeats(docs, window, anchor), ["doc_id", "th"], "left").select(
        "row", "doc_id", "spans", F.col("row.text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = [t.split() for t in texts(batch)]
            gone = []
            for ws, spans in zip(words, batch.column("spans"), strict=True):
                change = np.zeros(len(ws) + 1, np.int32)
                if spans.is_valid:
                    both = spans.values.flatten()
                    start, n = (np.asarray(x) for x in both)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n + window - 1, -1)
                gone.append(np.cumsum(change[:-1]) > 0)
            yield cut(batch, words, gone)
    return joined.mapInArrow(run, columns)


def removed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's words and what is left of them, joined by one space.

    A null text is one without words. Repeated rows and null ids give a row each; other columns
    are ignored.
    """
    def cut(batch: pa.RecordBatch, words: list[list[bytes]], gone: list[np.ndarray]) -> pa.RecordBatch:
        kept = [b" ".join(ws) if not g.any() else b" ".join([w for w, x in zip(ws, g.tolist(), strict=True) if not x]) for ws, g in zip(words, gone, strict=True)]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(map(len, words), pa.int64()),
                                "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})
    return _cut(docs.select("doc_id", "text"), "doc_id long, n_words long, n_removed long, kept string", cut, window, anchor)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """`docs` with the repeats cut out of `text`; white space around kept words stays, n_chars follows.

    Texts without repeats are unchanged. A text that is all repeats becomes empty; its row stays.
    """
    names = docs.columns

    def cut(batch: pa.RecordBatch, words: list[list[bytes]], gone: list[np.ndarray]) -> pa.RecordBatch:
        out = []
        for text, ws, g in zip(texts(batch), words, gone, strict=True):
            kept, at, since, before = [], 0, 0, False
            for w, x in zip(ws, g.tolist(), strict=True) if g.any() else ():
                begin = text.index(w, at)
                at = begin + len(w)
                if x:
                    # white space inside a removed passage goes with it
                    if not before:
                        kept.append(text[since:begin])
                    since = at
                before = x
            out.append(b"".join(kept) + text[since:])
        return pa.record_batch({"row": batch.column("row"), "cut": pa.array(out, pa.binary()).cast(pa.string())})
    row = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    done = _cut(docs, f"row {row}, cut string", cut, window, anchor)
    text = F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(F.col("cut"))
    new = {"text": text, "n_chars": F.when(F.col("row.text").isNull() | (F.length("cut") == F.length("row.text")), F.col("row.n_chars")).otherwise(
        F.length("cut").cast(docs.schema["n_chars"].dataType))} if "n_chars" in names else {"text": text}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in names))
