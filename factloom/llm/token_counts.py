"""Token counts: the number of pieces and the score of a text's segmentation, without the pieces.

For a BPE model these are the pieces that its merges leave (`lattice.Merges`), and the score is the
sum of theirs, an unknown character counting as in a unigram model. For a unigram model an Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character; the
dynamic programme carries only the best score and its piece count. See `lattice` for the ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.batches import MEMO_WORDS, made_once, pieces, sent
from factloom.llm.lattice import BPE, Merges, PieceTable, load

#: Segments longer than this are counted each time, not remembered.
MOST_REMEMBERED = 64


class Counter(dict):
    """(score, pieces) of segments, in a memo of bounded size."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.automaton = ahocorasick.Automaton()
        for piece, (score, _) in table.usable.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.merges = Merges(table) if table.model_type == BPE else None

    def merged(self, segment: str) -> tuple[float, int]:
        """(score, pieces) of `segment` under a BPE model."""
        table, score, n, open_unknown = self.table, 0.0, 0, False
        for piece in self.merges.cut(segment):
            hit = table.usable.get(piece)
            if hit is not None:
                score, n, open_unknown = score + hit[0], n + 1, False
            else:
                # without byte pieces, neighbouring unknown characters are one piece
                n += len(piece.encode()) if table.byte_ids else int(not open_unknown)
                score, open_unknown = score + table.unknown_score * len(piece), True
        return score, n

    def count(self, segment: str) -> tuple[float, int]:
        table, n = self.table, len(segment)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(segment):
            ends[end].append(match)
        best, pieces_to, open_unknown = [0.0], [0], [False]
        for end in range(n):
            value, count, unknown, alone = None, 0, False, False
            # the automaton gives the longest first: an equal sum does not replace the path whose last piece starts earlier
            for length, score in ends[end]:
                at = end + 1 - length
                total = best[at] + score
                if value is None or total > value:
                    value, count, unknown = total, pieces_to[at] + 1, False
                alone = alone or length == 1
            if not alone:
                total = best[end] + table.unknown_score
                if value is None or total > value:
                    # without byte pieces, neighbouring unknown characters are one piece
                    more = len(segment[end].encode()) if table.byte_ids else int(not open_unknown[end])
                    value, count, unknown = total, pieces_to[end] + more, True
            best.append(value)
            pieces_to.append(count)
            open_unknown.append(unknown)
        return best[n], pieces_to[n]

    def total(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a whole text."""
        found = [self[s] for s in self.table.segments(text)]
        return sum(s for s, _ in found), sum(n for _, n in found)

    def __missing__(self, segment: str) -> tuple[float, int]:
        found = self.merged(segment) if self.merges else self.count(segment)
        if len(segment) <= MOST_REMEMBERED:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[segment] = found
        return found


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score): pieces and score of the segmentation of each whole text by the model at `path`.

    A null or empty text has no pieces and score 0, an empty table no rows. Repeated rows and null ids give a row each;
    other columns are ignored.
    """
    shipped = sent(docs, load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = made_once(shipped, Counter)
        for batch in pieces(batches):
            found = [counter.total(text or "") for text in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array([n for _, n in found], pa.int64()),
                                   "score": pa.array([float(s) for s, _ in found], pa.float64())})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, score double")
