"""SentencePiece encoding and decoding: streaming Viterbi for unigram models, merges for BPE models.

A BPE model's ids come from its merges (`lattice.Merges`), segment by segment; no best path gives
them. For a unigram model the encoder reads a text character by character and keeps the best node of each boundary only as
far back as the longest piece reaches. Whenever the paths of all nodes kept lead back to one
boundary, everything before it is decided: its ids are committed and let go. See `lattice` for the
model and the ties.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.batches import MEMO_WORDS, made_once, pieces, sent
from factloom.llm.lattice import BPE, BYTE, CONTROL, SPACE, UNKNOWN, UNKNOWN_TEXT, Merges, PieceTable, load

#: Longer segments are streamed; others are decided whole, and remembered.
MOST_REMEMBERED = 64
#: Text bytes handled at once: ids take more room than the text.
PIECE_BYTES = 1 << 20


class _Node:
    """The best path to a boundary: its score, its last piece, and the node before that."""

    __slots__ = ("before", "end", "ids", "score")

    def __init__(self, end: int, score: float, ids: tuple[int, ...], before: _Node | None) -> None:
        self.end, self.score, self.ids, self.before = end, score, ids, before


def _meeting(nodes: Iterable[_Node]) -> _Node:
    """The last boundary that the paths of all `nodes` share."""
    open_ = {n.end: n for n in nodes}
    while len(open_) > 1:
        last = open_.pop(max(open_))
        open_.setdefault(last.before.end, last.before)
    return open_.popitem()[1]


def _committed(root: _Node, node: _Node) -> list[int]:
    """The ids on the path from `root` to `node`, which becomes the start of all paths."""
    steps, at = [], node
    while at is not root:
        steps.append(at.ids)
        at = at.before
    node.before, node.ids = None, ()
    return [i for ids in reversed(steps) for i in ids]


def stream(table: PieceTable, characters: Iterable[str]) -> Iterator[int]:
    """The ids of `characters`, which are already normal, as they are decided."""
    root = _Node(0, 0.0, (), None)
    window, tail, endings, most = [root], "", table.endings, table.longest
    for end, character in enumerate(characters, 1):
        tail = (tail + character)[-most:]
        best, alone = None, False
        # shortest first: an equal sum gives way to the path whose last piece starts earlier
        for length in range(1, min(len(tail), len(window)) + 1):
            ending = tail[-length:]
            if ending not in endings:
                break
            hit = endings[ending]
            if hit is not None:
                score = window[-length].score + hit[0]
                if best is None or score >= best[0]:
                    best = (score, (hit[1],), window[-length])
                alone = alone or length == 1
        if not alone:
            score = window[-1].score + table.unknown_score
            if best is None or score > best[0]:
                ids = tuple(table.byte_ids[b] for b in character.encode()) if table.byte_ids else (table.unknown_id,)
                best = (score, ids, window[-1])
        window.append(_Node(end, *best))
        if len(window) > most:
            del window[0]
        if end % most == 0:
            met = _meeting(window)
            if met is not root:
                yield from _committed(root, met)
                root = met
    yield from _committed(root, window[-1])


def whole(table: PieceTable, segment: str) -> tuple[int, ...]:
    """What `stream` gives, for a segment short enough to be decided at its end."""
    score, start, ids = [0.0], [0], [()]
    find, most = table.endings.get, len(segment)
    for end in range(1, most + 1):
        best, at, piece, first = None, 0, (), end - 1
        while first >= 0:
            hit = find(segment[first:end], False)
            if hit is False:
                break
            if hit is not None:
                total = score[first] + hit[0]
                if best is None or total >= best:
                    best, at, piece = total, first, (hit[1],)
            first -= 1
        if find(segment[end - 1]) is None:
            total = score[end - 1] + table.unknown_score
            if best is None or total > best:
                best, at = total, end - 1
                piece = tuple(table.byte_ids[b] for b in segment[at].encode()) if table.byte_ids else (table.unknown_id,)
        score.append(best)
        start.append(at)
        ids.append(piece)
    out, end = [], most
    while end:
        out.append(ids[end])
        end = start[end]
    return tuple(chain.from_iterable(reversed(out)))


class Encoder(dict):
    """Ids of segments, in a memo of bounded size."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.merges = Merges(table) if table.model_type == BPE else None
        self.id_of = {p: i for p, (_, i) in table.usable.items()}
        #: What was remembered before the memo was half full.
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, segment: str) -> tuple[int, ...]:
        """The ids of `segment` under a BPE model."""
        cut = self.merges.cut(segment)
        found = tuple(map(self.id_of.get, cut))
        if None not in found:
            return found
        table, ids = self.table, []
        for piece in cut:
            hit = table.usable.get(piece)
            if hit is not None:
                ids.append(hit[1])
            elif table.byte_ids:
                ids += [table.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(table.unknown_id)
        return tuple(ids)

    def __missing__(self, segment: str) -> tuple[int, ...]:
        if len(segment) > MOST_REMEMBERED:
            return self.merged(segment) if self.merges else tuple(stream(self.table, segment))
        found = self.older.get(segment)
        if found is None:
            # characters at the end that no piece joins to what is before them, as most marks
            end, inside = len(segment), self.table.inside
            while end > 1 and segment[end - 2:end] not in inside:
                end -= 1
            if end < len(segment):
                found = tuple(chain(self[segment[:end]], *map(self.__getitem__, segment[end:])))
            else:
                found = self.merged(segment) if self.merges else whole(self.table, segment)
        if len(self) >= MEMO_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[segment] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        ids = np.fromiter(chain.from_iterable(map(self.__getitem__, self.table.segments(text))), np.int32)
        if not self.table.byte_ids and len(ids):
            # neighbouring unknown characters are one piece
            unknown = ids == self.table.unknown_id
            ids = ids[~(unknown & np.r_[False, unknown[:-1]])]
        return ids


class Decoder:
    """Text of ids: bytes that are no UTF-8 become U+FFFD, control pieces nothing."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.texts = [b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
                      for p, k in zip(table.pieces, table.kinds, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.table.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the piece ids of each whole text under the model at `path`.

    A null or empty text has no ids, an empty table no rows. Repeated rows and null ids give a row
    each; other columns are ignored.
    """
    shipped = sent(docs, load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made_once(shipped, Encoder)
        for batch in pieces(batches, most=PIECE_BYTES):
            ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): `decode` of `encode`, in one pass of one worker a task.

    The two in a row keep two Python workers for each core of an executor, with a model in each.
    """
    shipped = sent(docs, load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = made_once(shipped, lambda table: (Encoder(table), Decoder(table)))
        for batch in pieces(batches, most=PIECE_BYTES):
            ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                                   "text": pa.array(map(decoder.decode, ids), pa.string())})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of `encoded` (doc_id, ids) with their `text`; null ids are an empty text, and an empty table gives no rows."""
    shipped = sent(encoded, load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = made_once(shipped, Decoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [decoder.decode(np.asarray(x.values) if x.is_valid else np.empty(0, np.int32)) for x in part.column("ids")]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "text": pa.array(found, pa.string())})
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, ids array<int>, text string")
