"""Token-id files: documents as ids in order, in compressed bit or byte planes with a chunk index.

Format. A store is a folder with two Parquet tables that Spark writes and commits. `chunks` holds
the ids: a row is a chunk of whole documents of one part, in order, with its document lengths and
its blocks. Every `BLOCK_IDS` ids of a chunk are one block; the ids of a block, as little-endian
unsigned 32-bit integers, are transposed into planes (all first bytes, all second bytes, and so on,
or all first bits, ...), each plane compressed with zstandard by itself. `sizes` gives the
compressed bytes of each plane, block by block, so a reader finds any block's planes in `data`.
`index` is the chunk index: part, chunk, first document, number of documents and ids, and the number
of documents and ids before the chunk. Parts, then chunks, ascend with the document ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import accumulate, chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.batches import made_once, pieces, sent, texts

BLOCK_IDS = 1 << 16
#: Ids after which a chunk is closed, at the end of a document.
CHUNK_IDS = 1 << 20
LEVEL = 1
PLANES = ("byte", "bit")
#: Words a worker remembers before it forgets the rare ones.
MEMO_WORDS = 600_000
CHUNKS = ("part int, chunk int, docs_in_part long, ids_in_part long, n_docs long, n_ids long, first_doc long, "
          "doc_ids binary, lengths binary, planes string, sizes binary, data binary")


def pack(ids: np.ndarray, planes: str = "byte", level: int = LEVEL) -> tuple[np.ndarray, bytes]:
    """(bytes of each plane, planes) of the blocks of `ids`, plane after plane, block after block."""
    out, sizes, press = [], [], zstandard.ZstdCompressor(level=level)
    for at in range(0, len(ids), BLOCK_IDS):
        raw = ids[at:at + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, 4)
        rows = raw.T if planes == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
        done = [press.compress(row.tobytes()) for row in rows]
        out += done
        sizes += map(len, done)
    return np.array(sizes, "<u4"), b"".join(out)


def unpack(sizes: np.ndarray, data: bytes, n_ids: int, planes: str = "byte") -> np.ndarray:
    """The ids that `pack` was given."""
    out, at, size, count = [], 0, iter(sizes.tolist()), 4 if planes == "byte" else 32
    expand = zstandard.ZstdDecompressor()
    for first in range(0, n_ids, BLOCK_IDS):
        n = min(BLOCK_IDS, n_ids - first)
        rows = []
        for _ in range(count):
            end = at + next(size)
            rows.append(np.frombuffer(expand.decompress(data[at:end]), np.uint8))
            at = end
        block = np.array(rows)
        if planes == "bit":
            block = np.packbits(np.unpackbits(block, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
        out.append(np.ascontiguousarray(block.T).view("<u4").ravel())
    return np.concatenate(out or [np.empty(0, "<u4")])


class _Slots(dict):
    """A number for each word, in the order they are first asked for; the new ones are noted."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordEncoder:
    """Ids by whole text, for tokenizers of which no token crosses white space.

    Such a tokenizer gives a text the ids of its white-space-separated words, one after the other,
    so each word is encoded once and remembered. Most words are letters with marks behind. If the
    tokenizer turns letters to small ones and parts them from marks (tried on `PROBES` first), the
    letters are encoded apart from marks, and a run of letters, being one piece before merging, goes
    straight to the merges. All else takes the tokenizer's whole way.
    """

    MARKS = b".,!?;:*#%&$"
    PROBES = ("word", "Word.", "WORD,,", "étés!?", "ÉTÉ***", "straße:", "Ñandú;", "мир.", "don't", "İx.", "İ.", "SEVGİ!", "e\u0301x.", "x1.", "1.", "...", "<|endoftext|>.", "<|ENDOFTEXT|>", "日本!", "a.b.")

    def __init__(self, tokenizer_json: str) -> None:
        # one core a task: the library's own threads would take others' cores, and memory for each
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.letters, self.before_marks = _Letters(self.tokenizer), _BeforeMarks(self.tokenizer)
        self._new()
        self.parts, self.plain = True, False
        self.parts = all(self.encode([w.encode()])[0].tolist() == self.tokenizer.encode(w, add_special_tokens=False).ids for w in self.PROBES)
        small = "abcdefghijklmnopqrstuvwxyz"
        #: Whether small letters of ASCII are themselves to the merges.
        self.plain = self.parts and small.translate(self.letters) == small
        self._new()

    def _new(self) -> None:
        self.slots, self.known = _Slots(), {}
        self.ids, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _parted(self, word: bytes) -> tuple[bytes, bytes]:
        """Letters and the marks behind them, or the whole word."""
        if not self.parts or b"<|" in word:
            return word, b""
        core = word.rstrip(self.MARKS)
        if core and (len(core) == len(word) or core[-1:].isalpha() or self.before_marks[core[-4:].decode(errors="ignore")[-1:]]):
            return core.lower(), word[len(core):]
        return word, b""

    def _learn(self, words: list[bytes]) -> None:
        known, merges, marks, parted, rest = self.known, self.tokenizer.model.tokenize, self.MARKS, [], []
        for word in words:
            core = word.rstrip(marks)
            # letters of ASCII, in front of marks or alone
            if self.plain and core.isalpha():
                core = core.lower()
                if core not in known:
                    known[core] = [t.id for t in merges(core.decode())]
                parted.append((core, word[len(core):]))
            else:
                parted.append(self._parted(word))
        for piece in dict.fromkeys(chain.from_iterable(parted)):
            if piece in known:
                continue
            text = piece.decode()
            if self.parts and text.isalpha() and is_normalized("NFC", text):
                try:
                    known[piece] = [t.id for t in merges(text.translate(self.letters))]
                    continue
                except ValueError:
                    pass
            rest.append(piece)
        for at in range(0, len(rest), 1024):
            part = rest[at:at + 1024]
            whole = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update(zip(part, (x.ids for x in whole), strict=True))
        found = [known[a] + known[b] if b else known[a] for a, b in parted]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])

    def _forget(self, at: np.ndarray) -> None:
        """Keeps what the last texts hold several times, whose words are `at`."""
        often = np.flatnonzero(np.bincount(at, minlength=len(self.slots)) >= 3)
        words = list(self.slots)
        kept = _Slots()
        kept.update(zip((words[n] for n in often), range(len(often)), strict=True))
        sizes, start = self.size[often], self.start[often]
        self.ids = self.ids[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        self.slots, self.size, self.start, self.known = kept, sizes, np.cumsum(sizes) - sizes, {}

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each)."""
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.slots.fresh:
            self._learn(self.slots.fresh)
            self.slots.fresh = []
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        # position of each id: its word's start, plus how far into the word it is
        ids = self.ids[np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        if len(self.slots) > MEMO_WORDS:
            self._forget(at)
        return ids, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(counts)]])


class _BeforeMarks(dict):
    """Whether the tokenizer parts marks from a character before them; it may turn a letter into more than letters."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def __missing__(self, char: str) -> bool:
        normal, pieces = self.tokenizer.normalizer, []
        if char.isalpha():
            text = f"a{char}."
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)]
        self[char] = len(pieces) == 2 and pieces[1] == "."
        return self[char]


class _Letters(dict):
    """What each letter is to the merges, asked of the tokenizer letter by letter."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def __missing__(self, code: int) -> str:
        normal = self.tokenizer.normalizer.normalize_str(chr(code)) if self.tokenizer.normalizer else chr(code)
        if len(normal) != 1 or not normal.isalpha():
            raise ValueError
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        if len(pieces) != 1:
            raise ValueError
        self[code] = pieces[0][0]
        return self[code]


def write(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int, planes: str = "byte", parts: int | None = None) -> None:
    """Writes `docs` (doc_id, text) as a token store, in ascending doc_id order, `end_id` after each document.

    `tokenizer_json` is the definition of a tokenizers model of which no token crosses white space.
    A null text is empty: only `end_id`. Rows without an id come first; equal ids are ordered by
    their text, and every repeated row is written. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    shipped = sent(docs, tokenizer_json)
    keys = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, chunk, n_docs, n_ids = made_once(shipped, WordEncoder), TaskContext.get().partitionId(), 0, 0, 0
        docs_held: list[pa.Array] = []
        ids_held: list[np.ndarray] = []
        lengths_held: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            nonlocal chunk, n_docs, n_ids
            ids, lengths = np.concatenate(ids_held), np.concatenate(lengths_held)
            doc_ids = pa.concat_arrays(docs_held)
            sizes, data = pack(ids, planes)
            small = zstandard.ZstdCompressor(level=LEVEL).compress
            known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            raw = np.packbits(known).tobytes() + doc_ids.fill_null(0).to_numpy().tobytes()
            row = {"part": part, "chunk": chunk, "docs_in_part": n_docs, "ids_in_part": n_ids, "n_docs": len(lengths), "n_ids": len(ids), "first_doc": doc_ids[0].as_py(),
                   "doc_ids": small(raw), "lengths": small(lengths.astype("<i8").tobytes()), "planes": planes, "sizes": sizes.tobytes(), "data": data}
            n_docs, n_ids = n_docs + len(lengths), n_ids + len(ids)
            chunk += 1
            for held in (docs_held, ids_held, lengths_held):
                held.clear()
            kinds = {"part": pa.int32(), "chunk": pa.int32(), "planes": pa.string(), "doc_ids": pa.binary(), "lengths": pa.binary(), "sizes": pa.binary(), "data": pa.binary()}
            return pa.record_batch({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})

        for batch in pieces(batches):
            ids, lengths = encoder.encode(texts(batch))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id)
            docs_held.append(batch.column("doc_id"))
            ids_held.append(ids)
            lengths_held.append(lengths + 1)
            if sum(map(len, ids_held)) >= CHUNK_IDS:
                yield closed()
        if docs_held:
            yield closed()
    dealt.mapInArrow(encode, CHUNKS).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/chunks")
    _index(spark, folder).write.mode("overwrite").parquet(f"{folder}/index")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk index: what is before a chunk is what is before its part, one row a part, and before it in the part."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").select("part", "chunk", "docs_in_part", "ids_in_part", "n_docs", "n_ids", "first_doc")
    totals = chunks.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum("n_ids").alias("ids")).orderBy("part").collect()
    before = list(zip((r["part"] for r in totals), accumulate((r["docs"] for r in totals), initial=0), accumulate((r["ids"] for r in totals), initial=0), strict=False))
    starts = spark.createDataFrame(before, "part int, docs_before long, ids_before long")
    return chunks.join(F.broadcast(starts), "part").select(
        "part", "chunk", "first_doc", "n_docs", "n_ids", *((F.col(f"{c}_before") + F.col(f"{c}_in_part")).alias(f"{c}_before") for c in ("docs", "ids")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a store, `start` being the ids of all documents before it."""
    # one row a part: as many as tasks wrote the store
    starts = spark.read.parquet(f"{folder}/index").where("chunk = 0").select("part", "ids_before")
    chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").join(F.broadcast(starts), "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids = unpack(np.frombuffer(x["sizes"], "<u4"), x["data"], x["n_ids"], x["planes"])
                lengths = np.frombuffer(expand.decompress(x["lengths"]), "<i8")
                raw = expand.decompress(x["doc_ids"])
                flags = -(-x["n_docs"] // 8)
                known = np.unpackbits(np.frombuffer(raw[:flags], np.uint8), count=x["n_docs"]).astype(bool)
                ends = np.cumsum(lengths)
                yield pa.record_batch({
                    "doc_id": pa.array(np.frombuffer(raw[flags:], np.int64), mask=~known), "start": pa.array(x["ids_before"] + x["ids_in_part"] + ends - lengths),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)], pa.binary())})
    return chunks.mapInArrow(decode, "doc_id long, start long, ids binary")
