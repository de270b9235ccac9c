"""Language ID: per-word scores of character trigrams, joined over a text by Viterbi.

A word is a run of letters. The Unicode range of its letters narrows the languages it can be in to
those seen in that script; its score for each is the log-likelihood of its trigrams. Viterbi over
the words, with a penalty for every change of language, labels spans of mixed-language text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.batches import MEMO_WORDS, pieces, received, sent

#: Labelled rows that the model is fitted on: those with the smallest hashes of their ids.
SAMPLE_ROWS = 8000
#: Log-likelihood that a change of language costs.
SWITCH = 20.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
# First code points of script ranges, and the script from there on.
SCRIPTS = [(0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
           (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"),
           (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
           (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
           (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "other")]
_STARTS = [a for a, _ in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")


def _lower(text: str) -> str:
    """Small letters, as many characters as before: the one letter that would become two is replaced first."""
    return text.replace("\u0130", "i").lower()


def script_of(word: str) -> str:
    at = bisect_right(_STARTS, ord(word[0]))
    return SCRIPTS[at - 1][1] if at else "other"


def _trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


@dataclass
class Model:
    """Languages, trigram log-likelihoods (one row a trigram, the last for unseen ones), and candidates by script."""

    languages: list[str]
    rows: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    candidates: dict[str, np.ndarray] = field(default_factory=dict)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages in `labelled` (doc_id, text, lang); rows with a null in any of them are left out.

    Fitted on at most about `sample_rows` rows, which bounds the model, the only thing the driver
    gathers. Without rows, the model knows no language.
    """
    rows = labelled.select(F.xxhash64("doc_id").alias("at"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = rows.count()
    if not total:
        return Model([])
    # the hash is uniform over the longs: a bound on it takes about as many rows as asked
    bound = min((1 << 63) - 1, round((1 << 64) * sample_rows / total) - (1 << 63))
    sample = rows.where(F.col("at") <= bound).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            grams: Counter = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for word, n in Counter(_WORD.findall(_lower(text))).items():
                    grams[lang, "script", script_of(word)] += n * len(word)
                    for gram in _trigrams(word):
                        grams[lang, "gram", gram] += n
            lang, kind, what = zip(*grams, strict=True) if grams else ((), (), ())
            yield pa.record_batch({"lang": pa.array(lang, pa.string()), "kind": pa.array(kind, pa.string()), "what": pa.array(what, pa.string()),
                                   "n": pa.array(list(grams.values()), pa.int64())})
    counts = sample.mapInArrow(count, "lang string, kind string, what string, n long").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counts})
    column = {x: i for i, x in enumerate(languages)}
    rows_of = {x: i for i, x in enumerate(sorted({r["what"] for r in counts if r["kind"] == "gram"}))}
    table = np.full((len(rows_of) + 1, len(languages)), 0.5)
    scripts: dict[str, np.ndarray] = {}
    for r in counts:
        if r["kind"] == "gram":
            table[rows_of[r["what"]], column[r["lang"]]] += r["n"]
        else:
            scripts.setdefault(r["what"], np.zeros(len(languages)))[column[r["lang"]]] += r["n"]
    letters = np.maximum(1, sum(scripts.values()))
    return Model(languages, rows_of, np.log(table / table.sum(axis=0)), {k: v / letters >= SCRIPT_SHARE for k, v in scripts.items()})


class _Words(dict):
    """The row of `scores` of each word, and its letters, in a memo of bounded size."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # the last row is for scripts that no language was seen in: every language is possible
        self.scripts = {s: i for i, s in enumerate(model.candidates)}
        self.possible = np.array([*model.candidates.values(), np.ones(len(model.languages), bool)])
        self._new()

    def _new(self) -> None:
        self.clear()
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        model, unseen = self.model, len(self.model.rows)
        grams = np.fromiter((model.rows.get(g, unseen) for w in words for g in _trigrams(w)), np.int64)
        # a word has as many trigrams as characters
        starts = np.cumsum([0, *map(len, words[:-1])])
        sums = np.add.reduceat(model.scores[grams], starts, axis=0)
        script = np.fromiter((self.scripts.get(script_of(w), -1) for w in words), np.int64)
        possible = self.possible[script] | ~self.possible[script].any(axis=1, keepdims=True)
        top = np.where(possible, sums, -np.inf).max(axis=1, keepdims=True)
        low = np.where(possible, sums, np.inf).min(axis=1, keepdims=True)
        # a language that isn't a candidate scores below every one that is; a script of none tells nothing
        scores = np.where(possible, sums - top, low - top - SWITCH)
        scores[script < 0] = 0.0
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words]])
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The rows of the words of each text."""
        if len(self) > MEMO_WORDS:
            self._new()
        words = list(chain.from_iterable(texts))
        if new := list(set(words) - self.keys()):
            self._learn(new)
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.split(rows, np.cumsum([len(t) for t in texts[:-1]]))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each row of `scores` (words x languages), where each change costs `switch`.

    If one language is best overall and no run of words gains another more than half the penalty,
    then no path with changes can win, and the loop over words is not needed.
    """
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    before = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    if (gain - before).max() <= switch / 2:
        return np.full(len(scores), best)
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        leave, source = top - switch, value.index(top)
        back.append([i if v >= leave else source for i, v in enumerate(value)])
        value = [(v if v >= leave else leave) + s for v, s in zip(value, row, strict=True)]
    at = value.index(max(value))
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return np.array(path[::-1])


def _spans(text: str, path: np.ndarray, letters: np.ndarray, names: list[str]) -> list[dict]:
    starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    ends = np.r_[starts[1:], len(path)]
    if len(starts) == 1:
        end = len(text)
        while not _WORD.match(text, end - 1):
            end -= 1
        return [{"lang": names[path[0]], "start": _WORD.search(text).start(), "end": end, "letters": int(letters.sum())}]
    sums = np.add.reduceat(letters, starts)
    places = [m.span() for m in _WORD.finditer(text)]
    return [{"lang": names[path[a]], "start": places[a][0], "end": places[b - 1][1], "letters": int(n)} for a, b, n in zip(starts, ends, sums, strict=True)]


SPANS = "array<struct<lang: string, start: int, end: int, letters: long>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """`docs` as a struct column `row`, with `lang_pred`, `score` and `spans` (lang, start, end, letters) of each whole text.

    `lang_pred` is the language of most letters over the spans (the first by name among equals);
    `score` is its share of the letters times its posterior over the words of its spans. A text
    that is null or without letters is `und` with score 0 and no spans. Only `text` is read.
    """
    names = model.languages
    shipped = sent(docs, model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words(received(shipped))
        for batch in pieces(batches):
            found, scores, spans = [], [], []
            texts = [_lower(t or "") for t in batch.column("text").to_pylist()]
            for text, index in zip(texts, memo.of([_WORD.findall(t) if names else [] for t in texts]), strict=True):
                letters = memo.letters[index]
                if not letters.sum():
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    spans.append([])
                    continue
                each = memo.scores[index]
                path = viterbi(each, switch)
                share = np.bincount(path, letters, len(names))
                best = int(share.argmax())
                total = each[path == best].sum(axis=0)
                found.append(names[best])
                scores.append(float(share[best] / share.sum() / np.exp(total - total[best]).clip(max=1e9).sum()))
                spans.append(_spans(text, path, letters, names))
            yield pa.record_batch({"row": batch.column("row"), "lang_pred": pa.array(found, pa.string()), "score": pa.array(scores, pa.float64()),
                                   "spans": pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("letters", pa.int64())])))})
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(label, f"row {row}, lang_pred string, score double, spans {SPANS}")
