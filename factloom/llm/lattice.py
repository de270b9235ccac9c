"""The piece table of a SentencePiece model, shared by encoding and counting.

The model's type decides how a segment is cut. In a BPE model neighbours merge, the pair whose piece
has the highest score first and the leftmost among equals, until no pair is a piece. In a unigram
model a text's best segmentation is the path of pieces with the highest sum of the model's scores. Among
equal sums, the last piece of a path is the one that starts first, as in SentencePiece's unigram
encoder; a character that no piece spells alone is unknown, at the lowest score less ten. Sums are
kept in double precision, which is exact where scores are whole numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_TEXT = " ⁇ "
#: Symbols of a segment that is merged without an agenda, and the order of a pair that is no piece.
SHORT, NEVER = 40, float("inf")


@dataclass
class PieceTable:
    """Pieces by id with their types, the usable ones by text as (score, id), and the model's settings."""

    pieces: list[str]
    kinds: list[int]
    usable: dict[str, tuple[float, int]]
    unknown_id: int
    unknown_score: float
    byte_ids: list[int]
    dummy_prefix: bool
    trim_spaces: bool
    model_type: int = UNIGRAM
    #: Pieces that merges may form but that are no result: (score, id) by text, in BPE models only.
    unused: dict[str, tuple[float, int]] = field(default_factory=dict)
    #: Every ending of a usable piece: the piece's (score, id) if it is one itself, else None.
    endings: dict[str, tuple[float, int] | None] = field(init=False)
    longest: int = field(init=False)
    cuts: re.Pattern = field(init=False)
    #: Neighbouring characters inside pieces; every segmentation has a boundary between any others.
    inside: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.endings = {p[i:]: None for p in self.usable for i in range(1, len(p))} | self.usable
        self.longest = max(map(len, self.usable), default=1)
        formed = self.usable | self.unused
        self.inside = frozenset(p[i:i + 2] for p in formed for i in range(len(p) - 1))
        crossing = any(SPACE in p.lstrip(SPACE) for p in formed)
        alone = bool(self.byte_ids) and not any("\n" in p for p in formed)
        # every path passes the boundary before a space that follows text, unless a piece crosses it;
        # and those around a line end, where no piece holds one and it is spelled in bytes
        line = "\n" if alone else ""
        self.cuts = re.compile("(?s:.+)" if crossing else f"{line or '(?!)'}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+")

    def normal(self, text: str) -> str:
        if self.trim_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def segments(self, text: str) -> list[str]:
        """`text`, made normal, cut at boundaries that every segmentation has."""
        return self.cuts.findall(self.normal(text))


class Merges:
    """The pieces of a segment under a BPE model."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.unused = table.unused
        self.fixed = fixed = {p for p, k in zip(table.pieces, table.kinds, strict=True) if k == USER_DEFINED}
        #: Order of merging of each piece that a pair can form.
        self.order = {p: -score for p, (score, _) in (table.usable | table.unused).items()}
        # user-defined pieces are found first, the longest at each place, and never merged
        self.symbols = re.compile("|".join([*map(re.escape, sorted(fixed, key=len, reverse=True)), "(?s:.)"])).findall if fixed else list

    def cut(self, segment: str) -> list[str]:
        """Pieces and unknown characters of `segment`, in order."""
        parts = self.symbols(segment)
        if len(parts) <= SHORT and not self.fixed:
            return self._short(parts)
        n, order, fixed = len(parts), self.order, self.fixed
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = parts[i] + parts[i + 1]
            if pair in order and not (fixed and (parts[i] in fixed or parts[i + 1] in fixed)):
                agenda.append((order[pair], i, pair, i + 1))
        heapify(agenda)
        formed = {}
        while agenda:
            _, i, pair, j = heappop(agenda)
            # either side may have merged since
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != len(pair):
                continue
            if pair in self.unused:
                formed[pair] = parts[i], parts[j]
            parts[i], parts[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    wider = parts[a] + parts[b]
                    if wider in order and not (fixed and (parts[a] in fixed or parts[b] in fixed)):
                        heappush(agenda, (order[wider], a, wider, b))
        parts = [p for p in parts if p]
        return [q for p in parts for q in self._split(p, formed)] if formed else parts

    def _short(self, parts: list[str]) -> list[str]:
        """`cut` of few symbols: the best pair is looked for in a list each time, which takes less than an agenda."""
        find, unused, formed = self.order.get, self.unused, {}
        order = [find(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while order and (best := min(order)) != NEVER:
            # the leftmost of equals
            i = order.index(best)
            pair = parts[i] + parts[i + 1]
            if pair in unused:
                formed[pair] = parts[i], parts[i + 1]
            parts[i] = pair
            del parts[i + 1], order[i]
            if i < len(order):
                order[i] = find(pair + parts[i + 1], NEVER)
            if i:
                order[i - 1] = find(parts[i - 1] + pair, NEVER)
        return [q for p in parts for q in self._split(p, formed)] if formed else parts

    def _split(self, piece: str, formed: dict[str, tuple[str, str]]) -> list[str]:
        """`piece`, or what it was formed of if it is no result."""
        if piece not in formed:
            return [piece]
        return [q for half in formed[piece] for q in self._split(half, formed)]


def load(path: str) -> PieceTable:
    """The table of a model file. Only unigram and BPE models with identity normalisation are supported, else ValueError."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if model.normalizer_spec.precompiled_charsmap:
        raise ValueError("the model normalises characters; only identity normalisation is supported")
    model_type = model.trainer_spec.model_type
    if model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model_type} is not supported; only unigram (1) and BPE (2) are")
    pieces, kinds = [p.piece for p in model.pieces], [p.type for p in model.pieces]
    scores = [p.score for p in model.pieces]
    normal = [s for s, k in zip(scores, kinds, strict=True) if k == NORMAL]
    top = max(normal, default=0.0)
    usable = {p: (len(p.encode()) * top - 0.1 if k == USER_DEFINED else s, i) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
    return PieceTable(pieces, kinds, usable, kinds.index(UNKNOWN), min(normal, default=0.0) - UNKNOWN_PENALTY,
                      [i for i, k in enumerate(kinds) if k == BYTE] if model.trainer_spec.byte_fallback else [],
                      model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model_type,
                      {p: (s, i) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds, strict=True)) if k == UNUSED} if model_type == BPE else {})
