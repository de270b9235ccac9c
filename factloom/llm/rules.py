"""Quality rules: per-document statistics and a learned decision list over them, native expressions only.

The list is learned by sequential covering from labelled documents. A rule is a conjunction of
threshold tests on the statistics; it grows by the test that gains most (FOIL's gain over a
histogram that one Spark aggregation fills), loses its last tests where that does not worsen it on
documents set apart, and is kept if it is precise there. Documents it covers are taken out before
the next. The list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import written

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Of 100 words, how many may lie in repeated 3-word windows; and the least words of a document.
MOST_REPEATED, LEAST_WORDS = 50, 50
#: Thresholds tried for each statistic, tests of a rule, rules of a list.
BINS, MOST_TESTS, MOST_RULES = 32, 4, 16
#: Thresholds are percentiles of values to so many bits after the leading one.
GRID_BITS = 10
#: A rule is kept if at least this share of what it covers is bad, in both parts of the labelled documents.
LEAST_PRECISION = 0.9
#: And if it covers at least so many.
LEAST_COVERED = 5
STATISTICS = ("symbols_per_char", "dup_lines_per_line", "repeats_per_word", "upper_per_char", "digits_per_char", "chars_per_word", "stops_per_word", "marks_per_word")


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many of `words` lie in a 3-word window that occurs twice or more in the text."""
    def over(windows: Column) -> Column:
        # most texts repeat no window, and need no sort
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(F.sort_array(placed), repeated))

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, n: (F.get(ordered, n - 1)["h"] == x["h"]) | (F.get(ordered, n + 1)["h"] == x["h"]))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(places: Column) -> Column:
        # each place covers three words, or those up to the next place
        return F.aggregate(F.transform(places, lambda p, n: F.least(F.lit(3), F.coalesce(F.get(places, n + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.when(F.size(words) < 4, 0).otherwise(_let(windows, over)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, then `STATISTICS`) of each row.

    Whole texts are read; a null text has no words. Shares of an empty text are 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = F.btrim(text, F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    base = docs.select(F.struct("*").alias("row"), text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    counts = base.select(
        "row", F.size("_words").cast("long").alias("n_words"), F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"), (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).alias("_upper"),
        (F.length("_text") - F.length(F.translate("_text", "0123456789", ""))).alias("_digits"),
        (F.length("_text") - F.length(F.translate("_text", ".", ""))).alias("_stops"),
        (F.length("_text") - F.length(F.translate("_text", "!?", ""))).alias("_marks"))

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)).cast("double")
    return counts.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols_per_char"), share("n_dup_lines", "_n_lines").alias("dup_lines_per_line"),
        share("n_repeat_words", "n_words").alias("repeats_per_word"), share("_upper", "word_chars").alias("upper_per_char"),
        share("_digits", "word_chars").alias("digits_per_char"), share("word_chars", "n_words").alias("chars_per_word"),
        share("_stops", "n_words").alias("stops_per_word"), share("_marks", "n_words").alias("marks_per_word"))


@dataclass(frozen=True)
class Test:
    """`statistic` at most, or over, a threshold."""

    statistic: str
    over: bool
    threshold: float

    def expression(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.over else F.col(self.statistic) <= self.threshold


Rule = tuple[Test, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.expression()
    return out


def _histogram(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """(bad, good) documents of each statistic between neighbouring thresholds, in one aggregation."""
    def bin_of(name: str) -> Column:
        return sum((F.when(F.col(name) > t, 1).otherwise(0) for t in thresholds[name]), F.lit(0))
    long = rows.select("bad", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), bin_of(n).alias("bin")) for n in thresholds))).alias("x"))
    counted = long.groupBy("x.name", "x.bin").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
    out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in thresholds}
    for r in counted:
        out[r["name"]][r["bin"]] = (r["bad"], r["good"])
    return out


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """FOIL's gain: bad documents still covered times the bits that the test tells about them."""
    if not after[0]:
        return -1.0
    return after[0] * (math.log2(after[0] / sum(after)) - math.log2(before[0] / sum(before)))


def _grown(rows: DataFrame, thresholds: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_TESTS:
        found = _histogram(rows.where(_holds(rule)), thresholds)
        any_bins = next(iter(found.values()))
        before = (sum(b for b, _ in any_bins.values()), sum(g for _, g in any_bins.values()))
        if not before[0] or not before[1]:
            break
        best, test = 0.0, None
        for name, bins in found.items():
            low = (0, 0)
            for i, threshold in enumerate(thresholds[name]):
                low = tuple(a + b for a, b in zip(low, bins.get(i, (0, 0)), strict=True))
                for over, side in ((False, low), (True, (before[0] - low[0], before[1] - low[1]))):
                    if sum(side) >= LEAST_COVERED and (gain := _gain(before, side)) > best:
                        best, test = gain, Test(name, over, threshold)
        if test is None:
            break
        rule += (test,)
    return rule


def _worth(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    """(bad, good) documents that each rule covers."""
    sums = rows.agg(*(F.sum(F.when(_holds(r), v)).alias(f"{k}{i}") for i, r in enumerate(rules) for k, v in (("b", F.col("bad")), ("g", 1 - F.col("bad"))))).first()
    return [(sums[f"b{i}"] or 0, sums[f"g{i}"] or 0) for i in range(len(rules))]


def _on_grid(value: Column) -> Column:
    """A value of zero or more with its first `GRID_BITS` bits after the leading one, the rest cut off."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(value)) - GRID_BITS)
    return F.when(value > 0, F.floor(value / step) * step).otherwise(F.lit(0.0))


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """The percentiles of each statistic, `BINS` apart; none without rows.

    Taken from counts of values on a grid, which no number of rows makes longer than some 2^GRID_BITS
    cells for each power of two, so that none of the tasks that rank them grows with the data.
    """
    marks = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    cells = rows.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), _on_grid(F.col(n).cast("double")).alias("cell")) for n in STATISTICS))))
    ranked = cells.groupBy("name", "cell").count().groupBy("name").agg(F.percentile("cell", marks, F.col("count")).alias("at")).collect()
    return {r["name"]: sorted(set(r["at"])) for r in sorted(ranked, key=lambda r: STATISTICS.index(r["name"]))}


def learn(labelled: DataFrame) -> list[Rule]:
    """The decision list of `labelled` (doc_id, bad 0/1, and `STATISTICS`); without bad or good rows, an empty one.

    A third of the documents, by a hash of their ids, is set apart for pruning. What the driver
    gathers are histograms: `BINS` thresholds of each statistic. Of tests that gain the same, the
    first in order of statistics and thresholds is taken.
    """
    rows = written(labelled.where("bad is not null").select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("apart"), *STATISTICS))
    thresholds = _thresholds(rows.where("not apart"))
    if not thresholds:
        return []
    rules: list[Rule] = []
    grow, prune = rows.where("not apart"), rows.where("apart")
    while len(rules) < MOST_RULES:
        rule = _grown(grow, thresholds)
        if not rule:
            break
        prefixes = [rule[:n] for n in range(len(rule), 0, -1)]
        worth = _worth(prune, prefixes)
        score = [(b - g) / (b + g) if b + g else -1.0 for b, g in worth]
        # of equals, the shorter rule
        best = max(range(len(prefixes)), key=lambda i: (score[i], i))
        kept, (bad, good) = prefixes[best], worth[best]
        (b, g), = _worth(grow, [kept])
        if b < LEAST_PRECISION * (b + g) or bad + good < 1 or bad < LEAST_PRECISION * (bad + good):
            break
        rules.append(kept)
        grow, prune = grow.where(~_holds(kept)), prune.where(~_holds(kept))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds from 1 on, else 0."""
    out = None
    for n, rule in enumerate(rules, 1):
        out = F.when(_holds(rule), n) if out is None else out.when(_holds(rule), n)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """`measured` (with what `statistics` gives) with `rule`, the first rule that covers a row (0: none), and `kept`.

    A document fails if the base rules fail it or a learned rule covers it.
    """
    return measured.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def learn_from(measured: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list of `measured` (doc_id and what `statistics` gives) and `labels` (doc_id, quality 0/1).

    Learned from the documents that the base rules pass, since it decides only about those. Rows
    with a null id or quality tell nothing; repeated labels of a document count once each; without
    labels the list is empty. Statistics meet labels, so no text is shuffled.
    """
    bad = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    passed = measured.where("doc_id is not null and not base_failed").select(F.col("doc_id").cast("long").alias("doc_id"), *STATISTICS)
    return learn(passed.join(bad, "doc_id"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, what `statistics` gives, rule, kept) of every row of `docs` (doc_id, text), judged by a list learned from `labels`.

    Repeated rows are judged alike, each for itself; an empty table gives no rows. The statistics
    are computed once, into a table without texts. To filter documents, use
    `judged(statistics(docs), rules)`, which keeps whole rows.
    """
    measured = written(statistics(docs.select("doc_id", "text")).withColumn("doc_id", F.col("row.doc_id")).drop("row"))
    return judged(measured, learn_from(measured, labels))
