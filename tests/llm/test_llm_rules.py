"""Quality rules: base statistics against plain code, and what a planted rule teaches."""

from collections import Counter

from pyspark.sql import functions as F

from factloom.llm import rules


def base(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


ODD = [None, "", " ", "a", "a b", "a b c", "a a a", "a a a a", "x y z x y z", "x y z q x y z x y z", "one\ntwo\none\n\n \n \none", "é☃ 👩‍👧 #*$%&|<>", " a b \x85c",
       "\x0b\x0c\r\t\n", "w " * 3000, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 25}" for i in range(60)), "a.\r\nb.\r\na.\r\n", " ".join(f"v{i}" for i in range(20000))]


def test_base_statistics(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, 9, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, row string")
    out = {r.doc_id: r for r in rules.statistics(df).select("row.doc_id", *rules.STATISTICS, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), repr(t)[:80]
        assert all(r[s] is not None for s in rules.STATISTICS)


def test_a_planted_rule_is_learned_and_clean_documents_stay(spark):
    def text(i):
        words = [f"word{i}x{j}" for j in range(80)]
        return " ".join(w + "***" if i % 4 == 0 else w.upper() if i % 9 == 1 else w for w in words) + "."
    docs = spark.createDataFrame([(i, text(i)) for i in range(600)] + [(None, text(0)), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 or i % 9 == 1 else 1) for i in range(400)] + [(400, None), (None, 0)], "doc_id long, quality int")
    out = rules.judge(docs, labels).select("doc_id", "kept", "rule").collect()
    assert len(out) == 602
    for r in out:
        if r.doc_id is not None:
            assert r.kept == (r.doc_id % 4 != 0 and r.doc_id % 9 != 1), r
    assert len({r.rule for r in out}) >= 3


def test_without_labels_only_the_base_rules_decide(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    out = rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.where(F.col("kept") == F.col("base_failed")).count() == 0
    assert rules.judge(docs.where("false"), spark.createDataFrame([(1, 0)], "doc_id long, quality int")).count() == 0


def test_the_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = rules.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_thresholds_are_percentiles_on_a_grid_however_many_values(spark):
    values = spark.range(20000).select(*[(F.col("id") * (i + 1) / 7.0).alias(n) for i, n in enumerate(rules.STATISTICS)])
    found = rules._thresholds(values)
    for i, n in enumerate(rules.STATISTICS):
        assert len(found[n]) == rules.BINS - 1
        for k, t in enumerate(found[n], 1):
            exact = 19999 * k / rules.BINS * (i + 1) / 7.0
            assert exact * (1 - 2 ** -rules.GRID_BITS) - 1 <= t <= exact
    assert values.select(rules._on_grid(F.col(rules.STATISTICS[0])).alias("c")).distinct().count() < 20000 * 2 / 3
    # few values are kept as they are
    few = spark.createDataFrame([(float(v),) * len(rules.STATISTICS) for v in (0, 0, 1, 3)], list(rules.STATISTICS))
    assert set(rules._thresholds(few)["stops_per_word"]) <= {x / 32 for x in range(97)} and min(rules._thresholds(few)["stops_per_word"]) == 0
    assert rules._thresholds(few.where("false")) == {}
