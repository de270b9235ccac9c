"""Language ID: the penalty path against all paths, held-out accuracy, and odd texts."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import language


def test_viterbi_is_the_best_path():
    r = random.Random(3)
    for _ in range(60):
        scores = np.array([[r.uniform(-6, 0) for _ in range(3)] for _ in range(r.randint(1, 7))])
        switch = r.choice([0.5, 2.0, 20.0])

        def value(path, scores=scores, switch=switch):
            return sum(scores[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))
        best = max(value(p) for p in itertools.product(range(3), repeat=len(scores)))
        assert abs(value(language.viterbi(scores, switch).tolist()) - best) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(docs.where(~held_out))
    found = language.identify(docs.where(held_out), model).select("row.lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_odd_texts_and_spans(spark):
    train = [(i, "the hat with thing and other words that they have", "en") for i in range(9)] + [(10 + i, "это слово и другие слова которые они знают", "ru") for i in range(9)]
    train += [(30 + i, "der Hut mit Ding und anderen Wörtern die sie haben", "de") for i in range(9)] + [(50, None, "en"), (51, "x", None), (None, "the", "xx")]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    mixed = "they have the hat and other words that they have, что они знают это слово и другие слова которые они знают"
    rows = [(1, None), (2, ""), (3, "12 !? _"), (4, "the other thing that they have"), (5, mixed), (6, "漢字"), (6, "漢字"), (None, "слово"), (7, "the " * 20000)]
    df = spark.createDataFrame([(a, b, 1.5, a) for a, b in rows], "doc_id long, text string, score double, spans long")
    out = language.identify(df, model)
    got = {r.row.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[1].row.score == 1.5
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (1, 2, 3)] == [("und", 0.0, [])] * 3
    assert (got[4].lang_pred, got[None].lang_pred, got[7].lang_pred) == ("en", "ru", "en") and got[6].lang_pred in model.languages
    assert [(s.lang, mixed[s.start:s.end].split()[0]) for s in got[5].spans] == [("en", "they"), ("ru", "что")]
    none = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.where("false"), model).count() == 0
