"""The pipeline against brute force on a small corpus with one case of each kind."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from factloom.llm import lattice, sentences

WORDS = {"en": "the and of hearing wishes through thing with other shall", "fr": "le que eau qui étaient nous où voilà dans être"}


def prose(lang, start, n):
    r, pool = random.Random(start), WORDS[lang].split()
    return [r.choice(pool) + r.choice("aeiou") + r.choice("lmnrst") for _ in range(n)]


@pytest.fixture
def folder(tmp_path):
    item = prose("en", 91, 20)
    passage = prose("fr", 55, 70)
    texts = {i: " ".join(prose("en" if i % 2 else "fr", i + 3, 120)) for i in range(1, 41)}
    texts[41] = texts[7] + " tailx"            # near copy of 7
    texts[42] = texts[8]                       # copy of 8
    texts[43] = " ".join(prose("en", 77, 60) + item + prose("en", 78, 60))
    texts[44] = " ".join(prose("fr", 61, 80) + passage)
    texts[45] = " ".join(passage + prose("fr", 62, 80))
    texts[46] = "123 456 !!"                   # no letters
    texts[47] = None
    rows = [{"doc_id": k, "text": v, "lang": None if k % 5 == 0 else "en" if k % 2 else "fr", "source": "s", "n_chars": len(v or "")} for k, v in texts.items()]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"item_id": 1, "text": " ".join(item)}, {"item_id": 2, "text": None}]), tmp_path / "benchmark.parquet")
    return tmp_path, texts, passage


def test_every_stage_takes_effect(spark, folder):
    path, texts, passage = folder
    out = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(path)).collect()}
    want = {k: v for k, v in texts.items() if k not in (41, 42, 43, 46, 47)}
    want[45] = texts[45][len(" ".join(passage)):]
    assert set(out) == set(want)
    table = lattice.load(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    decoder = sentences.Decoder(table)
    for k, v in want.items():
        assert decoder.decode(np.array(out[k])).strip() == v.strip()


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(path)).columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(path)).count() == 0, name


def test_last_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "the  cat\nsat ☃"), (2, None)], "doc_id long, text string")
    name, stage = corpus_pipeline.STAGES[-1]
    assert "decoding" in name
    assert {r.doc_id: r.text for r in stage(spark, docs, "").collect()} == {1: "the  cat\nsat ☃", 2: ""}


def test_last_stage_needs_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "the  cat\nsat ☃"), (2, None), (2, None), (None, ""), (3, "x")], "doc_id long, text string")
    model = corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")
    found = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = sentences.decode(sentences.encode(docs, model), model)
    assert found.schema == want.schema and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
