"""Token stores: exact round trips of planes, and of documents against the tokenizers library."""

from unicodedata import normalize

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import token_store

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
    TOKENIZER = f.read()


@pytest.mark.parametrize("planes", token_store.PLANES)
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65535, 65536, 65537, 200001])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    sizes, data = token_store.pack(ids, planes)
    assert len(sizes) == -(-n // token_store.BLOCK_IDS) * (4 if planes == "byte" else 32) and sizes.sum() == len(data)
    assert (token_store.unpack(sizes, data, n, planes) == ids).all()


def test_ids_of_letters_that_change_and_of_marks():
    """Every letter whose cases or normal form have other lengths, behind and before each mark, is encoded as the library does."""
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and (len(c.lower()) > 1 or len(c.upper()) > 1 or (c > "\uffff" or c < "\u3400") and normalize("NFC", c) != c)]
    letters += [chr(c) for c in range(0x300, 0x370)]
    words = [f"{a}{c}{m}{b}" for n, c in enumerate(letters) for m in (token_store.WordEncoder.MARKS.decode()[n % 11], ".") for a, b in (("x", ""), ("", "y"), ("SEVG", "."))]
    encoder, library = token_store.WordEncoder(TOKENIZER), Tokenizer.from_str(TOKENIZER)
    ids, sizes = encoder.encode([w.encode() for w in words])
    want = [x.ids for x in library.encode_batch(words, add_special_tokens=False)]
    assert encoder.parts and ids.tolist() == [i for ids in want for i in ids] and sizes.tolist() == list(map(len, want))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_WORDS", 20)
    encoder, library = token_store.WordEncoder(TOKENIZER), Tokenizer.from_str(TOKENIZER)
    for n in range(30):
        texts = [f"the word{k % 9}, of It. the the new{k * n} {k}" for k in range(25)]
        ids, sizes = encoder.encode([t.encode() for t in texts])
        assert ids.tolist() == [i for x in library.encode_batch(texts, add_special_tokens=False) for i in x.ids] and len(encoder.slots) < 500


@pytest.mark.parametrize("planes", token_store.PLANES)
def test_store_round_trip(spark, tmp_path, monkeypatch, planes):
    monkeypatch.setattr(token_store, "CHUNK_IDS", 300)
    odd = ["", None, " \t\n", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ΟΔΟΣ é é  x y", "don't we'll 1234 !!?? ab12cd", "日本語 テキスト 👩‍👩‍👧", "word " * 3000]
    rows = [(1000 - i, odd[i % len(odd)] if i % 5 == 0 else f"some text number {i} with Words{i * 7919} and more") for i in range(200)]
    rows += [(None, "no id"), (None, None), (3, "same id"), (3, "same id"), (3, "another")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, part string").repartition(7)
    token_store.write(df, str(tmp_path / planes), TOKENIZER, end_id=1, planes=planes, parts=5)
    got = token_store.read(spark, str(tmp_path / planes)).orderBy("start").collect()
    encoder = Tokenizer.from_str(TOKENIZER)
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append(np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r.start == at and r.ids in want[r.doc_id]
        want[r.doc_id].remove(r.ids)
        at += len(r.ids) // 4
    index = spark.read.parquet(f"{tmp_path}/{planes}/index").orderBy("part", "chunk").collect()
    assert [r.ids_before for r in index] == np.r_[0, np.cumsum([r.n_ids for r in index])][:-1].tolist()
    assert [r.docs_before for r in index] == np.r_[0, np.cumsum([r.n_docs for r in index])][:-1].tolist()


def test_empty_store(spark, tmp_path):
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), TOKENIZER, end_id=1)
    assert token_store.read(spark, str(tmp_path / "none")).count() == 0
