"""Token counts and SentencePiece encoding, against the sentencepiece library's unigram encoder."""

import re

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from factloom.llm import lattice, sentences, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", "   lead", "trail  ", "line\nbreak\n\n", "tab\there", "☃ snow ☃☃", "日本語テキスト", "x" * 300, "ab" * 200 + "日" * 40, "123 4567", "Ünïcödé é è"]


def unigram(tmp_path, byte_fallback=True):
    """The given pieces as a unigram model, with the scores that single precision can't add made moderate."""
    with open(MODEL, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = byte_fallback
    if not byte_fallback:
        for p in model.pieces:
            p.type = 1 if p.type == 6 else p.type
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.fixture(scope="module")
def lines():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    return [x for t in texts for x in re.split(r"(?<=[.\n])", t) if len(x) < 500][:1500] + ODD


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_both_agree_with_the_library(tmp_path, lines, byte_fallback):
    path = unigram(tmp_path, byte_fallback)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    table = lattice.load(path)
    encoder, counter = sentences.Encoder(table), token_counts.Counter(table)
    for line in lines:
        ids = encoder.encode(line)
        assert ids.tolist() == library.encode(line), line
        if byte_fallback:
            assert sum(counter[s][1] for s in table.segments(line)) == len(ids)


def test_counts_and_scores_are_those_of_the_encoding(lines):
    table = lattice.load(MODEL)
    encoder, counter = sentences.Encoder(table), token_counts.Counter(table)
    scores = {i: s for s, i in table.usable.values()}
    for line in lines:
        ids = encoder.encode(line).tolist()
        found = [counter[s] for s in table.segments(line)]
        assert sum(n for _, n in found) == len(ids)
        if all(i in scores for i in ids):
            assert sum(s for s, _ in found) == sum(scores[i] for i in ids)


def test_decoding_gives_the_text_back(lines):
    table = lattice.load(MODEL)
    encoder, decoder = sentences.Encoder(table), sentences.Decoder(table)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for line in lines:
        ids = encoder.encode(line)
        assert decoder.decode(ids) == line
        assert decoder.decode(np.array(library.encode(line), dtype=np.int32)) == line


def test_ids_are_committed_before_the_text_ends():
    table = lattice.load(MODEL)
    seen = 0

    def characters():
        nonlocal seen
        for c in "▁streaming" * 1000:
            seen += 1
            yield c
    next(sentences.stream(table, characters()))
    assert seen <= 4 * table.longest


def test_rows_in_spark(spark):
    docs = spark.createDataFrame([(1, "the cat\nsat", 5), (None, None, 1), (1, "", 2), (2, "the cat\nsat", None)], "doc_id long, text string, ids int")
    counts = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(docs, MODEL).collect())
    encoded = sentences.encode(docs, MODEL)
    back = sentences.decode(encoded, MODEL).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in back) == counts
    assert sorted((r.doc_id or 0, r.text) for r in back) == [(0, ""), (1, ""), (1, "the cat\nsat"), (2, "the cat\nsat")]
    assert counts[0] == (0, 0)
    empty = docs.where("false")
    assert token_counts.count_tokens(empty, MODEL).count() == 0
    assert sentences.encode(empty, MODEL).count() == 0


def changed(tmp_path, **kinds):
    """The given BPE model with some pieces of other types, or of another model type."""
    with open(MODEL, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = kinds.pop("model_type", 2)
    if not kinds.pop("byte_fallback", True):
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            p.type = 1 if p.type == 6 else p.type
    for p in model.pieces:
        p.type = kinds.get(p.piece, p.type)
    path = tmp_path / "changed.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kinds", [{}, {"byte_fallback": False}, {"th": 4, "ing": 4, "er": 5, "▁the": 5, "ion": 5}])
def test_bpe_files_give_their_own_merges(tmp_path, lines, kinds):
    path = changed(tmp_path, **kinds) if kinds else MODEL
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    table = lattice.load(path)
    encoder, counter = sentences.Encoder(table), token_counts.Counter(table)
    for line in lines:
        ids = library.encode(line)
        assert encoder.encode(line).tolist() == ids, line
        if table.byte_ids:
            assert counter.total(line)[1] == len(ids), line


@pytest.mark.parametrize("model_type", [3, 4])
def test_other_model_types_are_refused(tmp_path, model_type):
    with pytest.raises(ValueError, match="not supported"):
        lattice.load(changed(tmp_path, model_type=model_type))
