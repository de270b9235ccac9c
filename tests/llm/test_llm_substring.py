"""Substring dedup against a brute-force search for repeated windows."""

import random

import pytest

from factloom.llm import substring


def brute(rows, window):
    """(doc_id, words, removed, kept) of each row, by looking every window up."""
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1) if doc is not None and text is not None else ():
            key = tuple(words[i:i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i:i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((-1 if doc is None else doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def corpus(seed):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") for _ in range(r.randint(4, 40))] for _ in range(12)]
    rows = []
    for doc in range(80):
        words = []
        for _ in range(r.randint(0, 6)):
            p = list(r.choice(passages))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = r.choice("xyz")
            words += p[r.randint(0, 3):]
        rows.append((doc, r.choice([" ", "\n", "  \t"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 256), (2, 2), (3, 256)])
def test_against_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(substring, "MOST_RUNS", most)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(substring.removed(df, window=8, anchor=3)) == brute(rows, 8)


def test_odd_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i % 7}" for i in range(5000))
    rows = [(5, a), (5, a), (3, None), (None, a), (None, None), (2, ""), (7, f"x {a} y"), (7, b), (1, b), (4, "same " * 300), (6, "same " * 90), (9, " \n\t"), (5, f"other {b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substring.removed(df)) == brute(rows, 50)
    assert substring.removed(df.where("false")).count() == 0


def test_automaton_matches_every_factor():
    r = random.Random(5)
    held = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))) for _ in range(10)]
    automaton = substring.SuffixAutomaton()
    for h in held:
        automaton.add(h)
    text = "".join(r.choice("abc") for _ in range(200))
    for end, length in enumerate(automaton.matching(text), 1):
        assert length == max((n for n in range(min(end, 12) + 1) if any(text[end - n:end] in h for h in held)), default=0)


def test_documents_keep_their_columns_and_spacing(spark):
    a = " ".join(f"w{i}" for i in range(50))
    rows = [(1, a, 7, len(a), "x"), (2, f"head\n{a}\n tail", 8, 0, None), (3, None, 9, None, "y"), (None, "free", 1, 4, "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans int, n_chars int, th string")
    out = {r.doc_id: r for r in substring.without_repeats(df).collect()}
    assert out[1].text == a and out[2].text == "head\n\n tail" and out[2].n_chars == 11 and out[3].text is None and out[None].text == "free"
    assert substring.without_repeats(df).columns == df.columns
    assert (out[2].spans, out[2].th, out[1].n_chars) == (8, None, len(a))
