"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from factloom.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    lines = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in lines]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_classes(prints, distance=3):
    """The smallest index reachable from each print over pairs within the distance."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def clustered(seed, n):
    r = random.Random(seed)
    seeds = [r.getrandbits(64) for _ in range(4)]
    out = {r.getrandbits(64) for _ in range(n // 4)}
    while len(out) < n:
        x = r.choice(seeds)
        for b in r.sample(range(64), r.randint(0, 9)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("seed", "n"), [(1, 3), (2, 40), (3, 400)])
def test_linked_runs(seed, n):
    x = np.array(clustered(seed, n), np.uint64)
    x = x[np.argsort(simhash.gray_rank(x))]
    assert simhash.linked_runs(x).tolist() == brute_classes([int(v) for v in x])


@pytest.mark.parametrize("most", [4096, 3])
def test_edges_connect_what_links_connect(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_UNDER_PATTERN", most)
    x = clustered(9, 300)
    values = np.array(x, np.uint64).view(np.int64).tolist()
    edges = simhash.linked_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v
    for e in edges:
        assert ((e.src ^ e.dst) & (1 << 64) - 1).bit_count() <= 64
        label[root(e.src)] = root(e.dst)
    want = brute_classes(x)
    groups = {}
    for v, w in zip(values, want, strict=True):
        groups.setdefault(root(v), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(4, long), (2, long.upper()), (9, long + " tail"), (1, "Ünïque Ä"), (6, None), (5, ""), (5, ""), (None, long), (8, "one"), (3, "one  two\nthree four"), (7, " \t")]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, component_id int").repartition(4)
    got = sorted(((r.doc_id or 0, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()))
    prints = [brute_print(t) for _, t in rows]
    label = brute_classes(prints)
    least = {}
    for (doc, _), c in zip(rows, label, strict=True):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    assert got == sorted((doc or 0, p, least[c]) for (doc, _), p, c in zip(rows, prints, label, strict=True))
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_near_copies_by_similarity(spark):
    r = random.Random(5)
    texts = {}
    for base in range(0, 120, 4):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([3, 5, 30, 120, 600]))]
        texts[base] = " ".join(words)
        for n in range(1, 4):
            # a chain of edits: each a copy of the one before with some words replaced
            words = list(words)
            for i in r.sample(range(len(words)), len(words) // r.choice([40, 60, 90])):
                words[i] = f"x{r.randrange(10**6)}"
            texts[base + n] = " ".join(words)
    texts |= {200: None, 201: " ", 202: texts[8].upper(), 203: "one two", 204: "One  two", 205: "one three"}
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                near = 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
                if near and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(df, 5, 0.8).collect()}
    assert got == label
    assert len(set(label.values())) < len(texts) - 40
    assert simhash.near_copies(df.where("false"), 5, 0.8).count() == 0


def test_pipeline_drops_copies_of_similarity_0_8(spark):
    words = [f"w{i}" for i in range(300)]
    edited = list(words)
    for i in (40, 100, 160, 220, 270):
        edited[i] = "other"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited))], "doc_id long, text string")
    assert (brute_print(" ".join(words)) ^ brute_print(" ".join(edited))).bit_count() > simhash.DISTANCE
    assert [x.doc_id for x in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()] == [1]


def test_near_copies_of_rows_without_an_id_of_their_own(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words, "more"])
    rows = [(None, a), (None, a), (7, b), (7, b), (3, "quite other words than those"), (None, None)]
    got = sorted((x.doc_id is not None, x.doc_id, x.component_id) for x in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).where("fp <> 0").collect() if x.component_id is not None)
    assert got.count((True, 7, 7)) == 2 and (True, 3, 3) in got and sum(1 for _, i, c in got if i is None and c == 7) == 2
