"""Clustering, hard negatives and nearest neighbours against brute force, and on rows that take no part."""

import hashlib
import math

import numpy as np
import pytest

from factloom.llm import centroids, negatives, neighbours, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, x string, rank int, _n int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "clash", 7, 3) for i, v, l in rows], SCHEMA).repartition(5)


def odd(dims):
    """Rows that take no part."""
    return [(90_000, None, 1), (90_050, [], 1), (90_100, [1.0] * (dims - 1) + [None], 1), (90_150, [1.0] * (dims - 1) + [NAN], 1), (90_200, [INF] + [1.0] * (dims - 1), 1)]


def drawn(n, dims, seed, hot=True):
    """Random rows, a third of them near one vector, some equal."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    if hot:
        x[::3] = x[0] + 0.01 * rng.standard_normal((len(x[::3]), dims)).astype(np.float32)
    x[5::40] = x[5]
    return x


# --- clustering


def lloyd(rows, k, rounds, scale):
    ints = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    c = [v for _, _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v, v) for i, v in ints if i is not None)[:k]]

    def near(v):
        return min((sum((a - b)**2 for a, b in zip(v, m, strict=True)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in ints]
        for n in range(len(c)):
            mine = [v for (_, v), a in zip(ints, at, strict=True) if a == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted(((i, *near(v)[::-1]) for i, v in ints), key=repr), c


def clustered(df, **options):
    found = centroids.cluster(df, **options)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found.assigned.collect()), key=repr), found.centroids.tolist()


@pytest.mark.parametrize(("k", "rounds"), [(8, 4), (1, 2), (40, 3)])
def test_clusters_equal_plain_lloyd(spark, k, rounds):
    x = drawn(400, 6, k)
    rows = [*((i, v.tolist()) for i, v in enumerate(x)), (3, x[3].tolist()), (None, x[9].tolist())]
    df = table(spark, [*((i, v, 0) for i, v in rows), *odd(6), (90_300, [1.0] * 5, 1)])
    assert clustered(df, k=k, rounds=rounds, dims=6, scale=1024) == lloyd(rows, k, rounds, 1024)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (7, [3.0, 1.0])]
    assert clustered(table(spark, [(*r, 0) for r in rows]), k=8, rounds=3, dims=2) == lloyd(rows, 8, 3, 1024)
    none = centroids.cluster(table(spark, odd(2)), dims=2)
    assert none.assigned.count() == 0 and centroids.summarised(none).count() == 0
    with pytest.raises(Exception, match="component of 1024 times"):
        centroids.cluster(table(spark, [(1, [1e30, 0.0], 0)]), dims=2).assigned.collect()


def test_summary_adds_up(spark):
    found = centroids.cluster(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(drawn(90, 4, 2))]), k=3, dims=4)
    rows = centroids.summarised(found).collect()
    assert {r.inertia for r in rows} == {sum(r.distance for r in rows)}
    for c in {r.cluster for r in rows}:
        mine = [r for r in rows if r.cluster == c]
        assert {r.cluster_inertia for r in mine} == {sum(r.distance for r in mine)}
        assert {r.centroid_sha256 for r in mine} == {hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()}


@pytest.mark.parametrize("spread", [1, 1000, 1 << 26])
def test_search_is_exact_and_rejects(spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(-spread, spread, (300, 64)) + rng.integers(-spread, spread, (300, 1))
    x = np.concatenate([c[::3], c[:80] + rng.integers(-1, 2, (80, 64)), rng.integers(-spread, spread, (50, 64))])
    number, far, done = centroids.Sorted(c).nearest(x)
    every = ((x[:, None, :] - c[None])**2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    assert spread == 1 or done < 0.6 * every.size


# --- hard negatives


def mined(rows, every=100, n_positives=5, n_negatives=5, scale=256):
    ints = [(i, l, np.array([math.floor(scale * float(np.float32(x))) for x in v], np.int64)) for i, v, l in rows]
    out = []
    for a, label, v in ints:
        if a % every:
            continue
        scored = [(-int(v @ w), i, l) for i, l, w in ints]
        for s, p, _ in sorted(r for r in scored if r[2] == label and r[1] != a)[:n_positives]:
            fit = sorted(r[:2] for r in scored if r[2] != label and -80 * s <= -100 * r[0] <= -100 * s)[:n_negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "passed"), [(700, 8, 16_384), (900, 5, 3), (60, 4, 1)])
def test_negatives_equal_brute_force(spark, n, dims, passed):
    rng = np.random.default_rng(n)
    rows = [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(drawn(n, dims, n), rng.integers(0, 4, n), strict=True))]
    rows += [(100, rows[3][1], 2), (17, rows[17][1], rows[17][2])]
    df = table(spark, [*rows, *odd(dims), (None, [1.0] * dims, 1), (200_000, [1.0] * dims, None), (300_000, [1.0] * (dims + 1), 1)])
    got = sorted(map(tuple, negatives.mine(df, codes=4, pass_anchors=passed, every=100 if n > 100 else 10).collect()))
    assert got == mined(rows, 100 if n > 100 else 10) and got


def test_negatives_of_nothing(spark):
    assert negatives.mine(table(spark, odd(3))).count() == 0
    assert negatives.mine(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert negatives.mine(table(spark, [(100, [1.0], 1), (2, [1.0], 2)])).count() == 0
    # no negative score lies between 80 and 100 hundredths of a positive one that is below zero
    assert negatives.mine(table(spark, [(100, [1.0], 1), (2, [-1.0], 1), (3, [-1.0], 2)])).count() == 0


def test_certified_search_visits_few_cells():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (40, 16))
    x = centres[rng.integers(0, 40, 5000)] + rng.integers(-40, 40, (5000, 16))
    books = vectors.codebook(x[:, :8], 16), vectors.codebook(x[:, 8:], 16)
    block = negatives.Block(np.arange(5000), np.zeros(5000, np.int64), x, books)
    window = negatives.Window(-(1 << 62), 1 << 62, 5)
    visited = block.search(x[7].astype(np.int64), [window], lambda at: block.ids[at] != 7)
    every = sorted((-int(s), i) for i, s in enumerate(x.astype(np.int64) @ x[7]) if i != 7)[:5]
    assert window.found == every and visited < sum(a < b for a, b in zip(block.start, block.start[1:], strict=False)) / 2
    # scores of whole numbers beyond the exact range of doubles
    big = (x.astype(np.int64) << 14)
    block = negatives.Block(np.arange(5000), np.zeros(5000, np.int64), big, books)
    window = negatives.Window(-(1 << 62), 1 << 62, 5)
    block.search(big[7], [window], lambda at: block.ids[at] != 7)
    assert [s for s, _ in window.found] == sorted((-int(s) for i, s in enumerate(big @ big[7]) if i != 7))[:5]


# --- nearest neighbours


def nearest(rows, every, most):
    u = np.array([v for _, v in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for n, (q, _) in enumerate(rows):
        if q % every == 0:
            s = u @ u[n]
            out[q] = [(i, s[k]) for _, i, k in sorted((-round(s[k], 12), i, k) for k, (i, _) in enumerate(rows) if i != q)[:most]]
    return out


@pytest.mark.parametrize(("n", "dims", "hot", "passed"), [(4000, 64, False, 16_384), (3000, 48, True, 7), (500, 10, True, 16_384)])
def test_recall_against_brute_force(spark, n, dims, hot, passed):
    rows = [(i, v.tolist()) for i, v in enumerate(drawn(n, dims, n, hot))]
    df = table(spark, [*((i, v, 0) for i, v in rows), *odd(dims), (90_400, [0.0] * dims, 0), (None, [1.0] * dims, 0), (90_450, [1.0] * (dims + 1), 0)])
    got = neighbours.nearest(df, pass_queries=passed).orderBy("query_id", "rank").collect()
    want = nearest(rows, 50, 5)
    mine = {q: [r for r in got if r.query_id == q] for q in want}
    assert sum(map(len, mine.values())) == len(got)
    assert all([r.rank for r in rs] == [1, 2, 3, 4, 5] for rs in mine.values())
    assert all([(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs) for rs in mine.values())
    scores = {q: dict(w) for q, w in nearest(rows, 50, n).items()}
    assert all(abs(r.score - scores[r.query_id][r.vec_id]) < 1e-12 for r in got)
    recall = np.mean([len({i for i, _ in w} & {r.vec_id for r in mine[q]}) / 5 for q, w in want.items()])
    assert recall >= 0.9


def test_ties_scales_and_few_rows(spark):
    v = [0.3, -0.2, 0.7, 0.1]
    rows = [(50, v), (8, v), (3, v), (4, [x * 1e30 for x in v]), (5, [x * 1e-30 for x in v]), (9, [-x for x in v])]
    got = neighbours.nearest(table(spark, [(i, x, 0) for i, x in rows])).orderBy("rank").collect()
    assert [r.vec_id for r in got][:2] == [3, 8] and {r.vec_id for r in got} == {3, 4, 5, 8, 9}
    assert got[0].score == pytest.approx(1) and got[-1].score == pytest.approx(-1)
    assert neighbours.nearest(table(spark, odd(4))).count() == 0
    assert neighbours.nearest(table(spark, [(50, v, 0)])).count() == 0
    assert neighbours.nearest(table(spark, [(50, v, 0), (50, v, 0), (100, v, 0)])).count() == 4


def test_tests_abandon_early():
    x = drawn(5000, 64, 9, hot=False).astype(np.float64)
    index = neighbours.Index(x, 16)
    block = neighbours.Block(np.arange(5000), x, index)
    turned = (neighbours.unit(x[:1]) @ index.rotation).astype(np.float32)[0]
    found = []
    looked = block.search(0, x[0], [turned[c:c + 16] for c in range(0, 64, 16)], list(range(16)), found, 5)
    assert looked < 0.6 * x.size and len(found) == 5
