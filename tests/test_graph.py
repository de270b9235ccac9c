import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph


def naive_root(nxt, e):
    """(root, cyclic) by walking; a walk that repeats ends on the smallest node of its cycle."""
    path = []
    while e in nxt and e not in path:
        path.append(e)
        e = nxt[e]
    if e in path:
        return min(path[path.index(e):]), True
    return e, False


@pytest.mark.parametrize("seed", range(3))
def test_chain_roots_with_cycles_and_tails(spark, seed):
    r = random.Random(seed)
    nxt = {i: r.randrange(60) for i in r.sample(range(60), 45)}
    nxt = {k: v for k, v in nxt.items() if k != v}
    nxt.update({100 + i: 99 + i for i in range(1, 40)})
    got = {x.e: (x.root, x.cyclic) for x in graph.chain_roots(spark.createDataFrame(list(nxt.items()), "src long, dst long")).collect()}
    assert got == {e: naive_root(nxt, e) for e in nxt}


def test_same_as_fixture(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "src string, dst string")
    roots = graph.chain_roots(edges)
    everyone = spark.createDataFrame([(x,) for x in "abcde"], "e string")
    groups = {r.e: r.root for r in graph.same_group(roots, everyone).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}
    assert [tuple(r) for r in graph.overmerged(roots, 2).collect()] == [("a", 3)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200, 200 + i) for i in range(1, 60)] + [(300 + i, 301 + i) for i in range(40)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        stack = [s] if s not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = s
                stack += near[x]
    got = {x.e: x.root for x in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (4,), (9,)], "start long")
    assert sorted(map(tuple, graph.reachable(edges, starts).collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (4, 4), (9, 9)]
    assert sorted(map(tuple, graph.reachable(edges, starts, at_least=1).collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (9, 9)]
    assert sorted(map(tuple, graph.reachable(edges, spark.createDataFrame([(4,)], "start long"), at_least=1, reverse=True).collect())) == [(4, 1), (4, 2), (4, 3)]


def test_fixpoint_longer_than_the_merge_window(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)], "src long, dst long")
    out = graph.fixpoint(spark.createDataFrame([(0,)], "n long"), lambda new: new.join(edges, new["n"] == edges["src"]).select(F.col("dst").alias("n")))
    assert sorted(r.n for r in out.collect()) == list(range(26))


def test_linked_directly_or_through_a_small_record(spark):
    hub = [(1000, i) for i in range(1, 13)]
    edges = spark.createDataFrame([(1, 2), (50, 3), (50, 4)] + hub, "src long, dst long")
    pairs = spark.createDataFrame([(2, 1), (3, 4), (5, 6), (1, 4)], "a long, b long")
    assert sorted(map(tuple, graph.linked(pairs, edges).collect())) == [(2, 1), (3, 4)]


def test_levels_dangling_and_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdxy"], "e string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "gone"), ("x", "y"), ("y", "x")], "src string, dst string")
    out, dangling, rest = graph.levels(nodes, edges)
    assert {r.e: r.level for r in out.collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    assert [tuple(r) for r in dangling.collect()] == [("gone", "d")] or [tuple(r) for r in dangling.collect()] == [("d", "gone")]
    assert sorted(r.e for r in rest.collect()) == ["x", "y"]


@pytest.mark.parametrize("seed", range(2))
def test_levels_against_peeling(spark, seed):
    """Deep, with repeated edges, a self-reference, dangling targets and a ring."""
    r = random.Random(seed)
    edges = [(i, r.randrange(max(0, i - 3), i)) for i in range(1, 25) for _ in range(2)] + [(30, 31), (31, 30), (32, 30), (33, 33), (5, 99), (98, 1)]
    nodes = [*range(25), 30, 31, 32, 33, 3, 3]
    deps = {n: {d for s, d in edges if s == n and d in nodes} for n in nodes}
    level, k = {}, 0
    while ready := [n for n in deps if n not in level and all(d in level and level[d] < k for d in deps[n])]:
        level.update({n: k for n in ready})
        k += 1
    out, dangling, rest = graph.levels(spark.createDataFrame([(n,) for n in nodes], "e long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {x.e: x.level for x in out.collect()} == level and out.count() == len(level)
    assert sorted(map(tuple, dangling.collect())) == [(5, 99)] and sorted(x.e for x in rest.collect()) == [30, 31, 32, 33]
