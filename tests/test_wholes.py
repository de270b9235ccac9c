"""Linking through wholes against greedy and brute-force versions."""

import random
from collections import defaultdict

import pytest

from factloom.operators import score, wholes


def greedy(candidates):
    best = {}
    for x, y, v in candidates:
        best[x, y] = max(v, best.get((x, y), v))
    left, right, out = set(), set(), []
    for (x, y), v in sorted(best.items(), key=lambda c: (-c[1], c[0])):
        if x not in left and y not in right:
            out.append((x, y, v))
            left.add(x)
            right.add(y)
    return sorted(out)


@pytest.mark.parametrize("seed, lefts", [(0, 8), (1, 30), (2, 1)])
def test_assignment_is_the_greedy_one(spark, seed, lefts):
    r = random.Random(seed)
    rows = [(r.randrange(lefts), r.randrange(25), r.randrange(4)) for _ in range(60)]
    got = wholes.assign(spark.createDataFrame(rows, "left long, right long, votes long"))
    assert sorted(map(tuple, got.collect())) == greedy(rows)


def test_no_candidates(spark):
    assert wholes.assign(spark.createDataFrame([], "left long, right long, votes long")).collect() == []


def test_votes_of_keys_that_one_part_says(spark):
    left = [(1, 10, "a"), (1, 10, "a"), (1, 10, "b"), (1, 11, "b"), (1, 11, "c"), (2, 20, "a"), (3, 30, "a"), (1, 12, None)]
    right = [(7, 70, "a"), (7, 71, "c"), (7, 72, "b"), (8, 80, "a"), (8, 81, "a")]
    side = "whole long, part long, key string"
    got = wholes.votes(spark.createDataFrame(left, side), spark.createDataFrame(right, side), spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "left long, right long"))
    assert sorted(map(tuple, got.collect())) == [(10, 70, 1), (11, 71, 1)]


def test_attributes_by_values_and_by_parts(spark):
    known = spark.createDataFrame([("k", "1"), ("k", "2"), ("k", "2"), ("m", "x"), ("m", "y"), ("m", "z"), ("q", None)], "ident string, v string")
    held = spark.createDataFrame([("b", "1"), ("a", "2"), ("c", "x"), ("c", None)], "ident string, v string")
    assert list(map(tuple, wholes.same_attribute(known, held).collect())) == [("k", "a", 2, 1)]
    part_of = spark.createDataFrame([("p", "w"), ("w", "v"), ("v", "w"), ("r", "p")], "part string, whole string")
    assert sorted(map(tuple, wholes.in_wholes(part_of).collect())) == [("p", "v"), ("p", "w"), ("r", "p"), ("r", "v"), ("r", "w"), ("v", "w"), ("w", "v")]
    parts = spark.createDataFrame([("p", "x"), ("r", "x"), ("p", "x")], "part string, whole_kind string")
    carried = spark.createDataFrame([("p", "id"), ("r", "id"), ("p", "code"), ("p", "code")], "e string, ident string")
    assert list(map(tuple, wholes.identity_of_parts(parts, carried).collect())) == [("x", "id", 2)]


@pytest.mark.parametrize("seed", range(3))
def test_splits_and_twins_by_brute_force(spark, seed):
    r = random.Random(seed)
    truth = [(f"k{i}", r.randrange(12)) for i in range(30)] + [("k1", 3)]
    stored = [(f"k{r.randrange(40)}", r.randrange(9)) for _ in range(25)]
    where, things = defaultdict(set), defaultdict(set)
    for k, e in stored:
        where[k].add(e)
    of = defaultdict(set)
    for k, t in truth:
        of[t].add(k)
    lies = {t: set().union(*(where[k] for k in ks)) for t, ks in of.items()}
    for t, es in lies.items():
        for e in es:
            things[e].add(t)
    right = sum(len(lies[t]) == 1 and all(where[k] for k in of[t]) and len(things[next(iter(lies[t]))]) == 1 for t in of)
    want = (len(of), sum(bool(e) for e in lies.values()), sum(len(e) > 1 for e in lies.values()), len(things), sum(len(t) > 1 for t in things.values()), right)
    got = score.splits_and_twins(spark.createDataFrame(truth, "key string, thing long"), spark.createDataFrame(stored, "key string, e long")).first()
    assert tuple(got) == want
