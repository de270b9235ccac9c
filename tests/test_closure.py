"""Closed samples against a walk in Python."""

import hashlib
import random

import pytest

from factloom.operators.closure import Reference, closed_sample, dangling


def naive(tables, references, seeds):
    keys = {n: {k for k, *_ in rows if k is not None} for n, (rows, _) in tables.items()}
    links = []
    for r in references:
        at = 1 + tables[r.table][1].index(r.column)
        links.append({(row[0], row[at]) for row in tables[r.table][0] if row[0] is not None and row[at] in keys[r.target]})
    kept = {n: seeds.get(n, set()) & keys[n] for n in tables}
    while True:
        before = {n: set(k) for n, k in kept.items()}
        for r, pairs in zip(references, links):
            kept[r.target] |= {d for s, d in pairs if s in kept[r.table]}
            for d in before[r.target] | kept[r.target]:
                mine = sorted((s for s, t in pairs if t == d), key=lambda s: (hashlib.sha256(str(s).encode()).hexdigest(), s))
                kept[r.table] |= set(mine if r.most is None else mine[:r.most])
        if kept == before:
            return kept


def frames(spark, tables):
    return {n: (spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} long" for c in columns)), "id") for n, (rows, columns) in tables.items()}


@pytest.mark.parametrize("seed, most", [(0, 2), (1, None), (2, 0), (3, 2000)])
def test_against_a_walk(spark, seed, most):
    r = random.Random(seed)
    key = lambda n: r.choice([None, *range(n), n + 5])
    tables = {"a": ([(i, key(6)) for i in range(12)] + [(None, 1), (3, 2)], ["boss"]),
              "b": ([(100 + i, r.choice([None, 0, 0, 0, *range(12)]), key(12)) for i in range(60)], ["owner", "other"]), "c": ([], ["x"])}
    references = [Reference("a", "boss", "a"), Reference("b", "owner", "a", most), Reference("b", "other", "a", 1), Reference("c", "x", "b", 1)]
    df = frames(spark, tables)
    got = closed_sample(df, references, {"a": spark.createDataFrame([(4,), (4,), (77,)], "key long")})
    want = naive(tables, references, {"a": {4, 77}})
    for n, (rows, _) in tables.items():
        assert sorted(map(tuple, got[n].select(df[n][0].columns).collect()), key=repr) == sorted((x for x in rows if x[0] in want[n]), key=repr)
    assert {x.n for x in dangling(got, df, references).collect()} == {0}


def test_nothing_asked_and_wrong_names(spark):
    df = frames(spark, {"a": ([(1, None)], ["x"])})
    assert closed_sample(df, [], {})["a"].count() == 0
    for references, seeds in (([Reference("a", "x", "z")], {}), ([Reference("a", "x", "a", -1)], {}), ([], {"z": df["a"][0]})):
        with pytest.raises(ValueError):
            closed_sample(df, references, seeds)
