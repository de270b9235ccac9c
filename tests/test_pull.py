"""Nested records against a walk over a small store."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.model import FACT_SCHEMA, TX_SCHEMA, Attribute, kernel_attributes, registry
from factloom.operators import pull
from factloom.store import FactLog

NAME = Attribute(1001, "x/name", "string")
TAGS = Attribute(1002, "x/tags", "string", "many")
NEXT = Attribute(1003, "x/next", "ref")
LIKES = Attribute(1004, "x/likes", "ref", "many")
SIZE = Attribute(1005, "x/size", "decimal")
ALL = [NAME, TAGS, NEXT, LIKES, SIZE]
CURRENT = {
    1: {"x/name": "a", "x/tags": ["p", "q"], "x/next": 2, "x/likes": [2, 3]},
    2: {"x/name": "b", "x/next": 3, "x/size": 7},
    3: {"x/name": "c", "x/next": 1, "x/likes": [3]},
    4: {"x/tags": ["q"], "x/next": 99},
}


@pytest.fixture(scope="module")
def store(spark):
    rows = []
    for e, held in CURRENT.items():
        for a in ALL:
            vs = held.get(a.ident, [])
            for v in vs if isinstance(vs, list) else [vs]:
                rows.append({"e": e, "a": a.id, a.column: v if a.type != "decimal" else Decimal(v), "tx": 100, "op": True})
    rows.append({"e": 2, "a": NAME.id, "v_string": "b", "tx": 101, "op": False})
    rows.append({"e": 2, "a": NAME.id, "v_string": "bee", "tx": 101, "op": True})
    full = [tuple(r.get(f.name) for f in FACT_SCHEMA) for r in rows]
    tx = spark.createDataFrame([(100, 1, datetime(2026, 1, 1)), (101, 1, datetime(2026, 1, 2))], TX_SCHEMA)
    return FactLog.of(spark.createDataFrame(full, FACT_SCHEMA), registry(spark, kernel_attributes() + ALL), tx)


def ids(spark, *es):
    return spark.createDataFrame([(e,) for e in es], "e long")


def records(df):
    return {r.e: r.record.asDict(recursive=True) for r in df.collect()}


def test_values_arrays_and_references_both_ways(spark, store):
    shape = ["x/name", "x/tags", {"x/next": ["x/name", {"x/likes": ["x/name"]}]}, {"~x/likes": ["x/name"]}]
    got = records(pull.nested(store, shape, ids(spark, 1, 2, 3, 4, 5)))
    assert got[1] == {"id": 1, "x/name": "a", "x/tags": ["p", "q"], "x/next": {"id": 2, "x/name": "bee", "x/likes": None}, "~x/likes": None}
    assert got[2]["x/next"] == {"id": 3, "x/name": "c", "x/likes": [{"id": 3, "x/name": "c"}]}
    assert got[3]["~x/likes"] == [{"id": 1, "x/name": "a"}, {"id": 3, "x/name": "c"}]
    assert got[4]["x/next"] == {"id": 99, "x/name": None, "x/likes": None}  # nothing is known of it but its id
    assert got[5] == {"id": 5, "x/name": None, "x/tags": None, "x/next": None, "~x/likes": None}


def test_every_attribute_as_text(spark, store):
    got = records(pull.nested(store, [{"x/next": ["*"]}], ids(spark, 1)))
    assert got[1]["x/next"] == {"id": 2, "*": {"x/name": ["bee"], "x/next": ["3"], "x/size": ["7"]}}


def test_as_of_and_repeated_roots(spark, store):
    got = pull.nested(store, ["x/name"], ids(spark, 2, 2), as_of=100).collect()
    assert [r.record["x/name"] for r in got] == ["b"]


def test_a_repeated_reference_ends_where_it_closes(spark, store):
    got = records(pull.nested(store, ["x/name", {"x/next": 4}], ids(spark, 1, 4)))
    second = got[1]["x/next"]["x/next"]
    assert (second["id"], second["x/name"]) == (3, "c")
    assert (second["x/next"]["id"], second["x/next"]["x/name"], second["x/next"]["x/next"]) == (1, None, None)
    assert got[4]["x/next"]["id"] == 99 and got[4]["x/next"]["x/next"] is None


def test_wide_arrays_are_refused_not_cut(spark, store):
    with pytest.raises(pull.TooWide, match="x/tags"):
        pull.nested(store, ["x/tags"], ids(spark, 1), widest=1)
    with pytest.raises(pull.TooWide, match="~x/likes"):
        pull.nested(store, [{"~x/likes": ["x/name"]}], ids(spark, 3), widest=1)


@pytest.mark.parametrize("shape", [[{"x/name": ["x/name"]}], [{"x/likes": 2}], [3], [], [{"x/next": 0}]])
def test_shapes_that_mean_nothing(spark, store, shape):
    with pytest.raises(ValueError):
        pull.nested(store, shape, ids(spark, 1))


def walk(root, depth):
    out, level = [], [(root,)]
    for k in range(depth + 1):
        after = set()
        for path in level:
            for ident, vs in CURRENT.get(path[-1], {}).items():
                for v in vs if isinstance(vs, list) else [vs]:
                    ref = ident in ("x/next", "x/likes")
                    out.append((root, path, path[-1], ident, "bee" if v == "b" else str(v), ref and v in path))
                    if ref and v not in path:
                        after.add((*path, v))
        level = sorted(after)
    return sorted(out)


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_rows_against_a_walk(spark, store, depth):
    got = sorted((r.root, tuple(r.path), r.e, r.attribute, r.value, r.cut) for r in pull.rows(store, ids(spark, 1, 3, 4, 5), depth).collect())
    assert got == sorted(x for e in (1, 3, 4, 5) for x in walk(e, depth))


def test_no_roots(spark, store):
    none = ids(spark, 1).where(F.lit(False))
    assert pull.nested(store, ["x/name"], none).count() == 0 and pull.rows(store, none, 2).count() == 0
