"""Reading by layout: choice, fields, tables, and what goes to review."""

import pytest

from factloom.operators import layouts
from factloom.operators.layouts import Layout, Rows

BILL = Layout("bill", ("BILL", "Due:"), {"no": r"No\. *(\S+)", "due": r"Due: *(\S*)"},
              Rows(r"(\w+) x (\d+)", ("what", "n"), after="ITEMS:?", before="END"), required=("no", "due"), least=1)
SLIP = Layout("slip", ("SLIP", "No\\."), {"no": r"No\. *(\S+)"}, least=1)
ALL = [BILL, SLIP]
DOCS = [
    (1, "BILL No. 7 Due: 3.50\nskip x 9 ITEMS: nut x 2, bolt x 10 END washer x 4"),
    (2, "SLIP No. 8"),
    (3, "BILL SLIP"),
    (4, None),
    (5, "  "),
    (6, "hello"),
    (7, "BILL Due: \nITEMS nothing"),
    (8, "BILL No. 7 Due: 3.50\nskip x 9 ITEMS: nut x 2, bolt x 10 END washer x 4"),
]


@pytest.fixture(scope="module")
def read(spark):
    return layouts.read(spark.createDataFrame(DOCS, "id long, text string"), "text", ALL)


def test_layout_by_most_anchors_first_of_equals(read):
    got = {r.id: (r.layout, r.score, r.tied) for r in read.collect()}
    assert got == {1: ("bill", 2, False), 2: ("slip", 2, False), 3: ("bill", 1, True), 4: (None, 0, False), 5: (None, 0, False), 6: (None, 0, False),
                   7: ("bill", 2, False), 8: ("bill", 2, False)}


def test_fields_and_rows_between_marks(read):
    assert sorted(map(tuple, layouts.fields(read, "id").collect())) == [
        (1, "bill", "due", "3.50"), (1, "bill", "no", "7"), (2, "slip", "no", "8"), (8, "bill", "due", "3.50"), (8, "bill", "no", "7")]
    assert sorted(map(tuple, layouts.table_rows(read, "id", ("what", "n")).collect())) == [
        (k, "bill", i, w, n) for k in (1, 8) for i, w, n in ((1, "nut", "2"), (2, "bolt", "10"))]


def test_review_names_every_reason(read):
    got = sorted(map(tuple, layouts.review(read, "id", "text", ALL).collect()), key=repr)
    assert got == sorted([(3, "bill", "several layouts", None), (3, "bill", "missing", "no"), (3, "bill", "missing", "due"), (3, "bill", "no rows", None),
                          (4, None, "no text", None), (5, None, "no text", None), (6, None, "no layout", None),
                          (7, "bill", "missing", "no"), (7, "bill", "missing", "due"), (7, "bill", "no rows", None)], key=repr)


def test_long_text_and_no_documents(spark):
    text = "BILL Due: 1 No. 2 " + "filler " * 300_000 + "ITEMS " + " ".join(f"a{i} x {i}" for i in range(20_000)) + " END b x 1"
    read = layouts.read(spark.createDataFrame([(1, text)], "id long, text string"), "text", ALL)
    assert layouts.table_rows(read, "id", ("what", "n")).count() == 20_000
    none = layouts.read(spark.createDataFrame([], "id long, text string"), "text", ALL)
    assert none.count() == 0 and layouts.review(none, "id", "text", ALL).count() == 0


def test_rules_that_cannot_be_read(spark):
    docs = spark.createDataFrame([(1, "x", 2)], "id long, text string, score int")
    for given, rules in ((docs, ALL), (docs.drop("score"), []), (docs.drop("score"), [SLIP, SLIP]), (docs.drop("score"), [Layout("x", ("a",), required=("f",))])):
        with pytest.raises(ValueError):
            layouts.read(given, "text", rules)
