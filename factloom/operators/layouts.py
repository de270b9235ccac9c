"""Fields and table rows of documents by layout, with what could not be read told apart.

Rules are data: a layout is known by its anchors, names the patterns of its fields, and says how a
row of its table looks. They compile to one expression, so a document is read where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rows:
    """Rows of a table: what `row` matches, with a group for each of `columns`, between the first
    match of `after` and the next of `before`, where these are given."""

    row: str
    columns: tuple[str, ...]
    after: str | None = None
    before: str | None = None


@dataclass(frozen=True)
class Layout:
    """`anchors` are patterns; at least `least` of them must be found. `fields` are patterns with one group."""

    name: str
    anchors: tuple[str, ...]
    fields: dict[str, str] = field(default_factory=dict)
    rows: Rows | None = None
    required: tuple[str, ...] = ()
    least: int = 1


def read(docs: DataFrame, text: str, layouts: list[Layout]) -> DataFrame:
    """`docs` with (layout, score, tied, fields, rows).

    The layout whose anchors are found most often wins, counting each anchor once; of equals the one
    named first, and `tied` says so. A null text, or one with fewer than `least` anchors of every
    layout, has a null layout, no fields and no rows. `fields` maps each field that was found to its
    first match, trimmed; an empty match is no match. `rows` is the table in order of the text, each
    row a map of the columns. One pass over whole texts without a shuffle; columns of `docs` are kept.
    """
    if not layouts or len({x.name for x in layouts}) < len(layouts):
        raise ValueError("layouts need names of their own")
    for x in layouts:
        if set(x.required) - set(x.fields):
            raise ValueError(f"{x.name} requires a field it does not read")
    taken = {"layout", "score", "tied", "fields", "rows", "_scores", "_best"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns the reading adds are there: {sorted(taken)}")
    body = F.col(f"`{text}`")
    scored = docs.withColumn("_scores", F.array(*[_score(body, x) for x in layouts]))
    best = scored.withColumn("_best", F.array_max("_scores"))
    at = F.array_position("_scores", F.col("_best"))
    known = best.withColumn("layout", F.when(F.col("_best") > 0, F.element_at(F.array(*[F.lit(x.name) for x in layouts]), at.cast("int"))))
    return known.withColumns({
        "score": F.col("_best"), "tied": (F.col("_best") > 0) & (F.size(F.filter("_scores", lambda s: s == F.col("_best"))) > 1),
        "fields": _by_layout(layouts, lambda x: _fields(body, x), "map<string,string>"),
        "rows": _by_layout(layouts, lambda x: _rows(body, x.rows), "array<map<string,string>>")}).drop("_scores", "_best")


def _score(body: Column, layout: Layout) -> Column:
    found = reduce(lambda a, b: a + b, [F.coalesce(body.rlike(a), F.lit(False)).cast("int") for a in layout.anchors])
    return F.when(found >= layout.least, found).otherwise(0)


def _by_layout(layouts: list[Layout], of, type_: str) -> Column:
    empty = F.create_map() if type_.startswith("map") else F.array()
    out = empty.cast(type_)
    for x in layouts:
        out = F.when(F.col("layout") == x.name, of(x).cast(type_)).otherwise(out)
    return out


def _fields(body: Column, layout: Layout) -> Column:
    if not layout.fields:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.trim(F.regexp_extract(body, p, 1)).alias("v")) for n, p in layout.fields.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"] != ""))


def _rows(body: Column, rows: Rows | None) -> Column:
    if rows is None:
        return F.array().cast("array<map<string,string>>")
    if rows.after is not None:
        # what follows the first match: all of the text but the shortest beginning that ends in one
        body = F.when(body.rlike(rows.after), F.regexp_replace(body, rf"\A(?s:.*?)(?:{rows.after})", "")).otherwise("")
    if rows.before is not None:
        body = F.element_at(F.split(body, rows.before, 2), 1)
    found = F.regexp_extract_all(body, F.lit(rows.row), F.lit(0))
    return F.transform(found, lambda r: F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]),
                                                          F.array(*[F.trim(F.regexp_extract(r, rows.row, i + 1)) for i in range(len(rows.columns))])))


def fields(read_: DataFrame, key: str) -> DataFrame:
    """(key, layout, field, value) of what `read` found."""
    return read_.select(key, "layout", F.explode("fields").alias("field", "value"))


def table_rows(read_: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, layout, row, columns…) of the tables, numbered from 1 in the order of the text."""
    rows = read_.select(key, "layout", F.posexplode("rows").alias("_at", "_row"))
    return rows.select(key, "layout", (F.col("_at") + 1).alias("row"), *[F.col("_row")[c].alias(c) for c in columns])


def review(read_: DataFrame, key: str, text: str, layouts: list[Layout]) -> DataFrame:
    """(key, layout, reason, field): what a person has to look at, a row a reason.

    no text; no layout; several layouts (of equal score); missing (a required field); no rows (in a
    layout that has a table).
    """
    def reason(when: Column, told: str, name: str | None = None) -> Column:
        return F.when(when, F.struct(F.lit(told).alias("reason"), F.lit(name).cast("string").alias("field")))
    blank = F.coalesce(F.trim(F.col(f"`{text}`")) == "", F.lit(True))
    tests = [reason(blank, "no text"), reason(~blank & F.col("layout").isNull(), "no layout"), reason(F.col("tied"), "several layouts")]
    for x in layouts:
        mine = F.coalesce(F.col("layout") == x.name, F.lit(False))
        tests += [reason(mine & ~F.map_contains_key("fields", F.lit(f)), "missing", f) for f in x.required]
        if x.rows is not None:
            tests.append(reason(mine & (F.size("rows") == 0), "no rows"))
    told = read_.select(key, "layout", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("_x"))
    return told.select(key, "layout", "_x.reason", "_x.field")
