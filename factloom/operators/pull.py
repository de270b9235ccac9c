"""Records of entities, nested along their references: as typed structs, or as one row a value.

A shape says what a record holds, as a list of

    "order/status"                             a value, or an array where the attribute has many
    "*"                                        a map of every attribute to its values as text
    {"order/customer": ["customer/name"]}      the record a reference points at, or an array of them
    {"~line/order": ["line/quantity"]}         the records whose reference points here, always an array
    {"order/replaces": 3}                      the same shape again along a reference of one value, 3 deep

Every record starts with its `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.session import is_empty, written
from factloom.store import FactLog

Shape = list
#: Values one array of a record may hold.
WIDEST = 100_000


class TooWide(ValueError):
    """A record would hold more values in one array than allowed."""


def nested(store: FactLog, shape: Shape, roots: DataFrame, as_of=None, widest: int = WIDEST) -> DataFrame:
    """(e, record): the record of each of `roots` (e) in the given shape.

    Child records are built once for each entity, from the leaves up, and joined to what refers to
    them, so a record that many share is assembled once. Values of one are read in one shuffle for
    each level, references among them included. A root without facts has a record of nulls; an
    entity that stands above itself in a repeated reference is given by its id and ends there.
    An array of over `widest` values raises `TooWide` with the attribute's name before anything
    is gathered; `rows` has no such bound. Arrays are in order of value or id.
    """
    fields, record = _record(store, shape, store.resolve(as_of), widest, roots.select("e").distinct())
    return record.select("e", F.struct(F.col("e").alias("id"), *fields).alias("record"))


def _spread(ref: Column, e: Column) -> Column:
    """A join key that is no entity for an entity without the reference, another for each, so that these don't meet in one task."""
    return F.coalesce(ref, -1 - e)


def _narrow(rows: DataFrame, by: list[str], what: str, widest: int) -> DataFrame:
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > widest)
    if not is_empty(most):
        raise TooWide(f"an entity has over {widest} values of {what}: read it by rows, or set a higher bound")
    return rows


def _ordered(records: str) -> Column:
    """Array of (id, …) structs by id, whether or not their fields can be compared."""
    return F.array_sort(F.collect_list(records), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))


def _split(shape: Shape) -> tuple[list[str], bool, dict[str, Shape], dict[str, int]]:
    plain = [i for i in shape if isinstance(i, str) and i != "*"]
    refs = {k: v for i in shape if isinstance(i, dict) for k, v in i.items()}
    bad = [i for i in shape if not isinstance(i, (str, dict))] + [k for k, v in refs.items() if not isinstance(v, (list, int))]
    if bad:
        raise ValueError(f"no part of a shape: {bad[0]!r}")
    again = {k: v for k, v in refs.items() if isinstance(v, int)}
    if len(again) > 1:
        raise ValueError("a shape repeats along one reference")
    return plain, "*" in shape, {k: v for k, v in refs.items() if k not in again}, again


def _reference(store: FactLog, ident: str):
    a = store.attribute(ident.removeprefix("~"))
    if a.type != "ref":
        raise ValueError(f"{a.ident} is no reference")
    return a


def _record(store: FactLog, shape: Shape, tx: int | None, widest: int, roots: DataFrame | None) -> tuple[list[Column], DataFrame]:
    """The shape's fields, and (e, fields) of the roots, or of every entity that has any of them."""
    plain, everything, refs, again = _split(shape)
    ones = [i for i in plain if store.attribute(i).cardinality == "one"]
    one_refs = [i for i in refs if not i.startswith("~") and _reference(store, i).cardinality == "one"]
    parts: list[DataFrame] = []
    if ones or one_refs:
        part = store.wide(list(dict.fromkeys([*ones, *one_refs])), tx)
        for i in one_refs:
            part = _beneath(store, part, i, refs[i], tx, widest)
        parts.append(part)
    for i in plain:
        if i not in ones:
            rel = _narrow(store.attr(i, tx), ["e"], i, widest)
            parts.append(rel.groupBy("e").agg(F.sort_array(F.collect_list("v")).alias(i)))
    for i, below in refs.items():
        if i not in one_refs:
            parts.append(_gathered(store, i, below, tx, widest))
    if everything:
        parts.append(_everything(store, tx, widest))
    if not parts:
        raise ValueError("a shape names at least one attribute")
    out = roots
    for part in parts:
        out = part if out is None else out.join(part, "e", "full" if roots is None else "left")
    names = [*plain, *refs, *(["*"] if everything else [])]
    if again:
        (ident, depth), = again.items()
        return _repeated(store, ident, depth, [i for i in shape if not (isinstance(i, dict) and ident in i)], names, out, tx, widest)
    return [F.col(f"`{n}`") for n in names], out.select("e", *[F.col(f"`{n}`") for n in names])


def _beneath(store: FactLog, rows: DataFrame, ident: str, shape: Shape, tx: int | None, widest: int) -> DataFrame:
    """`rows` with the reference in column `ident` replaced by the record it points at."""
    fields, child = _record(store, shape, tx, widest, None)
    child = child.select(F.col("e").alias("_at"), F.struct(*fields).alias("_below"))
    met = rows.join(child, _spread(F.col(f"`{ident}`"), F.col("e")) == F.col("_at"), "left")
    names = child.schema["_below"].dataType.names
    nest = F.struct(F.col(f"`{ident}`").alias("id"), *[F.col("_below")[n].alias(n) for n in names])
    return met.withColumn(ident, F.when(F.col(f"`{ident}`").isNotNull(), nest)).drop("_at", "_below")


def _gathered(store: FactLog, ident: str, shape: Shape, tx: int | None, widest: int) -> DataFrame:
    """(e, array of records): those that references of many values point at, or that point here."""
    rel = store.attr(_reference(store, ident).ident, tx)
    here, there = ("v", "e") if ident.startswith("~") else ("e", "v")
    pairs = _narrow(rel.select(F.col(here).alias("e"), F.col(there).alias("_to")), ["e"], ident, widest)
    fields, child = _record(store, shape, tx, widest, None)
    child = child.select(F.col("e").alias("_at"), F.struct(*fields).alias("_below"))
    met = pairs.join(child, F.col("_to") == F.col("_at"), "left")
    names = child.schema["_below"].dataType.names
    nest = F.struct(F.col("_to").alias("id"), *[F.col("_below")[n].alias(n) for n in names])
    return met.select("e", nest.alias("_record")).groupBy("e").agg(_ordered("_record").alias(ident))


def _everything(store: FactLog, tx: int | None, widest: int) -> DataFrame:
    named = store.state(tx).join(store.attrs.select(F.col("id").alias("a"), "ident"), "a").select("e", "ident", V.any_text().alias("v"))
    values = _narrow(named, ["e", "ident"], "one attribute", widest).groupBy("e", "ident").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return values.groupBy("e").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ident", "v")))).alias("*"))


def _repeated(store: FactLog, ident: str, depth: int, shape: Shape, names: list[str], out: DataFrame, tx: int | None, widest: int) -> tuple[list[Column], DataFrame]:
    """`out` with the records met along a reference, each in the next, as column `ident`."""
    if _reference(store, ident).cardinality != "one":
        raise ValueError(f"{ident} has many values, so a shape cannot repeat along it; rows can")
    if depth < 1:
        raise ValueError("a shape repeats at least once")
    hops = store.attr(ident, tx).select(F.col("e").alias("_from"), F.col("v").alias("_to"))
    fields, child = _record(store, shape, tx, widest, None)
    child = child.select(F.col("e").alias("_at"), F.struct(*fields).alias("_below"))
    below = child.schema["_below"].dataType.names
    walk = [F.col("e")]
    for k in range(1, depth + 1):
        # past an entity that stands above itself nothing is followed
        from_ = F.col("e") if k == 1 else F.when(~F.col(f"_seen{k - 1}"), F.col(f"_hop{k - 1}"))
        out = out.join(hops.withColumnRenamed("_to", f"_hop{k}"), _spread(from_, F.col("e")) == F.col("_from"), "left").drop("_from")
        out = out.withColumn(f"_seen{k}", F.coalesce(F.array_contains(F.array(*walk), F.col(f"_hop{k}")), F.lit(False)))
        walk.append(F.coalesce(F.col(f"_hop{k}"), F.col("e")))
        open_ = F.when(~F.col(f"_seen{k}"), F.col(f"_hop{k}"))
        out = out.join(child.withColumnRenamed("_below", f"_rec{k}"), _spread(open_, F.col("e")) == F.col("_at"), "left").drop("_at")
    inner = None
    for k in range(depth, 0, -1):
        rest = [] if inner is None else [inner.alias(ident)]
        inner = F.when(F.col(f"_hop{k}").isNotNull(), F.struct(F.col(f"_hop{k}").alias("id"), *[F.col(f"_rec{k}")[n].alias(n) for n in below], *rest))
    kept = [F.col(f"`{n}`") for n in names]
    return [*kept, F.col(f"`{ident}`")], out.select("e", *kept, inner.alias(ident))


def rows(store: FactLog, roots: DataFrame, depth: int, as_of=None) -> DataFrame:
    """(root, path, e, attribute, value, cut): every value of each root (e), and of what it refers to up to `depth` references on.

    A row a value, so neither a hot entity nor a hot reference is gathered anywhere. `path` is the
    ids from the root down to `e`. A reference to an entity that is on its own path is `cut`: its row
    is there, and what lies beneath is not told again. Each level is one join of the current values,
    written before the next is read. A root without facts has no row; no roots give no rows.
    """
    state = store.state(as_of)
    if depth > 0 and not (as_of is None and store.has_snapshot()):
        state = written(state)
    facts = state.join(store.attrs.select(F.col("id").alias("a"), F.col("ident").alias("attribute")), "a").select(
        "e", "attribute", V.any_text().alias("value"), "v_ref")
    frontier = roots.select(F.col("e").alias("root"), F.array("e").alias("path"), "e").distinct()
    levels = []
    for k in range(depth + 1):
        level = frontier.join(facts, "e").withColumn("cut", F.coalesce(F.array_contains("path", F.col("v_ref")), F.lit(False)))
        level = written(level) if k < depth else level
        levels.append(level.select("root", "path", "e", "attribute", "value", "cut"))
        if k < depth:
            frontier = level.where(F.col("v_ref").isNotNull() & ~F.col("cut")).select(
                "root", F.concat("path", F.array("v_ref")).alias("path"), F.col("v_ref").alias("e")).distinct()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
