"""Pattern queries as DataFrames whose columns are the variables.

A pattern is one triple over the current state or the log; a conjunction is a natural join of
patterns. Catalyst picks the join order and strategy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.model import SPARK_TYPE


@dataclass(frozen=True)
class Var:
    """A variable of a pattern: a column of its result."""

    name: str


Test = Callable[[Column], Column]


def pattern(store, e=None, a=None, v=None, tx=None, op=None, *, source: str = "state", as_of=None) -> DataFrame:
    """Bindings of `[e a v tx op]`; each place is a Var, a constant, a test on the column, or None.

    A constant attribute reads that relation only, with a typed value; a variable one reads every
    fact, with values as text. `source` "log" ranges over all facts and gives op as text.
    """
    if isinstance(a, str):
        rows = store.history(a, as_of) if source == "log" else store.attr(a, as_of)
        literal = SPARK_TYPE[store.attribute(a).type]
    else:
        at = store.resolve(as_of)
        if source == "log":
            log = store.log()
            log = log if at is None else log.where(F.col("tx") <= at)
            named = log.join(store.attrs.select(F.col("id").alias("a"), "ident"), "a")
            from factloom.functions.values import any_text
            rows = named.select("e", F.col("ident").alias("a"), any_text().alias("v"), "tx",
                                F.when(F.col("op"), "assert").otherwise("retract").alias("op"))
        else:
            rows = store.facts(at)
        literal = SPARK_TYPE["string"]
    places = {"e": e, "v": v, "tx": tx}
    if not isinstance(a, str):
        places["a"] = a
    if source == "log":
        places["op"] = op
    out: dict[str, Column] = {}
    for column, want in places.items():
        cell = F.col(column)
        if isinstance(want, Var):
            if want.name in out:
                rows = rows.where(cell == out[want.name])
            else:
                out[want.name] = cell
        elif callable(want):
            rows = rows.where(want(cell))
        elif want is not None:
            # the literal takes the attribute's type, so the comparison stays on the stored column
            rows = rows.where(cell == (F.lit(want).cast(literal) if column == "v" else F.lit(want)))
    found = rows.select(*[c.alias(n) for n, c in out.items()])
    # what holds is one row for each e, a and v, and a log one for each tx and op of these
    identity = [w for c, w in places.items() if source == "log" or c != "tx"]
    fixed = all(isinstance(w, Var) or (w is not None and not callable(w)) for w in identity)
    return found if fixed else found.distinct()


def conjunction(*parts: DataFrame) -> DataFrame:
    """Natural join of patterns on shared variables; parts that share none are refused."""
    waiting = list(parts[1:])
    out = parts[0]
    while waiting:
        for i, p in enumerate(waiting):
            shared = [c for c in p.columns if c in out.columns]
            if shared:
                out = out.join(p, shared)
                waiting.pop(i)
                break
        else:
            raise ValueError("patterns share no variable: " + ", ".join(str(p.columns) for p in waiting))
    return out


def exclude(rows: DataFrame, part: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Bindings with no match in `part` on the named (or all shared) variables."""
    on = on or [c for c in part.columns if c in rows.columns]
    return rows.join(part.select(*on).distinct(), on, "left_anti")


def either(*branches: DataFrame, variables: list[str]) -> DataFrame:
    """Union of branches on the join variables, as a set."""
    out = branches[0].select(*variables)
    for b in branches[1:]:
        out = out.unionByName(b.select(*variables))
    return out.distinct()


def missing(rows: DataFrame, store, e: str, a: str, as_of=None) -> DataFrame:
    """Bindings whose entity variable has no value of an attribute."""
    return rows.join(store.attr(a, as_of).select(F.col("e").alias(e)), e, "left_anti")


def get_else(rows: DataFrame, store, e: str, a: str, name: str, default, as_of=None) -> DataFrame:
    """Bind an attribute's value, or a default where the entity lacks it."""
    side = store.attr(a, as_of).select(F.col("e").alias(e), F.col("v").alias(name))
    fallback = F.lit(default).cast(SPARK_TYPE[store.attribute(a).type])
    return rows.join(side, e, "left").withColumn(name, F.coalesce(F.col(name), fallback))


def bind(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Bind a computed value; where the variable is bound already, keep the rows that agree."""
    return rows.where(F.col(name) == value) if name in rows.columns else rows.withColumn(name, value)


def find(rows: DataFrame, by: list[str], aggregates: dict[str, Column], *, basis: list[str] | None = None) -> DataFrame:
    """Project bindings: distinct rows, or aggregates per group.

    With `basis`, aggregates range over the distinct groups and basis variables; without, over
    every match.
    """
    if not aggregates:
        return rows.select(*by).distinct()
    if basis is not None:
        rows = rows.select(*by, *[b for b in basis if b not in by]).distinct()
    columns = [c.alias(n) for n, c in aggregates.items()]
    return rows.groupBy(*by).agg(*columns) if by else rows.agg(*columns)


def match(store, shape: dict, entity: str = "e", as_of=None) -> DataFrame:
    """Bindings of a nested record pattern.

    Keys are attributes; `^attr` reads a reference backwards. A value is a Var to bind, a constant,
    a test, None (must be missing), or a nested dict over the entity the reference points at, whose
    own variable is its "as" key. All forward attributes of an entity are read in one fold.
    """
    forward = {k: s for k, s in shape.items() if k != "as" and not k.startswith("^")}
    wanted = [k for k, s in forward.items() if s is not None and store.attribute(k).cardinality == "one"]
    rows = None
    nested: list[tuple[str, dict, str]] = []
    if wanted:
        rows = store.wide(wanted, as_of)
        out = [F.col("e").alias(entity)]
        for k in wanted:
            s, cell = forward[k], F.col(f"`{k}`")
            rows = rows.where(cell.isNotNull())
            if isinstance(s, Var):
                out.append(cell.alias(s.name))
            elif isinstance(s, dict):
                name = s.get("as", f"_{len(nested)}_{entity}")
                nested.append((k, s, name))
                out.append(cell.alias(name))
            elif callable(s):
                rows = rows.where(s(cell))
            else:
                rows = rows.where(cell == F.lit(s).cast(SPARK_TYPE[store.attribute(k).type]))
        rows = rows.select(*out)
    for k, s in forward.items():
        if s is None or k in wanted:
            continue
        name = s.get("as", f"_many_{k.replace('/', '_')}") if isinstance(s, dict) else None
        part = pattern(store, Var(entity), k, Var(name) if name else s, as_of=as_of)
        rows = part if rows is None else conjunction(rows, part)
        if isinstance(s, dict):
            nested.append((k, s, name))
    for k, s in shape.items():
        if k.startswith("^"):
            if s is None:
                continue
            name = s.get("as", f"_back_{k[1:].replace('/', '_')}") if isinstance(s, dict) else None
            # a constant or a test is about the entity that refers here
            part = pattern(store, Var(name) if name else s, k[1:], Var(entity), as_of=as_of)
            rows = part if rows is None else conjunction(rows, part)
            if isinstance(s, dict):
                nested.append((k, s, name))
    if rows is None:
        raise ValueError("a pattern needs an attribute that is present")
    for _, s, name in nested:
        if set(s) - {"as"}:
            rows = conjunction(rows, match(store, s, name, as_of))
    for k, s in forward.items():
        if s is None:
            rows = missing(rows, store, entity, k, as_of)
    for k, s in shape.items():
        if k.startswith("^") and s is None:
            named = store.attr(k[1:], as_of).select(F.col("v").alias(entity))
            rows = rows.join(named, entity, "left_anti")
    return rows.drop(*[n for _, s, n in nested if n.startswith("_")])
