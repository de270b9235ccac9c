"""A fold of the log a reader can check by eye; the tests' yardstick."""

from decimal import Decimal

from factloom.model import FACT_SCHEMA, VALUE_COLUMN


def fold(log, as_of=None):
    """{(e, a, v): tx} of values whose last word up to `as_of` is an assert."""
    held = {}
    for e, a, v, tx, op in sorted(log, key=lambda f: (f[3], f[4])):
        if as_of is not None and tx > as_of:
            continue
        held[(e, a, v)] = tx if op else None
    return {k: t for k, t in held.items() if t is not None}


def canonical_one(feed):
    """Effective facts of a raw feed, one fact at a time."""
    now, out = {}, []
    for e, a, v, tx, op in sorted(feed, key=lambda f: (f[3], f[4])):
        was = now.get((e, a))
        if op and was != v:
            if was is not None:
                out.append((e, a, was, tx, False))
            out.append((e, a, v, tx, True))
            now[(e, a)] = v
        elif not op and was == v:
            out.append((e, a, v, tx, False))
            now[(e, a)] = None
    return out


def canonical_many(feed):
    now, out = set(), []
    for e, a, v, tx, op in sorted(feed, key=lambda f: (f[3], f[4])):
        if op != ((e, a, v) in now):
            out.append((e, a, v, tx, op))
            (now.add if op else now.discard)((e, a, v))
    return out


def facts(spark, rows, kind="string"):
    """A log DataFrame of (e, a, v, tx, op) rows with values of one type."""
    names = FACT_SCHEMA.fieldNames()
    column = VALUE_COLUMN[kind]
    out = []
    for e, a, v, tx, op in rows:
        row = dict.fromkeys(names)
        row.update(e=e, a=a, tx=tx, op=op)
        row[column] = Decimal(v) if kind == "decimal" else v
        out.append(tuple(row[n] for n in names))
    return spark.createDataFrame(out, FACT_SCHEMA)


def rows(df, kind="string", with_op=True):
    column = VALUE_COLUMN[kind]
    columns = ["e", "a", column, "tx"] + (["op"] if with_op else [])
    return sorted(tuple(r) for r in df.select(*columns).collect())
