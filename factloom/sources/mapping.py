"""Rows of any table as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.model import SPARK_TYPE, VALUE_COLUMN, Attribute


def typed_values(attribute: Attribute, value: Column) -> list[Column]:
    """The six value columns with `value` in the attribute's own."""
    return [(value.cast(SPARK_TYPE[t]) if t == attribute.type else F.lit(None).cast(SPARK_TYPE[t])).alias(c)
            for t, c in VALUE_COLUMN.items()]


def _typed(attribute: Attribute, name: str) -> list[str]:
    """`typed_values` as SQL text: one expression to parse instead of many to build."""
    return [f"CAST({name if t == attribute.type else 'NULL'} AS {SPARK_TYPE[t].simpleString()}) AS {c}" for t, c in VALUE_COLUMN.items()]


def as_facts(df: DataFrame, e: Column, tx: Column, values: dict[Attribute, Column],
             op: Column | None = None) -> DataFrame:
    """One fact per row and non-null mapped column, in a single pass over the table.

    One attribute is a plain projection; several are inlined from an array of facts, so the table
    is scanned once whatever the number of attributes.
    """
    op = F.lit(True) if op is None else op
    names = list(values)
    rows = df.select(e.alias("_e"), tx.alias("_tx"), op.alias("_op"), *[values[a].alias(f"_v{i}") for i, a in enumerate(names)])
    if len(names) == 1:
        return rows.where("_v0 IS NOT NULL").selectExpr("CAST(_e AS BIGINT) AS e", f"{names[0].id}L AS a", *_typed(names[0], "_v0"),
                                                        "CAST(_tx AS BIGINT) AS tx", "_op AS op")
    # the null test follows the generator, so the whole mapping stays in one generated stage
    structs = ", ".join(f"struct(CAST(_e AS BIGINT) AS e, IF(_v{i} IS NULL, NULL, {a.id}L) AS a, {', '.join(_typed(a, f'_v{i}'))}, "
                        f"CAST(_tx AS BIGINT) AS tx, _op AS op)" for i, a in enumerate(names))
    return rows.selectExpr(f"inline(array({structs}))").where("a IS NOT NULL")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
