"""Schemas of the fact log and its registry, and the fixed kernel vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DECIMAL = T.DecimalType(38, 18)

#: Spark type of each value type.
SPARK_TYPE: dict[str, T.DataType] = {
    "string": T.StringType(),
    "decimal": DECIMAL,
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "instant": T.TimestampType(),
    "ref": T.LongType(),
}
#: Column of the log that carries each value type.
VALUE_COLUMN: dict[str, str] = {t: f"v_{t}" for t in SPARK_TYPE}
VALUES: list[str] = list(VALUE_COLUMN.values())

FACT_SCHEMA = T.StructType(
    [T.StructField("e", T.LongType()), T.StructField("a", T.LongType())]
    + [T.StructField(VALUE_COLUMN[t], s) for t, s in SPARK_TYPE.items()]
    + [T.StructField("tx", T.LongType()), T.StructField("op", T.BooleanType())]
)
ATTR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ident", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("cardinality", T.StringType()),
    T.StructField("uniq", T.StringType()),
    T.StructField("doc", T.StringType()),
    T.StructField("replaced_by", T.LongType()),
])
TX_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("actor", T.LongType()),
    T.StructField("at", T.TimestampType()),
])

#: Longest text an identity key may have.
MAX_KEY_LENGTH = 512
#: Shape of an attribute name: namespace/name.
IDENT_PATTERN = "^[a-z][a-z0-9_]*/[a-z][a-z0-9_]*$"


@dataclass(frozen=True)
class Attribute:
    """One registered attribute."""

    id: int
    ident: str
    type: str
    cardinality: str = "one"
    uniq: str = "none"
    doc: str = ""
    replaced_by: int | None = None

    @property
    def column(self) -> str:
        return VALUE_COLUMN[self.type]


# Ids and names of the kernel attributes.
KERNEL: dict[str, int] = {
    "fs/ident": 1,
    "fs/type": 2,
    "fs/cardinality": 3,
    "fs/unique": 4,
    "fs/doc": 5,
    "fs/distinct_from": 6,
    "fs/replaced_by": 7,
    "fs/actor": 8,
    "fs/at": 9,
    "fs/name": 10,
    "fs/excised_entity": 11,
    "fs/excised_attribute": 12,
}
KERNEL_TYPES = {"fs/distinct_from": "ref", "fs/replaced_by": "ref", "fs/actor": "ref", "fs/at": "instant",
                "fs/excised_entity": "ref", "fs/excised_attribute": "ref"}
KERNEL_MANY = ("fs/distinct_from", "fs/excised_attribute")
#: Written only when a transaction is committed or facts are excised.
COMMIT_ONLY = ("fs/actor", "fs/at", "fs/excised_entity", "fs/excised_attribute")
#: Written only when an attribute is registered.
REGISTRATION_ONLY = ("fs/ident", "fs/type", "fs/distinct_from")
#: Describe an attribute; change under the evolution rules.
SCHEMA_FACTS = ("fs/cardinality", "fs/unique", "fs/doc", "fs/replaced_by")
ADMIN_ACTOR = 100
FIRST_ENTITY = 1000


def kernel_attributes() -> list[Attribute]:
    """The kernel vocabulary as registry entries."""
    return [
        Attribute(i, name, KERNEL_TYPES.get(name, "string"), "many" if name in KERNEL_MANY else "one",
                  "identity" if name == "fs/ident" else "none", name)
        for name, i in KERNEL.items()
    ]


def _literal(value: str | int | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return f"{value}L"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def registry(spark: SparkSession, attributes: list[Attribute]) -> DataFrame:
    """Registry of the given attributes as a local relation: its size is known, so joins with it broadcast."""
    rows = ", ".join("(" + ", ".join(_literal(v) for v in (a.id, a.ident, a.type, a.cardinality, a.uniq, a.doc, a.replaced_by)) + ")"
                     for a in attributes)
    return spark.sql(f"SELECT id, ident, type, cardinality, uniq, doc, CAST(replaced_by AS BIGINT) AS replaced_by FROM VALUES {rows} "
                     "AS t(id, ident, type, cardinality, uniq, doc, replaced_by)")
