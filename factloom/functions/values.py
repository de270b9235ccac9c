"""Reading typed values from text, and canonical text for equal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.model import DECIMAL, VALUES

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
#: Numbers without an exponent and with no more significant fraction digits than the type keeps.
_SHORT = rf"^\s*[+-]?\d*(\.\d{{0,{DECIMAL.scale}}}0*)?\s*$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def coerce(type_: str, raw: Column) -> Column:
    """`raw` text as the value type, NULL where it does not fit.

    An instant must name its offset: without one the session's zone would be assumed.
    """
    if type_ == "string":
        return raw
    if type_ == "decimal":
        return F.when(raw.rlike(_NUMBER) & (raw.rlike(_SHORT) | _exact(raw)), F.trim(raw).try_cast(DECIMAL))
    if type_ == "boolean":
        return F.when(raw.isin("true", "false"), raw == "true")
    if type_ == "date":
        return F.when(raw.rlike(_DAY), raw.try_cast("date"))
    if type_ == "instant":
        return F.when(raw.rlike(_INSTANT), raw.try_cast("timestamp"))
    if type_ == "ref":
        return F.when(raw.rlike(r"^\d{1,18}$"), raw.try_cast("bigint"))
    raise ValueError(f"no value type {type_}")


def _exact(raw: Column) -> Column:
    """Whether number text needs no more fraction digits than the type keeps: a value is refused, never rounded."""
    mantissa = F.regexp_extract(raw, r"([\d.]+)", 1)
    digits = F.regexp_replace(mantissa, r"\.", "")
    significant = F.length(F.regexp_replace(digits, "0+$", ""))
    exponent = F.coalesce(F.regexp_extract(raw, r"[eE]([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    scale = F.length(F.regexp_extract(mantissa, r"\.(\d*)", 1)) - exponent - (F.length(digits) - significant)
    return (significant == 0) | (scale <= DECIMAL.scale)


def decimal_text(value: Column) -> Column:
    """Plain decimal text without trailing zeros; zero is "0".

    A number format has no exponent, whatever the session's settings are.
    """
    return F.call_function("format_number", value.cast(DECIMAL), F.lit("0." + "#" * DECIMAL.scale))


def instant_text(value: Column) -> Column:
    """UTC ISO 8601 text, with microseconds only where there are any."""
    utc = F.to_utc_timestamp(value, F.current_timezone())
    micros = F.date_format(utc, "SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def canonical_key(type_: str, value: Column) -> Column:
    """Text equal for equal values: the key of an identity value."""
    if type_ == "decimal":
        return decimal_text(value)
    if type_ == "instant":
        return instant_text(value)
    if type_ == "boolean":
        raise ValueError("a boolean cannot identify an entity")
    return value.cast("string")


def one_value() -> Column:
    """Whether exactly one typed column of a fact is set, as every fact must have it."""
    return sum((F.col(c).isNotNull().cast("int") for c in VALUES), F.lit(0)) == 1


def any_text() -> Column:
    """Canonical text of whichever typed column of a fact is set."""
    return F.coalesce(F.col("v_string"), decimal_text(F.col("v_decimal")), F.col("v_boolean").cast("string"),
                      F.col("v_date").cast("string"), instant_text(F.col("v_instant")), F.col("v_ref").cast("string"))


def comparable(value: Column, type_: str, zone: str = "UTC") -> Column:
    """A result value normalised for comparison: numbers as canonical text, instants as the local date."""
    if type_ == "decimal":
        return decimal_text(value)
    if type_ == "instant":
        return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(value, F.current_timezone()), zone), "yyyy-MM-dd")
    return F.trim(value.cast("string"))
