"""Column helpers: safe names, missing values, physical kinds, report kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
STRINGS = (T.StringType, T.CharType, T.VarcharType)
INSTANTS = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
TIME = getattr(T, "TimeType", type(None))


def quoted(name: str) -> str:
    """A column's exact name as SQL, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS)


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, FLOATS)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (*INTEGERS, *FLOATS, T.DecimalType))


def is_boolean(kind: T.DataType) -> bool:
    return isinstance(kind, T.BooleanType)


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, STRINGS)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (*INSTANTS, TIME))


def hashable(kind: T.DataType) -> bool:
    return not isinstance(kind, NESTED)


def safe(column: Column, kind: T.DataType) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(column), column) if is_floating(kind) else column


def number(column: Column, kind: T.DataType) -> Column:
    """The safe value as a double, for moments."""
    return safe(column, kind).cast("double")


def seconds(column: Column, kind: T.DataType) -> Column:
    """Whole seconds since the epoch (TIME: since midnight); UTC for dates and zoneless timestamps."""
    if isinstance(kind, TIME):
        return F.hour(column) * 3600 + F.minute(column) * 60 + F.floor(F.second(column)).cast("int")
    return F.unix_timestamp(column.cast("timestamp"))


def counted(condition: Column) -> Column:
    """How many rows meet a condition; null on an empty table."""
    return F.sum(condition.cast("long"))


def bytes_per_row(kind: T.DataType) -> int:
    if is_integer(kind) or is_floating(kind):
        return 8
    if is_boolean(kind):
        return 1
    return 20 if is_string(kind) else 16


def report_kind(kind: T.DataType, label: str | None) -> str:
    """Numeric, Boolean, DateTime, Categorical or Unsupported."""
    if is_numeric(kind) or label in ("Integer", "Decimal", "Count"):
        return "Numeric"
    if is_boolean(kind) or label == "Boolean":
        return "Boolean"
    if is_temporal(kind) or label == "DateTime":
        return "DateTime"
    return "Categorical" if is_string(kind) else "Unsupported"
