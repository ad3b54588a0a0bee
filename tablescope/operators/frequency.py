"""The frequency pass: distinct values, singletons and top values of all columns together.

Columns are unpivoted by type family (whole numbers, doubles, text), so no number is formatted as
text and each family is one shuffle of partial counts, whatever the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INSTANTS, TIME, hashable, is_boolean, is_floating, is_integer, is_string, named

TOP = 20


def family(kind: T.DataType) -> str:
    if is_integer(kind) or is_boolean(kind) or isinstance(kind, INSTANTS):
        return "whole"
    return "real" if is_floating(kind) else "text"


def comparable(column: Column, kind: T.DataType) -> Column:
    """The value in its family's type, one to one: equal values stay equal, others stay apart."""
    if is_integer(kind) or is_boolean(kind):
        return column.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):  # by its fields, as no time zone takes part
        fields = F.unix_date(column.cast("date")).cast("long") * 86_400 + F.hour(column) * 3600 + F.minute(column) * 60
        return fields * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")
    if is_floating(kind):
        return column.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are equal
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    return column if is_string(kind) else column.cast("string")


def restored(value, kind: T.DataType):
    """A value of the family's type on the driver as the column's own."""
    import datetime as dt

    if value is None:
        return None
    if is_boolean(kind):
        return bool(value)
    if isinstance(kind, T.DateType):
        return dt.date(1970, 1, 1) + dt.timedelta(days=value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=value)
    if isinstance(kind, TIME):
        return dt.time.fromisoformat(value)
    return value


def frequencies(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    """(k, v, n) of each family: k is the column's place in ``columns``; null and NaN are values."""
    kinds = {c: df.schema[c].dataType for c in columns}
    out = []
    for name, type_ in (("whole", "long"), ("real", "double"), ("text", "string")):
        own = [c for c in columns if family(kinds[c]) == name and hashable(kinds[c])]
        if own:
            # Unpivoted by an Expand, which code generation covers, not by arrays of structs.
            wide = df.select(*[comparable(named(c), kinds[c]).cast(type_).alias(str(columns.index(c))) for c in own])
            f = wide.unpivot([], [named(c) for c in wide.columns], "k", "v").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
            out.append(f.select(F.col("k").cast("int").alias("k"), "v", "n"))
    return out


def _present(f: DataFrame) -> Column:
    v = F.col("v")
    return v.isNotNull() & ~F.isnan(v) if isinstance(f.schema["v"].dataType, T.DoubleType) else v.isNotNull()


def distinct_and_unique(freq: DataFrame) -> DataFrame:
    """k, n_distinct (without null and NaN) and n_unique (values that occur once; NaN counts)."""
    return freq.groupBy("k").agg(F.sum(_present(freq).cast("long")).alias("n_distinct"), F.sum(((F.col("n") == 1) & F.col("v").isNotNull()).cast("long")).alias("n_unique"))


def top(freq: DataFrame, number: int = TOP) -> DataFrame:
    """k, v, n, place of the most frequent values; ties by value. Each task keeps only its own best before the shuffle."""
    w = W.partitionBy("k").orderBy(F.col("n").desc(), F.col("v").asc_nulls_last())
    return freq.withColumn("place", F.row_number().over(w)).where(F.col("place") <= number)


def quantiles(freq: DataFrame, wanted: list[int], shares: list[float]) -> dict[int, list[float]]:
    """Exact interpolated quantiles of numeric columns from their value counts."""
    own = freq.where(F.col("k").isin(wanted) & _present(freq))
    return {r["k"]: r["q"] for r in own.groupBy("k").agg(F.percentile(F.col("v").cast("double"), F.lit(shares), F.col("n")).alias("q")).collect()}


def long_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_distinct, n_unique for a query."""
    names = F.array(*[F.lit(c) for c in columns])
    parts = [distinct_and_unique(f) for f in frequencies(df, columns)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.element_at(names, F.col("k") + 1).alias("column_name"), "n_distinct", "n_unique")


def long_top(df: DataFrame, columns: list[str], number: int = TOP) -> DataFrame:
    """column_name, label, n, place; null is labelled "None" and the empty string "(Empty)"."""
    names = F.array(*[F.lit(c) for c in columns])
    out = None
    for f in frequencies(df, columns):
        v = F.col("v").cast("string")
        part = top(f, number).select(F.element_at(names, F.col("k") + 1).alias("column_name"), F.when(v.isNull(), "None").when(v == "", "(Empty)").otherwise(v).alias("label"), "n", "place")
        out = part if out is None else out.unionByName(part)
    return out
