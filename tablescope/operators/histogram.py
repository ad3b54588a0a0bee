"""Equal-width histograms of all columns in one shuffle of partial counts, and lengths of texts."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import is_temporal, named, number, seconds

BINS, LENGTHS = 20, 10


def measured(df: DataFrame, column: str) -> Column:
    """What is binned: the number itself, or seconds of a point in time."""
    kind = df.schema[column].dataType
    return seconds(named(column), kind).cast("double") if is_temporal(kind) else number(named(column), kind)


def bin_of(x: Column, low: float, high: float, bins: int = BINS) -> Column:
    """0 .. bins - 1, the maximum in the last bin; null for null."""
    return F.when(x.isNotNull(), F.least(F.greatest(F.floor((x - F.lit(low)) / F.lit(high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int"))


def counts(df: DataFrame, bounds: dict[str, tuple[float, float]], bins: int = BINS) -> DataFrame:
    """(k, bin, n) for the columns of ``bounds``, in their order; empty bins are left out."""
    spread = [F.struct(F.lit(k).alias("k"), bin_of(measured(df, c), *b, bins).alias("bin")) for k, (c, b) in enumerate(bounds.items())]
    return df.select(F.explode(F.array(*spread)).alias("s")).select("s.k", "s.bin").where("bin is not null").groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n"))


def long_histogram(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """column_name, bin, n with every bin, the bounds found first in one aggregation."""
    row = df.agg(*[e for c in columns for e in (F.min(measured(df, c)), F.max(measured(df, c)))]).first()
    bounds = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns) if row[2 * i] is not None and row[2 * i] < row[2 * i + 1]}
    names = F.array(*[F.lit(c) for c in bounds])
    every = df.sparkSession.range(len(bounds) * bins).select((F.col("id") / bins).cast("int").alias("k"), (F.col("id") % bins).cast("int").alias("bin"))
    found = every.join(counts(df, bounds, bins), ["k", "bin"], "left")
    return found.select(F.element_at(names, F.col("k") + 1).alias("column_name"), "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shaped(found: dict[int, int], low: Any, high: Any, present: int, bins: int = BINS) -> dict[str, list]:
    """A report's histogram: labels of two decimals, or one bin for a constant."""
    if low == high:
        return {"bins": [str(low)], "counts": [present]}
    width = (high - low) / bins
    return {"bins": [f"[{low + i * width:.2f}, {low + (i + 1) * width:.2f}]" for i in range(bins)], "counts": [found.get(i, 0) for i in range(bins)]}


def usable(low: Any, high: Any) -> bool:
    return low is not None and high is not None and math.isfinite(low) and math.isfinite(high)


def lengths(df: DataFrame, columns: list[str], number_: int = LENGTHS) -> DataFrame:
    """(k, length, n): the most frequent lengths of each text column, ties by length."""
    spread = [F.struct(F.lit(k).alias("k"), F.char_length(named(c)).alias("length")) for k, c in enumerate(columns)]
    f = df.select(F.explode(F.array(*spread)).alias("s")).select("s.k", "s.length").groupBy("k", "length").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("k").orderBy(F.col("n").desc(), F.col("length").asc_nulls_last())
    return f.withColumn("place", F.row_number().over(w)).where(F.col("place") <= number_)
