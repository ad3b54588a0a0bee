"""Whole-row operators: duplicate rows and monotonic columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named


def canonical(column: Column, kind: T.DataType) -> Column:
    """A value that can be grouped: maps as sorted entries, variants as JSON."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(column))
    return F.to_json(column) if isinstance(kind, T.VariantType) else column


def distinct_rows(df: DataFrame) -> DataFrame:
    """n, n_distinct_rows: rows are grouped with partial counts, and counted again."""
    keys = [canonical(named(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    groups = df.select(*keys).groupBy(*[f"c{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("rows_"))
    return groups.agg(F.coalesce(F.sum("rows_"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_distinct_rows"))


def monotonic(df: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """One row: inc0, dec0, inc1, ... whether values never fall or never rise in the order of a column.

    Rows are range-partitioned by the order column, so each task checks a run of the order and only
    the edges of the runs are compared in one place. Comparisons with null don't count.
    """
    key, n = "_key", len(columns)
    x = df.select(named(order_by).alias(key), *[named(c).alias(f"c{i}") for i, c in enumerate(columns)])
    placed = x.repartitionByRange(F.col(key).asc_nulls_first()).withColumn("_p", F.spark_partition_id())
    w = W.partitionBy("_p").orderBy(F.col(key).asc_nulls_first())
    flags = placed.select("_p", key, *[f"c{i}" for i in range(n)], F.row_number().over(w).alias("_r"), *[F.lag(f"c{i}").over(w).alias(f"l{i}") for i in range(n)])
    runs = flags.groupBy("_p").agg(
        *[e for i in range(n) for e in (F.bool_and((F.col(f"c{i}") >= F.col(f"l{i}")) | F.col(f"l{i}").isNull()).alias(f"i{i}"), F.bool_and((F.col(f"c{i}") <= F.col(f"l{i}")) | F.col(f"l{i}").isNull()).alias(f"d{i}"), F.min_by(F.struct(f"c{i}"), "_r")[f"c{i}"].alias(f"f{i}"), F.max_by(F.struct(f"c{i}"), "_r")[f"c{i}"].alias(f"e{i}"))]
    )
    # One row for each task: the only rows that are brought together.
    edge = W.orderBy("_p")
    runs = runs.select(*[c for i in range(n) for c in (f"i{i}", f"d{i}", f"f{i}", F.lag(f"e{i}").over(edge).alias(f"q{i}"))])
    return runs.agg(*[e for i in range(n) for e in (F.bool_and(F.coalesce(f"i{i}", F.lit(True)) & ((F.col(f"f{i}") >= F.col(f"q{i}")) | F.col(f"q{i}").isNull())).alias(f"inc{i}"), F.bool_and(F.coalesce(f"d{i}", F.lit(True)) & ((F.col(f"f{i}") <= F.col(f"q{i}")) | F.col(f"q{i}").isNull())).alias(f"dec{i}"))])
