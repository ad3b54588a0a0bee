"""Pearson, Spearman and nullity correlations: one aggregation for a whole matrix."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import is_boolean, is_numeric, named, number, safe


def coefficient(x: Column, y: Column) -> Column:
    """Covariance of the pairs over the deviations of each column by itself; null without spread."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return named(name).cast("int").cast("double") if is_boolean(kind) else number(named(name), kind)


def eligible(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) or is_boolean(f.dataType)]


def values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles c0, c1, ..."""
    return df.select(*[as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])


def masks(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 where a value is missing, else 0, as doubles c0, c1, ..."""
    return df.select(*[safe(named(c), df.schema[c].dataType).isNull().cast("int").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ranks of each column's values, ties at the lowest, missing values tied last.

    One window a column, in one task: for tables of a known, small size.
    """
    x = values(df, columns)
    return x.select(*[F.rank().over(W.orderBy(F.col(f"c{i}").asc_nulls_last())).cast("double").alias(f"c{i}") for i in range(len(columns))])


def spread_ranks(x: DataFrame, columns: int) -> DataFrame:
    """(k, v, rank, n) of c0, c1, ...: the ranks of any number of rows from value counts, without a single-task sort.

    Values are range-partitioned; a prefix of the partitions' counts gives each its first rank.
    """
    f = x.unpivot([], [f"c{i}" for i in range(columns)], "name", "v").groupBy("name", "v").agg(F.count(F.lit(1)).alias("n")).select(F.substring("name", 2, 9).cast("int").alias("k"), "v", "n")
    # Kept, so that both uses see the same ranges: their limits are sampled anew for each plan.
    placed = f.repartitionByRange(F.col("k"), F.col("v").asc_nulls_last()).withColumn("p", F.spark_partition_id()).persist()
    totals = placed.groupBy("k", "p").agg(F.sum("n").alias("t"))
    first = totals.withColumn("before", F.coalesce(F.sum("t").over(W.partitionBy("k").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("k", "p", "before")
    inner = F.coalesce(F.sum("n").over(W.partitionBy("k", "p").orderBy(F.col("v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(first, ["k", "p"]).select("k", "v", (F.col("before") + inner + 1).alias("rank"), "n")


def pearson(x: DataFrame, n: int, centers: list[float], complete: list[bool]) -> list[list[float | None]]:
    """The matrix from plain sums around ``centers``, any numbers near the means; ``complete`` columns lack no value.

    A pair of complete columns takes one sum, other pairs the sums over the rows that have both.
    """
    c = [F.col(f"c{i}") - F.lit(centers[i]) for i in range(n)]
    sums: dict[tuple, Column] = {}
    for i in range(n):
        sums |= {("n", i): F.count(f"c{i}"), ("s", i): F.sum(c[i]), ("q", i): F.sum(c[i] * c[i])}
    for i, j in combinations(range(n), 2):
        sums["p", i, j] = F.sum(c[i] * c[j])
        if not (complete[i] and complete[j]):
            both = c[i].isNotNull() & c[j].isNotNull()
            sums |= {("n", i, j): F.count(c[i] + c[j]), ("s", i, j): F.sum(F.when(both, c[i])), ("s", j, i): F.sum(F.when(both, c[j]))}
    got = dict(zip(sums, x.agg(*[e.alias(f"m{k}") for k, e in enumerate(sums.values())]).first(), strict=True))
    out: list[list[float | None]] = [[1.0] * n for _ in range(n)]
    for i, j in combinations(range(n), 2):
        number_, p = got.get(("n", i, j), got["n", i]), got["p", i, j]
        r = None
        if number_ and p is not None:
            covariance = p / number_ - (got.get(("s", i, j), got["s", i]) / number_) * (got.get(("s", j, i), got["s", j]) / number_)
            variances = [got["q", k] / got["n", k] - (got["s", k] / got["n", k]) ** 2 for k in (i, j)]
            # What is left of a constant after rounding is no spread.
            if all(v > 1e-24 * centers[k] ** 2 for v, k in zip(variances, (i, j), strict=True)):
                r = covariance / math.prod(math.sqrt(v) for v in variances)
        out[i][j] = out[j][i] = r if r is not None and math.isfinite(r) else None
    return out


#: Up to this many rows are ranked in one task; it is the default size of the sample that correlations are computed on.
RANKED_ROWS = 1_000_000


def spearman(x: DataFrame, n: int, n_rows: int) -> list[list[float | None]]:
    """The matrix of Pearson correlations of ranks: a bounded sample is ranked in one task, anything larger is ranked in place."""
    if n_rows > RANKED_ROWS:
        return matrix(spread_rank_rows(x, n), n)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in own]) if own else np.empty(0) for i in range(n)]
        ranks_ = []
        for v in columns:  # missing values are NaN, which sorts last
            r = np.searchsorted(np.sort(v), v, "left").astype(float)
            ranks_.append(r - r.mean() if len(r) else r)
        scale = [math.sqrt(float(r @ r)) for r in ranks_]
        pairs = [[(float(a @ b) / (s * t) if s * t else None) for b, t in zip(ranks_, scale, strict=True)] for a, s in zip(ranks_, scale, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pairs], pa.list_(pa.list_(pa.float64())))], ["r"])

    rows = x.coalesce(1).mapInArrow(run, "r array<array<double>>").first()[0]
    return [[1.0 if i == j else rows[i][j] for j in range(n)] for i in range(n)]


def spread_rank_rows(x: DataFrame, n: int) -> DataFrame:
    """The ranks of each row's values as c0, c1, ...; no task sees more than its share of a column."""
    numbered = x.withColumn("row", F.monotonically_increasing_id()).persist()
    long = numbered.unpivot(["row"], [f"c{i}" for i in range(n)], "name", "v").select("row", F.substring("name", 2, 9).cast("int").alias("k"), "v")
    found = spread_ranks(x, n).select(F.col("k").alias("rank_k"), F.col("v").alias("rank_v"), "rank")
    ranked = long.join(found, (F.col("k") == F.col("rank_k")) & F.col("v").eqNullSafe(F.col("rank_v")))
    return ranked.groupBy("row").agg(*[F.max(F.when(F.col("k") == i, F.col("rank"))).cast("double").alias(f"c{i}") for i in range(n)])


def matrix_row(x: DataFrame, n: int) -> DataFrame:
    """One row with a coefficient for each pair i < j."""
    pairs = list(combinations(range(n), 2))
    return x.agg(*[coefficient(F.col(f"c{i}"), F.col(f"c{j}")).alias(f"r{i}_{j}") for i, j in pairs])


def matrix(x: DataFrame, n: int, undefined: float | None = None) -> tuple[list[list[float | None]], int]:
    """The symmetric matrix and how many pairs are undefined."""
    out: list[list[float | None]] = [[1.0] * n for _ in range(n)]
    row, missing = matrix_row(x, n).first(), 0
    for (i, j), r in zip(combinations(range(n), 2), row, strict=True):
        if r is None or not math.isfinite(r):
            missing += 1
            r = undefined
        out[i][j] = out[j][i] = r
    return out, missing


def long_matrix(x: DataFrame, columns: list[str]) -> DataFrame:
    """column_a, column_b, r for a query."""
    pairs = list(combinations(range(len(columns)), 2))
    return matrix_row(x, len(columns)).select(F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("column_a"), F.lit(columns[j]).alias("column_b"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs])).alias("s")).select("s.*")


def selected(columns: list[str], variables: dict[str, dict], limit: int) -> tuple[list[str], bool]:
    """The columns to correlate: fewest missing, then largest variance, then name."""
    limit = max(2, limit)
    if len(columns) <= limit:
        return columns, False

    def order(c: str) -> tuple:
        v = variables.get(c, {})
        spread = v.get("variance")
        return v.get("n_missing") or 0, -(float(spread) if isinstance(spread, (int, float)) and math.isfinite(spread) else 0.0), c

    return sorted(columns, key=order)[:limit], True


def sample(df: DataFrame, columns: list[str], n_rows: int, threshold: int = 1_000_000, sample_size: int = 1_000_000, seed: int | None = 42) -> tuple[DataFrame, dict]:
    """The columns as doubles, of a sample where the table is large, and what a report says of it."""
    share = sample_size / n_rows if n_rows else 1.0
    sampled = n_rows > threshold and share < 1
    own = df.select(*[named(c) for c in columns])
    own = own.sample(fraction=share, seed=seed) if sampled else own
    return values(own, columns), {"sampled": sampled, "sample_size": sample_size if sampled else n_rows}


def compute(df: DataFrame, variables: dict[str, dict], n_rows: int, threshold: int = 1_000_000, sample_size: int = 1_000_000, seed: int | None = 42, max_columns: int = 15, ranked: Callable[[], list] | None = None) -> dict:
    """Both matrices of a report. ``ranked`` gives that of Spearman if it has been started already, for all eligible columns."""
    every = eligible(df)
    columns, truncated = selected(every, variables, max_columns)
    meta = {"truncated": truncated, "original_count": len(every), "limit": max(2, max_columns)}
    x, flags = sample(df, columns, n_rows, threshold, sample_size, seed)
    if len(columns) < 2:
        return {"pearson": {"columns": columns, "matrix": [], **flags}, "spearman": {"columns": columns, "matrix": [], **flags}, "_metadata": meta}
    known = [variables.get(c, {}) for c in columns]
    centers = [float(v["mean"]) if isinstance(v.get("mean"), (int, float)) and math.isfinite(v["mean"]) else 0.0 for v in known]
    both = pearson(x, len(columns), centers, [v.get("n_missing") == 0 for v in known])
    ranks_ = ranked() if ranked else spearman(x, len(columns), flags["sample_size"])
    return {"pearson": {"columns": columns, "matrix": both, **flags}, "spearman": {"columns": columns, "matrix": ranks_, **flags}, "_metadata": meta}
