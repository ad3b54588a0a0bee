"""Statistics from value counts: one shuffle a type family, after which everything is small.

The frequency pass leaves (k, v, n), each value of each column once with its number of rows. From
it come, in three aggregations whatever the number of columns: counts, sums and bounds
(``totals``), central moments, the histogram and fine bins for quantiles (``spread``), and the few
values that quantiles and extremes still need (``fetched``). No expression is made per column, so
planning a wide table costs as much as planning a narrow one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .extremes import NUMBER
from .histogram import BINS

#: Bins in which quantiles are searched, and up to how many distinct values a column's search may fetch.
FINE, FEW = 1024, 20_000


def is_real(freq: DataFrame) -> bool:
    return isinstance(freq.schema["v"].dataType, T.DoubleType)


def is_text(freq: DataFrame) -> bool:
    return isinstance(freq.schema["v"].dataType, T.StringType)


def present(freq: DataFrame) -> Column:
    """Neither null nor NaN."""
    v = F.col("v")
    return v.isNotNull() & ~F.isnan(v) if is_real(freq) else v.isNotNull()


def totals(freq: DataFrame) -> DataFrame:
    """k, missing, n_distinct, n_unique and, by family, sums and bounds or text lengths."""
    v, n, here = F.col("v"), F.col("n"), present(freq)

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(F.lit(0)))

    out = [rows(~here).alias("missing"), F.sum(here.cast("long")).alias("n_distinct"), F.sum(((n == 1) & v.isNotNull()).cast("long")).alias("n_unique"), rows(here).alias("n_present")]
    if is_text(freq):
        length = F.char_length(v)
        out += [F.sum(length * n).alias("sum_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), rows(v == "").alias("n_empty")]
    else:
        value = F.when(here, v) if is_real(freq) else v
        total = F.sum(value * n) if is_real(freq) else F.sum(v.cast("decimal(38,0)") * n)
        out += [total.alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), rows(v == 0).alias("zeros"), rows(v < 0).alias("n_negative")]
        out += [rows(F.isnan(v)).alias("n_nan"), rows(F.abs(v) == float("inf")).alias("infinite")] if is_real(freq) else []
    return freq.groupBy("k").agg(*out)


def by_column(values: dict[int, float], k: Column) -> Column:
    """Looks a column's number up by k."""
    return F.get(F.lit([float(values.get(i, 0.0)) for i in range(max(values) + 1)]).cast("array<double>"), k)


def spread(freq: DataFrame, bounds: dict[int, tuple[float, float, float]], seconds: dict[int, float | None], bins: int = BINS, fine: int = FINE) -> DataFrame:
    """(k, bin, fine, n, distinct, low, high, m1 .. m4, away): rows by histogram bin and fine bin, with the
    powers of their distances from the column's mean. ``bounds``: k to (least, largest, mean), finite.
    ``seconds``: what the values of points in time are multiplied by; these are binned by whole seconds, as are their bounds."""
    k, n, x = F.col("k"), F.col("n"), F.col("v").cast("double")
    times = {c: f for c, f in seconds.items() if f is not None}
    if times:
        x = F.when(k.isin(list(times)), F.floor(x * by_column(times, k)).cast("double")).otherwise(x)
    low, width, mean = (by_column({c: f(b) for c, b in bounds.items()}, k) for f in (lambda b: b[0], lambda b: b[1] - b[0] or 1.0, lambda b: b[2]))
    at = (x - low) / width
    bin_of = lambda number: F.least(F.greatest(F.floor(at * number), F.lit(0)), F.lit(number - 1)).cast("int")
    own = freq.where(k.isin(list(bounds)) & present(freq)).select("k", "v", "n", bin_of(bins).alias("bin"), bin_of(fine).alias("fine"), (x - mean).alias("d"))
    d = F.col("d")
    sums = [F.sum(n).alias("n"), F.count(F.lit(1)).alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(d * n).alias("m1"), F.sum(d * d * n).alias("m2"), F.sum(d * d * d * n).alias("m3"), F.sum(d * d * d * d * n).alias("m4"), F.sum(F.abs(d) * n).alias("away")]
    return own.groupBy("k", "bin", "fine").agg(*sums)


def moments(rows: list, n: int) -> dict[str, float | None]:
    """Variance, deviation, kurtosis (G2), skewness by the sample deviation, mean absolute deviation, from ``spread``'s rows of one column."""
    away, m1, m2, m3, m4 = (math.fsum(r[c] for r in rows) / n for c in ("away", "m1", "m2", "m3", "m4"))
    # m1 is the rounding of the mean; what it does to the other moments is taken out.
    m4 += -4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1**4
    m3 += -3 * m1 * m2 + 2 * m1**3
    m2 -= m1 * m1
    variance = m2 * n / (n - 1) if n > 1 else None
    std = math.sqrt(variance) if variance is not None and variance > 0 else variance
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) if n > 3 and m2 > 0 else None
    return {"variance": variance, "std": std, "kurtosis": kurtosis, "skewness": m3 / std**3 if std else None, "mad": away}


class Search:
    """The quantiles and extremes of one column: which ranges of values have to be fetched, and what they give."""

    def __init__(self, rows: list, shares: Iterable[float], number: int = NUMBER):
        fine: dict[int, list] = {}
        for r in rows:
            own = fine.setdefault(r["fine"], [0, 0, r["low"], r["high"]])
            own[0], own[1], own[2], own[3] = own[0] + r["n"], own[1] + r["distinct"], min(own[2], r["low"]), max(own[3], r["high"])
        self.bins = [fine[b] for b in sorted(fine)]
        self.n = sum(b[0] for b in self.bins)
        self.shares, self.number = list(shares), number
        self.ends = []
        for b in self.bins:
            self.ends.append((self.ends[-1] if self.ends else 0) + b[0])
        wanted = {self.place(r) for q in self.shares for r in self.around(q)}
        for order in (range(len(self.bins)), range(len(self.bins) - 1, -1, -1)):
            got = 0
            for i in order:
                wanted.add(i)
                got += self.bins[i][1]
                if got >= number:
                    break
        self.wanted = sorted(wanted)
        #: Distinct values that would be fetched.
        self.cost = sum(self.bins[i][1] for i in self.wanted)

    def around(self, share: float) -> tuple[int, int]:
        at = share * (self.n - 1)
        return math.floor(at), math.ceil(at)

    def place(self, rank: int) -> int:
        return next(i for i, end in enumerate(self.ends) if rank < end)

    def ranges(self) -> list[tuple[Any, Any]]:
        return [(self.bins[i][2], self.bins[i][3]) for i in self.wanted]

    def quantiles(self, values: list[tuple[Any, int]]) -> list[float]:
        """Interpolated, from the fetched (value, rows), sorted."""

        def ranked(rank: int) -> float:
            i = self.place(rank)
            left = rank - (self.ends[i - 1] if i else 0)
            for v, n in values:
                if self.bins[i][2] <= v <= self.bins[i][3]:
                    if left < n:
                        return float(v)
                    left -= n
            raise ValueError("a rank lies outside of its bin")

        out = []
        for q in self.shares:
            a, b = self.around(q)
            low = ranked(a)
            out.append(low + (ranked(b) - low) * (q * (self.n - 1) - a) if a != b else low)
        return out


def fetched(freq: DataFrame, ranges: dict[int, list[tuple[Any, Any]]]) -> DataFrame:
    """(k, v, n) of the values inside a column's ranges."""
    condition = F.lit(False)
    for k, own in ranges.items():
        inside = F.lit(False)
        for low, high in own:
            inside = inside | F.col("v").between(low, high)
        condition = condition | ((F.col("k") == k) & inside)
    return freq.where(condition)


def outermost(values: list[tuple[Any, int]], distinct: bool, largest: bool, number: int = NUMBER) -> list[Any]:
    """The first values of either end, each once or as often as it occurs; ``values`` are sorted."""
    out: list[Any] = []
    for v, n in reversed(values) if largest else values:
        out += [v] * (1 if distinct else min(n, number))
        if len(out) >= number:
            break
    return out[:number]


def edges(freq: DataFrame, columns: list[int], number: int = NUMBER) -> DataFrame:
    """(k, v, n, side) of the first distinct values of either end, for columns whose bins don't tell."""
    from pyspark.sql import Window as W

    own = freq.where(F.col("k").isin(columns) & F.col("v").isNotNull())
    sides = []
    for side, order in (("smallest", F.col("v").asc()), ("largest", F.col("v").desc())):
        sides.append(own.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy(order))).where(F.col("place") <= number).select("k", "v", "n", F.lit(side).alias("side")))
    return sides[0].unionByName(sides[1])


def lengths(freq: DataFrame, columns: list[int], number: int) -> DataFrame:
    """(k, length, n): the most frequent lengths of each text column, ties by length."""
    from pyspark.sql import Window as W

    f = freq.where(F.col("k").isin(columns)).groupBy("k", F.char_length("v").alias("length")).agg(F.sum("n").alias("n"))
    w = W.partitionBy("k").orderBy(F.col("n").desc(), F.col("length").asc_nulls_last())
    return f.withColumn("place", F.row_number().over(w)).where(F.col("place") <= number)
