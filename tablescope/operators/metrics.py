"""The registry of column metrics: each is a name, a test on the physical type, and an aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import counted, hashable, is_floating, is_integer, is_numeric, is_string, is_temporal, number, safe

QUANTILES = (("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))


@dataclass(frozen=True)
class Metric:
    """``build(column, type)`` is an aggregate; ``applies`` is None for every type."""

    name: str
    applies: Callable[[T.DataType], bool] | None
    build: Callable[[Column, T.DataType], Column]
    category: str = "column"

    def supports(self, kind: T.DataType) -> bool:
        return self.applies is None or self.applies(kind)


class Registry:
    """Metrics in order of registration; the last one of a name wins."""

    def __init__(self):
        self._by_name: dict[str, Metric] = {}

    def register(self, metric: Metric) -> Metric:
        self._by_name[metric.name] = metric
        return metric

    def __iter__(self):
        return iter(self._by_name.values())

    def __getitem__(self, name: str) -> Metric:
        return self._by_name[name]

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def of(self, kind: T.DataType) -> list[Metric]:
        return [m for m in self if m.supports(kind)]


registry = Registry()


def total(c: Column, kind: T.DataType) -> Column:
    """A sum that can't overflow: integers add up as decimals."""
    return F.sum(c.cast("decimal(38,0)")) if is_integer(kind) else F.sum(safe(c, kind))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis (G2); null below four values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n > 3) & (F.stddev_pop(x) > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(x) + 6))


def _numeric_or_temporal(kind: T.DataType) -> bool:
    return is_numeric(kind) or is_temporal(kind)


for _m in (
    Metric("mean", is_numeric, lambda c, k: F.avg(number(c, k))),
    Metric("min", _numeric_or_temporal, lambda c, k: F.min(safe(c, k))),
    Metric("max", _numeric_or_temporal, lambda c, k: F.max(safe(c, k))),
    Metric("std", is_numeric, lambda c, k: F.stddev_samp(number(c, k))),
    Metric("missing", None, lambda c, k: counted(safe(c, k).isNull())),
    Metric("n_distinct", hashable, lambda c, k: F.count_distinct(safe(c, k))),
    Metric("zeros", is_numeric, lambda c, k: counted(c == 0)),
    # Spark orders NaN above every number, so a comparison needs no guard for "below".
    Metric("n_negative", is_numeric, lambda c, k: counted(c < 0)),
    Metric("n_unique", hashable, lambda c, k: F.lit(None).cast("long")),  # by the frequency pass
    Metric("infinite", is_floating, lambda c, k: counted(F.abs(c) == float("inf"))),
    Metric("sum", is_numeric, total),
    *(Metric(name, is_numeric, lambda c, k, q=q: F.percentile(number(c, k), F.lit(q))) for name, q in QUANTILES),
    Metric("variance", is_numeric, lambda c, k: F.var_samp(number(c, k))),
    Metric("kurtosis", is_numeric, lambda c, k: sample_kurtosis(number(c, k))),
    Metric("mean_length", is_string, lambda c, k: F.avg(F.char_length(c))),
    Metric("min_length", is_string, lambda c, k: F.min(F.char_length(c))),
    Metric("max_length", is_string, lambda c, k: F.max(F.char_length(c))),
    Metric("n_empty", is_string, lambda c, k: counted(c == "")),
):
    registry.register(_m)

#: Names that a report uses instead of the registry's. Fixed values.
REPORT_NAMES = {"median": "50%", "p5": "5%", "p25": "25%", "p75": "75%", "p95": "95%", "missing": "n_missing", "zeros": "n_zeros", "infinite": "n_infinite"}
#: Metrics that the first pass leaves to other passes.
ELSEWHERE = {"n_distinct", "n_unique"}
BUILT_IN = {m.name: m for m in registry}
