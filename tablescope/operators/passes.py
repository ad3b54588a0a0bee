"""The scalar passes: every registered metric of every column in one or a few aggregations."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named, number, safe
from .metrics import ELSEWHERE, QUANTILES, Metric, Registry
from .quantiles import by_narrowing

#: Up to this many rows, quantiles come from the exact ``percentile`` aggregate, which holds a
#: column's values in one task; beyond it from narrowing histograms, just as exact.
PERCENTILE_ROWS = 5_000_000
SKETCH_ACCURACY = 10_000


def in_batches(df: DataFrame, expressions: dict[Any, Column], size: int) -> dict[Any, Any]:
    """Evaluate aggregates, ``size`` at a time, under opaque aliases. A failing batch falls back to single ones."""
    keys, out = list(expressions), {}
    for a in range(0, len(keys), max(1, size)):
        own = keys[a : a + max(1, size)]
        try:
            row = df.agg(*[expressions[k].alias(f"m{i}") for i, k in enumerate(own)]).first()
            out |= dict(zip(own, row, strict=True))
        except Exception:
            if len(own) == 1:
                raise
            for k in own:
                try:
                    out[k] = df.agg(expressions[k].alias("m")).first()[0]
                except Exception as error:  # one metric must not cost the others
                    out[k] = error
    return out


def first_pass(df: DataFrame, registry: Registry, batch_size: int = 500, sketches: bool = False, known: Callable[[str, T.DataType, Metric], bool] | None = None) -> tuple[int, dict[tuple[str, str], Any]]:
    """Row count and {(column, metric): value}, without distinct counts and quantiles unless they are sketched,
    and without what is ``known`` from value counts.

    Exact quantiles aggregate objects and would take code generation from all other metrics;
    ``exact_quantiles`` or the frequency pass find them.
    """
    names = {q for q, _ in QUANTILES}
    expressions: dict[Any, Column] = {"n": F.count(F.lit(1))}
    for field in df.schema.fields:
        c, kind = named(field.name), field.dataType
        for m in registry.of(kind):
            if m.name == "n_distinct" and sketches:
                expressions[field.name, m.name] = F.approx_count_distinct(safe(c, kind), 0.02)
            elif m.name not in ELSEWHERE and m.name not in names and not (known and known(field.name, kind, m)):
                expressions[field.name, m.name] = m.build(c, kind)
    found = in_batches(df, expressions, batch_size)
    return int(found.pop("n")), found


def quantile_columns(df: DataFrame, registry: Registry) -> list[str]:
    names = {q for q, _ in QUANTILES}
    return [f.name for f in df.schema.fields if any(m.name in names for m in registry.of(f.dataType))]


def exact_quantiles(df: DataFrame, columns: list[str], n_rows: int, sketches: bool = False) -> dict[tuple[str, str], Any]:
    """Quantiles of columns that have no value counts: in one aggregation, or by narrowing where the table is large."""
    if not columns:
        return {}
    shares = [q for _, q in QUANTILES]
    if n_rows > PERCENTILE_ROWS and not sketches:
        by_column = by_narrowing(df, columns, shares)
    else:
        kinds = {c: df.schema[c].dataType for c in columns}
        built = {c: F.percentile_approx(number(named(c), kinds[c]), F.lit(shares), SKETCH_ACCURACY) if sketches else F.percentile(number(named(c), kinds[c]), F.lit(shares)) for c in columns}
        by_column = in_batches(df, built, 100)
    return {(c, name): v for c, values in by_column.items() for (name, _), v in zip(QUANTILES, values if isinstance(values, list) else [None] * len(shares), strict=True)}


def second_pass(df: DataFrame, moments: dict[str, tuple[float | None, float | None]], batch_size: int = 500) -> dict[tuple[str, str], Any]:
    """Skewness (by the sample deviation) and mean absolute deviation, around known means."""
    expressions: dict[Any, Column] = {}
    for column, (mean, std) in moments.items():
        if mean is None:
            continue
        x = number(named(column), df.schema[column].dataType)
        if std:
            z = (x - F.lit(float(mean))) / F.lit(float(std))
            expressions[column, "skewness"] = F.avg(z * z * z)
        expressions[column, "mad"] = F.avg(F.abs(x - F.lit(float(mean))))
    return in_batches(df, expressions, batch_size) if expressions else {}


def long_form(df: DataFrame, columns: Iterable[str], parts: dict[str, Any]) -> DataFrame:
    """One row per column; ``parts`` maps an output name to (column, type) -> aggregate."""
    rows = [F.struct(F.lit(c).alias("column_name"), *[build(named(c), df.schema[c].dataType).alias(name) for name, build in parts.items()]) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
