"""Scatter samples of the most correlated numeric columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions.columns import named

POINTS = 1000


def active_columns(numeric: list[str], correlations: dict | None, limit: int) -> list[str]:
    """The columns of the largest mean absolute Pearson correlation, by name; else the first ones."""
    pearson = (correlations or {}).get("pearson") or {}
    columns, rows = pearson.get("columns") or [], pearson.get("matrix") or []
    if not columns or not rows:
        return sorted(numeric[:limit])
    strength = {}
    for i, c in enumerate(columns):
        others = [abs(r) if r is not None and math.isfinite(r) else 0.0 for j, r in enumerate(rows[i]) if j != i]
        strength[c] = sum(others) / len(others) if others else 0.0
    return sorted(sorted(columns, key=lambda c: -strength[c])[:limit])


def sampled(df: DataFrame, columns: list[str], n_rows: int, seed: int | None, points: int = POINTS) -> DataFrame:
    own = df.select(*[named(c) for c in columns])
    return own.sample(fraction=points / n_rows, seed=seed) if n_rows > points else own


def compute(df: DataFrame, variables: dict[str, dict], n_rows: int, seed: int | None = 42, max_columns: int = 10, correlations: dict | None = None) -> dict:
    numeric = [c for c, v in variables.items() if v.get("type") == "Numeric"]
    if len(numeric) < 2:
        return {}
    active = [c for c in active_columns(numeric, correlations, max_columns) if c in df.columns]
    rows = sampled(df, active, n_rows, seed).collect()  # about a thousand rows

    def value(x) -> float | None:
        try:
            return None if x is None else float(x)
        except (TypeError, ValueError):
            return None

    data = [[value(x) for x in r] for r in rows]
    out: dict = {}
    for i, a in enumerate(active):
        out[a] = {b: [{"x": r[i], "y": r[j]} for r in data if r[i] is not None and r[j] is not None] for j, b in enumerate(active)}
    out["_metadata"] = {"max_pairs": max_columns, "active_columns": active, "total_numeric_columns": len(numeric), "is_truncated": len(numeric) > max_columns}
    return out
