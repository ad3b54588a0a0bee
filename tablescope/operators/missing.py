"""The missing-value section: counts, correlation of nullity, and where values are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import named, safe
from .correlations import masks, matrix

ROWS = 250


def most_missing(columns: list[str], variables: dict[str, dict], limit: int) -> tuple[list[str], bool]:
    if len(columns) <= limit:
        return columns, False
    return sorted(columns, key=lambda c: variables[c].get("n_missing") or 0, reverse=True)[:limit], True


def pattern(df: DataFrame, columns: list[str], rows: int = ROWS) -> DataFrame:
    """Null masks of the first rows."""
    return df.select(*[safe(named(c), df.schema[c].dataType).isNull().alias(f"c{i}") for i, c in enumerate(columns)]).limit(rows)


def bar(columns: list[str], counts: list[int]) -> dict:
    return {"name": "Count", "caption": "How many values each column lacks.", "matrix": {"columns": columns, "counts": counts}}


def heatmap(df: DataFrame, with_missing: list[str], variables: dict[str, dict], limit: int, warnings: list[str]) -> dict:
    """Nullity correlations of the columns that lack values."""
    hot, cut = most_missing(with_missing, variables, limit)
    cells, undefined = matrix(masks(df, hot), len(hot), undefined=0.0) if len(hot) >= 2 else ([], 0)
    if undefined:
        warnings.append(f"The missingness heatmap has {undefined} undefined pairs, as in columns that are never or always missing; they are shown as 0.")
    if cut:
        warnings.append(f"The nullity heatmap shows {limit} of {len(with_missing)} columns with missing values, those with the most.")
    meta = {"truncated": cut, "original_count": len(with_missing), "limit": limit}
    return {"name": "Heatmap", "caption": "How far columns lack values together: correlation of their null masks, from -1 to 1.", "matrix": {"columns": hot if cells else [], "matrix": cells, "sampled": False, "_metadata": meta}}


def first_rows(df: DataFrame, columns: list[str], variables: dict[str, dict], n_rows: int, limit: int, warnings: list[str]) -> dict:
    """Null masks of the first rows, of the columns that lack the most values."""
    shown, narrow = most_missing(columns, variables, limit)
    n = min(ROWS, n_rows)
    if narrow:
        warnings.append(f"The nullity matrix shows {limit} of {len(columns)} columns, those with the most missing values.")
    meta = {"truncated": narrow, "original_count": len(columns), "limit": limit}
    cells = [list(r) for r in pattern(df, shown, n).collect()] if columns else []
    return {"name": "Matrix", "caption": f"Where values are missing in the first {ROWS} rows.", "matrix": {"columns": shown, "matrix": cells, "sampled": n_rows > n, "sample_size": n, "_metadata": meta}}


def compute(df: DataFrame, variables: dict[str, dict], n_rows: int, heatmap_columns: int = 15, matrix_columns: int = 50) -> tuple[dict, list[str]]:
    """The section and its warnings."""
    warnings: list[str] = []
    columns = list(variables)
    counts = [variables[c].get("n_missing") or 0 for c in columns]
    with_missing = [c for c, n in zip(columns, counts, strict=True) if n > 0]
    hot = heatmap(df, with_missing, variables, max(2, heatmap_columns), warnings)
    return {"bar": bar(columns, counts), "matrix": first_rows(df, columns, variables, n_rows, max(2, matrix_columns), warnings), "heatmap": hot}, warnings
