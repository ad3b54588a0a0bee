"""The report: variables and table statistics, derived values, and export as dict, JSON and HTML."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql.types import StructType

from .alerts import alerts
from .config import DEFAULT_TITLE
from .functions.columns import hashable, report_kind
from .operators.metrics import REPORT_NAMES

SKIPPED = "Skipped"
#: Keys that a column loses when it turns from Numeric to Categorical. Fixed values.
NUMERIC_ONLY = ("mean", "std", "variance", "skewness", "kurtosis", "mad", "sum", "range", "iqr", "50%", "5%", "25%", "75%", "95%", "cv", "p_zeros", "p_infinite", "p_negative", "n_zeros", "n_infinite", "n_negative")


def plain(value: Any) -> Any:
    """A value as JSON can hold it: no NaN or infinity, ISO dates, decimals as floats."""
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() and value.as_tuple().exponent >= 0 else plain(float(value))
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (dt.datetime, dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return f"__unsupported_type__:{type(value).__name__}:{value!r}"


def ratio(part: Any, whole: Any) -> Any:
    if SKIPPED in (part, whole):
        return SKIPPED
    return part / whole if isinstance(part, (int, float)) and isinstance(whole, (int, float)) and whole else 0.0


def derived(stats: dict[str, Any], n: int) -> dict[str, Any]:
    """A variable's statistics with shares (of all rows), ranges and flags."""
    v = dict(stats)
    missing = v.get("n_missing")
    v["n"], v["p_missing"] = n, ratio(missing or 0, n)
    v["count"] = n - (missing or 0)
    v["p_distinct"], v["p_unique"] = ratio(v.get("n_distinct") or 0, n), ratio(v.get("n_unique") or 0, n)
    v["is_unique"] = bool(n > 0 and v.get("n_distinct") == n)

    def numbers(*names: str) -> bool:
        return all(isinstance(v.get(x), (int, float, decimal.Decimal)) and not isinstance(v.get(x), bool) for x in names)

    if v.get("type") == "Numeric":
        if numbers("min", "max"):
            v["range"] = v["max"] - v["min"]
        if numbers("25%", "75%"):
            v["iqr"] = v["75%"] - v["25%"]
        if numbers("mean", "std") and v["mean"]:
            v["cv"] = v["std"] / v["mean"]
        for name in ("zeros", "infinite", "negative"):
            if f"n_{name}" in v:
                v[f"p_{name}"] = ratio(v[f"n_{name}"] or 0, n)
    if "n_empty" in v:
        v["p_empty"] = ratio(v["n_empty"] or 0, n)
    return v


def table_totals(variables: dict[str, dict], n: int) -> dict[str, Any]:
    """Missing and empty cells, and how many variables have which."""
    cells = n * len(variables)
    missing = [v.get("n_missing") or 0 for v in variables.values()]
    empty = [v.get("n_empty") or 0 for v in variables.values()]
    return {
        "n_cells_missing": sum(missing),
        "p_cells_missing": sum(missing) / cells if cells else 0.0,
        "n_cells_empty": sum(empty),
        "p_cells_empty": sum(empty) / cells if cells else 0.0,
        "n_vars_with_missing": sum(m > 0 for m in missing),
        "n_vars_all_missing": sum(n > 0 and m == n for m in missing),
        "n_vars_constant": sum(v.get("n_distinct") == 1 for v in variables.values()),
        "n_vars_with_empty": sum(e > 0 for e in empty),
    }


class Report:
    """Sections are plain dicts; ``finalize`` derives the rest once, however often it is called."""

    def __init__(self, schema: StructType, title: str = DEFAULT_TITLE, labels: dict[str, str] | None = None):
        self.schema = schema
        self.analysis: dict[str, Any] = {"title": title, "warnings": []}
        self.table: dict[str, Any] = {"n": 0, "n_var": len(schema.fields), "memory_size": 0, "record_size": 0.0, "types": {}}
        self.variables: dict[str, dict[str, Any]] = {}
        for f in schema.fields:
            label = (labels or {}).get(f.name)
            self.variables[f.name] = {"type": report_kind(f.dataType, label), "logical_type": label, "n_distinct": 0, "n_unique": 0, "n_missing": 0, "p_missing": 0.0, "n": 0, "count": 0, "hashable": hashable(f.dataType), "warnings": []}
        self.correlations: dict[str, Any] = {}
        self.interactions: dict[str, Any] = {}
        self.missing: dict[str, Any] = {}
        self.alerts: list[dict[str, Any]] = []
        self.sample: dict[str, Any] = {}
        self._final = False

    def warn(self, text: str, column: str | None = None) -> None:
        (self.analysis if column is None else self.variables[column])["warnings"].append(text)

    def set(self, column: str, metric: str, value: Any) -> None:
        self.variables[column][REPORT_NAMES.get(metric, metric)] = value

    def reclassify(self, column: str, kind: str) -> None:
        self.variables[column]["type"] = kind
        if kind == "Categorical":
            for name in NUMERIC_ONLY:
                self.variables[column].pop(name, None)

    def finalize(self) -> Report:
        if not self._final:
            n = self.table["n"]
            self.variables = {c: derived(v, n) for c, v in self.variables.items()}
            self.table |= table_totals(self.variables, n)
            types: dict[str, int] = {}
            for v in self.variables.values():
                types[v["type"]] = types.get(v["type"], 0) + 1
            self.table["types"] = types
            self.alerts = alerts(self.table, self.variables)
            self._final = True
        return self

    def to_dict(self) -> dict[str, Any]:
        self.finalize()
        from . import __version__

        shape = {"analysis": self.analysis, "table": self.table, "variables": self.variables, "correlations": rows_by_name(self.correlations), "interactions": self.interactions, "missing": rows_by_name(self.missing), "alerts": self.alerts, "sample": self.sample, "package": {"name": "tablescope", "version": __version__}}
        return plain(shape)

    get_description = to_dict

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    def to_html(self, theme: str = "default", minify: bool = True, offline: bool = True) -> str:
        from .render import page

        return page(self.to_dict(), theme=theme, minify=minify, offline=offline)

    def to_file(self, path: str | Path, theme: str = "default", minify: bool = True, offline: bool = True) -> None:
        text = self.to_json() if str(path).endswith(".json") else self.to_html(theme, minify, offline)
        Path(path).write_text(text, encoding="utf-8")


def rows_by_name(section: Any) -> Any:
    """Every ``{columns, matrix: [[...]]}`` inside as a list of one dict for each row."""
    if not isinstance(section, dict):
        return section
    columns, rows = section.get("columns"), section.get("matrix")
    if isinstance(columns, list) and isinstance(rows, list) and all(isinstance(r, list) for r in rows):
        return section | {"matrix": [dict(zip(columns, r, strict=True)) for r in rows]}
    return {k: rows_by_name(v) for k, v in section.items()}
