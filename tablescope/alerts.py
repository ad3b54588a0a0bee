"""Data-quality alerts from finished statistics."""

from __future__ import annotations

from typing import Any

# Thresholds of the alerts.
MISSING, EMPTY, ZEROS, SKEWED, HIGH_CARDINALITY, UNIQUE_NUMBERS = 0.05, 0.05, 0.1, 10, 0.5, 1_000_000


def found(stats: dict[str, Any], n: int) -> list[tuple[str, str]]:
    """(alert, level) of one variable."""

    def value(name: str) -> float:
        v = stats.get(name)
        return v if isinstance(v, (int, float)) and not isinstance(v, bool) else 0

    kind, distinct, out = stats.get("type"), value("n_distinct"), []
    if distinct == 1:
        out.append(("CONSTANT", "warning"))
    elif distinct == n > 0 and (kind == "Categorical" or (kind == "Numeric" and distinct < UNIQUE_NUMBERS)):
        out.append(("UNIQUE", "warning"))
    elif n and kind == "Categorical" and distinct / n > HIGH_CARDINALITY:
        out.append(("HIGH_CARDINALITY", "warning"))
    if value("p_missing") > MISSING:
        out.append(("MISSING", "info"))
    if kind == "Categorical" and value("p_empty") > EMPTY:
        out.append(("EMPTY", "info"))
    if n and value("n_zeros") / n > ZEROS:
        out.append(("ZEROS", "info"))
    if abs(value("skewness")) > SKEWED:
        out.append(("SKEWED", "info"))
    return out


def alerts(table: dict[str, Any], variables: dict[str, dict]) -> list[dict[str, Any]]:
    """Alerts by kind with their fields; warnings first, then by name."""
    groups: dict[tuple[str, str], list[str]] = {}
    for name, stats in variables.items():
        for kind in found(stats, table.get("n") or 0):
            groups.setdefault(kind, []).append(name)
    order = sorted(groups, key=lambda k: (k[1] != "warning", k[0]))
    return [{"alert_type": kind, "fields": sorted(groups[kind, level]), "level": level} for kind, level in order]
