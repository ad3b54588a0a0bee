"""Options of a profile, their defaults and what they resolve to."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

DEFAULT_TITLE = "Data Profiling Report"


def batch_size(n_rows: int, n_columns: int) -> int:
    """Aggregates of one job: fewer where each of them works on more cells."""
    cells = n_rows * n_columns
    for most, size in ((10_000_000, 500), (100_000_000, 100), (500_000_000, 50)):
        if cells < most:
            return size
    return 20


@dataclass(frozen=True)
class ProfileConfig:
    """``None`` in correlations, monotonicity and compute_duplicates means "unless minimal"; True overrides thresholds."""

    minimal: bool = False
    title: str = DEFAULT_TITLE
    correlations: bool | None = None
    monotonicity: bool | None = None
    compute_duplicates: bool | None = None
    cardinality_threshold: int = 20
    max_interaction_pairs: int = 10
    correlations_sampling_threshold: int = 1_000_000
    correlations_sample_size: int = 1_000_000
    sample_seed: int | None = 42
    correlations_max_columns: int = 15
    missing_heatmap_max_columns: int = 15
    missing_matrix_max_columns: int = 50
    monotonicity_threshold: int = 100_000
    duplicates_threshold: int = 50_000_000
    n_unique_threshold: int | None = 50_000_000
    inference_sample_size: int | None = 10_000
    monotonicity_order_by: str | None = None
    use_sketches: bool = False
    global_batch_size: int | None = None
    warnings: tuple[str, ...] = ()

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls) if f.name != "warnings"]

    @classmethod
    def resolve(cls, *, n_rows: int, n_columns: int, **options: Any) -> ProfileConfig:
        """Options with everything decided that depends on the table or on other options."""
        c = cls(**options)
        said = []
        changes: dict[str, Any] = {}
        for name in ("correlations_sampling_threshold", "correlations_sample_size"):
            if getattr(c, name) <= 0:
                changes[name] = 1_000_000
                said.append(f"{name} must be positive; the default of 1,000,000 is used.")
        for name in ("correlations_max_columns", "missing_heatmap_max_columns", "missing_matrix_max_columns"):
            changes[name] = max(2, getattr(c, name))
        if c.n_unique_threshold is None:
            changes["n_unique_threshold"] = max(1_000_000, n_rows // 10)
        if c.global_batch_size is None:
            changes["global_batch_size"] = batch_size(n_rows, n_columns)
        return replace(c, **changes, warnings=tuple(said))

    def wants(self, option: str) -> bool:
        value = getattr(self, option)
        return not self.minimal if value is None else value

    def insists(self, option: str) -> bool:
        return getattr(self, option) is True
