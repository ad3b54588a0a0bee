"""Profiles of a stream: every micro-batch is a table with a report of its own, and counts that add up over batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import named, number, safe
from ..profiler import profile
from ..report import Report


def profile_stream(stream: DataFrame, sink: Callable[[Report, int], None], checkpoint: str, trigger: dict[str, Any] | None = None, **options: Any) -> StreamingQuery:
    """Start a query that hands a report of each micro-batch to ``sink``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            sink(profile(df, **options), batch_id)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


ADDED = ("n_missing", "n_empty", "n_zeros", "n_negative", "n_infinite")


def running_counts(sink: Callable[[dict[str, Any], int], None]) -> Callable[[Report, int], None]:
    """A sink for ``profile_stream`` that hands on what can be added up over batches: rows, and per column
    the counts of ``ADDED``, the sum, the bounds and, from these, the mean. A batch that is
    delivered again, as its number tells, is not added twice."""
    total: dict[str, Any] = {"n": 0, "variables": {}}
    seen: set[int] = set()

    def add(report: Report, batch_id: int) -> None:
        if batch_id not in seen:
            seen.add(batch_id)
            total["n"] += report.table["n"]
            for name, v in report.variables.items():
                t = total["variables"].setdefault(name, {"present": 0})
                t["present"] += report.table["n"] - (v.get("n_missing") or 0)
                for k in (*ADDED, "sum"):
                    if v.get(k) is not None:
                        t[k] = t.get(k, 0) + v[k]
                for k, best in (("min", min), ("max", max)):
                    if v.get(k) is not None:
                        t[k] = best(t[k], v[k]) if k in t else v[k]
                if "sum" in t:
                    t["mean"] = float(t["sum"]) / t["present"] if t["present"] else None
        sink(total, batch_id)

    return add


def windowed_counts(stream: DataFrame, time_column: str, column: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Rows, missing values and mean of a numeric column in tumbling windows; rows later than ``lateness`` are left out."""
    kind = stream.schema[column].dataType
    x = safe(named(column), kind)
    late = stream.withWatermark(time_column, lateness)
    return late.groupBy(F.window(named(time_column), width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(x.isNull().cast("long")).alias("n_missing"), F.avg(number(named(column), kind)).alias("mean")).select(F.col("w.start").alias("window_start"), "n", "n_missing", "mean")
