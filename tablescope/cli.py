"""Command line: ``python -m tablescope -f data.parquet -o report.html``."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .config import DEFAULT_TITLE, ProfileConfig


def least_two(text: str) -> int:
    n = int(text)
    if n < 2:
        raise argparse.ArgumentTypeError("must be at least 2")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tablescope", description="Profile a Parquet, CSV or Excel file into an HTML or JSON report.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-f", "--file-path", required=True, help="input file or folder")
    p.add_argument("-o", "--output", default="report.html", help="output file (default: %(default)s)")
    p.add_argument("-t", "--title", default=DEFAULT_TITLE)
    p.add_argument("--minimal", action="store_true", help="fewer metrics")
    for flag, dest in (("correlations", "correlations"), ("monotonicity", "monotonicity"), ("duplicates", "compute_duplicates")):
        p.add_argument(f"--{flag}", dest=dest, action=argparse.BooleanOptionalAction, default=None)
    d = ProfileConfig()
    for name in ("monotonicity_threshold", "duplicates_threshold", "n_unique_threshold", "global_batch_size"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(d, name))
    for name in ("correlations_max_columns", "missing_heatmap_max_columns", "missing_matrix_max_columns"):
        p.add_argument(f"--{name.replace('_', '-')}", type=least_two, default=getattr(d, name))
    p.add_argument("--monotonicity-order-by", help="column that gives the order of rows")
    p.add_argument("--use-sketches", action="store_true", help="approximate distinct counts and quantiles")
    p.add_argument("--theme", choices=("default", "ydata-like"), default="default")
    p.add_argument("--format", choices=("html", "json"), dest="output_format", help="overrides the extension")
    p.add_argument("--offline", action=argparse.BooleanOptionalAction, default=True, help="the page is always self-contained")
    p.add_argument("--multiline", action="store_true", help="values of a CSV file may hold line breaks (the file is then read by one task)")
    p.add_argument("--debug", action="store_true", help="print the time of each phase")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = vars(parser().parse_args(arguments))
    path, output, theme, form, offline, multiline, debug = (a.pop(k) for k in ("file_path", "output", "theme", "output_format", "offline", "multiline", "debug"))
    try:
        from pyspark.sql import SparkSession

        from .profiler import profile
        from .sources.readers import read_any

        spark = SparkSession.builder.appName("tablescope").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()

        def say(step: int, label: str | None) -> None:
            print(f"{label or ''} (+{step} %)", file=sys.stderr)

        report = profile(read_any(spark, path, multiline), say, **a)
        if debug:
            for name, ms in report.analysis["performance"].items():
                print(f"{name}: {ms:.0f} ms", file=sys.stderr)
        as_json = form == "json" or (form is None and output.endswith(".json"))
        text = report.to_json() if as_json else report.to_html(theme, offline=offline)
        with open(output, "w", encoding="utf-8") as f:
            f.write(text)
    except Exception as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    print(f"Report written to {output}")
    return 0


def script() -> None:
    """The console script."""
    sys.exit(main())
