"""Files as DataFrames, by extension."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, multiline: bool = False, schema: str | None = None) -> DataFrame:
    """Header and types from the file; with a ``schema`` (DDL) the file isn't read for its types first.

    ``multiline``: quoted line breaks are part of a value. Such a file can't be split among tasks.
    """
    reader = spark.read.options(header=True, multiLine=multiline, escape='"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_table(spark: SparkSession, data: Any) -> DataFrame:
    """A Spark DataFrame as it is; a pandas DataFrame or an Arrow table as one."""
    if isinstance(data, DataFrame) or not (hasattr(data, "to_pandas") or hasattr(data, "columns")):
        return data
    return spark.createDataFrame(data)


def read_excel(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """The sheet is read on the driver, as its format can't be split."""
    import pandas as pd

    try:
        sheet = pd.read_excel(path, **options)
    except ImportError as error:
        raise ImportError(f"reading {path} needs an Excel engine for pandas, such as openpyxl: {error}") from error
    for c in sheet.columns[sheet.dtypes == object]:
        sheet[c] = sheet[c].map(lambda x: None if pd.isna(x) else x if isinstance(x, (str, bytes)) else str(x))
    return spark.createDataFrame(sheet.rename(columns=str))


def read_any(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """By extension; an unknown one is tried as Parquet, then as CSV. A path that is not there, or may not be read, is an error."""
    name = path.lower().rstrip("/")
    if name.endswith(".parquet"):
        return read_parquet(spark, path)
    if name.endswith(".csv"):
        return read_csv(spark, path, multiline)
    if name.endswith((".xlsx", ".xls", ".xlsb")):
        return read_excel(spark, path)
    try:
        return read_parquet(spark, path)
    except Exception as error:  # Spark has no class of its own for this
        if not any(x in str(error) for x in ("is not a Parquet file", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER")):
            raise
        return read_csv(spark, path, multiline)
