"""What several operators share: the shared folder, written tables, row numbers, byte-exact word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of its own; a cluster has to name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablescope-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path. Cuts lineage: a lost executor costs a reread.

    Spark knows the size of a table that is read again, so whether a join broadcasts it is decided by that size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing needs any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now rather than at its next half-hourly collection.

    Its cleaner removes a shuffle once the driver has collected the plan that made it; plans held
    from Python go in the first round and are collected in the second.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column is called so (Spark's names don't tell case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Words of a text (null: none) as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def digest(text: Column) -> Column:
    """SHA-256 of a whole text in UTF-8, lowercase hex; null counts as empty."""
    return F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def partitions_for(rows: int, per_task: int, least: int = 1) -> int:
    return max(least, -(-int(rows) // per_task))


def same(a: DataFrame, b: DataFrame, names: Iterable[str], prefix: str) -> Column:
    """Whether columns of ``a`` equal those of ``b`` whose names have a prefix; nulls are equal."""
    condition = F.lit(True)
    for n in names:
        condition = condition & a[n].eqNullSafe(b[prefix + n])
    return condition


def running(df: DataFrame, order: dict[str, Column], sums: tuple[str, ...] = (), within: tuple[str, ...] = (), name: str = "running") -> DataFrame:
    """``df`` with ``place`` (from 0) of each row and, as ``before_x``, the sums of ``sums`` over the rows before it, in its group.

    ``order``: sort expressions by a name. Rows are dealt by ranges, so no task holds a group,
    however large; only one row for each task and group is brought together.
    """
    groups = [F.col(g).asc_nulls_last() for g in within]
    placed, _ = written(df.repartitionByRange(*groups, *order.values()).withColumn("_p", F.spark_partition_id()), name)
    totals = placed.groupBy(*within, "_p").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = W.partitionBy(*within).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_of_{g}") for g in within], F.col("_p").alias("_of__p"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b{c}") for c in ("_n", *(f"_s_{x}" for x in sums))])
    offsets, _ = written(offsets, name)
    here = W.partitionBy(*within, "_p").orderBy(*order.values())
    until = here.rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(offsets, same(placed, offsets, [*within, "_p"], "_of_"))
    return joined.select(*df.columns, (F.col("_b_n") + F.row_number().over(here) - 1).alias("place"), *[(F.col(f"_b_s_{c}") + F.coalesce(F.sum(c).over(until), F.lit(0))).alias(f"before_{c}") for c in sums])
