"""Exact dedup (op 2): a persistent digest index, bucketed and sorted by digest.

``DigestIndex`` is a table (text_sha256, keep_id, group_size), bucketed and sorted by digest, that
only grows. A batch is reduced to one row per digest before anything is joined, so a text that a
third of all rows share crosses the network once for each map task. Digests that are new to the
index are found by a sort-merge anti-join and appended; for digests that it holds already, the
batch's largest doc_id and number of rows are appended too, so that ``groups`` (one aggregation in
the buckets, without exchange) has the right values after any number of batches. The index side of
these joins needs no exchange either.

Nulls: a null text counts as empty; a null doc_id loses to any other. Rows that repeat a doc_id
are all returned by ``verdicts``; ``deduplicated`` keeps one row for each text, and of rows that
share doc_id and text the one whose columns have the smallest hash. A group whose ids are all null
has a null keep_id and keeps no row in ``verdicts``. Extra columns are ignored or passed on,
whatever their names; texts of any length are digested whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, dropped, fresh, partitions_for, shared_dir, written

#: A digest is hot if it has more rows than this, and more than one in ``HOT_SHARE`` of them all: so at most ``HOT_SHARE`` are.
HOT_ROWS, HOT_SHARE = 100_000, 10_000
#: Rows of a new index's bucket, about, and its most buckets; an index keeps the number that it was made with.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 50_000


def buckets_for(rows: int) -> int:
    return min(MOST_BUCKETS, partitions_for(rows, BUCKET_ROWS, 16))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of whole texts."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest(docs["text"]).alias("text_sha256"))


def grouped(digested: DataFrame) -> DataFrame:
    """One row per digest; partial aggregation comes before the shuffle."""
    return digested.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """``name`` is a table of the session's catalog; its files are in the shared folder unless ``path`` says otherwise."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 64, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        """All rows that were appended: one for each batch that has the digest."""
        return self.spark.table(self.name)

    def groups(self) -> DataFrame:
        """(text_sha256, keep_id, group_size) over all batches."""
        return self.read().groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def append(self, groups: DataFrame) -> None:
        writer = groups.select("text_sha256", "keep_id", "group_size").repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256").write
        writer.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def split(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The groups whose digest the index doesn't hold, by a sort-merge anti-join, and those whose digest it does."""
        if not self.exists():
            return groups, groups.limit(0)
        held = self.read().select("text_sha256").hint("merge")
        return groups.join(held, "text_sha256", "left_anti"), groups.join(held, "text_sha256", "left_semi")

    def add(self, digested: DataFrame) -> DataFrame:
        """Take in a batch of (doc_id, text_sha256); the groups that were new."""
        groups, path = written(grouped(digested), "op2-groups")
        new, held = self.split(groups)
        new, _ = written(new, "op2-new")
        held, held_path = written(held, "op2-held")
        self.append(new.unionByName(held))
        dropped(self.spark, path, held_path)
        return new


def verdicts(digested: DataFrame, index: DigestIndex) -> DataFrame:
    """Each row of (doc_id, text_sha256) with the id that stays, its group's size, and whether it is the one that stays.

    Rows of hot digests, at most ``HOT_SHARE`` digests, meet their group where they are: these
    groups are broadcast. All others are joined to the bucketed index.
    """
    n = digested.count()
    hot = index.groups().where(F.col("group_size") > max(HOT_ROWS, n // HOT_SHARE))
    hot, _ = written(hot, "op2-hot")
    few = digested.join(F.broadcast(hot), "text_sha256")
    rest = digested.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(index.groups().hint("merge"), "text_sha256")
    found = few.unionByName(rest)
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def judged(docs: DataFrame, batches: list[Column | str] | None = None, index: DigestIndex | None = None) -> DataFrame:
    """Digest the table once, take it into the index batch by batch, and give every row its verdict.

    ``batches``: conditions on doc_id that together hold for every row once; None: one batch.
    """
    digested, _ = written(digests(docs), "op2-digests")
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(digested.count()))
    for condition in batches or ["true"]:
        index.add(digested.where(condition))
    return verdicts(digested, index)


def deduplicated(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows that stay, one for each text, with the columns of ``docs``; with an index, those new to it, which are appended."""
    digested, path = written(digests(docs), "op2-digests")
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(digested.count()))
    new = index.add(digested)
    key, first = (fresh(docs.columns, c) for c in ("sha", "keep"))
    keep = new.select(F.col("text_sha256").alias(key), F.col("keep_id").alias(first))
    sha = digest(docs["text"])
    kept = docs.join(keep, (sha == keep[key]) & docs["doc_id"].eqNullSafe(keep[first]), "left_semi")
    # Only where rows repeat both doc_id and text is there more than one row to choose from.
    twice, _ = written(digested.groupBy("text_sha256", "doc_id").count().where("count > 1").select(F.col("text_sha256").alias(key), F.col("doc_id").alias(first)), "op2-twice")
    dropped(docs.sparkSession, path)
    if not twice.limit(1).count():
        return kept
    same = (digest(kept["text"]) == twice[key]) & kept["doc_id"].eqNullSafe(twice[first])
    row = F.struct(*[kept[c] for c in docs.columns])
    one = kept.join(twice, same, "left_semi").groupBy(digest(kept["text"]).alias(key)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return kept.join(twice, same, "left_anti").unionByName(one)
