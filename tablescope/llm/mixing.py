"""Mixing sources to target weights (op 8), in DataFrame operations only.

1. Sizes in words are summed by source and by (source, shard); only sums cross the network.
2. Targets: sources share all words by weight, at most ``max_repeats`` times their own size. With
   the sources in order of cap / weight, the capped ones are a prefix, so the level at which the
   rest is shared has a closed form: one running sum over the sources.
3. Sainte-Lague: equal-token blocks go to the highest quotients target / (2 j + 1). The seats
   at the common divisor differ from the result by at most half the number of sources, so only
   the quotients next to that are ranked. The same rule deals a source's blocks to its shards.
4. A shard takes its quota from its documents in seeded order: whole passes first, then a
   prefix of the order, the last document in part. So no document is taken more than
   ``max_repeats`` times, and reruns agree.

A hot source is many shards, each a small window; sums and ranks over all sources, or all shards of a
source, are running ones over ranges, so no task holds them. Nulls: a null text has size 0; a null source
is a source, the last one; a null doc_id sorts first in its shard. Rows that repeat a doc_id
count each. An empty table gives no rows; extra columns are ignored, whatever their names. Equal
quotients go by the names of sources and the numbers of shards; a text of any length counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import running, same, words, written

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 16
#: Rows of a shard, about; a source has as many shards as its rows need.
SHARD_ROWS = 2_000
SEED = 42


def sized(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, size, and a seeded place in 60 bits of md5, alike in any engine."""
    rank = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.size(words(docs["text"].cast("string"))).cast("long").alias("size"), rank.alias("place"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """Adds ``target`` to (source, n_rows, source_size)."""
    by_name = {"source": F.col("source").asc_nulls_last()}
    weight = F.element_at(F.lit(list(weights)).cast("array<double>"), (F.col("place") % len(weights) + 1).cast("int"))
    t = running(sources, by_name, name="op8-sources").withColumn("weight", weight).drop("place").withColumn("cap", max_repeats * F.col("source_size"))
    t, _ = written(running(t, {"ratio": (F.col("cap") / F.col("weight")).asc(), **by_name}, ("cap", "weight"), name="op8-ratios"), "op8-levels")
    size, weight = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    t = t.withColumn("level", (F.lit(size) - F.col("before_cap")) / (F.lit(weight) - F.col("before_weight")))
    # The level is that of the first source below its cap; where all are capped, none is.
    free = t.where(F.col("level") * F.col("weight") < F.col("cap"))
    level = free.agg(F.min(F.struct("place", "level"))["level"]).first()[0]
    capped, share = F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight")
    return t.select("source", "n_rows", "source_size", F.when(share < F.col("cap"), share).otherwise(capped).alias("target"))


def apportioned(parties: DataFrame, votes: str, seats: Column, within: list[str], names: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Lague's seats for the votes of each party, in each group of ``within``.

    ``seats``: how many there are in the group. ``names`` order equal quotients. Shares are rounded
    at the common divisor; if that gives e seats too few (too many) of S to n parties, the e next
    quotients are given (the last taken back). The final divisor is within a share n / 2S of the
    common one, so a party takes part with its next share x n / 2S + 2 quotients, about 2 n in all.
    """
    own, group = [*within, *names], lambda d: d.select(*[F.col(c).alias(f"_of_{c}") for c in within], *[c for c in d.columns if c not in within])
    p, _ = written(parties.withColumn("_seats", seats), "op8-parties")
    totals, _ = written(group(p.groupBy(*within).agg(F.sum(votes).alias("_total"), F.count(F.lit(1)).alias("_n"))), "op8-totals")
    share = F.when(F.col("_total") > 0, F.col("_seats") * F.col(votes) / F.col("_total")).otherwise(F.lit(0.0))
    p = p.join(totals, same(p, totals, within, "_of_")).select(*p.columns, "_n", share.alias("_share")).withColumn("_near", F.floor(F.col("_share") + 0.5).cast("long"))
    given, _ = written(group(p.groupBy(*within).agg(F.sum("_near").alias("_given"))), "op8-given")
    p = p.join(given, same(p, given, within, "_of_")).select(*p.columns, (F.col("_seats") - F.col("_given")).alias("_off"))
    p, _ = written(p, "op8-near")
    most = F.least(F.abs("_off"), F.ceil(F.col("_share") * F.col("_n") / (2 * F.greatest(F.lit(1), F.col("_seats")))).cast("long") + 2)
    none = F.array().cast("array<bigint>")
    steps = F.when(F.col("_off") > 0, F.sequence(F.lit(0).cast("long"), most - 1)).when((F.col("_off") < 0) & (F.col("_near") > 0), F.sequence(F.lit(-1).cast("long"), -F.least(most, F.col("_near")))).otherwise(none)
    q = p.where("_off <> 0").select(*own, votes, "_off", "_near", F.explode(steps).alias("_step"))
    quotient = F.col(votes) / (2 * (F.col("_near") + F.col("_step")) + 1)
    order = {"q": F.when(F.col("_off") > 0, -quotient).otherwise(quotient).asc(), **{n: F.col(n).asc_nulls_last() for n in names}, "step": F.abs("_step").asc()}
    ranked = running(q, order, within=tuple(within), name="op8-quotients").where(F.col("place") < F.abs("_off"))
    moved = ranked.groupBy(*own).agg(F.sum(F.signum(F.col("_off").cast("double"))).cast("long").alias("_moved"))
    moved, _ = written(moved.select(*[F.col(c).alias(f"_of_{c}") for c in own], "_moved"), "op8-moved")
    return p.join(moved, same(p, moved, own, "_of_"), "left").select(*parties.columns, (F.col("_near") + F.coalesce(F.col("_moved"), F.lit(0))).alias("quota"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, max_repeats: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, quota (blocks of the shard), taken."""
    # Sizes are read several times below; written once, the texts are read once.
    d, _ = written(sized(docs), "op8-sizes")
    by_source = targets(d.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size")), weights, max_repeats)
    by_source, _ = written(by_source, "op8-targets")
    blocks = int(by_source.agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0)) / block_words + 0.5)).first()[0])
    quotas = apportioned(by_source.withColumn("_all", F.lit(1)), "target", F.lit(blocks).cast("long"), ["_all"], ["source"])
    quotas, _ = written(quotas.withColumnRenamed("quota", "source_quota").drop("_all").withColumnRenamed("source", "_source"), "op8-quotas")
    shards = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / shard_rows).cast("long"))
    # The sources' table is written, so it is broadcast if its size allows; beyond that a hot source is a skewed join that adaptive execution splits.
    dealt = d.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "place", "source_size", "target", "source_quota", F.pmod(F.col("place"), shards).alias("shard"))
    sums = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.min("source_quota").alias("source_quota"))
    by_shard = apportioned(sums, "shard_size", F.col("source_quota"), ["source"], ["shard"])
    by_shard, _ = written(by_shard.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "quota"), "op8-shards")
    filled = dealt.join(by_shard, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    words_due = F.least(F.col("quota") * block_words, max_repeats * F.col("shard_size"))
    w = W.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    filled = filled.withColumn("_due", words_due).withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("_due") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("_due") - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return filled.select("doc_id", "source", "size", "source_size", "target", "shard", "quota", taken.cast("long").alias("taken"))
