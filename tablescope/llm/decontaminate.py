"""Benchmark decontamination (op 4): a positional inverted index, intersected from the rarest term.

DataFrame operations only. The texts are read once:

1. *index*: every map task turns its documents into postings (term, row, position) of the test
   windows' vocabulary and writes them sorted by term. The index is dealt by document, so a term's
   list is cut into one run for each task, however frequent the term is, and nothing is shuffled.
   One more posting for each document, of an end mark that no text can hold, keeps its key and
   its number of words.
2. *rarest first*: a window's terms are put in order by the lengths of their lists. The rarest
   term's list gives the places where the window may start.
3. *intersection*: the second rarest term's list, moved by its offset, is intersected with those
   places, then the lists of all other terms with what is left. What is left in the end is an
   exact phrase match.

The tables of the windows and of the places are written, so Spark broadcasts them only if their size
allows; beyond that the lists are joined by (row, term, position), which no frequent term makes hot.

Nulls: a null text or item has no words. A null item_id is an item shown as the empty string.
Rows are told apart by their place in the index, not by doc_id: rows that repeat a doc_id, or have
none, each get their own hits. Repeated items count once. Empty tables, on either side, give zero hits.
Extra columns are ignored, whatever their names; texts of any length are indexed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, digest, dropped, fresh, written

#: Words are runs of ASCII letters, digits and all non-ASCII characters; this is what lies between.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: The term that ends every document in the index, and its number.
END, END_ID = "\x00", -1


def tokens(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP), lambda w: w != "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, terms) windows of the items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("terms")).distinct()


@dataclass
class Index:
    """``phrases`` (phrase, terms), ``items`` (phrase, item_id), ``parts`` (phrase, size, offset, term), ``postings`` (term, row, at, key); ``paths`` of what was written."""

    phrases: DataFrame
    items: DataFrame
    parts: DataFrame
    postings: DataFrame
    paths: list[str]

    def ends(self) -> DataFrame:
        """(row, key, n_words) of every document."""
        return self.postings.where(F.col("term") == END_ID).select("row", "key", F.col("at").cast("long").alias("n_words"))

    def lists(self) -> DataFrame:
        return self.postings.where(F.col("term") != END_ID).select("term", "row", "at")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append(path)
        return out

    def close(self) -> None:
        """Delete the index; results that still read it must have been written."""
        dropped(self.postings.sparkSession, *self.paths)


def indexed(docs: DataFrame, benchmark: DataFrame, key: Column, window: int = WINDOW) -> Index:
    """The index of ``docs`` over the vocabulary of the test windows; ``key`` is what a document's end mark holds."""
    paths = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        paths.append(path)
        return out

    found = windows(benchmark, window)
    phrases = kept(found.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "op4-phrases")
    items = kept(found.join(phrases, "terms").select("phrase", "item_id"), "op4-items")
    spread = phrases.select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "word"))
    numbered = kept(spread.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "op4-vocabulary")
    parts = kept(spread.join(numbered, "word").select("phrase", "size", "offset", "term", "word"), "op4-parts")
    marks = docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(END_ID).cast("long").alias("term"))
    vocabulary = kept(numbered.union(marks), "op4-terms")
    d = docs.select(key.alias("key"), F.concat(tokens(docs["text"]), F.array(F.lit(END))).alias("w")).withColumn("row", F.monotonically_increasing_id())
    flat = d.select("row", "key", F.posexplode("w").alias("at", "word")).join(vocabulary, "word")
    postings = flat.select("term", "row", "at", F.when(F.col("term") == END_ID, F.col("key")).alias("key")).sortWithinPartitions("term", "row", "at")
    return Index(phrases, items, parts, kept(postings, "op4-postings"), paths)


def rated(index: Index) -> DataFrame:
    """``parts`` with the length of each term's list (0: in no document)."""
    n = index.lists().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return index.written(index.parts.join(n, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))), "op4-rated")


def phrase_hits(index: Index) -> DataFrame:
    """(row, phrase, start, size) of every exact match."""
    lists = index.lists()
    order = W.partitionBy("phrase").orderBy("n", "word", "offset")
    ranked = rated(index).withColumn("place", F.row_number().over(order)).withColumn("least", F.min("n").over(W.partitionBy("phrase")))
    # A term that never occurs has no list; a phrase that needs it can't occur either.
    ranked = index.written(ranked.where("least > 0").select("phrase", "size", "offset", "term", "place"), "op4-ranked")
    first = ranked.where("place = 1").select("phrase", "size", "offset", "term")
    second = ranked.where("place = 2").select("phrase", F.col("offset").alias("offset2"), F.col("term").alias("term2"))
    seeds = index.written(first.join(second, "phrase", "left"), "op4-seeds")
    starts = lists.join(seeds, "term").withColumn("start", F.col("at") - F.col("offset")).where("start >= 0")
    starts = index.written(starts.select("row", "phrase", "size", "start", F.col("term2").alias("term"), (F.col("start") + F.col("offset2")).alias("at")), "op4-starts")
    own = ["row", "phrase", "size", "start"]
    left = starts.where("size > 1").join(lists, ["row", "term", "at"], "left_semi").select(*own)
    left = index.written(left.union(starts.where("size = 1").select(*own)), "op4-left")
    rest = ranked.where("place > 2").select("phrase", "offset", "term")
    due = index.written(left.join(rest, "phrase").select(*own, "term", (F.col("start") + F.col("offset")).alias("at")), "op4-due")
    full = due.join(lists, ["row", "term", "at"], "left_semi").groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n = size - 2").select(*own)
    return index.written(full.union(left.where("size <= 2").select(*own)), "op4-hits")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact phrase matches: (doc_id, item_id, start, length), positions in words."""
    index = indexed(docs, benchmark, docs["doc_id"].cast("long"), window)
    named = phrase_hits(index).join(index.items, "phrase").join(index.ends(), "row")
    return named.select(F.col("key").alias("doc_id"), "item_id", "start", F.col("size").alias("length"))


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = 5, share: float = 0.8, window: int = WINDOW) -> DataFrame:
    """Places where at least ``share`` of a window's distinct terms lie within ``slop`` words of its extent, as
    one of its rarest terms places it: (doc_id, item_id, start, length, found).

    A window of n distinct terms of which m must be found is looked up by its n - m + 1 rarest, of
    which any match holds one; terms that the corpus lacks are the rarest of all.
    """
    index = indexed(docs, benchmark, docs["doc_id"].cast("long"), window)
    lists = index.lists()
    once = rated(index).groupBy("phrase", "size", "term", "word", "n").agg(F.min("offset").alias("offset"))
    every = W.partitionBy("phrase")
    once = once.withColumn("distinct", F.count(F.lit(1)).over(every)).withColumn("place", F.row_number().over(every.orderBy("n", "word")))
    once = index.written(once, "op4-once")
    seeds = index.written(once.where(F.col("place") <= F.col("distinct") - F.ceil(F.col("distinct") * share - 1e-9) + 1).select("phrase", "size", "distinct", "term", "offset"), "op4-seeds")
    placed = index.written(lists.join(seeds, "term").select("row", "phrase", "size", "distinct", (F.col("at") - F.col("offset")).alias("first")).distinct(), "op4-placed")
    around = placed.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - slop), F.col("first") + F.col("size") - 1 + slop)).alias("at"))
    own = ["row", "phrase", "size", "distinct", "first"]
    seen = around.join(lists, ["row", "at"]).join(once.select("phrase", "term"), ["phrase", "term"]).groupBy(*own).agg(F.count_distinct("term").alias("k"))
    near = seen.withColumn("found", F.col("k") / F.col("distinct")).where(F.col("found") >= share - 1e-9)
    named = near.join(index.items, "phrase").join(index.ends(), "row")
    start, length = F.greatest(F.lit(0), F.col("first") - slop).alias("start"), (F.col("size") + 2 * slop).alias("length")
    return named.groupBy("row", F.col("key").alias("doc_id"), "item_id", start, length).agg(F.max("found").alias("found")).drop("row")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, item_ids (sorted), contaminated."""
    index = indexed(docs, benchmark, docs["doc_id"].cast("long"), window)
    hits = phrase_hits(index)
    spots = hits.select("row", "start", "size").distinct().select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at")).distinct()
    n_hit = spots.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = hits.select("row", "phrase").distinct().join(index.items, "phrase").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    per_row = index.written(n_hit.join(ids, "row"), "op4-judged")
    joined = index.ends().join(per_row, "row", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(F.col("key").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def without_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows in whose text no window occurs, all columns as they are.

    Whether a window occurs depends on the text alone, so rows go by the digest of theirs.
    """
    index = indexed(docs, benchmark, digest(docs["text"]), window)
    key = fresh(docs.columns, "hit")
    gone, _ = written(phrase_hits(index).select("row").distinct().join(index.ends(), "row").select(F.col("key").alias(key)).distinct(), "op4-gone")
    index.close()
    return docs.join(gone, digest(docs["text"]) == gone[key], "left_anti")
