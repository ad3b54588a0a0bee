"""Substring dedup (op 1): exact repeats of at least ``window`` words, found by fixed-block anchors.

Every window of 35 words holds a whole aligned block of 18 words, whichever document it is in.
So (1) the aligned blocks are the index, and every rolling window of 18 words probes it: a key
census keeps the keys that are an aligned block somewhere and occur at least twice; (2) each hit
is extended: the 35-word windows around it go through a second census over 64-bit keys, and runs
of repeated windows are the maximal exact repeats; (3) their words are removed.

Nulls: a null text has no words; a null doc_id is a document like any other. Rows that repeat a
doc_id are documents of their own. Empty tables give empty results, extra columns are ignored,
whatever their names. A text of any length is one document of one piece, and is read whole.
What is removed is decided by 87-bit keys: of n candidate windows some n^2 / 2^88 pairs collide by
chance, less than one pair in 10^13 windows (100 TB); blocks only choose candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census
from .common import dropped, released, written

BLOCK_BITS = 50
OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first:long,last:long>>"


class Piece:
    """The words of a piece's documents in one row, with what hashing needs."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("row")
        self.doc_ids = table["doc_id"]
        texts = pc.fill_null(table["text"].combine_chunks(), "")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat, row = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        self.words, row = flat.filter(pa.array(full)), row[full]
        coded = self.words.dictionary_encode()
        digests = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.symbols = digests[coded.indices.to_numpy()] if len(digests) else np.empty(0, np.uint64)
        self.n = np.bincount(row, minlength=len(texts)).astype(np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.offset = np.arange(len(row)) - np.repeat(self.begin, self.n)
        self.left = np.repeat(self.n, self.n) - self.offset  # words from here to the document's end

    def rolled(self, width: int, use: np.ndarray | None = None, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows that lie in one document (and start where ``use`` says), and their hashes."""
        roller = census.Roller(width, census.Roller.SECOND) if second else census.Roller(width)
        starts, found = np.flatnonzero((self.left >= width) & use if use is not None else self.left >= width), []
        symbols = census.mixed(self.symbols) if second else self.symbols
        segments = list(roller.segments(len(symbols)))
        cuts = np.searchsorted(starts, [b for _, b in segments]).tolist()
        for (a, b), done, upto in zip(segments, [0, *cuts], cuts, strict=False):
            if upto > done:
                found.append(roller.hashes(symbols[a : b + width - 1], starts[done:upto] - a))
        return starts, np.concatenate(found) if found else np.empty(0, np.uint64)

    def windows(self, width: int, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, 64-bit keys and second hashes of the windows that start where ``use`` says."""
        starts, keys = self.rolled(width, use)
        return starts, keys, census.second(self.rolled(width, use, second=True)[1])


def block_keys(piece: Piece, block: int) -> tuple[np.ndarray, np.ndarray]:
    starts, h = piece.rolled(block)
    return starts, h >> np.uint64(64 - BLOCK_BITS)


def distinct_flagged(keys: np.ndarray, aligned: np.ndarray) -> np.ndarray:
    """Sorted distinct keys with two flag bits: an aligned block here (1), more than once here (2)."""
    order = np.argsort(keys, kind="stable")
    keys, aligned = keys[order], aligned[order]
    if not len(keys):
        return keys
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    flags = np.logical_or.reduceat(aligned, first).astype(np.uint64) | ((np.diff(np.append(first, len(keys))) > 1).astype(np.uint64) << np.uint64(1))
    return (keys[first] << np.uint64(2)) | flags


def repeated(key: np.ndarray, piece: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Groups with an aligned block and at least two occurrences."""
    n = len(key)
    if not n:
        return np.zeros(0, bool)
    flags = np.bitwise_or.reduceat(key & np.uint64(3), starts)
    sizes = np.diff(np.append(starts, n))
    return np.repeat(((flags & np.uint64(1)) > 0) & ((sizes > 1) | ((flags & np.uint64(2)) > 0)), sizes)


def candidates(piece: Piece, hits: np.ndarray, block: int, window: int) -> np.ndarray:
    """Starts of windows that hold a hit: a hit at p allows starts p - (window - block) .. p."""
    reach = np.zeros(len(piece.symbols) + 1, np.int32)
    starts, h = block_keys(piece, block)
    at = starts[census.member(h, hits)]
    np.add.at(reach, np.maximum(at - (window - block), 0), 1)
    np.add.at(reach, at + 1, -1)
    return np.cumsum(reach[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35, piece_bytes: int = census.PIECE_BYTES) -> DataFrame:
    """One row per document: words, removed words, kept text, and removed spans as word offsets."""
    spark, block = docs.sparkSession, (window + 1) // 2
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    (total,) = census.sizes(docs, census.text_bytes())
    pieces = max(1, -(-total // piece_bytes))
    buckets = census.Buckets.of(total // 6 + 1, pieces)
    dealt = census.dealt(docs, pieces, "op1_pieces", ordered=False)
    released(spark)

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        p = Piece(table)
        starts, keys = block_keys(p, block)
        return census.sent(key[0].as_py(), distinct_flagged(keys, p.offset[starts] % block == 0), buckets, BLOCK_BITS + 2)

    hits, hit_path = written(census.answered(dealt.groupBy("piece").applyInArrow(probe, census.PACKED), buckets, repeated, 2, BLOCK_BITS + 2), "op1-hits")
    released(spark)

    def extend(piece: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return census.packed_table([], [], [])
        p = Piece(table)
        _, key, extra = p.windows(window, candidates(p, census.received(replies)[0], block, window))
        if not len(key):
            return census.packed_table([], [], [])
        # The lowest bit of a key says that the window occurs more than once here.
        key &= ~np.uint64(1)
        order = np.lexsort((extra, key))
        key, extra = key[order], extra[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (extra[1:] != extra[:-1]))))
        flags = (np.diff(np.append(first, len(key))) > 1).astype(np.uint64)
        return census.sent(piece[0].as_py(), key[first] | flags, buckets, extra=extra[first])

    def twice(key: np.ndarray, piece: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.zeros(0, bool)
        flags, n = np.bitwise_or.reduceat(key & np.uint64(1), starts), np.diff(np.append(starts, len(key)))
        return np.repeat((flags > 0) | (n > 1), n)

    windows = dealt.groupBy("piece").cogroup(hits.groupBy("piece")).applyInArrow(extend, census.PACKED)
    matches, _ = written(census.answered(windows, buckets, twice, flag_bits=1), "op1-matches")
    dropped(spark, hit_path)
    released(spark)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        p = Piece(table)
        known, known_extra = census.received(replies)
        removed = np.zeros(len(p.symbols) + 1, np.int32)
        if len(known):
            starts, h = p.rolled(window)
            # The second hash is rolled only where the first has been found.
            use = np.zeros(len(p.symbols), bool)
            use[starts[census.member(h >> np.uint64(1), known)]] = True
            starts, h, extra = p.windows(window, use)
            at = starts[census.member(h >> np.uint64(1), known, extra, known_extra)]
            np.add.at(removed, at, 1)
            np.add.at(removed, at + window, -1)
        removed = np.cumsum(removed[:-1]) > 0
        n_removed, kept, spans = [], [], []
        for begin, n in zip(p.begin.tolist(), p.n.tolist(), strict=True):
            gone = removed[begin : begin + n]
            n_removed.append(int(gone.sum()))
            own = p.words.slice(begin, n)
            kept.append(" ".join((own.filter(pa.array(~gone)) if n_removed[-1] else own).to_pylist()))
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        return pa.table({"doc_id": p.doc_ids, "n_words": pa.array(p.n, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))})

    return dealt.groupBy("piece").cogroup(matches.groupBy("piece")).applyInArrow(lambda t, r: cut(t, r) if t.num_rows else empty(), OUT)


def empty() -> pa.Table:
    return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "spans": pa.array([], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))})


def brute_force(rows: list[tuple[int, str | None]], window: int = 35) -> dict:
    """Reference for tests: {doc_id: (n_words, n_removed, sha256 of the kept words)}."""
    split = {d: (t or "").encode().split() for d, t in rows}
    seen: dict = {}
    for w in split.values():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
