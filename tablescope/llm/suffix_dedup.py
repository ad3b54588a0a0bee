"""Suffix-array dedup (op 9): bytes covered by a 100-byte string that also starts earlier.

A difference cover D of the residues modulo 57 has 8 members, and for any two positions there is
a shift below 57 that brings both into D. So two equal strings of 100 bytes always hold two equal
sampled substrings of 44 bytes at the same shift. The steps of the difference-cover suffix sort,
bounded at the depth that the question needs (100 bytes).
Documents whose whole text an earlier one has are covered from end to end and leave first. Then:

1. *sample and sort*: the 44-byte substrings at covered positions are sorted by key in buckets;
   equal neighbours share a name, a substring without an equal neighbour can't be in a repeat.
2. *merge the remaining suffixes*: each suffix that has a repeated sample within reach is ranked
   by its full 100-byte prefix, the only depth that equality needs (naming recursion stops there).
3. *compare neighbours*: of each run of equal prefixes the first position in document order
   stays, and what the others cover is removed.

Order inside a bucket is that of prefix fingerprints, not of bytes: adjacency of equal
prefixes is all that is used. See the README for why the full recursion does not fit the disk.

Documents are cut into pieces by ranges of doc_id and text, so "earlier" between pieces is the order
of pieces and keys travel without positions. Nulls: a null text is empty; a null doc_id comes first.
Rows that repeat a doc_id are documents in the order of their text. Matches never cross documents.
An empty table gives no rows; extra columns are ignored, whatever their names. A text of any length
is one document of one piece, and is read whole. What is removed is decided by 88-bit keys: of n
candidate prefixes some n^2 / 2^89 pairs collide by chance, less than one for 10^13 of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census
from .common import dropped, released, written

#: A perfect difference set modulo 57: its differences are all residues, each once. Fixed values.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE_BITS = 50
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
#: One fixed random 64-bit number for each byte value.
TABLE = census.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TABLE2 = census.mixed(TABLE)


class Piece:
    """The bytes of a piece's documents, one after the other, in document order."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("row")
        self.doc_ids = table["doc_id"]
        texts = pc.fill_null(table["text"], "").cast(pa.large_binary())
        self.n = pc.binary_length(texts).to_numpy().astype(np.int64)
        self.buf = np.frombuffer(b"".join(b for c in texts.chunks for b in c.to_pylist()), np.uint8)
        self.end = np.cumsum(self.n)
        self.begin = self.end - self.n

    def rolled(self, width: int, use: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that start where ``use`` is true."""
        roller, starts = census.Roller(width, census.Roller.SECOND) if second else census.Roller(width), np.flatnonzero(use).astype(np.int32)
        codes = TABLE2 if second else TABLE
        segments = list(roller.segments(len(self.buf)))
        cuts = np.searchsorted(starts, np.array([b for _, b in segments], np.int32)).tolist()
        found = []
        for (a, b), done, upto in zip(segments, [0, *cuts], cuts, strict=False):
            if upto > done:
                found.append(roller.hashes(codes[self.buf[a : b + width - 1]], starts[done:upto] - a))
        return starts, np.concatenate(found) if found else np.empty(0, np.uint64)

    def inside(self, width: int) -> np.ndarray:
        """Where a window of this width ends in the document that it starts in."""
        use = np.ones(len(self.buf), bool)
        for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            use[max(a, b - width + 1) : b] = False
        return use

    def covered(self) -> np.ndarray:
        """Positions whose offset in the document is in the difference cover."""
        one = np.isin(np.arange(PERIOD), COVER)
        tile = np.tile(one, int(self.n.max(initial=0)) // PERIOD + 1)
        use = np.empty(len(self.buf), bool)
        for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            use[a:b] = tile[: b - a]
        return use


def sample_keys(piece: Piece, length: int) -> tuple[np.ndarray, np.ndarray]:
    starts, h = piece.rolled(length, piece.covered() & piece.inside(length))
    return starts, h >> np.uint64(64 - SAMPLE_BITS)


Suffixes = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, keys, second hashes


def candidate_keys(piece: Piece, names: np.ndarray, length: int, window: int) -> Suffixes:
    """Starts, keys and second hashes of the suffixes with a repeated sample in reach."""
    if not len(names):
        return np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint32)
    starts, keys = sample_keys(piece, length)
    at = starts[census.member(keys, names)]
    reach = np.bincount(np.maximum(at - (PERIOD - 1), 0), minlength=len(piece.buf) + 1).astype(np.int32)
    reach -= np.bincount(at + 1, minlength=len(piece.buf) + 1)
    use = (np.cumsum(reach[:-1], dtype=np.int32) > 0) & piece.inside(window)
    starts, keys = piece.rolled(window, use)
    return starts, keys, census.second(piece.rolled(window, use, second=True)[1])


def later_copies(dealt: DataFrame, window: int) -> DataFrame:
    """(piece, row) of the documents whose whole text an earlier one has: every byte of theirs is covered.

    Only texts as long as a window.
    """
    d = dealt.where(F.octet_length("text") >= window).select("piece", "row", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    return d.join(first, "sha").where("row > first").select("piece", "row")


def without(table: pa.Table, replies: pa.Table) -> tuple[pa.Table, pa.Table]:
    """A piece's documents without the later copies, and those copies."""
    rows = replies["row"].drop_null()
    copy = pc.is_in(table["row"], value_set=rows.combine_chunks() if len(rows) else pa.array([], pa.int64()))
    return table.filter(pc.invert(copy)), table.filter(copy)


def remove_repeats(docs: DataFrame, window: int = 100, piece_bytes: int = census.PIECE_BYTES) -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs, and the kept bytes."""
    if window < PERIOD + 7:
        raise ValueError(f"window must be at least {PERIOD + 7} bytes")
    spark, length = docs.sparkSession, window - PERIOD + 1
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    (total,) = census.sizes(docs, census.text_bytes())
    pieces = max(1, -(-total // piece_bytes))
    buckets = census.Buckets.of(total * len(COVER) // PERIOD + 1, pieces)
    dealt = census.dealt(docs, pieces, "op9_pieces", ordered=True)
    released(spark)
    nothing = {"keys": "binary", "extra": "binary", "row": "long"}

    def reply(df: DataFrame, phase: int) -> DataFrame:
        """What is sent to the pieces: keys of a phase (1, 2) or rows that leave (0)."""
        return df.select("piece", F.lit(phase).alias("phase"), *[c if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])

    copies, _ = written(reply(later_copies(dealt, window), 0), "op9-copies")
    released(spark)

    def sample(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return census.packed_table([], [], [])
        _, keys = sample_keys(Piece(without(table, replies)[0]), length)
        keys.sort()
        if not len(keys):
            return census.packed_table([], [], [])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        flags = (np.diff(np.append(first, len(keys))) > 1).astype(np.uint64)
        return census.sent(key[0].as_py(), (keys[first] << np.uint64(1)) | flags, buckets, SAMPLE_BITS + 1)

    def equal_neighbours(key: np.ndarray, piece: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.zeros(0, bool)
        n = np.diff(np.append(starts, len(key)))
        return np.repeat((n > 1) | (np.bitwise_or.reduceat(key & np.uint64(1), starts) > 0), n)

    samples = dealt.groupBy("piece").cogroup(copies.groupBy("piece")).applyInArrow(sample, census.PACKED)
    names, _ = written(census.answered(samples, buckets, equal_neighbours, 1, SAMPLE_BITS + 1), "op9-names")
    del samples
    released(spark)
    replies = copies.unionByName(reply(names, 1))

    def merge(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return census.packed_table([], [], [])
        _, keys, extra = candidate_keys(Piece(without(table, replies)[0]), census.received(of_phase(replies, 1))[0], length, window)
        order = np.lexsort((extra, keys))
        keys, extra = keys[order], extra[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (extra[1:] != extra[:-1])))) if len(keys) else order
        return census.sent(key[0].as_py(), keys[first], buckets, extra=extra[first])

    def not_first(key: np.ndarray, piece: np.ndarray, starts: np.ndarray) -> np.ndarray:
        # Pieces come sorted inside a group: all but the first hold a later copy.
        mask = np.ones(len(key), bool)
        mask[starts] = False
        return mask

    suffixes = dealt.groupBy("piece").cogroup(replies.groupBy("piece")).applyInArrow(merge, census.PACKED)
    later, _ = written(census.answered(suffixes, buckets, not_first), "op9-later")
    del suffixes
    released(spark)
    replies = replies.unionByName(reply(later, 2))

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result(pa.array([], pa.int64()), [], [], [], [])
        table, copy = without(table, replies)
        p, copy = Piece(table), Piece(copy)
        starts, keys, extra = candidate_keys(p, census.received(of_phase(replies, 1))[0], length, window)
        at = starts[repeats(keys, extra, *census.received(of_phase(replies, 2)))]
        cover = np.bincount(at, minlength=len(p.buf) + 1).astype(np.int32)
        cover -= np.bincount(at + window, minlength=len(p.buf) + 1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        n_removed, n_spans, kept = [], [], []
        for a, b in zip(p.begin.tolist(), p.end.tolist(), strict=True):
            g = gone[a:b]
            n_removed.append(int(g.sum()))
            n_spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + (b > a and bool(g[0]))))
            kept.append((p.buf[a:b][~g] if n_removed[-1] else p.buf[a:b]).tobytes())
        gone_whole = copy.n.tolist()
        ids = pa.chunked_array([*p.doc_ids.chunks, *copy.doc_ids.chunks], pa.int64())
        return result(ids, [*p.n.tolist(), *gone_whole], n_removed + gone_whole, n_spans + [1] * len(gone_whole), kept + [b""] * len(gone_whole))

    return dealt.groupBy("piece").cogroup(replies.groupBy("piece")).applyInArrow(cut, OUT)


def of_phase(replies: pa.Table, phase: int) -> pa.Table:
    return replies.filter(pc.equal(replies["phase"], phase))


def repeats(keys: np.ndarray, extra: np.ndarray, earlier: np.ndarray, earlier_extra: np.ndarray) -> np.ndarray:
    """Which suffixes aren't the first with their prefix: those after the first here, or all if an earlier piece has it."""
    out = np.zeros(len(keys), bool)
    if not len(keys):
        return out
    order = np.lexsort((extra, keys))  # stable: equal ones stay in the order of their starts
    keys, extra = keys[order], extra[order]
    first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (extra[1:] != extra[:-1])))
    out[order] = ~first | census.member(keys, earlier, extra, earlier_extra)
    return out


def result(ids, n_bytes, n_removed, n_spans, kept) -> pa.Table:
    return pa.table({"doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def brute_force(rows: list[tuple[int, str | None]], window: int = 100) -> dict:
    """Reference for tests: {doc_id: (n_bytes, n_removed, n_spans, sha256 of the kept bytes)}."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if (k := b[i : i + window]) in seen:
                gone[i : i + window] = True
            seen.add(k)
        spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out
