"""Key census: which keys of one piece of the corpus occur elsewhere too?

The corpus is dealt once into pieces of documents, a table bucketed by piece that every phase reads
without moving the texts again. A piece sends its distinct 64-bit keys, cut into buckets by their
top bits and packed as sorted differences; the task of a bucket merges what all pieces sent and
answers each piece with those of its keys that occur elsewhere. A key that half the corpus shares
costs a bucket one entry for each piece, not one for each occurrence.

Packed, a key takes 4 to 6 bytes instead of the 24 of a shuffled row, which is what keeps the
disk of a census below the size of the text. Keys whose equality decides (``extra``) carry 24 more
bits of a second hash, 88 in all.

The number of buckets grows with the number of keys, so what a bucket's task holds doesn't. Where
a piece would send too few keys to each of so many buckets, it sends to coarse ones; their tasks,
each for one coarse bucket and a run of pieces, split what they get into the fine buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Text bytes of a piece; a task holds a few times this in memory. A larger executor takes larger pieces.
PIECE_BYTES = 12 << 20
#: Keys that a bucket's task merges at once.
BUCKET_KEYS = 3_000_000
#: Fewest keys that a piece sends to one bucket, so that rows grow in proportion to the corpus.
LEAST_KEYS = 1_000
#: Most buckets of the table of pieces; beyond that a bucket has several pieces, which are read one by one.
TABLE_BUCKETS = 50_000

PACKED = "piece int, bucket long, keys binary, extra binary"
MERGED = "bucket long, keys binary, extra binary, pieces binary"


def dealt(docs: DataFrame, pieces: int, name: str, ordered: bool) -> DataFrame:
    """(piece, row, doc_id, text), written once, bucketed by piece. ``row`` is a row's own number.

    ``ordered``: pieces are runs of the documents in order of doc_id (null first) and text, and row
    numbers follow that order; else rows are dealt evenly. Rows that share a doc_id, or have none,
    are spread by the beginnings of their texts; only rows equal in both stay together.
    """
    spark = docs.sparkSession
    if ordered:
        order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first()]
        docs = docs.repartitionByRange(pieces, *order).sortWithinPartitions(order[0], F.col("text").asc_nulls_first())
    else:
        docs = docs.repartition(pieces)
    table = f"{name}_{uuid.uuid4().hex}"
    out = docs.select(F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    out.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").bucketBy(min(pieces, TABLE_BUCKETS), "piece").saveAsTable(table)
    return spark.table(table)


@dataclass
class Buckets:
    """``coarse`` buckets that pieces send to, each of ``fine`` buckets that are merged; ``run``: pieces that one splitting task takes."""

    coarse: int
    fine: int
    run: int

    @classmethod
    def of(cls, keys: int, pieces: int) -> Buckets:
        wanted = max(1, -(-keys // BUCKET_KEYS))
        coarse = max(1, min(wanted, keys // pieces // LEAST_KEYS + 1))
        return cls(coarse, -(-wanted // coarse), max(1, BUCKET_KEYS * coarse * pieces // max(1, keys)))


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys as byte planes of their differences; the first byte is the number of planes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return bytes([planes]) + int(keys[0]).to_bytes(8, "little") + body


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    planes, n = blob[0], (len(blob) - 9) // blob[0]
    out = np.zeros((n + 1, 8), np.uint8)
    out[1:, :planes] = np.frombuffer(blob, np.uint8, planes * n, 9).reshape(planes, n).T
    keys = out.view(np.uint64).ravel()
    keys[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(keys, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads keys evenly over the buckets."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Roller:
    """Polynomial hashes, modulo 2^64, of every window of ``width`` symbols, segment by segment."""

    BASE = 0x9E3779B97F4A7C15 | 1
    #: Of the second hash.
    SECOND = 0xC2B2AE3D27D4EB4F | 1
    #: Windows hashed at once: the arrays of a segment stay in a core's cache.
    SEGMENT = 1 << 15

    def __init__(self, width: int, base: int = BASE):
        self.width, n = width, self.SEGMENT + width
        up = np.empty(n, np.uint64)
        up[0], up[1:] = 1, base
        self.up = np.cumprod(up, dtype=np.uint64)
        up[1:] = pow(base, -1, 1 << 64)
        self.down = np.cumprod(up, dtype=np.uint64)

    def segments(self, n: int) -> Iterator[tuple[int, int]]:
        """Window starts [a, b), a segment at a time."""
        for a in range(0, n - self.width + 1, self.SEGMENT):
            yield a, min(a + self.SEGMENT, n - self.width + 1)

    def hashes(self, symbols: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Of a segment's symbols (windows + width - 1 of them): all windows, or those that start at ``at``."""
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=sums[1:])
        if at is None:
            n = len(symbols) - self.width + 1
            return mixed((sums[self.width :] - sums[:n]) * self.down[:n])
        return mixed((sums[at + self.width] - sums[at]) * self.down[at])


def cut_at(keys: np.ndarray, first: int, number: int, total: int, key_bits: int) -> np.ndarray:
    """Where sorted keys pass into the next of ``number`` buckets from ``first`` on, of ``total`` that share the key space."""
    edges = np.array([(i << key_bits) // total for i in range(first + 1, first + number)], np.uint64)
    return np.searchsorted(keys, edges)


def sent(piece: int, keys: np.ndarray, buckets: Buckets, key_bits: int = 64, extra: np.ndarray | None = None) -> pa.Table:
    """The packed rows of one piece. ``keys``: distinct (with ``extra``) and sorted; their top bits name the bucket."""
    cut = cut_at(keys, 0, buckets.coarse, buckets.coarse, key_bits)
    parts = np.split(keys, cut)
    extras = np.split(extra, cut) if extra is not None else [None] * len(parts)
    rows = [(b, k, x) for b, (k, x) in enumerate(zip(parts, extras, strict=True)) if len(k)]
    return packed_table([piece] * len(rows), [b for b, _, _ in rows], [k for _, k, _ in rows], [x for _, _, x in rows])


#: Bytes of the second hash that travel with a key.
EXTRA_BYTES = 3


def pack_extra(extra: np.ndarray) -> bytes:
    """The lowest bytes of second hashes, plane by plane."""
    return np.ascontiguousarray(extra.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :EXTRA_BYTES].T).tobytes()


def unpack_extra(blob: bytes) -> np.ndarray:
    n = len(blob) // EXTRA_BYTES
    out = np.zeros((n, 4), np.uint8)
    out[:, :EXTRA_BYTES] = np.frombuffer(blob, np.uint8).reshape(EXTRA_BYTES, n).T
    return out.view(np.uint32).ravel()


def second(h: np.ndarray) -> np.ndarray:
    """What of a 64-bit hash serves as a second one."""
    return (h >> np.uint64(64 - 8 * EXTRA_BYTES)).astype(np.uint32)


def packed_table(pieces: list, buckets: list, keys: list, extras: list | None = None) -> pa.Table:
    extra = [pack_extra(x) if x is not None else None for x in extras] if extras else [None] * len(pieces)
    return pa.table({"piece": pa.array(pieces, pa.int32()), "bucket": pa.array(buckets, pa.int64()), "keys": pa.array([pack(k) for k in keys], pa.binary()), "extra": pa.array(extra, pa.binary())})


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # key, extra, piece


def in_order(key: np.ndarray, extra: np.ndarray, piece: np.ndarray, flag_bits: int = 0) -> Entries:
    """Sorted by key (without its flags) and second hash, equal ones as they come."""
    bare = key >> np.uint64(flag_bits)
    order = np.lexsort((extra, bare)) if extra.any() else np.argsort(bare, kind="stable")
    return key[order], extra[order], piece[order]


def from_pieces(table: pa.Table) -> Entries:
    """The entries of a bucket as pieces sent them, in the order of pieces."""
    table = table.sort_by("piece")
    keys = [unpack(b) for b in table["keys"].to_pylist()]
    extra = [unpack_extra(x) if x is not None else np.zeros(len(k), np.uint32) for k, x in zip(keys, table["extra"].to_pylist(), strict=True)]
    return np.concatenate(keys), np.concatenate(extra), np.repeat(table["piece"].to_numpy(), [len(k) for k in keys])


def from_runs(table: pa.Table) -> Entries:
    """The entries of a fine bucket as splitting tasks sent them, in the order of pieces."""
    parts = [(unpack(k), unpack_extra(x), np.frombuffer(p, np.int32)) for k, x, p in zip(*(table[c].to_pylist() for c in ("keys", "extra", "pieces")), strict=True)]
    key, extra, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(piece, kind="stable")
    return key[order], extra[order], piece[order]


def answered(keys: DataFrame, buckets: Buckets, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], flag_bits: int = 0, key_bits: int = 64) -> DataFrame:
    """Merge each bucket. ``keep(key, piece, start of each group)`` marks the entries to send back; keys come back without their flags."""

    def merge(table: pa.Table) -> pa.Table:
        key, extra, piece = in_order(*(from_runs if "pieces" in table.column_names else from_pieces)(table), flag_bits)
        bare = key >> np.uint64(flag_bits)
        mask = keep(key, piece, np.flatnonzero(np.concatenate(([True], (bare[1:] != bare[:-1]) | (extra[1:] != extra[:-1])))))
        bare, extra, piece = bare[mask], extra[mask], piece[mask]
        order = np.argsort(piece, kind="stable")
        bare, extra, piece = bare[order], extra[order], piece[order]
        pieces, first = np.unique(piece, return_index=True)
        if not len(pieces):
            return packed_table([], [], [])
        return packed_table(pieces.tolist(), [table["bucket"][0].as_py()] * len(pieces), np.split(bare, first[1:]), np.split(extra, first[1:]))

    if buckets.fine == 1:
        return keys.repartition(buckets.coarse, "bucket").groupBy("bucket").applyInArrow(merge, PACKED)

    def split(table: pa.Table) -> pa.Table:
        coarse = table["bucket"][0].as_py()
        key, extra, piece = in_order(*from_pieces(table))
        cut = cut_at(key, coarse * buckets.fine, buckets.fine, buckets.coarse * buckets.fine, key_bits)
        rows = [(coarse * buckets.fine + i, pack(k), pack_extra(x), p.astype(np.int32).tobytes()) for i, (k, x, p) in enumerate(zip(*(np.split(v, cut) for v in (key, extra, piece)), strict=True)) if len(k)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64())} | {c: pa.array([r[i] for r in rows], pa.binary()) for i, c in ((1, "keys"), (2, "extra"), (3, "pieces"))})

    runs = keys.withColumn("run", F.floor(F.col("piece") / buckets.run)).groupBy("bucket", "run").applyInArrow(split, MERGED)
    return runs.groupBy("bucket").applyInArrow(merge, PACKED)


def counts(starts: np.ndarray, n: int) -> np.ndarray:
    """For each entry, the size of its group."""
    sizes = np.diff(np.append(starts, n))
    return np.repeat(sizes, sizes)


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys that were sent back to a piece, sorted, with their second hashes."""
    keys = [unpack(b) for b in table["keys"].to_pylist() if b is not None]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    extra = [unpack_extra(x) for x, b in zip(table["extra"].to_pylist(), table["keys"].to_pylist(), strict=True) if b is not None]
    key, extra = np.concatenate(keys), np.concatenate(extra)
    order = np.lexsort((extra, key))
    return key[order], extra[order]


def member(keys: np.ndarray, of: np.ndarray, extra: np.ndarray | None = None, of_extra: np.ndarray | None = None) -> np.ndarray:
    """Which keys are in the sorted array ``of``, with the same second hash if there is one. A table of hashed bits rules most others out before the search."""
    out = np.zeros(len(keys), bool)
    if not len(of) or not len(keys):
        return out
    mask = np.uint64((1 << 23) - 1)
    table = np.zeros(1 << 23, bool)
    table[of & mask] = True
    maybe = np.flatnonzero(table[keys & mask])
    wanted = keys[maybe]
    at = np.searchsorted(of, wanted)
    while len(maybe):  # more than one round only for keys that differ in the second hash alone
        at[at == len(of)] = 0
        same = of[at] == wanted
        hit = same if extra is None else same & (of_extra[at] == extra[maybe])
        out[maybe[hit]] = True
        left = same & ~hit
        maybe, wanted, at = maybe[left], wanted[left], at[left] + 1
        left = at < len(of)
        maybe, wanted, at = maybe[left], wanted[left], at[left]
    return out


def sizes(docs: DataFrame, *measures) -> tuple[int, ...]:
    """Corpus-wide sums, as whole numbers."""
    return tuple(int(x or 0) for x in docs.agg(*measures).first())


def text_bytes():
    return F.sum(F.octet_length("text"))
