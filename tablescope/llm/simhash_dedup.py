"""SimHash near-dedup (op 7): Gray-order hierarchical index over 64-bit fingerprints.

1. Fingerprints of whole texts, next to the scan; equal ones collapse to one row at once.
2. Two fingerprints within d bits agree on one of d + 1 disjoint bit blocks. Each fingerprint is
   sent once for each block, keyed by the block's bits; groups that share a block are sorted by
   Gray rank. A group with more than ``split_at`` members shares a hot block and is dealt again by
   the same rule over its other bits, as often as there are bits left to tell its members apart,
   before any task reads it.
3. Inside a group a tree of nodes over consecutive Gray ranks holds the bits that all members
   share. Pairs of nodes are compared from the root: differences on the shared bits add up, and a
   pair of whole groups is pruned once they exceed d. A group yields a spanning forest, so a
   cluster of n near copies gives n - 1 links and never its n^2 pairs.
4. Components: minimum labels with pointer jumping over the links, written out between rounds.

``without_near_copies``, the pipeline's near-dedup, needs the exact similarity of shingle sets. It groups
by shared rare shingles instead of bit blocks, searches each group in the same Gray-ordered tree,
there over parity maps of the sets, and confirms what it finds by the sets themselves.

Nulls: a null text has no words and fingerprint zero; a null doc_id is never the smallest of a
component unless it has only nulls. Rows that repeat a doc_id are all returned. Extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, partitions_for, written

SEED = 42
BITS = 64
#: Leaf size and fan-out of the tree over a group's Gray order.
LEAF, FAN = 32, 8
SPLIT_AT = 50_000
#: Edges of a task while components are found.
EDGES_A_TASK = 500_000


def shingle_hashes(text: str | None, k: int, seed: int = SEED) -> np.ndarray:
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w)] if len(w) < k else map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(g, seed) for g in grams), np.uint64) if w else np.empty(0, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if set in over half the hashes; of none, zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), k)) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def gray_order(x: np.ndarray) -> np.ndarray:
    """The order by Gray rank of fingerprints of several words, (n, words), the first word leading."""
    rank = gray_rank(x)
    odd = (np.cumsum(np.bitwise_count(x), 1, dtype=np.int64) - np.bitwise_count(x)) & 1  # of the words before
    rank = np.where(odd == 1, ~rank, rank)
    return np.lexsort(rank.T[::-1])


class GrayTree:
    """Levels of nodes over a Gray-ordered array: first member, shared bits (mask), their pattern.

    ``fp`` is (n,) or, for longer fingerprints, (n, words).
    """

    def __init__(self, fp: np.ndarray):
        self.fp, self.levels = fp.reshape(len(fp), -1), []
        ones, any_ = self.fp, self.fp
        while True:
            cut = np.arange(0, len(ones), LEAF if not self.levels else FAN)
            ones, any_ = np.bitwise_and.reduceat(ones, cut), np.bitwise_or.reduceat(any_, cut)
            self.levels.append((~(ones ^ any_), ones))
            if len(ones) == 1:
                break
        self.levels.reverse()

    def largest(self, values: np.ndarray) -> list[np.ndarray]:
        """The largest value under each node, level by level from the root, then the members' own."""
        out = [values]
        while len(out) <= len(self.levels):
            out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), LEAF if len(out) == 1 else FAN)))
        return out[::-1]

    def near(self, allowed: Callable[[int, np.ndarray, np.ndarray], np.ndarray | int], chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) that differ in at most ``allowed(level, i, j)`` bits, in chunks.

        Whole pairs of nodes are pruned on their shared bits: what they differ in there adds up on
        the way down. For nodes, ``allowed`` is the most that any pair below them may differ in; the
        members' level is ``len(levels)``.
        """
        words_ = self.fp.shape[1]
        chunk, slice_, bottom = max(64, chunk // words_), max(16, 512 // words_), len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        stack = [(0, zero, zero, np.zeros((1, words_), np.uint64), np.zeros(1, np.int64))]
        while stack:
            level, a, b, seen, acc = stack.pop()
            if len(a) > chunk:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:], seen[half:], acc[half:]), (level, a[:half], b[:half], seen[:half], acc[:half])]
                continue
            mask, pattern = self.levels[level]
            shared = mask[a] & mask[b]
            acc = acc + np.bitwise_count((pattern[a] ^ pattern[b]) & shared & ~seen).sum(1, dtype=np.int64)
            keep = acc <= allowed(level, a, b)
            a, b, seen, acc = a[keep], b[keep], shared[keep], acc[keep]
            if not len(a):
                continue
            fan, n = (LEAF, len(self.fp)) if level == bottom else (FAN, len(self.levels[level + 1][0]))
            grid = np.arange(fan)
            step = slice_ if level == bottom else len(a)
            for s in range(0, len(a), step):
                i = (a[s : s + step, None, None] * fan + grid[:, None]).repeat(fan, 2)
                j = (b[s : s + step, None, None] * fan + grid[None, :]).repeat(fan, 1)
                if level < bottom:
                    ok = (i <= j) & (j < n)
                    own = np.broadcast_to(np.arange(len(a))[:, None, None], i.shape)[ok]
                    stack.append((level + 1, i[ok], j[ok], seen[own], acc[own]))
                    continue
                ok = (i < j) & (j < n)
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(1, dtype=np.int64) <= allowed(level + 1, i, j)
                yield i[ok], j[ok]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label of each of n members: the smallest index of its component."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            li, lj = label[i], label[j]
            differ = li != lj
            if not differ.any():
                break
            i, j, li, lj = i[differ], j[differ], li[differ], lj[differ]
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            while (label != label[label]).any():
                label = label[label]
    return label


def blocks(bits: list[int], parts: int) -> list[list[int]]:
    """The bits in ``parts`` runs of about equal length."""
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def group_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one group, as (member, smallest member of its component)."""
    fp = fp[np.argsort(gray_rank(fp), kind="stable")]
    label = forest(len(fp), GrayTree(fp).near(lambda level, a, b: distance))
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed_by(prints: DataFrame, layouts: dict[int, list[int]]) -> DataFrame:
    """(fp, layout, key): each fingerprint once for each layout, a list of bits, keyed by these bits."""
    masks = {i: signed(sum(1 << b for b in bits)) for i, bits in layouts.items()}
    spread = F.array(*[F.struct(F.lit(i).alias("layout"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in masks.items()])
    return prints.select("fp", F.explode(spread).alias("k")).select("fp", "k.layout", "k.key")


def groups(prints: DataFrame, distance: int, split_at: int) -> Iterator[DataFrame]:
    """(fp, layout, key): groups of fingerprints, so that any two within ``distance`` are in one.

    Two that agree on a group's bits and are within the distance agree on one of d + 1 blocks of
    the other bits as well. So a group of more than ``split_at`` members is dealt again by these
    blocks, each group by itself, as often as there are bits left to tell its members apart.
    """
    layouts = dict(enumerate(blocks(list(range(BITS)), distance + 1)))
    keyed = keyed_by(prints, layouts)
    while True:
        splits = [i for i, bits in layouts.items() if BITS - len(bits) > 2 * (distance + 1)]
        hot = keyed.where(F.col("layout").isin(splits)).groupBy("layout", "key").count().where(F.col("count") > split_at).select("layout", "key")
        hot, path = written(hot, "op7-hot")
        which = sorted(r[0] for r in hot.select("layout").distinct().collect())  # no more than there are layouts
        if not which:
            yield keyed
            dropped(prints.sparkSession, path)
            return
        yield keyed.join(hot, ["layout", "key"], "left_anti").select("fp", "layout", "key")
        again, number, finer = None, 0, {}
        for i in which:
            own = keyed.where(F.col("layout") == i).join(hot, ["layout", "key"], "left_semi").select("fp")
            rest = [b for b in range(BITS) if b not in set(layouts[i])]
            deeper = {number + j: layouts[i] + block for j, block in enumerate(blocks(rest, distance + 1))}
            part = keyed_by(own, deeper)
            again = part if again is None else again.union(part)
            number, finer = number + len(deeper), finer | deeper
        layouts = finer
        keyed, _ = written(again, "op7-deeper")


def links(prints: DataFrame, distance: int = 2, split_at: int = SPLIT_AT) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect whatever is connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(group: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fp = np.concatenate(group)
            if len(fp) > 1:
                a, b = group_links(fp.view(np.uint64), distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            fp, layout, key = (batch.column(c).to_numpy() for c in ("fp", "layout", "key"))
            cut = np.flatnonzero((np.diff(layout) != 0) | (np.diff(key) != 0)) + 1
            edges = [0, *cut.tolist(), len(fp)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                k = (int(layout[a]), int(key[a]))
                if held and held[0] == k:
                    held[1].append(fp[a:b])
                else:
                    if held and (len(held[1]) > 1 or len(held[1][0]) > 1):
                        yield from done(held[1])
                    held = (k, [fp[a:b]])
        if held:
            yield from done(held[1])

    out = None
    for part in groups(prints, distance, split_at):
        found = part.repartition("layout", "key").sortWithinPartitions("layout", "key").mapInArrow(run, "a long, b long")
        out = found if out is None else out.union(found)
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges but the roots; the root is the smallest node of its component.

    Rounds of "link to the smallest neighbour, then jump": edges are replaced by edges between the
    neighbours' smallest, so chains halve; the number of rounds is logarithmic in a chain's length.
    """
    spark = edges.sparkSession
    e, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while True:
        # As many tasks as the edges need; what is dealt by a node stays dealt for the grouping and the join after.
        parts = partitions_for(e.count(), EDGES_A_TASK)
        # Large star: every neighbour that is larger than a node points to the node's smallest.
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).toDF("n", "m").repartition(parts, "n")
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("lo"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("a"), F.col("lo").alias("b")).repartition(parts, "a").distinct()
        # Small star: a node's smaller neighbours and the node itself point to the smallest of them.
        lows = large.groupBy("a").agg(F.min("b").alias("lo"))
        small = large.join(lows, "a").select(F.when(F.col("b") == F.col("lo"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("lo").alias("b")).where("a <> b")
        nxt, nxt_path = written(small.repartition(parts, "a").distinct(), name)
        # Stars all: no node is both a leaf and a root, and no leaf has two roots.
        ends = nxt.select(F.col("a").alias("x"), F.lit(1).alias("leaf")).union(nxt.select("b", F.lit(0))).repartition(parts, "x")
        unsettled = ends.groupBy("x").agg(F.sum("leaf").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 OR (up = 1 AND n > 1)").limit(1).count()
        dropped(spark, path)
        e, path = nxt, nxt_path
        if not unsettled:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clustered(prints: DataFrame, distance: int = 2) -> DataFrame:
    """``prints`` (doc_id, fp, more columns) with component_id, the smallest doc_id reachable."""
    unique = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    unique, _ = written(unique, "op7-prints")
    roots = components(links(unique.select("fp"), distance), "op7-components")
    rooted = unique.join(roots, unique["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``."""
    prints, _ = written(fingerprints(docs, k), "op7-documents")
    return clustered(prints, distance)


# --- Similarity of at least 0.8 on five-word shingles: candidates by shared rare shingles, each confirmed ---

#: Fewest bits of a set's parity map.
LEAST_BITS = 64


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles; of a shorter text, all its words as one."""
    w = (text or "").encode().lower().split()
    return {tuple(w)} if len(w) < k else set(zip(*(w[i:] for i in range(k)), strict=False))


def parity_map(hashes: np.ndarray) -> bytes:
    """Bit b is the parity of the number of (distinct) hashes that fall on b: two maps differ in no more bits than their sets in members.

    The width is the power of two from the number of hashes on, so that the map of a long text
    tells as much as that of a short one. Folding a map's halves on each other gives the narrower map.
    """
    bits = max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else LEAST_BITS
    odd = (np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def folded(blobs: list[bytes], width: int) -> np.ndarray:
    """Maps of ``width`` bytes or more as rows of 64-bit words, folded to that width."""
    out = np.empty((len(blobs), width // 8), np.uint64)
    lengths = np.array([len(x) for x in blobs], np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        wide = np.frombuffer(b"".join([blobs[i] for i in at.tolist()]), np.uint64).reshape(len(at), n // width, width // 8)
        out[at] = np.bitwise_xor.reduce(wide, axis=1)
    return out


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits each map of ``a`` differs from that of ``b``, at the narrower width of the two."""
    out = np.empty(len(a), np.int64)
    widths = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w).tolist()
        out[at] = np.bitwise_count(folded([a[i] for i in at], w) ^ folded([b[i] for i in at], w)).sum(1, dtype=np.int64)
    return out


def possible(n_a: np.ndarray, n_b: np.ndarray, apart: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many members can have this Jaccard similarity."""
    alike = np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-9
    return alike & (apart <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-9)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, doc_id, leader) for each key of two or more documents; the leader is the smallest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader, first = None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            key, ids = b.column("key").to_numpy(), b.column("doc_id").to_numpy()
            new = np.concatenate(([last is None or key[0] != last], np.diff(key) != 0))
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lead = np.where(start >= 0, ids[start], leader)
            # A leader is sent along with the second member of its key.
            second = ~new & np.concatenate(([first], new[:-1]))
            last, leader, first = key[-1], lead[-1], new[-1]
            columns = [np.concatenate((key[~new], key[second])), np.concatenate((ids[~new], lead[second])), np.concatenate((lead[~new], lead[second]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "doc_id", "leader"])

    return keyed.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(run, "key long, doc_id long, leader long")


def bounded(pairs: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and parity maps allow the similarity."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("map").alias(f"map_{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n_a, n_b = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
                apart = differing(b.column("map_a").to_pylist(), b.column("map_b").to_pylist())
                yield b.select(["a", "b"]).filter(pa.array(possible(n_a, n_b, apart, similarity)))

    return both.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, similarity: float, k: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity, compared as they stand."""
    both = pairs
    for c in ("b", "a"):
        both = both.join(docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, set()
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                if held != (text_a.as_py(),):
                    held = (text_a.as_py(),)
                    own = shingle_set(held[0], k)
                other = shingle_set(text_b.as_py(), k)
                common = len(own & other)
                keep.append(common >= similarity * (len(own) + len(other) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


#: Groups of up to this many members are compared pair by pair, larger ones through the tree.
SMALL = 32


def pairs_in_tree(root: np.ndarray, n: np.ndarray, maps: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one group in different components that may have the similarity.

    Members are in the order of their components, and of Gray rank in each, so that whole nodes of
    one component are pruned like those that differ in too many shared bits.
    """
    width = np.array([len(x) for x in maps], np.int64)
    # Sets of this similarity have maps of the same width, or of one and the next.
    for w in np.unique(width).tolist():
        at = np.flatnonzero((width == w) | (width == 2 * w))
        bits = folded(maps[at].tolist(), w)
        order = gray_order(bits)
        order = order[np.argsort(root[at[order]], kind="stable")]
        at, bits = at[order], bits[order]
        tree, size, narrow, label = GrayTree(bits), n[at], width[at] == w, root[at]
        most, high, low = tree.largest(size), tree.largest(label), tree.largest(-label)

        def allowed(level: int, a: np.ndarray, b: np.ndarray, most=most, high=high, low=low) -> np.ndarray:
            one = (high[level][a] == -low[level][a]) & (high[level][b] == -low[level][b]) & (high[level][a] == high[level][b])
            return np.where(one, -1.0, (1 - similarity) / (1 + similarity) * (most[level][a] + most[level][b]) + 1e-9)

        for i, j in tree.near(allowed):
            ok = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9) & (narrow[i] | narrow[j])
            yield at[i[ok]], at[j[ok]]


def best_of(group: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which pairs are the closest of a component in its group."""
    if not len(i):
        return np.zeros(0, bool)
    owner, of, rank = np.concatenate((root[i], root[j])), np.concatenate((group[i], group[i])), np.concatenate((apart, apart))
    order = np.lexsort((rank, owner, of))
    first = np.concatenate(([True], (np.diff(owner[order]) != 0) | (np.diff(of[order]) != 0)))
    out = np.zeros(len(i), bool)
    out[order[first] % len(i)] = True
    return out


def cross_pairs(shared: DataFrame, roots: DataFrame, sizes: DataFrame, similarity: float, best: bool) -> DataFrame:
    """Pairs (a < b) that share a key, are in different components and may have the similarity.

    The members of a key are searched by their parity maps, large groups through the Gray-ordered
    tree of shared bits: two maps differ in no more bits than their sets in members, so groups of
    nodes are pruned by accumulated differences without losing a pair. ``best``: of each component
    in a group only its closest pair, no more than the group has members.
    """
    named = shared.select("key", "doc_id").join(roots, shared["doc_id"] == roots["node"], "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    split = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = named.join(split, "key").join(sizes, "doc_id").select("key", "doc_id", "root", "n", "map")

    def batch(ids: np.ndarray, chosen: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*chosen, strict=True)) if chosen else (np.empty(0, np.int64),) * 2
        a, b = ids[i], ids[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    def compared(key: np.ndarray, ids: np.ndarray, root: np.ndarray, n: np.ndarray, maps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``key``: the groups, one after the other."""
        start = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        size, chosen = np.diff(np.append(start, len(key))), []
        for m in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
            x, y = np.triu_indices(m, 1)
            first = start[size == m]
            step = max(1, 200_000 // len(x))
            for s in range(0, len(first), step):
                i, j = (first[s : s + step, None] + x).ravel(), (first[s : s + step, None] + y).ravel()
                ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                i, j = i[ok], j[ok]
                apart = differing(maps[i].tolist(), maps[j].tolist())
                ok = possible(n[i], n[j], apart, similarity)
                i, j, apart = i[ok], j[ok], apart[ok]
                keep = best_of(key, root, i, j, apart / (n[i] + n[j])) if best else slice(None)
                chosen.append((i[keep], j[keep]))
        yield batch(ids, chosen)
        for a, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            own, held = slice(a, a + m), None
            for i, j in pairs_in_tree(root[own], n[own], maps[own], similarity):
                i, j = i + a, j + a
                if not best:
                    yield batch(ids, [(i, j)])
                    continue
                near = differing(maps[i].tolist(), maps[j].tolist()) / (n[i] + n[j])
                if held:
                    i, j, near = (np.concatenate(x) for x in zip(held, (i, j, near), strict=True))
                keep = best_of(key, root, i, j, near)
                held = i[keep], j[keep], near[keep]
            if held:
                yield batch(ids, [held[:2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for b in batches:
            if not b.num_rows:
                continue
            held.append((*(b.column(c).to_numpy() for c in ("key", "doc_id", "root", "n")), np.array(b.column("map").to_pylist() + [None], object)[:-1]))
            # All groups but the last, which may go on in the next batch.
            if held[-1][0][-1] != held[0][0][0]:
                rows = joined()
                end = int(np.searchsorted(rows[0], rows[0][-1]))
                yield from compared(*(x[:end] for x in rows))
                held[:] = [tuple(x[end:] for x in rows)]
        if held:
            yield from compared(*joined())

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, sizes: DataFrame, keyed: DataFrame, similarity: float, k: int, rounds: int = 3) -> DataFrame:
    """(node, root) of the documents of ``docs`` that reach another over pairs which share a key and have the similarity.

    Every pair of a key is either compared or already connected by confirmed links: first each
    member with its key's leader, then, round by round, each component's closest pair in a key with
    another component, which joins a cluster of n near copies by about n pairs and not its n^2, and
    in the end all pairs of one key that are still in different components.
    """
    spark = docs.sparkSession
    shared, shared_path = written(shared_keys(keyed), "op7-shared")
    pairs = bounded(shared.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct(), sizes, similarity)
    tested, tested_path = written(pairs, "op7-tested")
    links_, links_path = written(confirmed(tested, docs, similarity, k), "op7-links")
    roots = components(links_, "op7-groups")
    for step in range(rounds):
        found, found_path = written(cross_pairs(shared, roots, sizes, similarity, best=step + 1 < rounds), "op7-found")
        more, more_path = written(found.join(tested, ["a", "b"], "left_anti"), "op7-more")
        dropped(spark, found_path)
        if not more.limit(1).count():
            dropped(spark, more_path)
            continue
        all_links, all_path = written(links_.union(confirmed(more, docs, similarity, k)), "op7-links")
        all_tested, all_tested_path = written(tested.union(more), "op7-tested")
        dropped(spark, links_path, tested_path, more_path)
        links_, links_path, tested, tested_path = all_links, all_path, all_tested, all_tested_path
        roots = components(links_, "op7-groups")
    dropped(spark, shared_path, tested_path, links_path)
    return roots


def common_hashes(docs: DataFrame, k: int, docs_sampled: int = 5_000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, sorted, that a sample of the documents holds more than once, and in how many of its documents.

    They only put shingles in order, rare ones first. Any order finds all pairs; this one keeps
    documents that share no more than a frequent line from being compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), k)).view(np.int64))], ["h"])

    share = max(1, docs.count() // docs_sampled)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    found = some.mapInArrow(run, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a document's distinct shingles (sorted hashes), as many of the first in the common order as
    make sure that another set of the similarity has one of them among its own first."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    known, count = common
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    often = np.where(known[at] == hashes, count[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
    first = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    return hashes[np.argsort(often, kind="stable")[:first]]


def near_rows(numbered: DataFrame, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """(row, root) of the rows of (doc_id, text) that have a near copy, its root included; here doc_id is a row's own number.

    Two texts are near copies if their sets of ``k``-word shingles have a Jaccard similarity of at
    least ``similarity``. Candidates come from a prefix filter: sets of that similarity share at
    least ceil(similarity x n) of the n shingles of either, so in any common order the first
    n - ceil(similarity x n) + 1 of both have one in common, whatever the number of documents or
    the shape of the edits. Those that share one are searched in the Gray-ordered tree by their
    parity maps. SimHash itself takes no part, as it only estimates the similarity.
    """
    common = common_hashes(numbered, k)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bits, keys = [], [], []
            for t in b.column("text"):
                own = np.unique(shingle_hashes(t.as_py(), k))
                n.append(max(1, len(own)))
                bits.append(parity_map(own))
                keys.append(prefix(own, common, similarity).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "n", "map", "keys"])

    printed, path = written(numbered.mapInArrow(prints, "doc_id long, n long, map binary, keys binary"), "op7-sets")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A long text has many keys: a few documents at a time.
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                keys = part.column("keys").to_pylist()
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(x) // 8 for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(ids, pa.int64())], ["key", "doc_id"])

    keyed = printed.select("doc_id", "keys").mapInArrow(spread, "key long, doc_id long")
    roots = linked(numbered, printed.select("doc_id", "n", "map"), keyed, similarity, k)
    dropped(numbered.sparkSession, path)
    return roots.select(F.col("node").alias("row"), "root").union(roots.select(F.col("root").alias("row"), "root").distinct())


def grouped_rows(docs: DataFrame, similarity: float, k: int) -> tuple[DataFrame, str, DataFrame, str]:
    """The rows of ``docs`` with a number, the name of that column, (row, doc_id, root) of those with near copies, and the numbered table's path."""
    row = fresh(docs.columns, "row")
    numbered, path = written(docs.withColumn(row, F.monotonically_increasing_id()), "op7-rows")
    found = near_rows(numbered.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")), similarity, k)
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return numbered, row, found.join(ids, "row").select("row", "doc_id", "root"), path


def similar_groups(docs: DataFrame, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """(doc_id, component_id) of the documents that have a near copy, the representative included; component_id
    is the smallest doc_id of the group (null if all are). See ``near_rows``."""
    _, _, found, _ = grouped_rows(docs, similarity, k)
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``: the one with the smallest doc_id, a
    null one last, and the first in the table of rows that share it. Rows are told apart by a number of
    their own, so rows that repeat a doc_id or have none are compared like others. All texts without
    words are equal; an empty table gives no rows; extra columns are passed on, whatever their names."""
    numbered, row, found, path = grouped_rows(docs, similarity, k)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("first"))
    gone, _ = written(found.join(first, "root").where("row <> first").select(F.col("row").alias(row)), "op7-gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
