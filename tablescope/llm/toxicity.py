"""Toxicity (op 10): a linear-chain conditional random field over tokens.

Training, on a bounded sample of labelled documents (``max_toxic`` + ``max_clean``, a documented
parameter): tokens get distant labels, "toxic" where a word or word beginning is frequent in
toxic and absent from clean documents; the field learns weights of hashed token features and the
label transitions by gradient ascent on the conditional likelihood. Scoring is a map over whole
documents: forward-backward marginals of each token; the score is the largest marginal, the
offending spans are the runs of tokens whose marginal passes the threshold.

Only the text is an input of a score. Nulls: a null text is empty; empty texts score 0. Labels
that are null are not used, documents without label are scored like others. With no toxic
training documents, every score is 0. Rows that repeat a doc_id are scored each. Extra columns
are ignored, whatever their names; an empty table gives no rows; texts of any length are scored whole,
by marginals of the whole sequence. A score at the threshold is toxic.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

DIM = 1 << 18
MAX_TOXIC, MAX_CLEAN = 800, 1600
THRESHOLD = 0.3
#: Tokens of a block, and the error at which a message may start inside a document.
BLOCK, FORGET = 256, 1e-9
TRIM = b".,;:!?\"'()[]{}<>*_-|`~"
FEATURES = 5
SCHEMA = "doc_id long, score double, spans array<struct<first:int,last:int>>"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def parts(token: bytes) -> tuple[bytes, ...]:
    """The features of a token: the word, its beginnings and its end."""
    w = token.strip(TRIM)
    return b"w" + w, b"a" + w[:4], b"b" + w[:5], b"c" + w[:6], b"s" + w[-3:]


def hashed(token: bytes) -> list[int]:
    return [zlib.crc32(p) % DIM for p in parts(token)]


@dataclass
class Field:
    """``weights``: log-odds of label 1 by feature; ``bias`` of label 1; ``chain``: transition scores."""

    weights: np.ndarray
    bias: float
    chain: np.ndarray

    def emissions(self, found: list[bytes], memo: dict) -> np.ndarray:
        """Log-odds of each token by itself. ``memo`` keeps those of tokens seen before, up to a bound."""
        new = [t for t in dict.fromkeys(found) if t not in memo]
        if len(memo) + len(new) > 300_000:
            memo.clear()
            new = list(dict.fromkeys(found))
        if new:
            code = np.array([hashed(t) for t in new], np.int32)
            memo.update(zip(new, (self.weights[code].sum(1, dtype=np.float64) + self.bias).tolist(), strict=True))
        return np.fromiter(map(memo.__getitem__, found), np.float64, len(found))

    def marginals(self, lengths: np.ndarray, emissions: np.ndarray) -> np.ndarray:
        """P(label 1) of each token; the sequences lie one after the other."""
        return chain_marginals(lengths, emissions, self.chain)[0]


def reach(chain: np.ndarray) -> int:
    """After how many tokens a message has forgotten what came before, up to ``FORGET``.

    A step contracts the difference of two messages' log-odds by tanh(d / 4), d the log of the
    cross ratio of the transitions.
    """
    rate = math.tanh(abs(chain[0, 0] + chain[1, 1] - chain[0, 1] - chain[1, 0]) / 4)
    return 1 if rate < 1e-9 else min(4096, max(1, math.ceil(math.log(FORGET) / math.log(rate))))


def chain_marginals(lengths: np.ndarray, emissions: np.ndarray, chain: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once, and the expected number of each transition.

    Sequences are cut into blocks that advance together. A block's messages start as far outside
    of it as the chain remembers, or at the end of the sequence, so every marginal is that of
    the whole sequence. With two labels a message is one number, its odds.
    """
    n = int(lengths.sum())
    if not n:
        return np.empty(0), np.zeros((2, 2))
    warm = reach(chain)
    per = -(-lengths // BLOCK)
    begin = np.cumsum(lengths) - lengths
    number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(begin, per) + number * BLOCK
    low, high = np.repeat(begin, per), np.repeat(begin + lengths, per)
    offset = np.arange(-warm, BLOCK + warm)
    at = start[:, None] + offset
    real = ((at >= low[:, None]) & (at < high[:, None])).T
    odds = np.exp(np.clip(emissions[np.clip(at, 0, n - 1)].T, -30, 30))
    a, b, c, d = np.exp(chain).ravel()  # 0-0, 0-1, 1-0, 1-1
    steps, blocks = odds.shape
    ahead, r = np.empty((BLOCK, blocks)), np.ones(blocks)
    for t in range(warm + BLOCK):
        r = np.where(real[t], odds[t] * (b + d * r) / (a + c * r), 1.0)
        if t >= warm:
            ahead[t - warm] = r
    back, s = np.empty((BLOCK, blocks)), np.ones(blocks)
    for t in range(steps - 1, warm - 1, -1):
        # s: odds of what follows token t.
        if t < warm + BLOCK:
            back[t - warm] = s
        o = odds[t] * s
        s = np.where(real[t], (c + d * o) / (a + b * o), 1.0)
    inside = real[warm : warm + BLOCK]
    odd = ahead * back
    probability = (odd / (1 + odd)).T[inside.T]
    moves = np.zeros((2, 2))
    if count:
        pairs = inside[1:] & inside[:-1]
        f, o = ahead[:-1][pairs], (odds[warm + 1 : warm + BLOCK] * back[1:])[pairs]
        weight = np.stack([np.full(len(f), a), b * o, c * f, d * f * o])
        moves = (weight / weight.sum(0)).sum(1).reshape(2, 2)
    return probability, moves


def distant_labels(toxic: list[list[bytes]], clean: list[list[bytes]]) -> set[bytes]:
    """Words and beginnings that enough toxic documents have, and that are 100 times rarer in clean ones.

    Enough grows with the root of their number, as chance does.
    """
    seen = [Counter(), Counter()]
    for kind, docs in enumerate((clean, toxic)):
        for d in docs:
            seen[kind].update({p for t in set(d) for p in parts(t)[:4] if len(p) > 4})
    least = max(3.0, 1 + math.sqrt(len(toxic)) / 2)
    return {p for p, n in seen[1].items() if n >= least and n / len(toxic) >= 100 * (seen[0][p] / max(1, len(clean)))}


def unlike(docs: list[list[bytes]], size: int = 16, most: int = 3) -> list[list[bytes]]:
    """The documents without near copies of earlier ones, so that copies don't count as evidence.

    A document's sketch is its ``size`` smallest hashes of five-word shingles.
    """
    kept, holders = [], {}
    for d in docs:
        sketch = sorted({zlib.crc32(b" ".join(d[i : i + 5])) for i in range(max(1, len(d) - 4))})[:size]
        if max(Counter(h for x in sketch for h in holders.get(x, ())).values(), default=0) > min(most, len(sketch) // 2):
            continue
        for x in sketch:
            holders.setdefault(x, []).append(len(kept))
        kept.append(d)
    return kept


def trained(toxic: list[str], clean: list[str], rounds: int = 20) -> Field | None:
    """Fit the field; None without toxic documents."""
    docs = [unlike([tokens(t) for t in dict.fromkeys(group)]) for group in (clean, toxic)]
    if not docs[1]:
        return None
    marks = distant_labels(docs[1], docs[0])
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(t, len(seen)) for group in docs for d in group for t in d), np.int32)
    lengths = np.array([len(d) for group in docs for d in group])
    if not len(ids):
        return None
    first_toxic = len(docs[0])
    docs.clear()
    code = np.array([hashed(t) for t in seen], np.int32)
    marked = np.fromiter((any(p in marks for p in parts(t)[:4]) for t in seen), bool, len(seen))
    y = (marked[ids] & (np.repeat(np.arange(len(lengths)), lengths) >= first_toxic)).astype(float)
    w, chain, bias = np.zeros(DIM), np.zeros((2, 2)), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    offset = np.arange(len(y)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(offset % BLOCK)  # transitions inside blocks, as the field counts them
    pairs = np.array([[((y[at - 1] == i) & (y[at] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    square = [np.full(DIM, 1e-3), 1e-3, np.full((2, 2), 1e-3)]
    # Whole sequences, about 100,000 tokens at a time.
    part = np.cumsum(lengths) // 100_000
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    for _ in range(rounds):
        word = w[code].sum(1) + bias
        error, moves = np.zeros(len(seen)), np.zeros((2, 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = slice(ends[a], ends[b])
            p, some = chain_marginals(lengths[a:b], word[ids[own]], chain, count=True)
            error += np.bincount(ids[own], y[own] - p, len(seen))  # tokens of one word share their features
            moves += some
        gradient = np.bincount(code.ravel(), np.repeat(error, FEATURES), DIM) - 0.01 * w
        steps = (gradient, float(error.sum()), pairs - moves - chain)
        square = [s + g * g for s, g in zip(square, steps, strict=True)]
        w += 0.5 * gradient / np.sqrt(square[0])
        bias += 0.2 * steps[1] / math.sqrt(square[1])
        chain = np.clip(chain + 0.05 * steps[2] / np.sqrt(square[2]), -1, 1)
    return Field(w.astype(np.float32), bias, chain)


def fitted(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Field | None:
    """Train on labelled documents outside the held-out quarter, the first in hashed order of each label.

    A document that is labelled both ways is toxic; of rows that share a doc_id each text counts.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    # Only ids travel; labels without a document are out before the first of each label are taken.
    found = own.select("doc_id").join(marked, "doc_id").distinct()
    wanted = None
    for kind, most in ((1, max_toxic), (0, max_clean)):
        some = found.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        wanted = some if wanted is None else wanted.union(some)
    wanted, path = written(wanted, "op10-training")
    # Bounded by max_toxic + max_clean ids, so the broadcast is.
    rows, texts = own.join(F.broadcast(wanted), "doc_id"), {}
    for kind, most in ((1, max_toxic), (0, max_clean)):
        texts[kind] = [r[0] for r in rows.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select("text").toLocalIterator()]
    dropped(docs.sparkSession, path)
    return trained(texts[1], texts[0])


def in_slices(batch: pa.RecordBatch, field: Field | None, threshold: float, memo: dict) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Slices of whole documents, about 200,000 tokens each, with their scores."""
    texts, at = batch.column("text"), 0
    while at < len(texts):
        found, lengths, first = [], [], at
        while at < len(texts) and len(found) < 200_000:
            own = tokens(texts[at].as_py())
            lengths.append(len(own))
            found += own
            at += 1
        part = batch.slice(first, at - first)
        yield part, scores(part.column("doc_id"), found, np.array(lengths, np.int64), field, threshold, memo)


def scored(docs: DataFrame, field: Field | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, and the offending spans as first and last token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            yield from (own for _, own in in_slices(batch, field, threshold, memo))

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, field: Field | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, all columns as they are; one pass, nothing is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part, own in in_slices(batch, field, threshold, memo):
                yield part.filter(pa.array(own.column("score").to_numpy() < threshold))

    return docs.mapInArrow(run, docs.schema)


def scores(ids: pa.Array, found: list[bytes], lengths: np.ndarray, field: Field | None, threshold: float, memo: dict) -> pa.RecordBatch:
    score, spans = np.zeros(len(lengths)), [[] for _ in lengths]
    if field is not None and found:
        p = field.marginals(lengths, field.emissions(found, memo))
        full = np.flatnonzero(lengths)
        begin = (np.cumsum(lengths) - lengths)[full]
        score[full] = np.clip(np.maximum.reduceat(p, begin), 0, 1)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        hot = np.flatnonzero(p >= threshold)
        new = np.concatenate(([True], (np.diff(hot) > 1) | (np.diff(doc[hot]) > 0))) if len(hot) else np.empty(0, bool)
        edges = np.append(np.flatnonzero(new), len(hot))
        lead = np.cumsum(lengths) - lengths
        for a, b in zip(edges[:-1], edges[1:], strict=True) if len(hot) else ():
            d = doc[hot[a]]
            spans[d].append({"first": int(hot[a] - lead[d]), "last": int(hot[b - 1] - lead[d])})
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return pa.RecordBatch.from_arrays([ids, pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])
