"""Exact quantiles of any number of rows, by narrowing histograms.

The ``percentile`` aggregate gathers every distinct value of a column in one task. Here each round
counts, for each wanted rank, the values in equal bins of the interval that must hold it, and goes
on with the one bin; only counts travel. When few values are left they are fetched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named, number

BINS, FEW = 1024, 4096


def by_narrowing(df: DataFrame, columns: list[str], shares: list[float], bins: int = BINS, few: int = FEW) -> dict[str, list[float | None]]:
    """Interpolated quantiles, as the median of an even count is the mean of the middle two."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    x = {c: number(named(c), kinds[c]) for c in columns}
    row = df.agg(*[e for c in columns for e in (F.count(x[c]), F.min(x[c]), F.max(x[c]))]).first()
    known = {c: tuple(row[3 * i : 3 * i + 3]) for i, c in enumerate(columns)}
    ranks: dict[tuple[str, int], float | None] = {}
    # [low, high], values below low, values inside
    open_: dict[tuple[str, int], tuple[float, float, int, int]] = {}
    for c, (n, low, high) in known.items():
        for q in shares if n else ():
            at = q * (n - 1)
            for r in {math.floor(at), math.ceil(at)}:
                if low == high or not (math.isfinite(low) and math.isfinite(high)):
                    ranks[c, r] = low if low == high else None
                else:
                    open_[c, r] = (low, high, 0, n)
    while open_:
        pieces = sorted({(c, *v[:2]) for (c, _), v in open_.items()})
        small = {p for p in pieces if any((c, *v[:2]) == p and v[3] <= few for (c, _), v in open_.items())}
        values: dict[tuple, list[float]] = {p: [] for p in small}
        counts: dict[tuple, dict[int, int]] = {}
        number_of = {p: i for i, p in enumerate(pieces)}
        spread = []
        for p in pieces:
            c, low, high = p
            inside = x[c].between(low, high)
            bin_ = F.least(F.lit(bins - 1), F.floor((x[c] - low) / (high - low) * bins)).cast("int")
            spread.append(F.when(inside, F.struct(F.lit(number_of[p]).alias("p"), (F.lit(-1) if p in small else bin_).alias("bin"), F.when(F.lit(p in small), x[c]).alias("v"))))
        flat = df.select(F.explode(F.array_compact(F.array(*spread))).alias("s")).select("s.*").groupBy("p", "bin", "v").agg(F.count(F.lit(1)).alias("n"))
        for r in flat.collect():  # bounded: bins for each piece, or at most FEW values
            p = pieces[r["p"]]
            if p in small:
                values[p] += [r["v"]] * r["n"]
            else:
                counts.setdefault(p, {})[r["bin"]] = r["n"]
        for key, (low, high, below, _) in list(open_.items()):
            p = (key[0], low, high)
            if p in small:
                ranks[key] = sorted(values[p])[key[1] - below]
                del open_[key]
                continue
            at = below
            for b in sorted(counts[p]):
                n = counts[p][b]
                if at + n > key[1]:
                    width = (high - low) / bins
                    left, right = low + b * width, (high if b == bins - 1 else low + (b + 1) * width)
                    # Neighbours of the edges may round into the bin: widen by one step and count again.
                    left, right = max(low, math.nextafter(left, -math.inf)), min(high, math.nextafter(right, math.inf))
                    if (left, right) == (low, high) or right <= left:
                        ranks[key] = left
                        del open_[key]
                    else:
                        open_[key] = (left, right, at, n)
                    break
                at += n
        # Values below the widened interval are counted anew, so ranks stay exact.
        if open_:
            keys = list(open_)
            row = df.agg(*[e for c, r in keys for e in (F.sum((x[c] < open_[c, r][0]).cast("long")), F.sum(x[c].between(*open_[c, r][:2]).cast("long")), F.min(F.when(x[c].between(*open_[c, r][:2]), x[c])), F.max(F.when(x[c].between(*open_[c, r][:2]), x[c])))]).first()
            for i, key in enumerate(keys):
                below, n, low, high = row[4 * i : 4 * i + 4]
                if low == high:
                    ranks[key] = low
                    del open_[key]
                else:
                    open_[key] = (low, high, below, n)
    out = {}
    for c in columns:
        n = known[c][0]
        out[c] = []
        for q in shares:
            if not n:
                out[c].append(None)
                continue
            at = q * (n - 1)
            a, b = ranks[c, math.floor(at)], ranks[c, math.ceil(at)]
            out[c].append(None if a is None or b is None else a + (b - a) * (at - math.floor(at)))
    return out
