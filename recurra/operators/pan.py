"""Pan profile: the nearest neighbours of a series at many window lengths, and their contrast over (length, place).

Lengths are taken level by level of the balanced binary tree over them, so any number of them is spread over the whole range.
Samples are dealt to tiles once for all lengths asked for: a block is as far ahead as the longest window reaches, and a tile gives
each of its windows the nearest in the other block, at each length. Dot products are moved along diagonals at each length; those of
another length would save nothing, since the ones of the samples between cost as much.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions import kernels, tiles
from recurra.operators import neighbours


def level_order(n: int) -> list[int]:
    """0..n-1 by levels of the balanced binary search tree over them, each from left to right."""
    out, spans = [], [(0, n)] if n else []
    while spans:
        mids = [(a + z) // 2 for a, z in spans]
        out += mids
        spans = [s for (a, z), m in zip(spans, mids) for s in ((a, m), (m + 1, z)) if s[0] < s[1]]
    return out


def taken(lengths: Sequence[int], most: int | None = None) -> list[int]:
    """The first `most` different lengths in level order (all, if None)."""
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 3:
        raise ValueError("one length at least, each of 3 samples at least")
    return [lengths[k] for k in level_order(len(lengths))][:most]


def pan_profile(sig: DataFrame, lengths: Sequence[int], most: int | None = None, metric: str = "znorm", digits: int = 6) -> DataFrame:
    """(dim, w, i, j, d): of each window the nearest one at least its length apart, for the lengths `taken`; ties to the smaller place.

    A partial run (most) gives the rows of a full one at its lengths. Degenerate windows, those that no other is apart from,
    and lengths beyond a dim's samples have no rows. Every t of a dim from its first to its last has one sample, else the task fails.
    """
    if metric not in kernels.METRICS:
        raise ValueError(f"metric {metric!r}; known are {', '.join(kernels.METRICS)}")
    todo = taken(lengths, most)
    longest, shortest = max(todo), min(todo)

    def block(t: pa.Table, r: int, w: int) -> tiles.Block | None:
        n, size, k, last = (t[c][r].as_py() for c in ("n", "size", "block", "last"))
        x = t["x"][r].values.to_numpy(zero_copy_only=False).astype(float)
        if len(x) != min(size + longest - 1, n - k * size):
            raise ValueError(f"block {k} of a series of {n} samples has {len(x)}: a dim needs one sample for every t")
        x = x if k == last else x[: size + w - 1]
        return tiles.Block.of(k * size, x, w, metric) if len(x) >= w else None

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lo, hi = (k.as_py() for k in key[1:])
        row = {k: r for r, k in enumerate(t["block"].to_pylist())}
        out = []
        for w in todo:
            a, b = block(t, row[lo], w), block(t, row[hi], w)
            if a is None or b is None:
                continue
            d = tiles.distances(a, b, metric, digits)
            tiles.leave_zone(d, a.first - b.first + np.arange(len(a)), w)
            for first, other, v in ((a, b, d), (b, a, d.T))[: 1 if lo == hi else 2]:
                j = v.argmin(1)
                best = v[np.arange(len(v)), j]
                ok = np.flatnonzero(np.isfinite(best))
                out.append(pa.table([pa.array(np.full(len(ok), key[0].as_py(), np.int32)), pa.array(np.full(len(ok), w, np.int32)), pa.array(first.first + ok), pa.array(other.first + j[ok]), pa.array(best[ok])], names))
        return pa.concat_tables([empty, *out])

    schema = "dim int, w int, i long, j long, d double"
    names = [c.split()[0] for c in schema.split(", ")]
    empty = pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())], names)
    near = neighbours.dealt(neighbours.stretches(sig, shortest, ahead=longest)).groupBy("dim", "lo", "hi").applyInArrow(compare, schema)
    least = near.groupBy("dim", "w", "i").agg(F.min(F.struct("d", "j")).alias("m"))
    return least.select("dim", "w", "i", F.col("m.j").alias("j"), F.col("m.d").alias("d"))


def contrast(pan: DataFrame, threshold: float = 0.2, digits: int = 6) -> DataFrame:
    """(dim, w, i, level, contrast, on): level is the z-normed distance over its greatest, 2 * sqrt(w), at most 1; contrast the sigmoid of
    its percentile among all lengths and places of the dim less the threshold; on: the level is at most the threshold.

    Percentiles come from counts by level, so only different levels are sorted together; of a single place it is 0.
    """
    p = pan.select("dim", "w", "i", F.least(F.lit(1.0), F.round(F.col("d") / (2 * F.sqrt("w")), digits)).alias("level"))
    by = p.groupBy("dim", "level").agg(F.count("*").alias("c"))
    dim = Window.partitionBy("dim")
    below = F.coalesce(F.sum("c").over(dim.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by.select("dim", "level", (below / F.greatest(F.sum("c").over(dim) - 1, F.lit(1))).alias("r"))
    return p.join(ranks, ["dim", "level"]).select("dim", "w", "i", "level", F.round(1 / (1 + F.exp(-10 * (F.col("r") - threshold))), digits).alias("contrast"), (F.col("level") <= threshold).alias("on"))


def spread(pan: DataFrame, lengths: Sequence[int], most: int | None = None) -> DataFrame:
    """(dim, w, own, i, ...): pan's rows at every length, those not taken yet with the rows of the next shorter one taken (the shortest taken, if none is); own: whether w itself was taken."""
    done = sorted(taken(lengths, most))
    pairs = [(w, max([x for x in done if x <= w], default=done[0])) for w in sorted(set(lengths))]
    stand = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(x).alias("x")) for w, x in pairs))
    rest = [c for c in pan.columns if c not in ("dim", "w")]
    every = pan.withColumn("s", F.explode(F.filter(stand, lambda s: s["x"] == F.col("w"))))
    return every.select("dim", F.col("s.w").alias("w"), (F.col("s.w") == F.col("s.x")).alias("own"), *rest)
