"""Nearest windows of a series: self-joins with exclusion zones by tiles, and the edges they give.

`knn` and `closest_pairs` deal the unordered pairs of blocks of a series to tasks: a tile has two blocks of samples with what
their last windows reach beyond, never the series, and moves dot products along its diagonals (functions.tiles), so
time doesn't depend on the window. A tile gives each of its windows, of both blocks, a list of k; lists are merged by window.

`per_pair` needs all distances of a window at once: there windows are dealt to as many parts as the session has shuffle
partitions, and a part's task receives the series as one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.functions import kernels, tiles
from recurra.sources.tables import dropped, saved

#: Windows of a block at most, and of a part at least.
BLOCK = 512
#: Windows of a tile's block: SMALL for short series, a PARTS-th of longer ones up to LARGE (a tile has the square of it in distances).
SMALL, LARGE, PARTS = 1024, 4096, 32
#: Zones of a block at least, up to LARGE: near a block's edge a pick can unsettle the next block's list, which is asked again.
ZONES = 16
#: Windows whose lists are merged together.
LISTS = 256


def packed(sig: DataFrame, *keys: str) -> DataFrame:
    """(keys..., x): each dim's values in order of t, as one array."""
    return sig.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("x"))


def stacked(sig: DataFrame) -> DataFrame:
    """(x): one row, the dims' arrays in order of dim."""
    return packed(sig, "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("x"))


def by_part(series: DataFrame, w: int, n: F.Column) -> DataFrame:
    """series(keys..., x) repeated for each part of its windows [first, last), dealt out to tasks; n: length of a series."""
    keys = [c for c in series.columns if c != "x"]
    most = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = (n - w + 1).cast("long")
    parts = F.least(F.ceil(count / BLOCK), F.lit(most))
    rows = series.where(n >= w).withColumns({"count": count, "parts": parts}).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    edge = lambda k: F.floor(k * F.col("count") / F.col("parts"))
    return rows.select(*keys, "x", edge(F.col("part")).alias("first"), edge(F.col("part") + 1).alias("last")).repartition(*keys, "first")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows, x as an array of numbers or a list of such arrays, without Python numbers between."""
    numbers = lambda v: v.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for b in batches:
        names = b.schema.names
        for k in range(b.num_rows):
            row = {c: b.column(i)[k] for i, c in enumerate(names)}
            x = row.pop("x").values
            yield {c: v.as_py() for c, v in row.items()} | {"x": [numbers(y.values) for y in x] if pa.types.is_list(x.type) else numbers(x)}


def blocks(r: dict, m: int, dims: int = 1) -> Iterator[tuple[int, int]]:
    """The part's windows, so many at a time that their distances to m windows in all dims are kernels.CELLS numbers at most (or one window's)."""
    step = max(1, min(BLOCK, kernels.CELLS // (m * dims)))
    for a in range(r["first"], r["last"], step):
        yield a, min(a + step, r["last"])


def stretches(sig: DataFrame, w: int, zone: int = 0, ahead: int | None = None) -> DataFrame:
    """(dim, n, size, last, block, x): the samples of windows block * size and on, `size` of them or what is left, in order of t. n: samples of the dim; last: its last block.

    Every t from a dim's first to its last has one sample (a task that finds another number fails); windows are counted from
    the first. Series shorter than w have none. ahead: samples of the longest window that begins in a block, where that isn't w.
    """
    ahead = ahead or w
    ends = sig.groupBy("dim").agg(F.min("t").alias("t0"), (F.max("t") - F.min("t") + 1).alias("n")).where(F.col("n") >= w)
    size = F.greatest(F.lit(max(SMALL, ahead, min(LARGE, ZONES * zone))), F.least(F.lit(LARGE), F.ceil((F.col("n") - w + 1) / PARTS))).cast("long")
    ends = ends.withColumn("size", size).withColumn("last", F.floor((F.col("n") - w) / F.col("size")))
    p = F.col("t") - F.col("t0")
    home = F.least("last", F.floor(p / F.col("size")))
    reach = F.greatest(F.lit(0).cast("long"), F.floor((p - ahead + 1) / F.col("size")))
    rows = sig.join(ends, "dim").select("dim", "n", "size", "last", p.alias("p"), "v", F.explode(F.sequence(reach, home)).alias("block"))
    return rows.groupBy("dim", "n", "size", "last", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"].cast("double")).alias("x"))


def dealt(blocks: DataFrame) -> DataFrame:
    """Each block once for every tile (lo, hi) that it is in: each unordered pair of blocks is one tile."""
    other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    return other.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("other")


def _samples(x: pa.Scalar, n: int, size: int, block: int, w: int) -> np.ndarray:
    out = x.values.to_numpy(zero_copy_only=False).astype(float)
    if len(out) != min(size + w - 1, n - block * size):
        raise ValueError(f"block {block} of {size} windows of {w} in a series of {n} samples has {len(out)}: a dim needs one sample for every t")
    return out


def _tile(t: pa.Table, w: int, metric: str) -> dict[int, list[tiles.Block]]:
    """The blocks of a tile's rows by number, of each dim in order."""
    out: dict[int, list[tiles.Block]] = {}
    by_dim = sorted(range(len(t)), key=lambda r: t["dim"][r].as_py())
    for r in by_dim:
        n, size, block = (t[c][r].as_py() for c in ("n", "size", "block"))
        out.setdefault(block, []).append(tiles.Block.of(block * size, _samples(t["x"][r], n, size, block, w), w, metric))
    return out


_LIST = "dim int, size long, i long, tile long, kind int, rank int, j long, d double"
_PICK, _LEFT, _ASK = 0, 1, 2


def _lists(dim: int, size: int, kind: int, i, tile=-1, rank=-1, j=-1, d=0.0) -> pa.Table:
    full = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, t), len(i)))
    return pa.table([full(dim, np.int32), full(size, np.int64), full(i, np.int64), full(tile, np.int64), full(kind, np.int32), full(rank, np.int32), full(j, np.int64), full(d, float)], [x.split()[0] for x in _LIST.split(", ")])


def knn(sig: DataFrame, w: int, k: int = 1, metric: str = "detrended", zone: int | None = None, digits: int | None = 6) -> DataFrame:
    """knn(dim, i, rank, j, d): greedily the k nearest windows that lie `zone` or more apart from i and from one another; ties to the smaller place.

    Distances are compared after rounding to `digits`, so engines agree on ties. Runs as it is called: what a merge can't tell
    for certain (tiles.merge_apart) is asked again of the tiles concerned, k - 1 times at most and mostly never. A window that
    no other is apart from has no rows; nor has a degenerate one (constant, a line, missing samples).
    """
    zone = w if zone is None else zone
    if metric not in kernels.METRICS:
        raise ValueError(f"metric {metric!r}; known are {', '.join(kernels.METRICS)}")
    if w < 3:
        raise ValueError("windows have 3 samples at least")

    def own(d: np.ndarray, a: tiles.Block, b: tiles.Block) -> np.ndarray:
        tiles.leave_zone(d, a.first - b.first + np.arange(len(a)), zone)
        return d

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim, lo, hi = (x.as_py() for x in key)
        size, got = t["size"][0].as_py(), _tile(t, w, metric)
        a, b = got[lo][0], got[hi][0]
        d = own(tiles.distances(a, b, metric, digits), a, b)
        out = []
        for r, z in tiles.strips(len(a)):
            i, j, v = tiles.best_apart(d[r:z].copy(), zone, k)
            out.append(_lists(dim, size, _LEFT, a.first + r + i, hi, -1, b.first + j, v))
        for r, z in tiles.strips(len(b)) if lo != hi else ():
            j, i, v = tiles.best_apart(d[:, r:z].T.copy(), zone, k)
            out.append(_lists(dim, size, _LEFT, b.first + r + j, lo, -1, a.first + i, v))
        return pa.concat_tables(out)

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim, size = t["dim"][0].as_py(), t["size"][0].as_py()
        i, tile, kind, j, d = (t[c].to_numpy() for c in ("i", "tile", "kind", "j", "d"))
        picked = kind == _PICK
        names, done = np.unique(i[picked], return_counts=True)
        i, tile, j, d = (c[~picked] for c in (i, tile, j, d))
        had = np.zeros(len(i), np.int64)
        at = np.searchsorted(names, i)
        known = at < len(names)
        known[known] = names[at[known]] == i[known]
        had[known] = done[at[known]]
        m = tiles.merge_apart(i, tile, j, d, k - had, zone)
        row, turn, pj, pd = m.picks
        before = np.zeros(len(row), np.int64)
        at = np.searchsorted(names, row)
        known = at < len(names)
        known[known] = names[at[known]] == row[known]
        before[known] = done[at[known]]
        # picks of rows that aren't finished are needed again by the next merge, under their ranks
        return pa.concat_tables([_lists(dim, size, _PICK, row, -1, before + turn, pj, pd), _lists(dim, size, _LEFT, i[m.left], tile[m.left], -1, j[m.left], d[m.left]), _lists(dim, size, _ASK, m.asks[0], m.asks[1])])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, n, size, lo, hi = (batch[c][r].as_py() for c in ("dim", "n", "size", "home", "tile"))
                a, b = (tiles.Block.of(q * size, _samples(batch[c][r], n, size, q, w), w, metric) for c, q in (("x", lo), ("y", hi)))
                asked = {x["i"] - a.first: x["taken"] for x in batch["rows"][r].as_py()}
                for s, z in tiles.strips(len(a), tiles.SEED):
                    rows = [x for x in sorted(asked) if s <= x < z]
                    if not rows:
                        continue
                    part = a.part(s, z)
                    d = own(tiles.distances(part, b, metric, digits), part, b)[[x - s for x in rows]]
                    for turn in range(max(len(asked[x]) for x in rows)):
                        tiles.leave_zone(d, np.array([asked[x][min(turn, len(asked[x]) - 1)] for x in rows]) - b.first, zone)
                    i, j, v = tiles.best_apart(d, zone, k)
                    yield from _lists(dim, size, _LEFT, a.first + np.array(rows)[i], hi, -1, b.first + j, v).to_batches()

    blocks = saved(stretches(sig, w, zone))
    lists = dealt(blocks).groupBy("dim", "lo", "hi").applyInArrow(compare, _LIST)
    found, rounds = [], []
    while True:
        merged = saved(lists.groupBy("dim", F.floor(F.col("i") / LISTS)).applyInArrow(merge, _LIST))
        rounds.append(merged)
        found.append(merged.where(F.col("kind") == _PICK))
        asks = merged.where(F.col("kind") == _ASK)
        if asks.isEmpty():
            break
        taken = None
        for f in found:
            taken = f if taken is None else taken.unionByName(f)
        open_ = asks.select("dim", "i").distinct()
        taken = taken.join(open_, ["dim", "i"], "left_semi")
        rows = asks.select("dim", "size", "i", "tile").join(taken.groupBy("dim", "i").agg(F.collect_list("j").alias("taken")), ["dim", "i"])
        rows = rows.groupBy("dim", F.floor(F.col("i") / F.col("size")).alias("home"), "tile").agg(F.collect_list(F.struct("i", "taken")).alias("rows"))
        pairs = rows.join(blocks.select("dim", "n", "size", F.col("block").alias("home"), "x"), ["dim", "home"]).join(blocks.select("dim", F.col("block").alias("tile"), F.col("x").alias("y")), ["dim", "tile"])
        lists = pairs.mapInArrow(again, _LIST).unionByName(merged.where(F.col("kind") == _LEFT)).unionByName(taken)
    dropped(blocks)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("dim", "i", "rank", "j", "d")


def closest_pairs(sig: DataFrame, w: int, metric: str, top: int, multi: bool = False, digits: int = 6) -> DataFrame:
    """The `top` pairs (dim, i, j, d) of windows w or more apart, by (d, dim, i, j); multi: one distance over all dims, the root of the mean of the dims' squares. Each tile keeps its own `top`."""

    def best(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lo, hi = (x.as_py() for x in key[-2:])
        got = _tile(t, w, metric)
        if len({len(x) for b in got.values() for x in b[:1]} | {len(x) for x in got[lo]}) > 2 or len(got[lo]) != len(got[hi]):
            raise ValueError("dims of a signal have the same length")
        first, second = got[lo][0].first, got[hi][0].first
        kept = [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for r, z in tiles.strips(len(got[lo][0])):
            d = sum(tiles.squared(a.part(r, z), b, metric, digits) for a, b in zip(got[lo], got[hi])) / len(got[lo])
            d = np.round(np.sqrt(d), digits)
            d[(second + np.arange(d.shape[1])) - (first + r + np.arange(len(d)))[:, None] < w] = np.nan
            d[np.isnan(d)] = np.inf
            cut = np.partition(d.ravel(), min(top, d.size) - 1)[min(top, d.size) - 1]
            i, j = np.nonzero((d <= cut) & np.isfinite(d))
            kept = [np.concatenate(c) for c in zip(kept, (d[i, j], first + r + i, second + j))]
            order = np.lexsort((kept[2], kept[1], kept[0]))[:top]
            kept = [c[order] for c in kept]
        v, i, j = kept
        return pa.table([pa.array(np.full(len(i), -1 if multi else key[0].as_py(), np.int32)), pa.array(i), pa.array(j), pa.array(v)], ["dim", "i", "j", "d"])

    keys = ["lo", "hi"] if multi else ["dim", "lo", "hi"]
    return dealt(stretches(sig, w)).groupBy(*keys).applyInArrow(best, "dim int, i long, j long, d double").orderBy("d", "dim", "i", "j").limit(top)


def per_pair(sig: DataFrame, w: int, metric: str, make: Callable[[np.ndarray, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows that make(distances of all dims (D, rows, windows), first row) gives for each block of windows."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            parts = [kernels.Series(x, w) for x in r["x"]]
            for a, z in blocks(r, len(parts[0].windows), len(parts)):
                got = make(np.stack([np.sqrt(kernels.squared(s, a, z, metric)) for s in parts]), a)
                yield pa.RecordBatch.from_arrays([pa.array(got[n]) for n in names], names)

    return by_part(stacked(sig), w, F.size(F.col("x")[0])).mapInArrow(run, schema)


def filtration(neighbours: DataFrame, drop_first: bool = False, time_edges: bool = True) -> DataFrame:
    """edges(dim, u, v, w, kind): neighbour edges once for each unordered pair, and (time_edges) edges between consecutive windows weighing the greater of their nearest distances. drop_first leaves out the first neighbour edge of each dim in order of (u, v)."""
    from pyspark.sql import Window

    near = neighbours.select("dim", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.col("d").alias("w")).groupBy("dim", "u", "v").agg(F.min("w").alias("w"))
    if drop_first:
        first = near.groupBy("dim").agg(F.min(F.struct("u", "v")).alias("first"))
        near = near.join(F.broadcast(first), "dim").where(F.struct("u", "v") != F.col("first")).drop("first")  # one row a dim
    near = near.withColumn("kind", F.lit("near"))
    if not time_edges:
        return near
    nn = neighbours.where("rank = 0").select("dim", F.col("i").alias("u"), F.col("d"))
    step = Window.partitionBy("dim").orderBy("u")
    time = nn.select("dim", "u", F.lead("u").over(step).alias("v"), F.greatest("d", F.lead("d").over(step)).alias("w")).where("v = u + 1")
    return near.unionByName(time.withColumn("kind", F.lit("time")))
