"""Whole methods: a signal in, occurrence(motif, start, end exclusive) and motif_dims(motif, dim) out."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.functions import kernels
from recurra.functions.windows import squash
from recurra.operators import extract, graph, mdl, neighbours, subspace
from recurra.operators import persistence as ps


@dataclass
class Motif:
    dims: list[int]
    spans: list[tuple[int, int]]


@dataclass
class Found:
    motifs: list[Motif] = field(default_factory=list)

    def occurrences(self, spark) -> DataFrame:
        return spark.createDataFrame([(m, int(a), int(z)) for m, x in enumerate(self.motifs) for a, z in x.spans], "motif int, start long, end long")

    def dimensions(self, spark) -> DataFrame:
        return spark.createDataFrame([(m, int(d)) for m, x in enumerate(self.motifs) for d in x.dims], "motif int, dim int")

    def write(self, spark, path: str, mode: str = "error") -> None:
        """Both tables as Parquet under path: occurrences, dimensions."""
        self.occurrences(spark).write.mode(mode).parquet(f"{path}/occurrences")
        self.dimensions(spark).write.mode(mode).parquet(f"{path}/dimensions")


@dataclass
class LinkedMotifs:
    """Coordinated motifs: neighbour edges per dim, persistence, pooled cuts, thresholded components, merges and splits across dims, extraction.

    Only the two cuts and the candidates' positions reach the driver: at most one position a window and dim that lies
    below the cuts.
    """

    wlen: int
    max_wlen: int | None = None
    n_patterns: int | None = None
    k: int = 5
    jump: int = 2
    alpha: float = 10.0
    beta: float = 0.0
    least_weight: float = 0.8
    ratio: float = 0.4
    metric: str = "detrended"
    compat: bool = False

    def edges(self, sig: DataFrame) -> DataFrame:
        knn = neighbours.knn(sig, self.wlen, self.k, self.metric, digits=9)
        return neighbours.filtration(knn, self.compat).withColumn("w", squash(F.col("w"), self.alpha, self.beta))

    def cuts(self, edges: DataFrame) -> tuple[float, float] | None:
        """(birth cut, gap cut) over all dims together; None where there are too few points."""
        p = ps.persistence(edges).where("death < double('inf') and death > birth").cache()
        birth = ps.otsu_cut(p, "birth").first()[0]
        gap = None if birth is None else ps.gap_cut(p.where(F.col("birth") < birth).withColumn("gap", F.col("death") - F.col("birth")), "gap", self.jump).first()[0]
        p.unpersist()
        return None if gap is None else (birth, gap)

    def fit(self, sig: DataFrame) -> Found:
        with self.prepared(sig) as tail:
            return tail.found()

    @contextmanager
    def prepared(self, sig: DataFrame) -> Iterator[Tail]:
        """What the cuts and all that follows start from, kept while the context lasts: `found` may be called again under other settings without searching neighbours anew."""
        edges = self.edges(sig).persist()
        try:
            yield Tail(self, edges, sig.agg(F.max("t")).first()[0] + 1)
        finally:
            edges.unpersist()


@dataclass
class Tail:
    """The method after its neighbour search."""

    method: LinkedMotifs
    edges: DataFrame
    n: int

    def persistence(self, infinite: bool = True, dim: int | None = None) -> DataFrame:
        """(dim, birth, death, cluster) of every dim, or one. What never dies has an infinite death; infinite=False: 2, to which distances saturate."""
        p = ps.persistence(self.edges if dim is None else self.edges.where(F.col("dim") == dim))
        return p if infinite else p.withColumn("death", F.least("death", F.lit(2.0)))

    def cuts(self) -> tuple[float, float] | None:
        return self.method.cuts(self.edges)

    def found(self, cuts: tuple[float, float] | None = None, **changed) -> Found:
        """Motifs under the automatic cuts or those given (birth, gap); changed: other settings of the method that act after the search (n_patterns, least_weight, ratio, jump, max_wlen)."""
        if late := set(changed) - {"n_patterns", "least_weight", "ratio", "jump", "max_wlen"}:
            raise ValueError(f"{', '.join(sorted(late))}: needs another neighbour search")
        m = replace(self.method, **changed)
        cuts = cuts or m.cuts(self.edges)
        if cuts is None:
            return Found()
        parts = ps.components(self.edges, *cuts).persist()
        try:
            rows = ps.candidates(parts).collect()
            births = {(r["dim"], r["pos"]): r["birth"] for r in parts.collect()}
        finally:
            parts.unpersist()
        cands = graph.resolve([graph.Candidate(r["cand"], frozenset(r["dims"]), frozenset(r["positions"])) for r in rows], m.least_weight, m.n_patterns)
        rank = {}
        for c in cands:
            for p in c.positions:
                b = [births[d, p] for d in c.dims if (d, p) in births]
                if b:
                    rank[c.name, p] = sum(b) / len(b)
        placed = extract.place([(c.name, c.dims, c.positions) for c in cands], rank, self.n, m.wlen, m.max_wlen or m.wlen, m.ratio, not m.compat)
        out = [Motif(sorted(c.dims), sorted((a, z) for name, a, z in placed if name == c.name)) for c in cands]
        return Found([x for x in out if x.spans])


def _best_by_k(sig: DataFrame, w: int, metric: str, zone: int, banned: dict[int, set[int]], mean: bool) -> list[tuple[int, int, int, float, list[int]]]:
    """(k, i, j, distance, dims) of the closest pair for each number of dims; banned: windows left out, by dim. Each part of windows gives one row a k."""

    def run(batches):
        for r in neighbours.rows_of(batches):
            parts = [kernels.Series(x, w) for x in r["x"]]
            m = len(parts[0].windows)
            least: dict[int, tuple] = {}
            for a, z in neighbours.blocks(r, m, len(parts)):
                d = np.stack([np.sqrt(kernels.squared(s, a, z, metric)) for s in parts])
                for dim, places in banned.items():
                    gone = np.array(sorted(places), int)
                    d[dim][:, gone[gone < m]] = np.nan
                    own = gone[(gone >= a) & (gone < z)] - a
                    d[dim][own] = np.nan
                order = np.argsort(np.where(np.isnan(d), np.inf, d), axis=0, kind="stable")
                total = np.cumsum(np.take_along_axis(d, order, 0), 0)
                far = np.abs(np.arange(m) - np.arange(a, z)[:, None]) >= zone
                for k in range(len(parts)):
                    t = np.where(far & ~np.isnan(total[k]), total[k] / (k + 1 if mean else 1), np.inf)
                    i, j = np.unravel_index(t.argmin(), t.shape)
                    if np.isfinite(t[i, j]) and (k not in least or t[i, j] < least[k][0]):
                        least[k] = float(t[i, j]), int(i) + a, int(j), order[: k + 1, i, j].tolist()
            for k, (v, i, j, dims) in least.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i]), pa.array([j]), pa.array([v]), pa.array([dims], pa.list_(pa.int64()))], ["k", "i", "j", "d", "dims"])

    got = neighbours.by_part(neighbours.stacked(sig), w, F.size(F.col("x")[0])).mapInArrow(run, "k long, i long, j long, d double, dims array<bigint>")
    best = got.groupBy("k").agg(F.min_by(F.struct("i", "j", "d", "dims"), F.struct("d", "i", "j")).alias("b")).orderBy("k").collect()
    return [(r["k"], r["b"]["i"], r["b"]["j"], r["b"]["d"], sorted(r["b"]["dims"])) for r in best]


def _z(x: np.ndarray) -> np.ndarray:
    s = x.std(1, keepdims=True)
    return (x - x.mean(1, keepdims=True)) / np.where(s < 1e-7, 1, s)


def _windows_at(sig: DataFrame, places: list[int], w: int) -> dict[int, np.ndarray]:
    """Windows (dims x samples) that begin at the places."""
    rows = sig.join(F.broadcast(sig.sparkSession.createDataFrame([(int(p),) for p in places], "p long")), (F.col("t") >= F.col("p")) & (F.col("t") < F.col("p") + w)).select("p", "dim", "t", "v").distinct().orderBy("p", "dim", "t").collect()
    out: dict[int, dict[int, list[float]]] = {}
    for r in rows:
        out.setdefault(r["p"], {}).setdefault(r["dim"], []).append(r["v"])
    return {p: np.array([x for _, x in sorted(d.items())]) for p, d in out.items()}


def _near(sig: DataFrame, w: int, metric: str, refs: list[int], dims: list[int], radius: float, banned: dict[int, set[int]], strict: bool = True) -> list[int]:
    """Windows nearer than radius to one of refs (mean over dims), greedily w or more apart, nearest first."""

    def run(batches):
        for r in neighbours.rows_of(batches):
            parts = [kernels.Series(r["x"][d], w) for d in dims]
            m = len(parts[0].windows)
            best = np.full(m, np.inf)
            for p in refs:
                d = np.mean([np.sqrt(kernels.squared(s, p, p + 1, metric))[0] for s in parts], 0)
                best = np.fmin(best, d)
            for dim in dims:
                gone = np.array(sorted(banned.get(dim, ())), int)
                best[gone[gone < m]] = np.inf
            on = np.flatnonzero(best < radius if strict else best <= radius)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(best[on])], ["i", "d"])

    rows = neighbours.stacked(sig).mapInArrow(run, "i long, d double").orderBy("d", "i").collect()
    out: list[int] = list(refs)
    for r in rows:
        if all(abs(r["i"] - o) >= w for o in out):
            out.append(r["i"])
    return sorted(out)


def _matches(sig: DataFrame, w: int, metric: str, first: int, dims: list[int], least: float, zone: int) -> list[int]:
    """Windows whose distance to `first` (mean over dims) is at most mean - 2 sd of all such distances, or `least` if that is more; greedily more than `zone` apart, nearest first, `first` before all."""

    def run(batches):
        for r in neighbours.rows_of(batches):
            parts = [kernels.Series(r["x"][d], w) for d in dims]
            d = np.mean([np.sqrt(kernels.squared(s, first, first + 1, metric))[0] for s in parts], 0)
            d[first] = 0
            known = d[np.isfinite(d)]
            on = np.flatnonzero(d <= max(known.mean() - 2 * known.std(), least))
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(d[on])], ["i", "d"])

    rows = neighbours.stacked(sig).mapInArrow(run, "i long, d double").orderBy("d", "i").collect()
    out = [first]
    for r in rows:
        if all(abs(r["i"] - o) > zone for o in out):
            out.append(r["i"])
    return sorted(out)


def _auto_radius(sig: DataFrame, w: int, metric: str, first: int, dims: list[int], least: float) -> float:
    """Mean - 2 sd of the first window's distances (mean over dims), `least` at least."""

    def run(batches):
        for r in neighbours.rows_of(batches):
            parts = [kernels.Series(r["x"][d], w) for d in dims]
            d = np.mean([np.sqrt(kernels.squared(s, first, first + 1, metric))[0] for s in parts], 0)
            d = d[np.isfinite(d)]
            yield pa.RecordBatch.from_arrays([pa.array([float(d.mean() - 2 * d.std())])], ["r"])

    return max(neighbours.stacked(sig).mapInArrow(run, "r double").first()[0], least + 1e-9)


def sdim_motifs(sig: DataFrame, w: int, n_patterns: int, ratio: float | None = 3.0, metric: str = "unit", single: bool = False, left_out: set[int] = frozenset()) -> Found:
    """Sub-dimensional motifs: closest pair for each number of dims, dims by description length, neighbours of both windows (single: of the first) within `ratio` times the pair's mean distance, without a ratio within mean - 2 sd of the first window's distances; then those windows are left out and the next is searched. left_out: windows never used."""
    banned: dict[int, set[int]] = {}
    if left_out:
        banned = {r[0]: set(left_out) for r in sig.select("dim").distinct().collect()}
    out = Found()
    for _ in range(n_patterns):
        best = _best_by_k(sig, w, metric, w, banned, mean=False)
        if not best:
            break
        wins = _windows_at(sig, [p for b in best for p in b[1:3]], w)
        bits = [mdl.window_bits(_z(wins[i]), _z(wins[j]), dims) for _, i, j, _, dims in best]
        k, i, j, d, dims = best[int(np.argmin(bits))]
        radius = _auto_radius(sig, w, metric, i, dims, d / (k + 1)) if ratio is None else ratio * d / (k + 1)
        places = _near(sig, w, metric, [i] if single else [i, j], dims, radius, banned, strict=ratio is not None)
        out.motifs.append(Motif(dims, [(p, p + w) for p in places]))
        for dim in dims:
            banned.setdefault(dim, set()).update(t for p in places for t in range(max(0, p - w + 1), p + w))
    return out


def multidim_motifs(sig: DataFrame, w: int, max_motifs: int = 3, cutoff: float = float("inf"), least_neighbours: int = 1) -> Found:
    """Motifs of the k-dimensional matrix profile with dims by description length; matches of the first window within the greatest distance mean - 2 sd (at least the pair's, so that the pair itself is found), more than a quarter window apart."""
    banned: dict[int, set[int]] = {}
    zone = max(1, -(-w // 4))
    out = Found()
    n_dims = sig.agg(F.max("dim")).first()[0] + 1
    for _ in range(max_motifs):
        best = _best_by_k(sig, w, "znorm", zone + 1, banned, mean=True)
        if not best:
            break
        wins = _windows_at(sig, [p for b in best for p in b[1:3]], w)
        bits = [mdl.window_bits(_z(wins[i]), _z(wins[j]), dims) for _, i, j, _, dims in best]
        k, i, j, d, dims = best[int(np.argmin(bits))]
        if d > cutoff:
            break
        places = _matches(sig, w, "znorm", i, dims, d + 1e-6, zone)
        if len(places) > least_neighbours:
            out.motifs.append(Motif(dims, [(p, p + w) for p in places]))
        for dim in range(n_dims):
            banned.setdefault(dim, set()).update(t for p in places for t in range(max(0, p - zone), p + zone + 1))
    return out


def leitmotifs(sig: DataFrame, lengths: list[int], n_dims: int, k_max: int = 8) -> Found:
    """k-leitmotifs: for each length and k the window with its k - 1 nearest (w apart from one another) whose extent, the greatest pairwise distance on the n_dims dims where the window is nearest to them, is least; k at the elbow of extents, length of least scaled extent.

    The radius (greatest distance to the window itself) bounds the extent from below, so sets of a radius beyond the least extent so far are passed over.
    """
    best: tuple[float, Motif] | None = None
    for w in lengths:

        def run(batches, w: int = w):
            for r in neighbours.rows_of(batches):
                parts = [kernels.Series(x, w) for x in r["x"]]
                least: dict[int, tuple] = {}
                for a, z in neighbours.blocks(r, len(parts[0].windows), len(parts)):
                    d = np.stack([np.sqrt(kernels.squared(s, a, z, "znorm")) for s in parts])
                    d = np.where(np.isnan(d), np.inf, d)
                    mean = np.sort(d, 0)[:n_dims].mean(0)
                    i, rank, j, _ = kernels.nearest(mean, a, w, k_max - 1)
                    for row in range(a, z):
                        near = j[i == row][np.argsort(rank[i == row])]
                        if len(near):
                            _grow(parts, row, near, d[:, row - a], n_dims, least)
                for k, (extent, places, dims) in least.items():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([extent]), pa.array([places], pa.list_(pa.int64())), pa.array([dims], pa.list_(pa.int64()))], ["k", "extent", "places", "dims"])

        got = neighbours.by_part(neighbours.stacked(sig), w, F.size(F.col("x")[0])).mapInArrow(run, "k long, extent double, places array<bigint>, dims array<bigint>")
        by_k = got.groupBy("k").agg(F.min(F.struct("extent", "places", "dims")).alias("b")).orderBy("k").collect()
        extents = np.array([r["b"]["extent"] for r in by_k])
        if len(extents) < 2:
            continue
        at = int((np.diff(extents) / np.maximum(extents[:-1], 1e-9)).argmax())
        score, chosen = extents[at] / np.sqrt(w), by_k[at]["b"]
        if best is None or score < best[0]:
            best = score, Motif(sorted(chosen["dims"]), sorted((p, p + w) for p in chosen["places"]))
    return Found([best[1]] if best else [])


def _grow(parts: list[kernels.Series], row: int, near: np.ndarray, d: np.ndarray, n_dims: int, least: dict[int, tuple]) -> None:
    """Puts into least[k] (extent, places, dims) the set of window `row` and its k - 1 nearest, where its extent is less; d: distances of the row by dim."""
    for k in range(2, len(near) + 2):
        others = near[: k - 1]
        per_dim = d[:, others].sum(1)
        dims = np.sort(np.argsort(per_dim, kind="stable")[:n_dims])
        extent = d[np.ix_(dims, others)].mean(0).max()
        if not np.isfinite(extent) or (k in least and extent >= least[k][0]):
            continue  # the radius on these dims: no set has a smaller extent than that
        for p, q in itertools.combinations(others, 2):
            extent = max(extent, np.mean([_pair(parts[x], p, q) for x in dims]))
        if np.isfinite(extent) and (k not in least or extent < least[k][0]):
            least[k] = float(extent), [int(row), *map(int, others)], [int(x) for x in dims]


def _pair(s: kernels.Series, p: int, q: int) -> float:
    """z-normed distance of two windows; infinite where one is constant."""
    scale = s.w * s.std[p] * s.std[q]
    return float("inf") if scale <= kernels.ETA else float(np.sqrt(max(0.0, 2 * s.w * (1 - (s.windows[p] - s.mean[p]) @ (s.windows[q] - s.mean[q]) / scale))))


def first_component(sig: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The signal on its first principal component, as dim 0, and the loadings; moments are aggregated, D * D numbers reach the driver."""
    stats = sig.groupBy("dim").agg(F.avg("v").alias("m"))
    c = sig.join(F.broadcast(stats), "dim").select("dim", "t", (F.col("v") - F.col("m")).alias("c"))  # one row a dim
    pairs = c.alias("a").join(c.alias("b"), "t").groupBy(F.col("a.dim").alias("x"), F.col("b.dim").alias("y")).agg(F.avg(F.col("a.c") * F.col("b.c")).alias("s")).collect()
    n = 1 + max(r["x"] for r in pairs)
    cov = np.zeros((n, n))
    for r in pairs:
        cov[r["x"], r["y"]] = r["s"]
    load = np.linalg.eigh(cov)[1][:, -1]
    load = load * (1 if load[np.abs(load).argmax()] > 0 else -1)
    weights = F.create_map(*[F.lit(x) for k in range(n) for x in (k, float(load[k]))])
    return c.groupBy("t").agg(F.sum(F.col("c") * weights[F.col("dim")]).alias("v")).select(F.lit(0).alias("dim"), "t", "v"), load


def principal_motifs(sig: DataFrame, lengths: list[int], n_dims: int) -> Found:
    """leitmotifs of the first principal component; dims are the first of the ascending loadings."""
    one, load = first_component(sig)
    found = leitmotifs(one, lengths, 1)
    dims = sorted(np.argsort(load, kind="stable")[:n_dims].tolist())
    return Found([Motif(dims, m.spans) for m in found.motifs])


def univariate_sets(sig: DataFrame, w: int, ratio: float = 2.0, n_sets: int = 3, start_mask: DataFrame | None = None, end_mask: DataFrame | None = None) -> dict[int, list[subspace.MotifSet]]:
    """Per dim, motif sets of fixed length: closest pairs and what lies within `ratio` times their distance. start_mask, end_mask (t, on): windows begin, and end, only at samples that are on."""
    banned: set[int] = set()
    for mask, shift in ((start_mask, 0), (end_mask, w - 1)):
        if mask is not None:
            banned.update(r[0] - shift for r in mask.where("not on").select("t").collect())  # at most a number a sample, for one series
    banned = {p for p in banned if p >= 0}
    out: dict[int, list[subspace.MotifSet]] = {}
    for dim in sorted(r[0] for r in sig.select("dim").distinct().collect()):
        one = sig.where(F.col("dim") == dim).withColumn("dim", F.lit(0))
        out[dim] = [subspace.MotifSet([{dim: s} for s in m.spans]) for m in sdim_motifs(one, w, n_sets, ratio, left_out=banned).motifs]
    return out


def subspace_motifs(sig: DataFrame, w: int, delta: float = 0.5, least_dims: int = 1, names: list[str] | None = None, start_mask: DataFrame | None = None, end_mask: DataFrame | None = None, **constraints) -> list[subspace.MotifSet]:
    """Fixed-length motif sets of single dims, merged across dims under constraints (include, exclude, together: see subspace.plan), with least_dims dims at least."""
    n = sig.agg(F.max("dim")).first()[0] + 1
    groups = subspace.plan(n, names=names, **constraints)
    single = univariate_sets(sig, w, start_mask=start_mask, end_mask=end_mask)

    def discover(group: list[int]) -> list[subspace.MotifSet]:
        sets = single[group[0]]
        for d in group[1:]:
            sets = [s for s in subspace.merge(sets, single[d], delta) if len(s.dims) > 1]
        return [s for s in sets if set(s.dims) == set(group)]

    return subspace.apply(groups, discover, delta, included=bool(constraints.get("include")), least_dims=least_dims)
