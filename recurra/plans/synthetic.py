"""Seeded synthetic signals with planted motifs, one series for each row of an id table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shape(rng: np.random.Generator, length: int, waves: int = 5) -> np.ndarray:
    """A random sum of sines under a squared-sine envelope, of deviation 1."""
    t = np.linspace(0, 1, length)
    x = sum(rng.normal() * np.sin(2 * np.pi * (k + rng.uniform(0.2, 1)) * t + rng.uniform(0, 2 * np.pi)) for k in range(waves))
    x = x * np.sin(np.pi * t) ** 2
    return (x - x.mean()) / max(x.std(), 1e-9)


def make(seed: int, n_motifs: int = 3, n_dims: int = 6, active: int = 2, occurrences: int = 4, length: int = 60, jitter: float = 0.1, noise: float = 0.1, walk: float = 0.0) -> tuple[np.ndarray, list[tuple[int, list[int], list[tuple[int, int]]]]]:
    """Signal (samples, dims) and truth (motif, dims, [start, end exclusive])."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(np.repeat(np.arange(n_motifs), occurrences))
    dims = [sorted(rng.choice(n_dims, active, replace=False).tolist()) for _ in range(n_motifs)]
    shapes = [[shape(rng, length) for _ in d] for d in dims]
    at, spans = 0, []
    for m in order:
        at += int(rng.integers(length // 2, length))
        size = int(round(length * (1 + rng.uniform(-jitter, jitter))))
        spans.append((int(m), at, at + size))
        at += size
    n = at + length
    x = rng.normal(0, noise, (n, n_dims)) + np.cumsum(rng.normal(0, walk, (n, n_dims)), 0)
    for m, a, z in spans:
        for d, s in zip(dims[m], shapes[m]):
            x[a:z, d] += (1 + rng.uniform(-jitter, jitter)) * np.interp(np.linspace(0, 1, z - a), np.linspace(0, 1, length), s)
    return x, [(m, dims[m], [(a, z) for k, a, z in spans if k == m]) for m in range(n_motifs)]


def signals(spark: SparkSession, n_series: int, seed: int = 0, **options) -> DataFrame:
    """signal(series_id, dim, t, v) of n_series generated series."""

    def run(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                x, _ = make(seed + s, **options)
                n, d = x.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * d, s)), pa.array(np.repeat(np.arange(d, dtype=np.int32), n)), pa.array(np.tile(np.arange(n), d)), pa.array(x.T.ravel())], ["series_id", "dim", "t", "v"])

    return spark.range(n_series).mapInArrow(run, "series_id long, dim int, t long, v double")


def truth(spark: SparkSession, n_series: int, seed: int = 0, **options) -> DataFrame:
    """motif_loc(series_id, motif, dim, start, end) of the same series."""

    def run(batches):
        for b in batches:
            rows = [(s, m, d, a, z) for s in b.column(0).to_pylist() for m, dims, spans in make(seed + s, **options)[1] for d in dims for a, z in spans]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["series_id", "motif", "dim", "start", "end"])

    return spark.range(n_series).mapInArrow(run, "series_id long, motif int, dim int, start long, end long")


def make_subspace(seed: int, n_motifs: int = 2, n_dims: int = 5, active: int = 3, occurrences: int = 4, length: int = 50, offset: int = 10, noise: float = 0.1) -> tuple[np.ndarray, list[list[dict[int, tuple[int, int]]]]]:
    """Signal (samples, dims) and, for each motif, its occurrences as dim -> [start, end): each dim of a motif is shifted by its own offset, the same in every occurrence."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(np.repeat(np.arange(n_motifs), occurrences))
    dims = [sorted(rng.choice(n_dims, active, replace=False).tolist()) for _ in range(n_motifs)]
    shifts = [rng.integers(0, offset + 1, active) for _ in range(n_motifs)]
    shapes = [[shape(rng, length) for _ in d] for d in dims]
    gap = length // 2
    n = (length + offset + gap) * len(order) + gap
    x, truth, at = rng.normal(0, noise, (n, n_dims)), [[] for _ in range(n_motifs)], gap
    for m in order:
        where = {}
        for d, s, g in zip(dims[m], shifts[m], shapes[m]):
            x[at + s : at + s + length, d] += g
            where[d] = (int(at + s), int(at + s + length))
        truth[m].append(where)
        at += length + offset + gap
    return x, truth


def from_instances(instances: list[tuple[str, np.ndarray]], seed: int, n_classes: int, per_class: int, length: int | None = None) -> tuple[np.ndarray, list[tuple[str, int, int]]]:
    """A benchmark series of labelled instances (samples, dims): sampled classes and instances, no two of a class in a row where it can be helped, each resampled to `length`, one after another; and [start, end) by label."""
    rng = np.random.default_rng(seed)
    labels = sorted({k for k, _ in instances})
    chosen = rng.choice(labels, min(n_classes, len(labels)), replace=False)
    left = {k: [x for n, x in instances if n == k] for k in sorted(chosen)}
    left = {k: [v[i] for i in rng.permutation(len(v))[:per_class]] for k, v in left.items()}
    parts, truth, at, last = [], [], 0, None
    while any(left.values()):
        most = max((k for k in left if left[k] and (k != last or sum(map(bool, left.values())) == 1)), key=lambda k: (len(left[k]), k))
        x = left[most].pop()
        if length:
            old, new = np.linspace(0, 1, len(x)), np.linspace(0, 1, length)
            x = np.stack([np.interp(new, old, x[:, d]) for d in range(x.shape[1])], 1)
        parts.append(x)
        truth.append((most, at, at + len(x)))
        at, last = at + len(x), most
    return np.concatenate(parts) if parts else np.zeros((0, 1)), truth
