"""Time-warped motifs of one series: paths of similar samples off the diagonal, grouped by the segment that they repeat.

Similarity is exp(-(difference)**2) of the z-normalised samples; a cell at or above the quantile rho adds its similarity
to the best of three warping steps before it, another shrinks what it inherits. Paths are traced from the greatest
cells; a segment's set is the segment and its images under the paths that cross it; the fitness of a set is the
harmonic mean of its normalised score and coverage. Quadratic in the series: meant for down-sampled series, one a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recurra.operators.neighbours import packed

STEPS = ((1, 1), (2, 1), (1, 2))


def similarity(x: np.ndarray) -> np.ndarray:
    z = (x - x.mean()) / max(x.std(), 1e-9)
    return np.exp(-((z[:, None] - z) ** 2))


def similarity_quantile(x: np.ndarray, rho: float) -> float:
    """The quantile of similarities above the diagonal."""
    s = similarity(x)
    return float(np.quantile(s[np.triu_indices(len(x), 1)], rho)) if len(x) > 1 else 1.0


def paths(x: np.ndarray, shortest: int, rho: float) -> list[np.ndarray]:
    """All paths (cells i < j) of at least `shortest` steps, best first; cells near a path are used once."""
    n = len(x)
    s, cut = similarity(x), similarity_quantile(x, rho)
    best = np.zeros((n + 2, n + 2))
    came = np.full((n + 2, n + 2), -1, np.int8)
    for i in range(n):
        for j in range(i + shortest, n):
            inherited = [best[i + 2 - a, j + 2 - b] for a, b in STEPS]
            k = int(np.argmax(inherited))
            v = s[i, j] + inherited[k] if s[i, j] >= cut else 0.5 * inherited[k] - 2 * cut
            if v > 0:
                best[i + 2, j + 2], came[i + 2, j + 2] = v, k if inherited[k] > 0 else -1
    out = []
    free = best.copy()
    cells_in_order = np.argsort(-best, axis=None, kind="stable")[: int((best > 0).sum())]
    for i, j in zip(*(c.tolist() for c in np.unravel_index(cells_in_order, best.shape))):
        if free[i, j] <= 0:
            continue
        cells = []
        while True:
            cells.append((i - 2, j - 2))
            k = came[i, j]
            if k < 0 or free[i - STEPS[k][0], j - STEPS[k][1]] <= 0:
                break
            i, j = i - STEPS[k][0], j - STEPS[k][1]
        for a, b in cells:
            free[max(2, a + 2 - shortest // 2) : a + 3 + shortest // 2, b + 2] = 0
            free[a + 2, max(2, b + 2 - shortest // 2) : b + 3 + shortest // 2] = 0
        p = np.array(cells[::-1])
        if p[-1, 0] - p[0, 0] + 1 >= shortest and p[-1, 1] - p[0, 1] + 1 >= shortest:
            out.append(p)
    return out


def images(found: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray, a: int, z: int) -> list[tuple[int, int]]:
    """Where the paths (x, y), with x from ends[0] to ends[1], that cross all of [a, z) lead."""
    out = []
    for k in np.flatnonzero((ends[0] <= a) & (ends[1] >= z - 1)):
        x, y = found[k]
        out.append((int(y[np.searchsorted(x, a)]), int(y[min(np.searchsorted(x, z - 1), len(y) - 1)]) + 1))
    return out


def motif_sets(x: np.ndarray, shortest: int, longest: int, rho: float = 0.8, n_sets: int = 3, step: int = 1) -> list[list[tuple[int, int]]]:
    """Sets of intervals, best first; later sets don't overlap earlier ones."""
    found = [q for p in paths(x, shortest, rho) for q in ((p[:, 0], p[:, 1]), (p[:, 1], p[:, 0]))]
    ends = np.array([(q[0], q[-1]) for q, _ in found], int).reshape(-1, 2).T
    taken, out = np.zeros(len(x), bool), []
    for _ in range(n_sets):
        best: tuple[float, list[tuple[int, int]]] = (0.0, [])
        for a in range(0, len(x) - shortest + 1, step):
            for z in range(a + shortest, min(a + longest, len(x)) + 1, step):
                if taken[a:z].any():
                    continue
                kept = [(a, z)]
                for b, y in sorted(images(found, ends, a, z)):
                    if shortest <= y - b <= longest and not taken[b:y].any() and all(y <= p or b >= q for p, q in kept):
                        kept.append((b, y))
                if len(kept) > 1:
                    score, cover = (len(kept) - 1) / len(kept), sum(q - p for p, q in kept) / len(x)
                    fit = 2 * score * cover / (score + cover)
                    if fit > best[0]:
                        best = fit, sorted(kept)
        if not best[1]:
            break
        out.append(best[1])
        for p, q in best[1]:
            taken[p:q] = True
    return out


def warped_motifs(sig: DataFrame, shortest: int, longest: int, rho: float = 0.8, n_sets: int = 3) -> DataFrame:
    """(dim, motif, start, end exclusive) per dim, each dim in its own task."""

    def run(t: pa.Table) -> pa.Table:
        dim, x = t["dim"][0].as_py(), np.array(t["x"][0].as_py(), float)
        rows = [(dim, k, a, z) for k, s in enumerate(motif_sets(x, shortest, longest, rho, n_sets)) for a, z in s]
        return pa.table({n: pa.array([r[k] for r in rows], ty) for k, (n, ty) in enumerate((("dim", pa.int32()), ("motif", pa.int32()), ("start", pa.int64()), ("end", pa.int64())))})

    return packed(sig, "dim").groupBy("dim").applyInArrow(run, "dim int, motif int, start long, end long")
