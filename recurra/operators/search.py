"""Profiles of a query window over a series: sliding dot products by Fourier transform, z-normed and p-norm distances.

A series is dealt in chunks that reach w - 1 samples into the next (overlap-save); a chunk and its query meet in a task, so
memory is linear in chunk and window, and no row carries a window. Time of 'dot' and 'znorm' doesn't depend on the window, but for cells that
the transform or running sums leave unsure: those are computed from their windows, a bounded number at once.

Every t of a dim from its first to its last has one sample, else the task fails. A window with a missing or infinite sample has a null
value, and so has every window of a dim whose query has one; dims without a whole query have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.functions.windows import CONSTANT, chunked

KINDS = ("dot", "znorm", "pnorm")
#: Numbers of windows that are gathered at once.
GATHER = 1 << 20
EPS = np.finfo(float).eps


def query_at(sig: DataFrame, w: int, place: int) -> DataFrame:
    """(dim, q): the w samples from t = place on, of dims that have them."""
    own = sig.where((F.col("t") >= place) & (F.col("t") < place + w)).groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return own.where(F.size("s") == w).select("dim", F.transform("s", lambda s: s["v"].cast("double")).alias("q"))


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of q with all windows of x, by one transform of at least len(x) places: what wraps around isn't among them."""
    n = 1 << (len(x) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.conj(np.fft.rfft(q, n)), n)[: len(x) - len(q) + 1]


def _direct(x: np.ndarray, w: int, cells: np.ndarray, make) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    view, step = sliding_window_view(x, w), max(1, GATHER // w)
    for k in range(0, len(cells), step):
        c = cells[k : k + step]
        yield c, make(view[c])


def deviations(x: np.ndarray, w: int) -> np.ndarray:
    """Standard deviations of all windows, by running sums; small ones, in which their errors would show, directly."""
    c = (x - x.mean()).astype(np.longdouble)
    sums = lambda v: np.concatenate([[0], np.cumsum(v)])
    run = lambda v: (sums(v)[w:] - sums(v)[:-w]) / w
    var = (run(c * c) - run(c) ** 2).astype(float)
    error = len(x) * float(np.finfo(np.longdouble).eps) * float((c * c).max())
    for cells, v in _direct(x, w, np.flatnonzero(var < 1e9 * error), lambda u: u.var(1)):
        var[cells] = v
    return np.sqrt(np.maximum(var, 0))


def znormed(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """z-normed distances of q to all windows of x; both constant: 0, one: the root of w."""
    w, own, sd = len(q), q.std(), deviations(x, len(q))
    flat = sd < CONSTANT
    if own < CONSTANT:
        return np.where(flat, 0.0, np.sqrt(w))
    c, z = x - x.mean(), (q - q.mean()) / own
    scale = np.where(flat, 1.0, sd)
    square = 2 * w * (1 - dots(c, z) / (w * scale))
    # the transform's error of a dot product is about that of its norms; a distance shows it over itself
    error = 2 * EPS * (8 + np.log2(len(x))) * np.linalg.norm(c) * np.linalg.norm(z) / scale
    near = np.flatnonzero(~flat & (square < (1e8 * error) ** 2))

    def make(u: np.ndarray) -> np.ndarray:
        u = u - u.mean(1, keepdims=True)
        return ((u / np.sqrt((u * u).mean(1, keepdims=True)) - z) ** 2).sum(1)

    for cells, v in _direct(x, w, near, make):
        square[cells] = v
    return np.where(flat, np.sqrt(w), np.sqrt(np.maximum(square, 0)))


def pnormed(x: np.ndarray, q: np.ndarray, p: float) -> np.ndarray:
    out = np.empty(len(x) - len(q) + 1)
    for cells, v in _direct(x, len(q), np.arange(len(out)), lambda u: (np.abs(u - q) ** p).sum(1) ** (1 / p)):
        out[cells] = v
    return out


def profile(sig: DataFrame, query: DataFrame, w: int, kind: str = "znorm", p: float = 2.0, size: int | None = None) -> DataFrame:
    """(dim, i, d): of every window of w samples its dot product with the query of its dim (kind 'dot'), or its distance to it.

    query: (dim, q), one row a dim, w samples. size: samples of a chunk.
    """
    if kind not in KINDS:
        raise ValueError(f"kind {kind!r}; known are {', '.join(KINDS)}")
    if w < 3:
        raise ValueError("windows have 3 samples at least")
    made = {"dot": dots, "znorm": znormed, "pnorm": lambda x, q: pnormed(x, q, p)}[kind]
    given = chunked(sig.select("dim", "t", F.col("v").cast("double").alias("v")), 0, w - 1, size)
    parts = given.groupBy("dim", "chunk").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.when(F.col("own") == F.col("chunk"), 1)).alias("starts"), F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s")
    )
    rows = parts.where("starts > 0").select("dim", "first", "last", "starts", F.transform("s", lambda s: s["v"]).alias("x")).join(query.select("dim", "q"), "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda v: v.values.to_numpy(zero_copy_only=False).astype(float)
        for b in batches:
            for r in range(b.num_rows):
                dim, first, last, starts = (b.column(c)[r].as_py() for c in range(4))
                x, q = numbers(b.column(4)[r]), numbers(b.column(5)[r])
                if len(x) != last - first + 1:
                    raise ValueError(f"dim {dim} has {len(x)} samples from {first} to {last}: a dim needs one for every t")
                if len(q) != w:
                    raise ValueError(f"the query of dim {dim} has {len(q)} samples, not {w}")
                n = min(starts, len(x) - w + 1)
                if n < 1:
                    continue
                x = x[: n + w - 1]
                sound = np.isfinite(x)
                bad = np.concatenate([[0], np.cumsum(~sound)])
                ok = (bad[w:] == bad[:-w]) & np.isfinite(q).all()
                d = made(np.where(sound, x, 0.0), q) if ok.any() else np.zeros(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.array(np.arange(first, first + n)), pa.array(d, mask=~ok)], ["dim", "i", "d"])

    return rows.mapInArrow(run, "dim int, i long, d double")
