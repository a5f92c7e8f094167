"""numpy kernels for a tile: the distances of a block of windows to another block, by dot products moved along diagonals.

A block is a stretch of samples and the statistics of the windows that begin in it. The dot product of two windows
follows from that of the windows one sample before by one product more and one less, so a cell costs the same whatever
the window; every SEED rows are computed anew, so rounding errors don't add up. Cells so near to 0 that the error that
is left could show are computed again from their windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from recurra.functions.kernels import ETA, METRICS, Series

#: Rows after which dot products are computed directly, and numbers of windows gathered at once.
SEED, GATHER = 256, 1 << 20


@dataclass
class Block:
    """Windows first, first + 1, ... of w samples over x; mean and slope are 0 and scale 1 where the metric has none; energy is that of the raw metric."""

    first: int
    x: np.ndarray
    w: int
    mean: np.ndarray
    slope: np.ndarray
    scale: np.ndarray
    energy: np.ndarray

    @staticmethod
    def of(first: int, x: np.ndarray, w: int, metric: str) -> Block:
        if metric not in METRICS:
            raise ValueError(f"metric {metric!r}; known are {', '.join(METRICS)}")
        x = np.asarray(x, float)
        sound = np.isfinite(x)
        whole = sliding_window_view(sound, w).all(1)
        x = np.where(sound, x, 0.0)  # windows that hold such a sample are degenerate; it must not run on along the diagonals
        centre = 0.0 if metric == "raw" else x.mean()  # a shift that no other metric sees
        s = Series(x, w)
        m = len(s.mean)
        none, one = np.zeros(m), np.ones(m)
        s.energy[~whole] = s.eta[~whole] = s.std[~whole] = np.nan
        if metric == "raw":
            return Block(first, x, w, none, none, one, s.energy)
        x = x - centre
        if metric == "detrended":
            return Block(first, x, w, s.mean - centre, s.slope, s.eta, none)
        return Block(first, x, w, s.mean - centre, none, s.std * np.sqrt(w), none)

    def __len__(self) -> int:
        return len(self.mean)

    def part(self, a: int, z: int) -> Block:
        """Windows a..z of the block."""
        return Block(self.first + a, self.x[a : z + self.w - 1], self.w, *(v[a:z] for v in (self.mean, self.slope, self.scale, self.energy)))


def dots(x: np.ndarray, y: np.ndarray, w: int) -> np.ndarray:
    """Dot products of all windows of x with all of y."""
    n, m = len(x) - w + 1, len(y) - w + 1
    q, step = np.empty((n, m)), np.empty(m - 1)
    left = np.correlate(x, y[:w], "valid")
    enters, leaves = y[w:], y[: m - 1]
    for i in range(n):
        row = q[i]
        if i % SEED == 0:
            row[:] = np.correlate(y, x[i : i + w], "valid")
            continue
        np.multiply(enters, x[i - 1 + w], out=step)
        np.add(q[i - 1, :-1], step, out=row[1:])
        np.multiply(leaves, x[i - 1], out=step)
        row[1:] -= step
        row[0] = left[i]
    return q


def squared(a: Block, b: Block, metric: str, digits: int = 6) -> np.ndarray:
    """Squared distances of the windows of two blocks; NaN where a window is degenerate. digits: those of the distance that matter."""
    w = a.w
    if metric == "raw":
        centre, ones = a.x.mean(), np.ones(w)
        x, y = a.x - centre, b.x - centre  # one shift for both changes no distance
        left, right = (np.where(np.isnan(e), np.nan, np.correlate(v * v, ones, "valid")) for v, e in ((x, a.energy), (y, b.energy)))
        d = left[:, None] + right - 2 * dots(x, y, w)
        error = 16 * np.finfo(float).eps * max(left.max(initial=0, where=left > 0), right.max(initial=0, where=right > 0)) * 10.0 ** (digits + 2)
        _again(d, np.nonzero(d < error**2), a, b, lambda u, v, i, j: ((u - v) ** 2).sum(1))
        return np.maximum(d, 0, out=d)
    top = np.abs(a.x).max() * np.abs(b.x).max() * w
    q = dots(a.x, b.x, w)
    q -= np.multiply.outer(w * a.mean, b.mean)
    if metric == "detrended":
        q -= np.multiply.outer(w * (w * w - 1) / 12 * a.slope, b.slope)
    factor = 2 * w if metric == "znorm" else 2
    with np.errstate(divide="ignore", invalid="ignore"):
        inv_a, inv_b = np.where(a.scale > ETA, 1 / a.scale, np.nan), np.where(b.scale > ETA, 1 / b.scale, np.nan)
    q *= inv_a[:, None]
    q *= inv_b
    d = np.subtract(1, q, out=q)
    d *= factor
    # the error of a correlation is at most about `error`; that of the distance is it over the distance
    error = 16 * np.finfo(float).eps * top * np.multiply.outer(inv_a, inv_b)
    error *= factor * 10.0 ** (digits + 2)
    np.square(error, out=error)
    near = np.nonzero(d < error)
    line = np.arange(w) - (w - 1) / 2

    def direct(u, v, i, j):
        u = u - a.mean[i, None] - a.slope[i, None] * line
        v = v - b.mean[j, None] - b.slope[j, None] * line
        return factor * (1 - np.einsum("ij,ij->i", u, v) / (a.scale[i] * b.scale[j]))

    _again(d, near, a, b, direct)
    return np.maximum(d, 0, out=d)


def _again(d: np.ndarray, near: tuple[np.ndarray, np.ndarray], a: Block, b: Block, direct) -> None:
    """Cells `near` of d from their windows."""
    u, v = sliding_window_view(a.x, a.w), sliding_window_view(b.x, b.w)
    step = max(1, GATHER // a.w)
    for k in range(0, len(near[0]), step):
        i, j = near[0][k : k + step], near[1][k : k + step]
        d[i, j] = direct(u[i], v[j], i, j)


def leave_zone(d: np.ndarray, place: np.ndarray, zone: int) -> None:
    """Columns less than `zone` from each row's place become infinite."""
    m = d.shape[1]
    for r, (a, z) in enumerate(zip(np.clip(place - zone + 1, 0, m).tolist(), np.clip(place + zone, 0, m).tolist())):
        if a < z:
            d[r, a:z] = np.inf


def best_apart(d: np.ndarray, zone: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance): of each row greedily the k least finite cells that are `zone` or more apart, ties to the smaller column. d is overwritten."""
    rows, out = np.arange(len(d)), []
    for turn in range(k):
        j = d.argmin(1)
        v = d[rows, j]
        ok = np.isfinite(v)
        out.append((rows[ok], j[ok], v[ok]))
        if turn + 1 < k:
            leave_zone(d, j, zone)
    return tuple(np.concatenate(c) for c in zip(*out))


def strips(n: int, size: int = 2 * SEED) -> list[tuple[int, int]]:
    return [(a, min(a + size, n)) for a in range(0, n, size)]


def distances(a: Block, b: Block, metric: str, digits: int | None) -> np.ndarray:
    """Distances of the windows of two blocks, rounded; infinite where a window is degenerate."""
    out = np.empty((len(a), len(b)))
    for r, z in strips(len(a)):
        d = np.sqrt(squared(a.part(r, z), b, metric, 9 if digits is None else digits))
        out[r:z] = d if digits is None else np.round(d, digits)
    out[np.isnan(out)] = np.inf
    return out


@dataclass
class Merged:
    """picks: (row, turn, column, distance); left: places in the input of candidates that still hold; asks: (row, tile) whose list has to be made anew."""

    picks: tuple[np.ndarray, ...]
    left: np.ndarray
    asks: tuple[np.ndarray, np.ndarray]


def merge_apart(row: np.ndarray, tile: np.ndarray, j: np.ndarray, d: np.ndarray, want: np.ndarray, zone: int) -> Merged:
    """The picks of each row that are certain, from the lists of its tiles; want: how many the row (same for its candidates) still needs.

    A tile's list are its own greedy picks, as many as wanted or all there are. Picking greedily from all lists in order of
    (d, column), a pick may leave out a candidate c of another tile's list. What c had left out within that tile, and no list holds,
    comes after c in this order: every pick before the first candidate left out is the pick from all windows. From there on the
    row isn't certain. Then the tiles that lost a candidate have to make their lists anew, apart from the picks so far; the
    lists of all other tiles still hold, as none of theirs went but by being picked. Each turn has one certain pick at
    least, so `want` turns end it.
    """
    order = np.lexsort((j, d, row))
    srow, stile, sj, sd = row[order], tile[order], j[order], d[order]
    names, first, count = np.unique(srow, return_index=True, return_counts=True)
    n, width = len(names), int(count.max()) if len(count) else 0
    place, line = np.arange(len(row)) - np.repeat(first, count), np.repeat(np.arange(n), count)
    jj, dd = np.full((n, width), -1, np.int64), np.full((n, width), np.inf)
    jj[line, place], dd[line, place] = sj, sd
    free, lost = jj >= 0, np.zeros((n, width), bool)
    need = want[order][first] if n else np.zeros(0, np.int64)
    horizon, n_picks = np.full(n, width), np.zeros(n, np.int64)
    picks = []
    for turn in range(int(need.max()) if n else 0):
        p = free.argmax(1)
        at = np.arange(n)
        on = np.flatnonzero(free[at, p] & (p < horizon) & (n_picks == turn) & (turn < need))
        if not len(on):
            break
        p = p[on]
        picks.append((names[on], np.full(len(on), turn), jj[on, p], dd[on, p]))
        n_picks[on] += 1
        free[on, p] = False
        gone = free[on] & (np.abs(jj[on] - jj[on, p][:, None]) < zone)
        free[on] &= ~gone
        lost[on] |= gone
        horizon[on] = np.minimum(horizon[on], np.where(gone.any(1), gone.argmax(1), width))
    unsure = (n_picks < need) & (horizon < width)
    asked = lost[line, place] & unsure[line]
    asks = np.unique(np.stack([srow[asked], stile[asked]]), axis=1)
    stale = np.zeros(len(row), bool)
    if asks.shape[1]:
        span = int(stile.max()) + 1
        stale = np.isin(line * span + stile, np.searchsorted(names, asks[0]) * span + asks[1])
    left = order[free[line, place] & unsure[line] & ~stale]
    got = tuple(np.concatenate(c) for c in zip(*picks)) if picks else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return Merged(got, left, (asks[0], asks[1]))
