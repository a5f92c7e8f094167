"""numpy kernels for windows of a series: statistics, and blocks of distances to all windows by tiles of matrix products.

Only the series and its statistics, one number a window, are kept; centred windows exist for a block of rows and a tile
of columns at a time, so memory is linear in the series whatever the window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

ETA = 1e-9
#: Numbers of a tile of windows, and of a block of distances.
TILE, CELLS = 1 << 20, 1 << 22


@dataclass
class Series:
    x: np.ndarray
    w: int

    def __post_init__(self) -> None:
        if not 3 <= self.w <= len(self.x):
            raise ValueError(f"windows of {self.w} samples in a series of {len(self.x)}: 3 at least, and no more than the series has")
        self.windows = sliding_window_view(self.x, self.w)
        self.line = np.arange(self.w) - (self.w - 1) / 2
        self.spread = (self.w**2 - 1) / 12
        m = len(self.windows)
        self.mean, self.std, self.slope, self.eta, self.energy = (np.empty(m) for _ in range(5))
        for a, z in self.tiles():
            self.mean[a:z] = self.windows[a:z].mean(1)
            c = self.centred(a, z)
            self.std[a:z] = np.sqrt((c**2).mean(1))
            self.slope[a:z] = c @ self.line / (self.w * self.spread)
            self.eta[a:z] = np.sqrt(((c - self.slope[a:z, None] * self.line) ** 2).sum(1))
            self.energy[a:z] = (self.windows[a:z] ** 2).sum(1)

    def tiles(self) -> list[tuple[int, int]]:
        step, m = max(1, TILE // self.w), len(self.windows)
        return [(a, min(a + step, m)) for a in range(0, m, step)]

    def centred(self, a: int, z: int) -> np.ndarray:
        return self.windows[a:z] - self.mean[a:z, None]

    def residual(self, a: int, z: int) -> np.ndarray:
        return self.centred(a, z) - self.slope[a:z, None] * self.line


#: Metrics: 'znorm' (2w(1-r)), 'unit' (2(1-r)), 'detrended' (2(1-r) of the residuals from a line), 'raw'.
METRICS = ("znorm", "unit", "detrended", "raw")


def squared(s: Series, a: int, z: int, metric: str, other: Series | None = None) -> np.ndarray:
    """Squared distances of windows a..z of s to all windows of other (or s); NaN where a window is degenerate."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r}; known are {', '.join(METRICS)}")
    o = other or s
    out = np.empty((z - a, len(o.windows)))
    if metric == "raw":
        for c, e in o.tiles():
            out[:, c:e] = np.maximum(s.energy[a:z, None] + o.energy[c:e] - 2 * s.windows[a:z] @ o.windows[c:e].T, 0)
        return out
    if metric == "detrended":
        part, left, right = Series.residual, s.eta[a:z], o.eta
    else:
        part, left, right = Series.centred, s.std[a:z] * np.sqrt(s.w), o.std * np.sqrt(s.w)
    u = part(s, a, z)
    for c, e in o.tiles():
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (u @ part(o, c, e).T) / (left[:, None] * right[c:e])
        r[left <= ETA] = np.nan
        r[:, right[c:e] <= ETA] = np.nan
        out[:, c:e] = np.maximum(2 * (s.w if metric == "znorm" else 1) * (1 - r), 0)
    return out


def nearest(d: np.ndarray, first: int, zone: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, neighbour, distance): greedily the k nearest windows of each row that lie `zone` or more apart from it and from one another; ties to the smaller place. d is overwritten."""
    rows = np.arange(len(d))
    d[np.isnan(d)] = np.inf

    def leave_out(at: np.ndarray) -> None:
        for r, p in enumerate(at.tolist()):
            d[r, max(0, p - zone + 1) : p + zone] = np.inf

    leave_out(first + rows)
    out = []
    for rank in range(k):
        j = d.argmin(1)
        best = d[rows, j]
        ok = np.isfinite(best)
        out.append((first + rows[ok], np.full(ok.sum(), rank), j[ok], best[ok]))
        if rank + 1 < k:
            leave_out(j)
    return tuple(np.concatenate(c) for c in zip(*out))
