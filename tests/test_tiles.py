"""Self-joins by diagonal tiles against plain distances, over many tile edges."""

import time

import numpy as np
import pytest

from recurra.functions import kernels, tiles
from recurra.operators import neighbours


def _signal(spark, dims):
    return spark.createDataFrame([(d, t, None if v is None else float(v)) for d, x in enumerate(dims) for t, v in enumerate(x)], "dim int, t long, v double")


def _plain(x, w, k, metric, zone, digits=6):
    s = kernels.Series(np.asarray(x, float), w)
    d = np.round(np.sqrt(kernels.squared(s, 0, len(s.windows), metric)), digits)
    return sorted(zip(*(c.tolist() for c in kernels.nearest(d, 0, zone, k))))


def _series(n, seed):
    r = np.random.default_rng(seed)
    x = np.sin(np.arange(n) / 5) + r.normal(0, 0.3, n).cumsum() * 0.2
    x[n // 2 : n // 2 + 40] = x[:40]  # a copy, and a stretch of one value
    x[n // 3 : n // 3 + 30] = 1e3
    return x


@pytest.mark.parametrize("metric", kernels.METRICS)
@pytest.mark.parametrize("w", [3, 17, 300])
def test_tile_distances_equal_those_of_windows(metric, w):
    x = _series(900, 3) + 1e4
    win = np.lib.stride_tricks.sliding_window_view(x.astype(np.longdouble), w)
    if metric != "raw":
        win = win - win.mean(1)[:, None]
    if metric == "detrended":
        line = np.arange(w) - np.longdouble(w - 1) / 2
        win = win - (win @ line / (line @ line))[:, None] * line
    size = np.sqrt((win**2).sum(1))
    flat = np.zeros(len(win), bool) if metric == "raw" else size < 1e-9
    unit = win if metric == "raw" else win / np.where(flat, 1, size)[:, None] * (np.sqrt(np.longdouble(w)) if metric == "znorm" else 1)
    want = np.array([np.sqrt(((unit[i] - unit[50:550]) ** 2).sum(1)) for i in range(100, 400)])
    a, b = tiles.Block.of(100, x[100 : 400 + w - 1], w, metric), tiles.Block.of(50, x[50 : 550 + w - 1], w, metric)
    got = tiles.distances(a, b, metric, None)
    none = flat[100:400, None] | flat[50:550]
    assert (none == np.isinf(got)).all() and (np.abs(got - want)[~none] < 1e-6).all()


def test_lists_are_merged_as_all_windows_would_be(monkeypatch):
    """merge_apart, asked again as long as it wants to be, against the greedy choice over the whole row; with many ties."""
    r = np.random.default_rng(5)
    asked = 0
    for trial in range(60):
        n, zone, k, edge = 60, int(r.integers(1, 12)), int(r.integers(1, 6)), int(r.integers(7, 30))
        d = r.integers(0, 25, (8, n)).astype(float)
        want = sorted(zip(*(c.tolist() for c in tiles.best_apart(d.copy(), zone, k))))
        spans = [(a, min(a + edge, n)) for a in range(0, n, edge)]
        rows = [(i, t, j + a, v) for t, (a, z) in enumerate(spans) for i, j, v in zip(*tiles.best_apart(d[:, a:z].copy(), zone, k))]
        picks = {i: [] for i in range(8)}
        while rows:
            row, tile, j, v = (np.array(c) for c in zip(*rows))
            m = tiles.merge_apart(row, tile, j, v, np.array([k - len(picks[i]) for i in row]), zone)
            before = {i: len(p) for i, p in picks.items()}
            for i, turn, p, x in sorted(zip(*m.picks), key=lambda q: (q[0], q[1])):
                assert turn == len(picks[i]) - before[i]
                picks[i].append((int(p), float(x)))
            rows = [rows[x] for x in m.left]
            for i, t in zip(*m.asks):
                asked += 1
                a, z = spans[t]
                own = d[i : i + 1].copy()
                for p, _ in picks[i]:
                    tiles.leave_zone(own, np.array([p]), zone)
                rows += [(i, t, q + a, v) for _, q, v in zip(*tiles.best_apart(own[:, a:z].copy(), zone, k))]
            if not len(m.asks[0]):
                break
        assert sorted((i, p, x) for i, got in picks.items() for p, x in got) == want
    assert asked > 50


@pytest.mark.parametrize("metric,w,k,zone", [("detrended", 9, 4, None), ("znorm", 16, 3, 40), ("raw", 5, 5, 3)])
def test_neighbours_over_tile_edges(spark, monkeypatch, metric, w, k, zone):
    monkeypatch.setattr(neighbours, "SMALL", 37)
    monkeypatch.setattr(neighbours, "LARGE", 37)
    monkeypatch.setattr(neighbours, "LISTS", 16)
    x = [_series(260, 1), _series(260, 2)]
    got = neighbours.knn(_signal(spark, x), w, k, metric, zone).collect()
    for dim, v in enumerate(x):
        mine = sorted((r["i"], r["rank"], r["j"], r["d"]) for r in got if r["dim"] == dim)
        want = _plain(v, w, k, metric, zone or w)
        assert [m[:3] for m in mine] == [p[:3] for p in want]
        assert np.allclose([m[3] for m in mine], [p[3] for p in want], atol=2e-6)


def test_missing_samples_and_short_series(spark):
    x = _series(120, 4)
    holes = x.tolist()
    holes[50], holes[70] = None, float("inf")
    got = neighbours.knn(_signal(spark, [x, holes, x[:7], np.ones(60)]), 8, 1).collect()
    assert {r["dim"] for r in got} == {0, 1}
    bad = {i for i in range(113) if 43 <= i <= 50 or 63 <= i <= 70}
    assert not bad & {r["i"] for r in got if r["dim"] == 1} and not bad & {r["j"] for r in got if r["dim"] == 1}
    assert neighbours.knn(_signal(spark, [x[:7]]), 8, 1).count() == 0
    with pytest.raises(Exception, match="one sample for every t"):
        neighbours.knn(_signal(spark, [x]).where("t <> 60"), 8, 1).count()


def test_time_of_a_tile_does_not_follow_the_window():
    x = np.random.default_rng(0).normal(size=4096 + 1000)

    def took(w):
        a, b = tiles.Block.of(0, x[: 1024 + w - 1], w, "detrended"), tiles.Block.of(2000, x[2000 : 2000 + 2048 + w - 1], w, "detrended")
        began = time.perf_counter()
        tiles.distances(a, b, "detrended", 6)
        return time.perf_counter() - began

    assert min(took(1000) for _ in range(3)) < 2 * min(took(24) for _ in range(3))
