"""Profiles of a query against whole windows, over chunk edges, long windows, constant stretches and missing samples."""

import tracemalloc

import numpy as np
import pytest

from recurra.operators import search


def _brute(x, q, kind, p=2.0):
    v = np.lib.stride_tricks.sliding_window_view(x, len(q))
    if kind == "dot":
        return v @ q
    if kind == "pnorm":
        return (np.abs(v - q) ** p).sum(1) ** (1 / p)
    z = lambda u: (u - u.mean(-1, keepdims=True)) / np.where(u.std(-1, keepdims=True) < 1e-7, 1, u.std(-1, keepdims=True))
    d = np.sqrt(((z(v) - z(q)) ** 2).sum(1))
    flat = v.std(1) < 1e-7
    return np.where(flat, 0.0 if q.std() < 1e-7 else np.sqrt(len(q)), np.sqrt(len(q)) if q.std() < 1e-7 else d)


@pytest.mark.parametrize("w", [3, 16, 200])
def test_chunks(spark, w):
    r = np.random.default_rng(w)
    x = r.normal(size=1000).cumsum() + 1e4
    x[300:600] = 7.0
    x[700 : 700 + w] = 3 * x[40 : 40 + w] - 5  # the same shape again
    bad = x.copy()
    bad[[120, 121, 800]] = np.nan, np.inf, np.nan
    rows = [(k, t, None if k == 2 and t == 800 else float(v)) for k, y in ((0, x), (2, bad), (4, x[: w - 1])) for t, v in enumerate(y)]
    sig = spark.createDataFrame(rows, "dim int, t long, v double").repartition(5)
    for place in (40, 350):
        for kind in search.KINDS:
            got = {(g.dim, g.i): g.d for g in search.profile(sig, search.query_at(sig, w, place), w, kind, 3.0, size=64).collect()}
            assert set(got) == {(k, i) for k in (0, 2) for i in range(1001 - w)}
            for k, y in ((0, x), (2, bad)):
                q = y[place : place + w]
                want = _brute(np.where(np.isfinite(y), y, 0), np.where(np.isfinite(q), q, 0), kind, 3.0)
                for i in range(1001 - w):
                    if np.isfinite(y[i : i + w]).all() and np.isfinite(q).all():
                        assert got[k, i] == pytest.approx(want[i], rel=1e-9, abs=1e-6), (kind, k, i)
                    else:
                        assert got[k, i] is None


def test_gaps_and_unknown_kinds(spark):
    sig = spark.range(50).where("id <> 30").selectExpr("0 as dim", "id as t", "double(id * id % 7) as v")
    with pytest.raises(ValueError):
        search.profile(sig, search.query_at(sig, 8, 2), 8, "cosine")
    with pytest.raises(Exception, match="one for every t"):
        search.profile(sig, search.query_at(sig, 8, 2), 8).collect()
    assert search.profile(sig, search.query_at(sig, 8, 25), 8).count() == 0


def test_memory_is_flat_in_the_window():
    x = np.random.default_rng(1).normal(size=1 << 16)
    peaks = []
    for w in (16, 4096):
        tracemalloc.start()
        search.znormed(x, x[50 : 50 + w])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]
