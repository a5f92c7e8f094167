"""Pan profile against whole matrices of distances, over tile edges and for dims shorter than a length."""

import numpy as np
import pytest

from recurra.operators import pan

LENGTHS = [5, 9, 40, 100]


def _signal():
    r = np.random.default_rng(4)
    long = np.round(r.normal(size=2300).cumsum(), 3)
    long[700:760] = 1.0  # constant windows
    long[1500:1640] = long[100:240]  # a repeat over an edge of blocks
    return {0: long, 3: np.round(r.normal(size=60), 3), 5: np.zeros(3)}


def _brute(x, w):
    v = np.lib.stride_tricks.sliding_window_view(x, w)
    sd = v.std(1)
    ok = sd > 1e-9
    z = np.where(ok[:, None], v - v.mean(1, keepdims=True), 0) / np.where(ok, sd, 1)[:, None]
    d = np.round(np.sqrt(np.maximum(0, 2 * w - 2 * z @ z.T)), 6)
    place = np.arange(len(d))
    d[(np.abs(place[:, None] - place) < w) | ~ok[:, None] | ~ok] = np.inf
    return d


@pytest.fixture(scope="module")
def sig(spark):
    return spark.createDataFrame([(k, t, float(v)) for k, x in _signal().items() for t, v in enumerate(x)], "dim int, t long, v double").cache()


def test_order():
    assert pan.level_order(10) == [5, 2, 8, 1, 4, 7, 9, 0, 3, 6]
    assert pan.level_order(1) == [0] and pan.level_order(0) == []
    assert pan.taken([24, 8, 16, 8], 2) == [16, 8]
    with pytest.raises(ValueError):
        pan.taken([2, 8])


def test_whole_and_partial(spark, sig):
    rows = pan.pan_profile(sig, LENGTHS).collect()
    assert len(rows) == len({(r.dim, r.w, r.i) for r in rows})
    for dim, x in _signal().items():
        for w in LENGTHS:
            got = {r.i: (r.j, r.d) for r in rows if (r.dim, r.w) == (dim, w)}
            d = _brute(x, w) if len(x) >= w else np.zeros((0, 0))
            assert set(got) == set(np.flatnonzero(np.isfinite(d).any(1)).tolist())
            for i, (j, v) in got.items():
                assert v == pytest.approx(d[i].min(), abs=2e-5) and d[i, j] == pytest.approx(v, abs=2e-5) and abs(i - j) >= w
    part = {tuple(r) for r in pan.pan_profile(sig, LENGTHS, 2).collect()}
    done = set(pan.taken(LENGTHS, 2))
    assert part == {tuple(r) for r in rows if r.w in done}


def test_contrast_and_spread(spark):
    p = spark.createDataFrame([(0, 9, 0, 5, 0.6), (0, 9, 1, 5, 3.0), (0, 16, 0, 9, 99.0), (0, 16, 1, 9, 3.0), (1, 9, 0, 3, 0.0)], "dim int, w int, i long, j long, d double")
    got = {(r.dim, r.w, r.i): (r.level, r.contrast, r.on) for r in pan.contrast(p).collect()}
    sigmoid = lambda r: round(1 / (1 + np.exp(-10 * (r - 0.2))), 6)
    assert got == {(0, 9, 0): (0.1, sigmoid(0), True), (0, 9, 1): (0.5, sigmoid(2 / 3), False), (0, 16, 0): (1.0, sigmoid(1), False), (0, 16, 1): (0.375, sigmoid(1 / 3), False), (1, 9, 0): (0.0, sigmoid(0), True)}
    out = {(r.w, r.own, r.i, r.d) for r in pan.spread(p.where("dim = 0 and w = 16"), [9, 16, 25], 1).collect()}
    assert out == {(9, False, 0, 99.0), (9, False, 1, 3.0), (16, True, 0, 99.0), (16, True, 1, 3.0), (25, False, 0, 99.0), (25, False, 1, 3.0)}


def test_nothing_to_search(spark, sig):
    assert pan.pan_profile(sig.where("dim = 5"), LENGTHS).count() == 0
    assert pan.contrast(pan.pan_profile(sig.limit(0), LENGTHS)).count() == 0
