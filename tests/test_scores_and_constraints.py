"""Scores, constraints and whole methods against brute force over small inputs."""

import itertools

import numpy as np
import pytest

from recurra.functions import kernels
from recurra.operators import metrics, neighbours, subspace
from recurra.plans import methods


def long_form(spark, x):
    return spark.createDataFrame([(d, t, float(v)) for d, row in enumerate(x) for t, v in enumerate(row)], "dim int, t long, v double")


def random_motifs(r, n):
    out = []
    for _ in range(n):
        starts = np.sort(r.choice(20, r.integers(1, 5), replace=False)) * 15
        out.append(([(int(s), int(s + r.integers(2, 14))) for s in starts], set(r.choice(4, r.integers(1, 4), replace=False).tolist())))
    return out


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("dims", [False, True])
def test_event_scores_by_enumeration(weighted, dims):
    """Every pairing tried; precision, recall and F1 of a pair by counting; weights of the real motifs alone."""
    r = np.random.default_rng(3)
    for _ in range(25):
        real, pred = random_motifs(r, r.integers(1, 4)), random_motifs(r, r.integers(1, 5))
        cover = lambda ev: {t for a, z in ev for t in range(a, z + 1)}
        jac = lambda a, b: len(a & b) / len(a | b) if dims else 1
        w = np.array([[len(cover(x) & cover(y)) * jac(c, d) for y, d in pred] for x, c in real])
        small = min(w.shape)
        total = lambda pairs: sum(w[i, j] for i, j in pairs)
        options = [list(zip(i, j)) for i in itertools.combinations(range(len(real)), small) for j in itertools.permutations(range(len(pred)), small)]
        top = max(map(total, options))
        best = [p for p in options if total(p) >= top - 1e-12]
        sizes = [len(ev) for ev, _ in real]
        weight = [x / sum(sizes) if weighted else 1 / len(real) for x in sizes]
        want = []
        for pairs in best:
            out = np.zeros(6)
            for i, j in pairs:
                p, q, _ = metrics.event_prf(real[i][0], pred[j][0], 0.4)
                a, b = real[i][1], pred[j][1]
                dp, dr = len(a & b) / len(b), len(a & b) / len(a)
                out += weight[i] * np.array([p, q, 2 * p * q / (p + q) if p + q else 0, dp, dr, 2 * dp * dr / (dp + dr) if dp + dr else 0])
            want.append(out[: 6 if dims else 3])
        got = metrics.event_score(real, pred, 0.4, weighted, dims)
        assert any(np.allclose(got, x) for x in want)
        assert metrics.event_score(real, pred, [0.2, 0.4], weighted, dims)[1] == got


def test_a_spurious_motif_costs_no_event_score():
    one = [([(1, 10), (21, 30)], {0})]
    assert metrics.event_score(one, [*one, ([(50, 60)], {1})], 0.5) == (1, 1, 1)
    assert metrics.event_score([*one, ([(50, 60)], {1})], one, 0.5) == (0.5, 0.5, 0.5)
    assert metrics.event_score(one, [], 0.5, dims=True) == (0,) * 6 and metrics.event_score([], one, 0.5) == (0,) * 3


def test_sample_score_means():
    overlap = np.array([[8, 0], [1, 3], [0, 0]])
    p, r, f = metrics.sample_score(overlap, [10, 5, 5], [9, 4])
    assert (p, r) == pytest.approx(((8 / 9 + 3 / 4) / 3, (8 / 10 + 3 / 5) / 3))
    assert metrics.sample_score(overlap, [10, 5, 5], [9, 4], True)[1] == pytest.approx(0.5 * 0.8 + 0.25 * 0.6)


def test_set_score_means_with_more_or_fewer_sets():
    wide, none = np.array([[3, 1, 0]]), np.array([1])
    s = metrics.set_scores(wide, none, np.array([0, 0, 4]))
    t = metrics.set_scores(wide, none, np.array([0, 0, 4]), off_target=True)
    assert (s["macro_precision"], t["macro_precision"], s["micro_precision"], t["micro_precision"]) == pytest.approx((1, 1 / 3, 1, 3 / 8))
    assert s["macro_recall"] == t["macro_recall"] == pytest.approx(3 / 5) and (s["macro_f1"], t["macro_f1"]) == pytest.approx((0.75, 0.25))
    tall = metrics.set_scores(wide.T, np.zeros(3), np.array([0]))
    assert tall["macro_recall"] == pytest.approx(1 / 3) and tall["macro_f1"] == pytest.approx(2 * 0.75 / 1.75 / 3)


def test_overlaps_of_occurrences():
    a = {0: (0, 10), 1: (5, 15)}
    assert metrics.multivariate_overlap(a, {0: (0, 10), 1: (10, 20)}) == pytest.approx(1 / 3)
    assert metrics.multivariate_overlap(a, {0: (0, 10)}) == 0 and metrics.multivariate_overlap({}, {}) == 0
    assert metrics.subspaces_overlap({1, 2}, {2}, 0.5) and not metrics.subspaces_overlap({1, 2}, {2}, 0.6)


def at(d, *starts):
    return subspace.MotifSet([{d: (s, s + 10)} for s in starts])


def test_sets_of_one_occurrence_stay_unless_a_join_left_them():
    out = subspace.merge([at(0, 5), at(1, 0, 50, 100)], [at(2, 0, 50), at(3, 300)], 0.5)
    assert [(s.dims, len(s.occurrences)) for s in out] == [((1, 2), 2), ((0,), 1), ((3,), 1)]


def test_one_included_dim_is_searched_first_and_joined():
    sets = {2: [at(2, 0, 50, 100)], 3: [at(3, 1, 51, 101)], 0: [at(0, 200, 240)], 1: []}
    groups = subspace.plan(4, include=[2])
    assert groups == [[2], [0], [1], [2], [3]]
    out = subspace.apply(groups, lambda g: list(sets[g[0]]), 0.5, included=True)
    assert [s.dims for s in out] == [(2, 3)] and len(out[0].occurrences) == 3
    assert subspace.apply(groups, lambda g: list(sets[g[0]]), 0.5, included=True, least_dims=3) == []


def test_constraints_are_checked_and_take_names():
    names = ["a", "b", "c"]
    assert subspace.plan(3, include=["c"], exclude=["a"], together=[["b", "c"]], names=names) == [[2], [1, 2]]
    for bad in ({"include": [3]}, {"exclude": ["z"]}, {"together": [[0, "a"]]}, {"include": ["a"]}):
        with pytest.raises(ValueError):
            subspace.plan(3, **bad, names=None if bad == {"include": ["a"]} else names)


def test_masks_hold_back_starts_and_ends(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1, 120))
    for s in (10, 50, 90):
        x[0, s : s + 12] = np.sin(np.arange(12)) * 3 + r.normal(size=12) * 0.01
    sig = long_form(spark, x)
    found = lambda **k: {o[0] for s in methods.univariate_sets(sig, 12, 3.0, 1, **k)[0] for o in s.occurrences}
    assert {a for a, _ in found()} == {10, 50, 90}
    start = spark.createDataFrame([(t, not 40 < t < 60) for t in range(120)], "t long, on boolean")
    assert all(not 40 < a < 60 for a, _ in found(start_mask=start))
    assert all(not 40 < z - 1 < 70 for _, z in found(end_mask=spark.createDataFrame([(t, not 40 < t < 70) for t in range(120)], "t long, on boolean")))


def test_leitmotif_of_least_extent_by_enumeration(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(3, 90))
    for s in (4, 30, 61):
        x[:2, s : s + 8] = np.cos(np.arange(8)) * 4 + r.normal(size=(2, 8)) * 0.02
    got = methods.leitmotifs(long_form(spark, x), [8], 2, 5).motifs[0]
    assert got.dims == [0, 1] and [a for a, _ in got.spans] == [4, 30, 61]
    parts = [kernels.Series(v, 8) for v in x]
    d = np.stack([np.sqrt(kernels.squared(s, 0, 83, "znorm")) for s in parts])
    pairs = list(itertools.combinations([4, 30, 61], 2))
    extent = max(d[:2, p, q].mean() for p, q in pairs)
    assert all(methods._pair(parts[k], p, q) == pytest.approx(d[k, p, q], abs=1e-6) for k in (0, 1) for p, q in pairs)
    for i in range(83):  # no window with its two nearest has a smaller extent
        mean = np.sort(d[:, i], 0)[:2].mean(0)
        near = kernels.nearest(mean[None].copy(), i, 8, 2)[2]
        for dims in itertools.combinations(range(3), 2):
            assert max(d[np.ix_(dims, [p], [q])].mean() for p, q in itertools.combinations([i, *near], 2)) >= extent - 1e-9


def test_blocks_of_any_size_give_the_same_neighbours(spark, monkeypatch):
    sig = long_form(spark, np.random.default_rng(7).normal(size=(2, 300)))
    want = sorted(map(tuple, neighbours.knn(sig, 9, 3).collect()))
    top = list(map(tuple, neighbours.closest_pairs(sig, 9, "unit", 20).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(kernels, "CELLS", 300 * 7)
    monkeypatch.setattr(kernels, "TILE", 9 * 50)
    assert sorted(map(tuple, neighbours.knn(sig, 9, 3).collect())) == want
    assert list(map(tuple, neighbours.closest_pairs(sig, 9, "unit", 20).collect())) == top


def test_a_long_series_needs_little_memory():
    """A million samples, windows of 100: the statistics and one block, not windows times their width."""
    import tracemalloc

    x = np.random.default_rng(8).normal(size=1_000_000)
    tracemalloc.start()
    s = kernels.Series(x, 100)
    d = kernels.squared(s, 500_000, 500_002, "detrended")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert d.shape == (2, 999_901) and peak < 200e6
    u, v = (w - np.polyval(np.polyfit(np.arange(100), w, 1), np.arange(100)) for w in (x[500_000:500_100], x[7:107]))
    assert d[0, 7] == pytest.approx(2 * (1 - u @ v / np.linalg.norm(u) / np.linalg.norm(v)))


def test_unknown_metrics_and_windows_are_refused():
    with pytest.raises(ValueError):
        kernels.squared(kernels.Series(np.arange(9.0), 3), 0, 1, "nosuch")
    for w in (2, 10):
        with pytest.raises(ValueError):
            kernels.Series(np.arange(9.0), w)


def test_the_tail_runs_again_without_a_search(spark, monkeypatch):
    from recurra.plans import synthetic

    sig = synthetic.signals(spark, 1, seed=7).drop("series_id")
    method = methods.LinkedMotifs(40, 60)
    with method.prepared(sig) as tail:
        monkeypatch.setattr(neighbours, "knn", lambda *a, **k: pytest.fail("searched anew"))
        whole, two = tail.found(), tail.found(n_patterns=2)
        assert tail.persistence().where("death > birth").count() > 0 and len(tail.cuts()) == 2
        with pytest.raises(ValueError):
            tail.found(wlen=10)
    monkeypatch.undo()
    assert whole == method.fit(sig) and len(two.motifs) <= 2 <= len(whole.motifs) + 1
    assert two == methods.LinkedMotifs(40, 60, n_patterns=2).fit(sig)
