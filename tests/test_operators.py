"""Kernels and operators against written values, brute force and invariants."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from recurra.functions import kernels
from recurra.operators import extract, graph, mdl, metrics, neighbours, subspace
from recurra.operators import persistence as ps
from recurra.plans import methods, synthetic
from recurra.streaming.profile import incremental_profile

#: Two short series with the distances and description lengths published for them.
T = [[584, -11, 23, 79, 1001, 0, -19], [1, 2, 4, 8, 16, 0, 32]]


def long_form(spark, x):
    return spark.createDataFrame([(d, t, float(v)) for d, row in enumerate(x) for t, v in enumerate(row)], "dim int, t long, v double")


def naive(x, w, metric):
    n = len(x) - w + 1
    out = np.full((n, n), np.nan)
    for i, j in itertools.product(range(n), repeat=2):
        a, b = x[i : i + w].astype(float), x[j : j + w].astype(float)
        if metric == "raw":
            out[i, j] = np.sum((a - b) ** 2)
            continue
        t = np.arange(w)
        fit = (lambda v: v - np.polyval(np.polyfit(t, v, 1), t)) if metric == "detrended" else (lambda v: v - v.mean())
        a, b = fit(a), fit(b)
        if min(np.linalg.norm(a), np.linalg.norm(b)) > 1e-9:
            out[i, j] = (2 * w if metric == "znorm" else 2) * (1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    return np.maximum(out, 0)


@pytest.mark.parametrize("metric", ["znorm", "unit", "detrended", "raw"])
def test_kernel_equals_definition(metric):
    x = np.random.default_rng(1).normal(size=40).cumsum()
    x[20:26] = 3.0
    s = kernels.Series(x, 6)
    got = kernels.squared(s, 5, 30, metric)
    assert np.allclose(got, naive(x, 6, metric)[5:30], atol=1e-7, equal_nan=True)


def test_distances_ignore_affine_changes_and_trends():
    x = np.random.default_rng(2).normal(size=60)
    for metric, y in (("znorm", 3 * x + 7), ("unit", 0.5 * x - 1), ("detrended", 2 * x + 0.7 * np.arange(60))):
        a, b = (kernels.squared(kernels.Series(v, 9), 0, 20, metric) for v in (x, y))
        assert np.allclose(a, b, atol=1e-7)


def test_published_values():
    q, t = np.array([-11.1, 23.4, 79.5, 1001.0]), np.array(T[0], float)
    d = np.sqrt(kernels.squared(kernels.Series(q, 4), 0, 1, "znorm", kernels.Series(t, 4)))[0]
    assert d == pytest.approx([3.18792463, 0.00111297393, 3.23874018, 3.34470195], rel=1e-6)
    each = np.stack([np.sqrt(naive(np.array(r), 3, "znorm")) for r in T])
    order = np.argsort(each, 0, kind="stable")
    mean = np.cumsum(np.sort(each, 0), 0) / np.arange(1, 3)[:, None, None]
    mean[:, np.abs(np.subtract.outer(np.arange(5), np.arange(5))) <= 1] = np.inf
    bits = []
    for k in range(2):
        i, j = np.unravel_index(mean[k].argmin(), mean[k].shape)
        a, b = (methods._z(np.array([r[p : p + 3] for r in T], float)) for p in (i, j))
        bits.append(mdl.window_bits(a, b, order[: k + 1, i, j].tolist()))
    assert bits == pytest.approx([80.0, 111.509775])


def test_published_motif(spark):
    found = methods.multidim_motifs(long_form(spark, T), 3, 1)
    assert found.motifs[0].dims == [1] and [a for a, _ in found.motifs[0].spans][:2] == [0, 2]


def test_knn_is_greedy_with_exclusion(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=90)
    x[60:72] = x[10:22]
    got = neighbours.knn(long_form(spark, [x]), 8, 3, "unit").collect()
    d = np.round(np.sqrt(naive(x, 8, "unit")), 6)
    for i in range(83):
        taken = []
        for v, j in sorted((v, j) for j, v in enumerate(d[i]) if abs(i - j) >= 8):
            if len(taken) < 3 and all(abs(j - k) >= 8 for _, k in taken):
                taken.append((v, j))
        mine = sorted((g["rank"], g["d"], g["j"]) for g in got if g["i"] == i)
        assert [(j) for _, _, j in mine] == [j for _, j in taken]


def test_blocks_don_t_change_neighbours(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(2, 100))
    whole = sorted(map(tuple, neighbours.knn(long_form(spark, x), 8, 2).collect()))
    assert whole and len({r[:3] for r in whole}) == len(whole)
    parts = [kernels.Series(v, 8) for v in x]
    for dim, s in enumerate(parts):
        for a in range(0, 93, 31):
            d = np.round(np.sqrt(kernels.squared(s, a, min(a + 31, 93), "detrended")), 6)
            rows = kernels.nearest(d, a, 8, 2)
            assert {(dim, int(i), int(r), int(j)) for i, r, j, _ in zip(*rows)} <= {r[:4] for r in whole}


def prim(edges):
    """Weight of a minimum spanning forest."""
    nodes, total = {n for _, u, v in edges for n in (u, v)}, 0.0
    while nodes:
        tree = {nodes.pop()}
        while True:
            out = [(w, u, v) for w, u, v in edges if (u in tree) != (v in tree)]
            if not out:
                break
            w, u, v = min(out)
            total += w
            tree |= {u, v}
            nodes -= tree
    return total


def test_persistence_is_a_spanning_forest():
    r = random.Random(5)
    edges = sorted((round(r.random(), 3), *r.sample(range(25), 2)) for _ in range(40))
    got = ps.diagram(edges)
    nodes = {n for _, u, v in edges for n in (u, v)}
    alive = [g for g in got if g[1] == float("inf")]
    assert len(got) == len(nodes)
    assert sum(d for _, d, _ in got if d != float("inf")) == pytest.approx(prim(edges))
    assert all(b <= d for b, d, _ in got) and len(alive) >= 1
    births = {n: min(w for w, u, v in edges if n in (u, v)) for n in nodes}
    assert {x: b for x, _, b in ps.cut_components(edges, 2.0, 0.0)} == births
    assert len({root for _, root, _ in ps.cut_components(edges, 2.0, 2.0)}) == len(alive)


def test_cuts(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(1, 0.1, 200), r.normal(3, 0.1, 100)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    cut = ps.otsu_cut(df, "v").first()[0]
    count, edge = np.histogram(x, 1024)
    best, p, s = (-1, None), 0.0, 0.0
    for c, e in zip(count[:-1], edge[:-1]):
        p, s = p + c / len(x), s + c / len(x) * e
        if 0 < p < 1 and round(p * (1 - p) * (s / p - (x.mean() - s) / (1 - p)) ** 2, 9) > best[0]:
            best = round(p * (1 - p) * (s / p - (x.mean() - s) / (1 - p)) ** 2, 9), e
    assert cut == pytest.approx(best[1])
    gaps = [9.0, 8.5, 5.0, 4.8, 2.0, 1.9]
    g = spark.createDataFrame([(v,) for v in gaps], "g double")
    assert ps.gap_cut(g, "g", 1).first()[0] == pytest.approx(6.75) and ps.gap_cut(g, "g", 2).first()[0] == pytest.approx(3.4)
    assert ps.gap_cut(g.limit(1), "g", 2).first()[0] is None


def candidate(name, dims, positions):
    return graph.Candidate(name, frozenset(dims), frozenset(positions))


def test_merge_and_split():
    same = [candidate("a", [0], range(10)), candidate("b", [1], range(10))]
    out = graph.resolve(same)
    assert len(out) == 1 and out[0].dims == {0, 1} and out[0].positions == set(range(10))
    fused = [candidate("big", [0], range(40)), candidate("x", [1, 2, 3], range(12)), candidate("y", [4], range(20, 34))]
    out = graph.resolve(fused, n=1)
    assert graph.merged(fused, 0.8)[0].coverage == 40
    assert out[0].dims == {0, 1, 2, 3} and out[0].positions == set(range(12))
    apart = [candidate("p", [0], range(5)), candidate("q", [1], range(10, 15))]
    assert {c.name for c in graph.resolve(apart, n=2)} == {"p", "q"}


def test_placement_never_overlaps():
    r = random.Random(7)
    cands = [(str(k), frozenset(r.sample(range(4), 2)), frozenset(r.sample(range(300), 120))) for k in range(5)]
    got = extract.place(cands, {}, 320, 6, 10, 0.2)
    dims = {c[0]: c[1] for c in cands}
    assert got and all(6 <= z - a <= 10 for _, a, z in got)
    for (m, a, z), (n, b, y) in itertools.combinations(got, 2):
        assert not (dims[m] & dims[n]) or z <= b or y <= a


def test_assignment_is_optimal():
    r = np.random.default_rng(8)
    for _ in range(60):
        w = r.integers(0, 9, (r.integers(1, 5), r.integers(1, 6)))
        small, large = sorted(w.shape)
        m = w if w.shape[0] == small else w.T
        best = max(sum(m[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        got = metrics.assignment(w)
        assert len(got) == small and sum(w[i, j] for i, j in got) == best


def test_scores_of_a_perfect_and_a_half_match():
    events = [([(1, 10), (21, 30)], {0, 1}), ([(41, 50)], {2})]
    assert metrics.event_score(events, events, 0.9, dims=True) == (1, 1, 1, 1, 1, 1)
    p, r, f = metrics.event_score(events, [([(1, 10)], {0, 1})], 0.5)
    assert (p, r) == (0.5, 0.25) and 0 < f < 1
    assert metrics.event_prf([(1, 10)], [(5, 14)], 0.9) == (0, 0, 0) and metrics.event_prf([], [], 0.5) == (0, 0, 0)
    assert metrics.adjusted_mutual_information(np.diag([5, 7, 9])) == pytest.approx(1)
    s = metrics.set_scores(np.array([[3, 0], [0, 2]]), np.array([0, 1]), np.array([0, 2]))
    assert s["micro_recall"] == pytest.approx(5 / 6) and s["micro_precision"] == pytest.approx(5 / 7)


def test_interval_overlaps_equal_all_pairs(spark):
    r = random.Random(9)
    a, b = ([(k, s, s + r.randrange(1, 200)) for k, s in enumerate(r.sample(range(2000), 60))] for _ in range(2))
    frames = [spark.createDataFrame(x, "id long, start long, end long") for x in (a, b)]
    got = {(x["a"], x["b"]): x["rate"] for x in metrics.interval_overlaps(*frames).collect()}
    want = {(i, j): subspace.rate((s, e), (t, f)) for i, s, e in a for j, t, f in b if min(e, f) > max(s, t)}
    assert got == pytest.approx(want)


def test_subspace_merge():
    at = lambda d, *starts: subspace.MotifSet([{d: (s, s + 10)} for s in starts])
    out = subspace.merge([at(0, 0, 50, 100)], [at(1, 2, 51, 200, 300)], 0.5)
    assert [s.dims for s in out] == [(0, 1), (1,)] and len(out[0].occurrences) == 2
    assert subspace.plan(5, include=[1, 2], exclude=[4], together=[[0, 3]]) == [[1, 2], [0, 3], [1], [2]]
    assert subspace.linkage({0: (0, 10)}, {1: (0, 10), 2: (5, 15)}, complete=True) == pytest.approx(1 / 3)


def test_coordinated_motifs_find_what_was_planted(spark):
    x, truth = synthetic.make(7)
    sig = synthetic.signals(spark, 1, seed=7).drop("series_id")
    found = methods.LinkedMotifs(40, 60).fit(sig)
    planted = [s for _, _, spans in truth for s in spans]
    mine = [s for m in found.motifs for s in m.spans]
    assert sum(any(min(z, y) - max(a, b) >= 30 for b, y in mine) for a, z in planted) >= 0.9 * len(planted)
    dims = {d for m in found.motifs for d in m.dims}
    assert dims <= {d for _, ds, _ in truth for d in ds}
    occ = found.occurrences(spark).join(found.dimensions(spark), "motif").collect()
    for p, q in itertools.combinations(occ, 2):
        assert p["dim"] != q["dim"] or p["end"] <= q["start"] or q["end"] <= p["start"]


def test_signals_and_truth_agree(spark):
    assert synthetic.signals(spark, 2, seed=3).groupBy("series_id", "dim").count().count() == 12
    t = synthetic.truth(spark, 2, seed=3)
    assert t.where("end <= start").count() == 0 and t.select("series_id", "motif").distinct().count() == 6


def test_stream_gives_the_earlier_neighbours(spark, tmp_path):
    x = np.random.default_rng(10).normal(size=60)
    for k in range(3):
        part = pd.DataFrame({"series": "s", "dim": 0, "t": np.arange(20 * k, 20 * k + 20), "v": x[20 * k : 20 * k + 20]})
        spark.createDataFrame(part, "series string, dim int, t long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema("series string, dim int, t long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    q = incremental_profile(stream, 6).writeStream.format("memory").queryName("profile").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    d = np.round(np.sqrt(kernels.squared(kernels.Series(x, 6), 0, 55, "detrended")), 6)
    got = {r["i"]: (r["j"], r["d"]) for r in spark.table("profile").collect()}
    assert set(got) == set(range(6, 55))
    for i, (j, v) in got.items():
        assert v == pytest.approx(d[i, : i - 5].min()) and d[i, j] == pytest.approx(v)


def test_chunks_don_t_change_windows(spark, monkeypatch):
    from recurra.functions import windows
    from recurra.sources import signals as sg

    sig = long_form(spark, np.random.default_rng(11).normal(size=(2, 90)))
    idle = sorted(map(tuple, sg.idle_mask(sig, 2, 0.6).collect()))
    whole = sorted(map(tuple, windows.windows(sig, 7, "mean", "low", "x").collect()))
    assert len(whole) == 2 * 84 and len(idle) == 90
    monkeypatch.setattr(windows, "CHUNK", 20)
    assert sorted(map(tuple, windows.windows(sig, 7, "mean", "low", "x").collect())) == whole
    assert sorted(map(tuple, sg.idle_mask(sig, 2, 0.6).collect())) == idle


def test_falling_over_parts(spark):
    x = [float(v) for v in np.random.default_rng(12).integers(0, 60, 200)]
    got = sorted(map(tuple, ps.falling(spark.createDataFrame([(v,) for v in x], "v double"), "v").collect()))
    x.sort(reverse=True)
    assert got == sorted(zip(x, x[1:]))
