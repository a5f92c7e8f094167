"""Persistence on merged forests against Kruskal over all edges, with ties."""

import numpy as np
import pytest

from recurra.operators import persistence as ps


def _edges(spark, seed, n=60, m=260):
    r = np.random.default_rng(seed)
    rows = {(d, min(a, b), max(a, b)): float(x) / 8 for d in (0, 1) for a, b, x in r.integers(0, [n, n, 16], (m, 3)).tolist() if a != b}
    return spark.createDataFrame([(*k, w) for k, w in rows.items()], "dim int, u long, v long, w double"), rows


@pytest.mark.parametrize("ranges", [(4, 16), (1000,), ()])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_diagram_of_forests_is_that_of_all_edges(spark, monkeypatch, ranges, seed):
    monkeypatch.setattr(ps, "RANGES", ranges)
    df, rows = _edges(spark, seed)
    got, kept = ps.persistence(df).collect(), ps.forest(df).groupBy("dim").count().collect()
    for dim in (0, 1):
        want = ps.diagram(sorted((w, u, v) for (d, u, v), w in rows.items() if d == dim))
        assert sorted((r["birth"], r["death"], r["cluster"]) for r in got if r["dim"] == dim) == sorted(want)
    if ranges == (1000,):
        assert all(r["count"] <= 59 for r in kept)


@pytest.mark.parametrize("cut,gap", [(1.0, 0.3), (0.5, 0.125), (1.5, 2.0), (0.0, 1.0)])
def test_components_of_forests_are_those_of_all_edges(spark, monkeypatch, cut, gap):
    monkeypatch.setattr(ps, "RANGES", (8, 24))
    for seed in (4, 5):
        df, rows = _edges(spark, seed, n=90, m=130)
        got = ps.components(df, cut, gap).collect()
        for dim in (0, 1):
            want = ps.cut_components(sorted((w, u, v) for (d, u, v), w in rows.items() if d == dim), cut, gap)
            assert sorted((r["pos"], r["root"], r["birth"]) for r in got if r["dim"] == dim) == want


def test_components_of_many_random_graphs():
    """The rule of `components`, without Spark."""
    r = np.random.default_rng(9)
    for _ in range(400):
        edges = sorted({(float(w) / 4, int(min(a, b)), int(max(a, b))) for a, b, w in r.integers(0, [14, 14, 12], (r.integers(3, 40), 3)) if a != b})
        if not edges:
            continue
        cut, gap = r.integers(0, 12) / 4, r.integers(0, 8) / 4
        born = {x for w, u, v in edges if w < cut for x in (u, v)}
        left = [(w, u, v) for w, u, v in edges if w < cut or (u in born and v in born)]
        w, u, v = (np.array(c) for c in zip(*left)) if left else (np.zeros(0),) * 3
        forest = sorted(left[k] for k in ps.spanning(u, v, w))
        assert ps.cut_components(forest, cut, gap) == ps.cut_components(edges, cut, gap)
