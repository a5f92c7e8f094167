"""Warped motifs, checks, generators and ties."""

import itertools

import numpy as np
import pytest

from recurra.operators import checks, metrics, warped
from recurra.plans import synthetic


def test_warped_motifs_find_a_stretched_pattern():
    r = np.random.default_rng(1)
    t = np.linspace(0, 1, 30)
    p = np.sin(6 * np.pi * t) * (1 + 2 * t)
    x = r.normal(0, 0.05, 160)
    for a, n in ((10, 30), (70, 36), (120, 27)):
        x[a : a + n] += np.interp(np.linspace(0, 1, n), t, p)
    sets = warped.motif_sets(x, 20, 36, 0.7, 1)
    assert len(sets) == 1 and len(sets[0]) >= 2
    for a, z in sets[0]:
        assert any(min(z, b + n) - max(a, b) >= 8 for b, n in ((10, 30), (70, 36), (120, 27)))
    for (a, z), (b, y) in itertools.combinations(sets[0], 2):
        assert z <= b or y <= a
    assert warped.motif_sets(np.zeros(30), 5, 9) is not None and 0 <= warped.similarity_quantile(x, 0.9) <= 1


def test_ties_prefer_fewer_foreign_matches():
    m = np.array([[2, 2, 0], [0, 1, 3]])
    assert metrics.tied(m) and metrics.break_ties(m) == [(0, 0), (1, 2)]
    assert not metrics.tied(np.array([[2, 1, 0], [0, 1, 3]]))


def test_subspace_generator_plants_shifted_copies():
    x, truth = synthetic.make_subspace(4, noise=0.0)
    for occ in truth:
        assert len(occ) == 4
        for d, (a, z) in occ[0].items():
            for o in occ[1:]:
                b, y = o[d]
                assert np.allclose(x[a:z, d], x[b:y, d]) and z - a == y - b
        assert len({tuple(o[d][0] - min(a for a, _ in o.values()) for d in sorted(o)) for o in occ}) == 1


def test_benchmark_of_instances():
    inst = [(k, np.full((n, 2), ord(k), float)) for k, n in (("a", 5), ("a", 9), ("b", 7), ("b", 6), ("c", 4))]
    x, truth = synthetic.from_instances(inst, 0, 2, 2, length=8)
    assert x.shape == (8 * len(truth), 2) and len({k for k, *_ in truth}) == 2
    assert all((x[a:z] == ord(k)).all() for k, a, z in truth)
    assert all(p[0] != q[0] for p, q in zip(truth, truth[1:])) or len(truth) < 4


def test_checks(spark):
    sig = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, float("nan")), (0, 4, float("inf")), (1, 0, 2.0)], "dim int, t long, v double")
    got = {r["dim"]: r for r in checks.signal_checks(sig).collect()}
    assert (got[0]["n"], got[0]["n_missing"], got[0]["n_infinite"], got[0]["dense"]) == (4, 2, 1, False) and got[1]["dense"]
    flags = spark.createDataFrame([(t, t in (1, 2, 5)) for t in range(7)], "t long, on boolean")
    assert sorted(map(tuple, checks.islands(flags).collect())) == [(1, 3), (5, 6)]
    assert checks.signal_checks(sig.limit(0)).count() == 0


def test_constant_windows_may_be_told(spark):
    from recurra.functions import windows

    rows = [(0, t, 1.0 if t < 6 else float(t), told) for t, told in enumerate([None, False, None, None, None, True, None, True, None, None])]
    rows[9] = (0, 9, float("nan"), None)
    sig = spark.createDataFrame(rows, "dim int, t long, v double, told boolean")
    got = {r["i"]: r["constant"] for r in windows.windows(sig, 3, "constant", override="told").collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False}
    assert not windows.windows(sig, 3, "constant").where("i = 5").first()["constant"]


def test_self_joins_are_told_from_joins_of_two(spark):
    a = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan"))], "t long, v double")
    b = a.where("t < 2")
    assert checks.without_trivial(a, a, True) and not checks.equal_series(a, b).first()[0] and checks.equal_series(a.limit(0), b.limit(0)).first()[0]
    with pytest.warns(UserWarning, match="self-join"):
        assert not checks.without_trivial(a, a, False)
    with pytest.warns(UserWarning, match="differ"):
        assert not checks.without_trivial(a, b, True)


def test_collections_and_found_motifs_go_through_files(spark, tmp_path):
    from recurra.plans import methods
    from recurra.sources import signals

    sig = spark.createDataFrame([("a", 0, t, float(t)) for t in range(4)], "series_id string, dim int, t long, v double")
    loc = spark.createDataFrame([("a", 0, 0, 0, 1, 3)], "series_id string, set_id int, occ_id int, dim int, start long, end long")
    for x, name in ((sig, "signal"), (loc, "motif_loc")):
        x.write.parquet(f"{tmp_path}/test/{name}")
        x.unionByName(x.selectExpr("'b' AS series_id", *x.columns[1:])).write.parquet(f"{tmp_path}/two/{name}")
    one, truth = signals.single(spark, f"{tmp_path}/test")
    assert one.columns == ["dim", "t", "v"] and one.count() == 4 and truth.first()["end"] == 3
    assert signals.collection(spark, str(tmp_path), "two")[0].count() == 8
    with pytest.raises(ValueError, match="more than one"):
        signals.single(spark, f"{tmp_path}/two")
    found = methods.Found([methods.Motif([0, 2], [(1, 5), (9, 13)]), methods.Motif([1], [(3, 7)])])
    found.write(spark, f"{tmp_path}/found")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/found/occurrences").collect())) == [(0, 1, 5), (0, 9, 13), (1, 3, 7)]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/found/dimensions").collect())) == [(0, 0), (0, 2), (1, 1)]


def test_what_never_dies_saturates(spark):
    from recurra.plans import methods

    edges = spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 3, 1.5), (1, 4, 5, 0.25)], "dim int, u long, v long, w double")
    tail = methods.Tail(methods.LinkedMotifs(4), edges, 9)
    assert sorted(r["death"] for r in tail.persistence(dim=0).collect())[-1] == float("inf")
    assert sorted(r["death"] for r in tail.persistence(infinite=False).collect())[-2:] == [2.0, 2.0] and tail.persistence(dim=1).count() == 2


def test_discords_come_farthest_first(spark):
    pair = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0), (3, 3.0)], "dim int, d double")
    assert [r["dim"] for r in checks.include_order(pair, [2], discords=True).orderBy("k").collect()] == [2, 1, 3, 0]
    assert [r["dim"] for r in checks.include_order(pair, [2]).orderBy("k").collect()] == [2, 0, 1, 3]
