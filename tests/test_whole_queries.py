"""Queries over all rows, where SQL takes a part of them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.plans.queries import QUERIES
from recurra.sources import signals as sg

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_linkage_rates_of_all_vectors_and_elements(spark):
    x = {r["vec_id"]: np.floor(np.array(r["embedding"], float) * 10) for r in sg.table(spark, SF, "embeddings").collect()}
    got = {r["k"]: r for r in QUERIES["linkage_rates"](spark, SF).collect()}
    assert set(got) == {m // 2 for m in x if m % 2 == 0 and m + 1 in x} and len(got) > 100
    for k in list(got)[::37]:
        a, b = x[2 * k][:, None], x[2 * k + 1]
        low, high = np.minimum(a, b), np.maximum(a, b)
        rate = np.maximum(0, low + 20 - high) / (high + 20 - low)
        assert got[k]["average"] == pytest.approx(rate.mean(), abs=2e-6) and got[k]["complete"] == pytest.approx(rate.min(), abs=2e-6)


def test_every_pair_of_windows(spark):
    s = sg.ord_week(spark, SF).collect()
    n, dims = max(r["t"] for r in s) + 1, 1 + max(r["dim"] for r in s)
    m = n - 7
    x = np.zeros((dims, n))
    for r in s:
        x[r["dim"], r["t"]] = r["v"]
    whole = QUERIES["distance_matrix_whole"](spark, SF)
    assert whole.count() == dims * dims * m * m
    for r in whole.where("(dim_i * 7 + dim_j * 5 + i * 31 + j) % 9973 = 0").collect():
        assert r["d"] == pytest.approx(np.linalg.norm(x[r["dim_i"], r["i"] : r["i"] + 8] - x[r["dim_j"], r["j"] : r["j"] + 8]), abs=2e-6)
    part = {tuple(r) for r in QUERIES["distance_matrix"](spark, SF).collect()}
    assert part == {tuple(r) for r in whole.where("dim_i = 0 and dim_j = 4 and j % 10 = 0").select("i", "j", "d").collect()}
    pairs = QUERIES["subspace_of_pair_whole"](spark, SF).agg(F.countDistinct("i", "j")).first()[0]
    assert pairs > 0.9 * m * (m - 1)


def test_all_hours_and_dims_are_read(spark, monkeypatch):
    s = sg.ev_signal(spark, SF).collect()
    real, pred = {}, {}
    for r in s:
        if r["v"] > 0 and r["t"] < 400:
            real.setdefault(r["t"] % 50, set()).add(r["dim"])
        if r["v"] > 50 and r["t"] >= 400:
            pred.setdefault(r["t"] % 50, set()).add(r["dim"])
    got = {r["motif"]: r["jaccard"] for r in QUERIES["dim_prf"](spark, SF).collect()}
    for k in set(real) & set(pred):
        assert got[k] == pytest.approx(len(real[k] & pred[k]) / len(real[k] | pred[k]), abs=2e-6)
    assert QUERIES["subspace_merge"](spark, SF).agg(F.max("dim")).first()[0] >= 3
    seen = []
    weeks = sg.ord_week
    monkeypatch.setattr(sg, "ord_week", lambda *a: seen.append(a) or weeks(*a))
    assert QUERIES["coordinated_motifs"](spark, SF).columns and seen
