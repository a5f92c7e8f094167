import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.plans.queries import QUERIES
from recurra.sources import signals as sg

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_all_elements_are_read(spark):
    x = np.array([r["embedding"] for r in sg.table(spark, SF, "embeddings").orderBy("vec_id").collect()], float)
    dims = x.shape[1]
    for name in ("znorm_signal", "query_profile", "query_profile_pnorm", "sliding_dot", "replace_distance"):
        assert QUERIES[name](spark, SF).agg(F.countDistinct("dim")).first()[0] == dims > 8, name
    assert QUERIES["dist_single"](spark, SF).count() == dims
    w = np.lib.stride_tricks.sliding_window_view(x, 16, 0)
    z = (w - w.mean(2, keepdims=True)) / w.std(2, keepdims=True)
    for name, refs in (("query_match_whole", [100]), ("pair_neighbours", [100, 300])):
        if len(z) <= max(refs):
            continue
        d = np.stack([np.sqrt(((z - z[p]) ** 2).sum(2)).mean(1) for p in refs]).min(0)
        got = QUERIES[name](spark, SF).collect()
        assert got
        for r in got:
            assert r["d"] == pytest.approx(d[r["i"]], abs=2e-4), name
