import numpy as np

from recurra.plans import methods
from tests.test_operators import long_form


def test_noisy_occurrences_join_an_exact_pair(spark):
    r = np.random.default_rng(21)
    x, shape = r.normal(size=400), np.sin(np.arange(24) / 2) * 3
    for p in (30, 110, 190, 270, 350):
        x[p : p + 24] = shape + (r.normal(0, 0.3, 24) if p > 110 else 0)
    found = methods.multidim_motifs(long_form(spark, [x]), 24, 1)
    assert {30, 110, 190, 270, 350} <= {a for a, _ in found.motifs[0].spans}
