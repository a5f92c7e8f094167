import numpy as np

from recurra.operators import warped


def test_odd_starts_and_odd_lengths_are_candidates():
    x = np.zeros(61)
    x[11:20] = x[41:50] = np.array([3, -4, 5, -6, 7, -5, 6, -3, 4])
    x[:11], x[20:41], x[50:] = np.linspace(0, 1, 11), np.linspace(-1, 2, 21), np.linspace(1, 0, 11)
    full, half = (warped.motif_sets(x, 8, 15, 0.9, 1, step)[0] for step in (1, 2))
    assert warped.motif_sets(x, 8, 15, 0.9, 1) == [full]
    size = lambda s: (len(s) - 1) / len(s) * sum(z - a for a, z in s)
    assert full != half and size(full) >= size(half)


def test_no_path_is_left():
    """Every free cell is used: as many paths as there are, above 200."""
    x = np.random.default_rng(2).normal(size=500)
    assert len(warped.paths(x, 3, 0.8)) > 200


def test_the_whole_series_is_read(spark, monkeypatch):
    from recurra.plans import queries

    seen = []
    monkeypatch.setattr(queries.warped, "warped_motifs", lambda sig, *a: seen.append(sig.agg({"t": "max"}).first()[0]) or sig)
    queries.QUERIES["warped_motifs"](spark, "/root/testdata/sf0.001")
    assert seen[0] >= 160
