"""Scores of masks whose samples pass the 100,000 that an event's number leaves to a label, and of many events."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from recurra.operators import metrics
from recurra.plans.oracle import ORACLE
from recurra.plans.queries import QUERIES


@pytest.fixture
def far_apart(spark, tmp_path):
    """Event 622 of label 2 and event 200622 of label 0 have one number, 200622."""
    rows = [(t, [0.5, 0.0], label) for start, label in ((622, 2), (200622, 0), (622 + 50, 0)) for t in range(start, start + 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_equal_numbers_of_events_keep_their_labels(spark, far_apart):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{far_apart}/embeddings.parquet/*.parquet'")
    want = duck.sql(f"SELECT gt, occ, disc FROM ({ORACLE['gt_best_match']})").fetchall()
    got = [tuple(r) for r in QUERIES["gt_best_match"](spark, far_apart).select("gt", "occ", "disc").collect()]
    assert sorted(got) == sorted(want) == [(0, 672, 0), (0, 200622, 0), (2, 200622, 2)]


def test_set_scores_keep_the_labels_too(spark, far_apart):
    scores = dict(QUERIES["set_scores"](spark, far_apart).collect())
    assert scores["micro_precision"] == scores["micro_recall"] == scores["ami"] == 1


def random_events(r, n):
    ends = np.cumsum(r.integers(1, 6, 2 * n))
    return [(int(a), int(z) - 1) for a, z in zip(ends[::2], ends[1::2])]


def test_matched_pairs_have_the_greatest_total():
    """Against the dense assignment: the same common samples in all, no event twice."""
    r = np.random.default_rng(5)
    for _ in range(200):
        a, b = random_events(r, r.integers(1, 12)), random_events(r, r.integers(1, 12))
        w = np.array([[metrics._common(x, y) for y in b] for x in a])
        got = list(metrics.matched(metrics._meetings(a, b)))
        assert sum(n for *_, n in got) == sum(w[i, j] for i, j in metrics.assignment(w))
        assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got)


def test_many_events_are_scored_in_linear_time():
    """20,000 events in one chain; all pairs of them would be 400 million numbers."""
    real, pred = [(10 * k, 10 * k + 9) for k in range(20000)], [(10 * k + 3, 10 * k + 12) for k in range(20000)]
    assert metrics.event_prf(real, pred, 0.5) == (1, 1, 1)


def test_event_scores_take_many_events(spark, tmp_path):
    """60,000 samples of two labels: the query gives what the operator over lists gives."""
    r = np.random.default_rng(9)
    label, x = r.integers(0, 2, 60000), r.normal(size=(60000, 2)) + 0.6
    table = pa.table({"vec_id": np.arange(60000), "embedding": pa.array(list(x.astype(np.float32))), "label": label.astype(np.int32)})
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")

    def motifs(mask):
        out = {}
        for k, t in sorted(mask):
            if out.get(k) and out[k][-1][1] == t:
                out[k][-1] = (out[k][-1][0], t + 1)
            else:
                out.setdefault(k, []).append((t + 1, t + 1))
        return [(e, {k % 3, 3}) for k, e in sorted(out.items())]

    x = x.astype(np.float32)
    real = motifs({(int(k), t) for t, k in enumerate(label)})
    pred = motifs({(int(k), t) for t, k in enumerate(label) if x[t, 0] > 0} | {(int(k), t + 1) for t, k in enumerate(label) if x[t, 1] > 0.1})
    for row in QUERIES["event_scores"](spark, str(tmp_path)).collect():
        want = metrics.event_score(real, pred, row["threshold"], row["weighted"], row["with_dims"])
        assert [v for v in row[3:] if v is not None] == pytest.approx(want, abs=1e-6)
