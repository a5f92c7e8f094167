"""Memory that a worker takes beside its batch: it adds up with the JVM's in an executor."""

import tracemalloc

import numpy as np
import pyarrow as pa

from recurra.llm import decontam


def peak_mb(step):
    tracemalloc.start()
    try:
        step()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_decontamination_holds_a_small_shard():
    """4 MB of texts, all words in the benchmark's vocabulary, and one hit in each; 94 MB before."""
    r = np.random.default_rng(1)
    words = np.array([f"word{k}" for k in range(500)])
    texts = [" ".join(words[r.integers(0, 500, 500)]) for _ in range(1100)]
    items = [" ".join(t.split()[k % 400 : k % 400 + 12]) for k, t in enumerate(texts)] + [" ".join(words)]

    class Shared:
        value = decontam.Phrases([str(k) for k in range(len(items))], items, 10)

    seen = []
    step = lambda: seen.extend((items, w.counts().sum()) for *_, w, _, items in decontam._cover(pa.array(texts), [Shared]))
    assert peak_mb(step) < 40
    found = [x for items, _ in seen for x in items]
    assert all(str(k) in x for k, x in enumerate(found)) and sum(n for _, n in seen) == 500 * len(texts)
