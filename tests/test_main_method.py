"""The main method's queries on the given tables: they find motifs, and those of a plain run from the definitions."""

import math
import os

import numpy as np
import pytest

from recurra.operators import extract, graph
from recurra.plans.queries import MAIN, QUERIES
from recurra.sources import signals as sg

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
K, JUMP, ALPHA, LEAST, RATIO, BINS = 5, 2, 10.0, 0.8, 0.4, 1024


def plain(x: np.ndarray) -> list[tuple[tuple[int, ...], tuple]]:
    """(dims, spans) of each motif of x (dims, samples)."""
    w, n = MAIN["wlen"], x.shape[1]
    m, line = n - w + 1, np.arange(w) - (w - 1) / 2
    all_edges, points = [], []
    for v in x:
        unit = []
        for i in range(m):
            c = v[i : i + w] - v[i : i + w].mean()
            c = c - line * (c @ line) / (line @ line)
            unit.append(c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else c * np.nan)
        unit = np.array(unit)
        edges, nearest = {}, {}
        for i in range(m):
            d = np.round(np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit[i]))), 9)
            taken = [i]
            while len(taken) <= K:
                free = [j for j in range(m) if not math.isnan(d[j]) and all(abs(j - p) >= w for p in taken)]
                if not free:
                    break
                j = min(free, key=lambda j: (d[j], j))
                nearest.setdefault(i, d[j])
                key = (min(i, j), max(i, j))
                edges[key] = min(edges.get(key, 9), d[j])
                taken.append(j)
        rows = [(a, b, d) for (a, b), d in edges.items()] + [(i, i + 1, max(nearest[i], nearest[i + 1])) for i in nearest if i + 1 in nearest]
        squash = lambda d: 2 * math.sqrt(math.tanh(ALPHA * d * d) / math.tanh(4 * ALPHA))
        rows = sorted((squash(d), a, b) for a, b, d in rows)
        all_edges.append(rows)
        root, birth = {}, {}
        for wt, a, b in rows:
            for p in (a, b):
                if p not in root:
                    root[p], birth[p] = p, wt
            ra, rb = root[a], root[b]
            if ra != rb:
                dies, stays = (rb, ra) if birth[ra] < birth[rb] else (ra, rb)
                if wt > birth[dies]:
                    points.append((birth[dies], wt))
                root = {p: stays if r == dies else r for p, r in root.items()}
    at = np.array([b for b, _ in points])
    low, high = at.min(), at.max()
    bins = np.minimum((at - low) / (high - low) * BINS, BINS - 1).astype(int)
    left = low + np.arange(BINS) * (high - low) / BINS
    best, cut = -1.0, None
    for k in range(BINS - 1):
        inside = bins <= k
        p = inside.mean()
        if 0 < p < 1:
            s = left[bins[inside]].sum() / len(bins)
            var = round(p * (1 - p) * (s / p - (at.mean() - s) / (1 - p)) ** 2, 9)
            if var > best:
                best, cut = var, left[k]
    gaps = sorted((d - b for b, d in points if b < cut), reverse=True)
    first = 0
    for _ in range(JUMP):
        drop = max(range(first, len(gaps) - 1), key=lambda k: (gaps[k] - gaps[k + 1], -k))
        gap, first = (gaps[drop] + gaps[drop + 1]) / 2, drop + 1
    cands, births = [], {}
    for dim, rows in enumerate(all_edges):
        root, birth = {}, {}
        for wt, a, b in rows:
            if wt >= cut and (a not in root or b not in root):
                continue
            for p in (a, b):
                if p not in root:
                    root[p], birth[p] = p, wt
            ra, rb = root[a], root[b]
            if ra != rb and wt - max(birth[ra], birth[rb]) < gap:
                dies, stays = (rb, ra) if birth[ra] < birth[rb] else (ra, rb)
                root = {p: stays if r == dies else r for p, r in root.items()}
        births |= {(dim, p): birth[p] for p in root}
        cands += [graph.Candidate(f"{dim}:{r}", frozenset({dim}), frozenset(p for p in root if root[p] == r)) for r in set(root.values())]
    kept = graph.resolve(sorted(cands, key=lambda c: c.name), LEAST, MAIN["n_patterns"])
    rank = {}
    for c in kept:
        for p in c.positions:
            b = [births[d, p] for d in c.dims if (d, p) in births]
            if b:
                rank[c.name, p] = sum(b) / len(b)
    placed = extract.place([(c.name, c.dims, c.positions) for c in kept], rank, n, w, MAIN["max_wlen"], RATIO)
    return sorted((tuple(sorted(c.dims)), tuple(sorted((a, z) for name, a, z in placed if name == c.name))) for c in kept if any(name == c.name for name, *_ in placed))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_motifs_of_the_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    got = {}
    for r in QUERIES["coordinated_motifs"](spark, d).collect():
        got.setdefault((r["motif"], r["dims"]), []).append((r["start"], r["end"]))
    assert len(got) >= 2
    rows = sg.ord_week(spark, d).collect()
    x = np.zeros((1 + max(r["dim"] for r in rows), 1 + max(r["t"] for r in rows)))
    for r in rows:
        x[r["dim"], r["t"]] = r["v"]
    assert sorted((tuple(map(int, dims.split(","))), tuple(sorted(spans))) for (_, dims), spans in got.items()) == plain(x)


def test_retuned_motifs_are_some(spark):
    runs = QUERIES["retuned_motifs"](spark, "/root/testdata/sf0.01").collect()
    assert {r["run"] for r in runs} == {0, 1, 2} and sum(r["run"] == 1 for r in runs) <= 2
