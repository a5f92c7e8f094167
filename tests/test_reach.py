"""Components and sinks against depth-first searches, and on a long chain."""

import random

from recurra.operators import reach


def _reached(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    out = {}
    for v in {x for e in edges for x in e}:
        seen, stack = set(), list(to.get(v, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += to.get(x, ())
        out[v] = seen
    return out


def _held(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string")
    true = [(a, b) for a, b in edges if a is not None and b is not None]
    far = _reached(true)
    want = {v: min({v} | {x for x in far[v] if v in far[x]}) for v in far}
    want |= {x: x for e in edges for x in e if x is not None and x not in want}
    assert {(r.v, r.c) for r in reach.components(df).collect()} == set(want.items())
    ends = set(far) - {a for a, _ in true}
    rows = [(r.sink, r.v) for r in reach.sinks(df).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(s, v) for v in far for s in far[v] & ends}


def test_random_graphs_blocks_of_cycles_and_edge_cases(spark):
    """Graphs apart from one another, searched together: random ones, rings that lead into rings, loops, repeats, nulls."""
    edges = []
    for seed, n, m in [(1, 12, 14), (2, 40, 60), (3, 30, 120)]:
        r = random.Random(seed)
        edges += [(f"{seed}:{r.randrange(n):02}", f"{seed}:{r.randrange(n):02}") for _ in range(m)]
    ring = lambda name, k: [(f"{name}{i}", f"{name}{(i + s) % k}") for i in range(k) for s in (1, 2)]
    _held(spark, [*edges, *ring("a", 6), *ring("b", 5), ("a0", "b0"), ("a3", "b2"), ("b1", "z"), ("y", "a1"), ("x", "x"), ("a0", "b0"), (None, "a0"), ("q", None)])


def test_no_edges(spark):
    df = spark.createDataFrame([], "src string, dst string")
    assert reach.components(df).collect() == [] and reach.sinks(df).collect() == []


def test_long_chain(spark):
    """10,000 nodes in a row: the rounds grow with the logarithm of its length."""
    chain = spark.range(9999).selectExpr("id as src", "id + 1 as dst")
    found = reach.components(chain)
    assert found.count() == 10000 and found.where("v <> c").isEmpty()
    to = reach.sinks(chain)
    assert to.count() == 9999 and to.select("sink").distinct().collect()[0][0] == 9999
