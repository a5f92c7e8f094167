"""Ranked search held to a plain ranking of all documents."""

import math
import random
import re

import numpy as np
import pytest

from recurra.llm import lexical
from recurra.llm import textnum as tn
from tests.llm import common

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=50):
    """docs, items: (id, text) rows; every document is scored for every item."""
    terms = [(i, [common.lower(w) for w in TERM.findall(t or "")]) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n_docs, n_terms = len(terms), sum(len(t) for _, t in terms)
    df, query, out = {}, {}, []
    for _, t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    for i, t in items:
        query.setdefault(i, set()).update(common.lower(w) for w in TERM.findall(t or ""))
    for item, words in query.items():
        scores = []
        for i, t in terms:
            m = 50 + 50 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 20 * m)) for w in words if w in t)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=50):
    d = common.clashing(spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "body")).withColumnRenamed("body", "text")
    i = common.clashing(spark.createDataFrame(items, "item_id long, text string"))
    index = lexical.build(d.repartition(3))
    rows = sorted((tuple(r) for r in lexical.search(index, i, k).collect()), key=repr)
    index.drop()
    return rows


def corpus(rng, n):
    docs = [(i, common.prose(rng, rng.choice([1, 3, 20, 90]))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(40)]  # equal scores
    docs += [(3, docs[3][1]), (None, docs[5][1]), (None, "river0 RIVER0 river1")]
    return docs + [(10_000 + i, t) for i, t in enumerate(common.odd_texts())]


def test_equals_plain_ranking(spark):
    rng = random.Random(8)
    docs = corpus(rng, 150)
    items = [(i, common.prose(rng, 12)) for i in range(9)] + [(2, common.prose(rng, 4)), (20, None), (21, "  ...  "), (22, docs[5][1]), (None, "the0 River0"), (23, "absentword"), (24, "L'ÉTÉ ÜBER 日本語 a-b_c"), (25, "same Same line")]
    assert found(spark, docs, items, 10) == plain(docs, items, 10)


def test_blocks_of_items_and_of_cells(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 20)
    monkeypatch.setattr(lexical, "CELLS", 50)
    monkeypatch.setattr(lexical, "SHARD", 2000)
    rng = random.Random(9)
    docs, items = corpus(rng, 120), [(i, common.prose(rng, 9)) for i in range(8)]
    assert found(spark, docs, items, 7) == plain(docs, items, 7)
    assert found(spark, docs, items, 1000) == plain(docs, items, 1000)  # fewer documents than asked for


def test_empty_tables(spark):
    docs, items = [(1, "river stone"), (2, "river")], [(1, "river")]
    assert found(spark, docs, []) == [] == found(spark, [], items) == found(spark, [(1, None), (2, "")], items)
    assert found(spark, docs, items) == plain(docs, items)
    with pytest.raises(ValueError):
        lexical.search(lexical.build(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), 0)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    got = lexical.search(lexical.build(docs), spark.createDataFrame([("q", "x")], "item_id string, text string")).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in sorted(got)] == [("q", 1, "a"), ("q", 2, "b")]


def test_bytes_bound_the_exact_factor():
    rng = np.random.default_rng(0)
    tf, n = rng.integers(1, 400, 5000), rng.integers(1, 200_000, 5000)
    exact = lexical.factors(tf, n, 1000, 700_000)
    q = -(-exact // lexical.STEP)
    assert q.max() <= 255 and (q * lexical.STEP >= exact).all() and (np.maximum(q - 1, 0) * lexical.STEP <= exact).all()
    assert exact.tolist() == [10**9 * int(a) // (1000 * int(a) + 20 * (50 + 50 * int(b) * 1000 // 700_000)) for a, b in zip(tf, n)]


def test_lists_of_a_shard():
    texts = ["b a b", "", "A c", "a"]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *map(len, texts)])
    terms, starts, docs, tf, n = lexical.lists(np.frombuffer(raw, np.uint8), off)
    assert n.tolist() == [3, 0, 2, 1] and (np.diff(terms) > 0).all()
    a = tn.words(np.frombuffer(b"a", np.uint8), np.array([0, 1]), tn.PUNCTUATION).hash.view(np.int64)[0]
    k = terms.tolist().index(a)
    assert docs[starts[k] : starts[k + 1]].tolist() == [0, 2, 3] and tf[starts[k] : starts[k + 1]].tolist() == [1, 1, 1]


def test_few_documents_are_scored_exactly(spark, monkeypatch):
    """The byte bounds leave few texts for exact scores."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, common.prose(rng, 60)) for i in range(3000)], "doc_id long, text string")
    index = lexical.build(docs)
    items = spark.createDataFrame([(i, common.prose(rng, 30)) for i in range(5)], "item_id long, text string")
    scored, rows = lexical._scored, []

    def counted(*a):
        rows.append(scored(*a).count())
        return scored(*a)

    monkeypatch.setattr(lexical, "_scored", counted)
    assert lexical.search(index, items, 10).count() == 50
    assert rows[0] <= 5 * 10 * 8  # of 15,000 pairs
