"""Manifests held to trees made in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from recurra.llm import merkle
from tests.llm import common

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 3 * 3
        out.append((i - a, [d for k, d in enumerate(nodes[a : a + 3]) if a + k != i]))
        i //= 3
    return out


def plain(docs):
    by = {}
    for r in docs:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            t = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and t is not None:
                t = t.replace("\n", "")
            folded = leaf_of(r, t)
            for place, sides in path:
                folded = H("".join(sides[:place] + [folded] + sides[place:]))
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], H("".join(d for _, x in path for d in x)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, docs, tmp_path, parts=5):
    import os

    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs], common.DOCS)
    folder = f"{tmp_path}/{len(os.listdir(tmp_path))}"
    common.clashing(df).repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, folder).collect()), key=repr)


def doc(i, text, source="s", lang="en", n=3):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


def corpus(rng):
    docs = [doc(i, rng.choice([f"a\nb{i}", "x\n", "plain", "", None, "é\n日本"]), rng.choice(["hot", "hot", None, "", "a", "B", "é", "z9"]), rng.choice(["en", None]), rng.choice([1, 20, None])) for i in range(400)]
    docs += [doc(7, "a\nb7", "hot")] * 5 + [doc(7, "other\n", "hot"), doc(None, "n\n", "hot"), doc(None, "n\n", None), doc(-3, "x\ny", "alone")]
    return docs + [doc(5000 + k, t, f"src{k % 3}") for k, t in enumerate(common.odd_texts())]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_equals_plain_trees(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs = corpus(random.Random(levels))
    assert run(spark, docs, tmp_path) == plain(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_groups(spark, tmp_path, n):
    docs = [doc(i, "x\n") for i in range(n)]
    assert run(spark, docs, tmp_path) == plain(docs)


def test_many_groups_and_none(spark, tmp_path):
    docs = [doc(i, "x\n", f"g{i}") for i in range(60)]
    assert run(spark, docs, tmp_path) == plain(docs)
    assert run(spark, [], tmp_path) == []


def test_fold_and_encoding(spark):
    assert merkle.fold("a", "", "") == "a"
    one, two = H("1"), H("2")
    assert merkle.fold("a", "1200", one + two) == H(H(one + "a" + two))
    r = spark.createDataFrame([(None, "é", 12)], "a string, b string, c long").select(merkle.encoded(F.col("a"), F.col("b"), F.col("c")).alias("x")).first()
    assert r[0] == "-2:é2:12"


def test_clashing_payload_is_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        merkle.manifest(df, merkle.digest(df["text"]), df["text"], df["doc_id"], root=df["text"])
