"""Word BPE by segment trees, held to the tokenizers library and to plain merging."""

import hashlib
import random

import numpy as np
import pytest

from recurra.llm import word_bpe
from tests.llm import common

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def mine():
    return word_bpe.WordBpe(word_bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(5)
    out = [t or "" for t in common.odd_texts()]
    out += ["<|endoftext|>", "a<|endoftext|><|startoftext|>b c<|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ. Σ İIı", "it's I'LL we'Ve 'd", "x" * 3000, "ab" * 400, "日本" * 700, "é Å ﬁ"]
    out += ["".join(rng.choice("ab'stSΣé́e \n<|endoftext|>12日") for _ in range(rng.randrange(60))) for _ in range(400)]
    return out + ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x370, 0x530), rng.randrange(0x4E00, 0x9FA5), rng.randrange(0x1F300, 0x1F600)])) for _ in range(30)) for _ in range(300)]


def test_equals_the_library(mine, library):
    ts = texts()
    for t, want, (ids, n, decoded) in zip(ts, library.encode_batch(ts, add_special_tokens=False), mine.encode(ts)):
        assert ids == " ".join(map(str, want.ids)) and n == len(want.ids), t[:60]
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def plain(v, ids):
    """Merges the leftmost pair of least rank until there is none."""
    ranks = {(a, b): (r, m) for r, (a, b, m) in enumerate(v.merges.tolist())}
    ids = list(ids)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        if not found:
            return ids
        (_, m), i = min(found)
        ids[i : i + 2] = [m]


def test_trees_in_rows_and_single_trees_merge_alike(mine):
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcthein") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 30, 64, 65]))) for _ in range(300)] + [b"a" * n for n in range(1, 40)]
    got = dict(mine.encode_words(words))
    assert sorted(got) == list(range(len(words)))
    for k, w in enumerate(words):
        first, off = mine.symbols([w])
        assert off.tolist() == [0, len(w)]
        assert got[k] == mine.merge_wide(first.tolist()) == plain(mine.v, first.tolist())


def test_memory_is_bounded_and_answers_stay(mine, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 2000)
    monkeypatch.setattr(word_bpe, "PORTION", 40)
    rng = random.Random(4)
    ts = [" ".join(rng.choice(["river", "stone", "qqxz", "light", "zzz" + str(i)]) for _ in range(6)) for i in range(200)]
    small = word_bpe.WordBpe(mine.v)
    assert list(small.encode(ts)) == list(mine.encode(ts))
    assert len(small.seen) + len(small.old) < 60


def test_bytes_without_symbol_are_left_out():
    v = word_bpe.Vocabulary(["a", "a</w>", "aa</w>"], {}, np.full(256, -1), np.full(256, -1), np.array([[0, 1, 2]]))
    v.first[97], v.last[97] = 0, 1
    assert list(word_bpe.WordBpe(v).encode(["aa b a", "b", "ab"])) == [("2 1", 2, "aa</w> a</w>"), ("", 0, ""), ("0", 1, "a")]


def test_frames(spark, library):
    ts = common.odd_texts() + ["Twice", "Twice"]
    df = common.clashing(common.table(spark, ts))
    rows = {r["doc_id"]: r for r in word_bpe.encode(df, PATH).collect()}
    short = {r["doc_id"]: r for r in word_bpe.digests(df, PATH).collect()}
    assert len(rows) == len(short) == len(ts)
    for i, t in enumerate(ts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want and rows[i]["decoded"] == library.decode(want, skip_special_tokens=False)
        assert short[i]["n_tokens"] == len(want) and short[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert short[i]["decoded_sha256"] == hashlib.sha256(rows[i]["decoded"].encode()).hexdigest()
    empty = word_bpe.digests(df.limit(0), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_query_reads_whole_table(spark, library):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    rows = word_bpe.op11_word_bpe(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
