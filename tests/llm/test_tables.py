"""Operators over tables: revisits, chats, near duplicates, the pipeline."""

import hashlib
import random
import re

import pytest

from recurra.llm import chat_format, near_dup, warc
from recurra.llm.scratch import Scratch
from tests.llm.common import clashing, lower, odd_texts, prose, table


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(ids, texts, n, percent=80):
    sets = [shingle_set(t, n) for t in texts]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = root(ids[a]), root(ids[b])
                    up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


def edited(r, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = "new" + str(r.randrange(10**6))
    return " ".join(w)


def near_texts():
    r = random.Random(11)
    out = []
    base = prose(r, 150)
    out += [edited(r, base, r.choice([0.01, 0.03, 0.06])) for _ in range(120)]  # one large group, many members of it loose
    for _ in range(30):
        t = prose(r, r.randrange(5, 100))
        out += [t] + [edited(r, t, 0.02) for _ in range(r.randrange(3))] + [t.upper()] * r.randrange(3)
    r.shuffle(out)
    return out + odd_texts() + ["a b c", "A b  c", "a b", "b a c d", "x y z w", "x y z w"]


def test_near_duplicates(spark):
    texts = near_texts()
    df = clashing(table(spark, texts, first=5))
    got = {x["doc_id"]: x for x in near_dup.near_duplicates(df, shingle=4).collect()}
    want = brute_components(list(range(5, 5 + len(texts))), texts, 4)
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == want
    assert all(x["kept"] == (i == want[i][1]) for i, x in got.items())


def test_near_duplicates_odd_tables(spark):
    rows = table(spark, ["one two three four five", "one two three four five", None])
    twice = rows.union(rows).union(spark.createDataFrame([(None, "one two three four five", "", "", 0)], rows.schema))
    got = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["component_id"], x["kept"]) for x in near_dup.near_duplicates(twice).collect())
    assert got == [(-1, None, True), (0, 0, True), (0, 0, True), (1, 0, False), (1, 0, False), (2, 2, True), (2, 2, True)]
    assert near_dup.near_duplicates(rows.limit(0)).count() == 0
    kept = near_dup.keep_one(clashing(rows))
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 2] and kept.columns == clashing(rows).columns


def test_residual_grid_finds_all_links(spark, monkeypatch):
    """Cells much smaller than the buckets: one link at least for every linked pair that shares a band."""
    monkeypatch.setattr(near_dup, "GRID_SMALL", 4)
    monkeypatch.setattr(near_dup, "GRID_ALL", 8)
    from pyspark.sql import functions as F

    r = random.Random(12)
    base = prose(r, 80)
    texts = [edited(r, base, 0.012) for _ in range(40)]
    docs = table(spark, texts).select("doc_id", "text")
    scratch = Scratch(spark, "t")
    base_table = scratch.save(near_dup.signatures(docs, 4))
    buckets = base_table.select("doc_id", F.explode("bands").alias("key"))
    standing = near_dup._standing(buckets, docs.select(F.col("doc_id").alias("v"), F.col("doc_id").alias("c")))
    links = near_dup.residual_links(standing, base_table, docs, near_dup.least_matches(0.8, 1e-6), 4, 0.8, scratch)
    got = {frozenset((x["a"], x["b"])) for x in links.collect()}
    sets = [shingle_set(t, 4) for t in texts]
    want = {frozenset((a, b)) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 20


def test_members_that_can_link_stay(spark):
    """Texts that share a passage, and copies: what has a link stays, what shares too little goes."""
    r = random.Random(21)
    passage = prose(r, 150)
    texts = [f"{passage} {prose(r, r.randrange(200, 300))}" for _ in range(40)]
    texts += [edited(r, t, 0.01) for t in texts[:12]] + ["a b c", "a b c", None, ""]
    docs = table(spark, texts).select("doc_id", "text")
    scratch = Scratch(spark, "t")
    left = {x["doc_id"] for x in near_dup.possible(docs, scratch.save(docs.select("doc_id")), 4, 0.8, 1e-6, scratch).collect()}
    sets = [shingle_set(t, 4) for t in texts]
    linked = {i for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for i in (a, b)}
    assert linked <= left and len(left) < len(linked) + 12 and len(linked) > 20


def test_near_duplicates_through_all_stages(spark, monkeypatch):
    """Texts that share a passage, copies of some, and a chain of edits."""
    monkeypatch.setattr(near_dup, "GRID_SMALL", 4)
    monkeypatch.setattr(near_dup, "GRID_ALL", 8)
    called = []
    for name in ("possible", "residual_links"):
        monkeypatch.setattr(near_dup, name, lambda *a, f=getattr(near_dup, name), n=name: (called.append(n), f(*a))[1])
    r = random.Random(22)
    passage = prose(r, 120)
    texts = [f"{passage} {prose(r, r.randrange(35, 60))}" for _ in range(50)]
    chain = [prose(r, 60)]
    for _ in range(25):
        chain.append(edited(r, chain[-1], 0.03))
    texts += [edited(r, t, 0.01) for t in texts[:20]] + chain
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(table(spark, texts), shingle=4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(range(len(texts))), texts, 4).items()}
    assert "possible" in called


def test_near_duplicates_of_string_ids(spark):
    from pyspark.sql import functions as F

    texts = ["one two three four five six", "one two three four five six", "other words that stand here alone", None]
    named = table(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = {x["doc_id"]: (x["component_id"], x["kept"]) for x in near_dup.near_duplicates(named).collect()}
    assert got == {"d0": ("d0", True), "d1": ("d0", False), "d2": ("d2", True), "d3": ("d3", True)}
    assert sorted(x["doc_id"] for x in near_dup.keep_one(named).collect()) == ["d0", "d2", "d3"]


@pytest.mark.parametrize("bound", [("GONE_IDS", 10), ("GONE_IDS", 0), ("GONE_BYTES", 0)])
def test_keep_one_both_ways(spark, monkeypatch, bound):
    """Dropped ids are broadcast within the bounds and dealt beyond them; the rows that stay are the same."""
    monkeypatch.setattr(near_dup, *bound)
    texts = ["one two three four five six", "one two three four five six", "other words that stand here alone", None, "one two three four five six"]
    rows = table(spark, texts)
    rows = rows.union(spark.createDataFrame([(None, "one two three four five six", "", "", 0)], rows.schema))
    kept = near_dup.keep_one(rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"]) for x in kept.collect()) == [-1, 0, 2, 3]
    plan = kept._jdf.queryExecution().toString()
    assert ("strategy=broadcast" in plan) == (bound[1] > 0)


def test_posterior_bounds():
    least = near_dup.least_matches(0.8, 1e-6)
    assert list(least) == list(range(16, 129, 16)) and all(0 <= m <= n for n, m in least.items())
    assert least[128] < 0.8 * 128 and least[128] > 0.5 * 128


def test_chats(spark):
    odd = ["", "###", "####", "\\", "\\h\\t\\s", "</turn>", "<</turn>", "### user:\n</turn>", "a\n### b", None, "é" * 5, ":\n"]
    r = random.Random(13)
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", "### x:\n", None]), r.choice(odd)))
    rows += [(99, 0, "user", "tie b"), (99, 0, "user", "tie a"), (99, 0, "user", "tie a"), (None, 1, "user", "no id")]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(600)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_format.format_chats(df)
    got = out.select("conv_id", "formatted", "loss_spans", chat_format.parse(out["formatted"]).alias("turns"), chat_format.masked(out["formatted"], out["loss_spans"]).alias("loss")).collect()
    assert len(got) == 43
    for x in got:
        mine = sorted((t, ro or "", tx or "") for c, t, ro, tx in rows if c == x["conv_id"])
        assert [(t["role"], t["text"]) for t in x["turns"]] == [m[1:] for m in mine]
        assert x["loss"] == "".join(m[2] for m in mine if m[1] == "assistant")
        heads = sum(k == 0 or mine[k][1] != mine[k - 1][1] for k in range(len(mine)))
        assert x["formatted"].count("### ") == heads and x["formatted"].count("</turn>") == len(mine)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_a_chat_of_100_000_turns(spark):
    from pyspark.sql import functions as F

    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t\\"), F.col("id").cast("string")).alias("text"))
    out = chat_format.format_chats(df)
    got = out.select(F.size("loss_spans").alias("n"), F.sha2(chat_format.masked(out["formatted"], F.slice("loss_spans", 66_000, 5)), 256).alias("h")).first()
    loss = [f"t\\{k}" for k in range(n) if k % 3]
    assert got["n"] == len(loss) and got["h"] == hashlib.sha256("".join(loss[65_999:66_004]).encode()).hexdigest()


@pytest.mark.parametrize("radix", [4096, 16])
def test_revisits(spark, monkeypatch, radix):
    monkeypatch.setattr(warc, "RADIX", radix)
    r = random.Random(14)
    rows = []
    for k in range(400):
        kind = r.choice(["response", "revisit", "revisit"])
        url = r.choice(["http://a.org/x", "https://www.A.org/x/", "a.org:80/x?utm_a=1", "a.org/x?b=2&a=1#f", "http://a.org/x?a=1&b=2", "b.org", None, ""])
        h = {n: r.choice(["1", "2"]) for n in r.sample(["etag", "last-modified", "date", "content-length", "server", "vary"], r.randrange(5))}
        rows.append((k, kind, r.choice([200, 200, 404]) if kind == "response" else 304, url, r.randrange(0, 300_000), h or None, f"d{k}", k))
    df = clashing(spark.createDataFrame(rows, "record_id long, kind string, status int, url string, ts long, headers map<string,string>, digest string, n_bytes long"))
    keys = {"http://a.org/x": "a.org/x", "https://www.A.org/x/": "a.org/x", "a.org:80/x?utm_a=1": "a.org/x", "a.org/x?b=2&a=1#f": "a.org/x?a=1&b=2", "http://a.org/x?a=1&b=2": "a.org/x?a=1&b=2", "b.org": "b.org", None: None, "": ""}
    got = {x["record_id"]: x for x in warc.resolve_revisits(df).collect()}
    assert len(got) == sum(x[1] == "revisit" for x in rows)
    for k, kind, _, url, ts, h, *_ in rows:
        if kind != "revisit":
            continue
        full = [x for x in rows if x[1] == "response" and x[2] == 200 and keys[x[3]] is not None and keys[x[3]] == keys[url] and x[4] < ts]
        x, h = got[k], h or {}
        assert x["url_key"] == keys[url]
        if not full:
            assert x["outcome"] == "unmatched" and x["refers_to"] is None
            continue
        f = max(full, key=lambda v: (v[4], v[0]))
        fh = f[5] or {}
        name = next((n for n in ("etag", "last-modified") if n in h and n in fh), "unchecked")
        ok = name == "unchecked" or h[name] == fh[name]
        assert (x["refers_to"], x["validator"], x["outcome"]) == (f[0], name, "resolved" if ok else "mismatch")
        if ok:
            assert x["headers"] == {**fh, **{n: v for n, v in h.items() if n in warc.PERMITTED}} and x["digest"] == f[6] and x["n_bytes"] == f[7]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import base64

    import public_tokenizers as public
    import tiktoken

    import corpus_pipeline
    from recurra.llm import pii, quality_rules
    from tests.llm.test_texts import brute_contamination

    r = random.Random(15)
    items = [(k, prose(r, 15)) for k in range(4)]
    texts = [prose(r, 60) for _ in range(30)]
    texts += [edited(r, t, 0.01) for t in texts[:8]] + texts[:3]
    texts += [prose(r, 20) + " " + items[k % 4][1] + " " + prose(r, 20) for k in range(6)]
    texts += [prose(r, 30) + " mail a.b@c.de now " + prose(r, 9), "again and again " * 20, *odd_texts()]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    judged = {x["doc_id"] for x in quality_rules.quality_measures(table(spark, texts)).where("kept").collect()}
    ids = sorted(judged)
    keep = [i for i, (_, c) in brute_components(ids, [texts[i] for i in ids], 5).items() if i == c]
    assert set(got) == set(keep)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in keep:
        back = lib.decode(got[i]["ids"])
        assert got[i]["ids"] == lib.encode_ordinary(back) and got[i]["n_tokens"] == len(got[i]["ids"])
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
        assert brute_contamination(back, items)[1] == 0 and not pii.base_spans(back)
        if not brute_contamination(texts[i], items)[1] and not re.search("[0-9]{3}|@", texts[i]):
            assert back == texts[i]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing(table(spark, texts).limit(0)), str(tmp_path)).columns == clashing(table(spark, texts)).columns
