"""Operators that judge every text by itself, against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recurra.llm import bpe, decontam, labelled, licenses, pii, quality_model, quality_rules, toxicity
from tests.llm.common import clashing, lower, odd_texts, prose, table


def rng_texts(n=60):
    r = random.Random(1)
    out = []
    for k in range(n):
        t = prose(r, r.randrange(0, 120))
        if k % 3 == 0:
            t = t + "\n" + " ".join(t.split()[:20]) + "\n" + t[: len(t) // 2]
        out.append(t)
    return out + odd_texts() + ["again and again"] * 3


def test_quality_rules(spark):
    texts = rng_texts()
    df = clashing(table(spark, texts))
    got = {r["doc_id"]: r for r in quality_rules.quality_measures(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        hit = {}
        for n in (5, 8, 13):
            c = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
            hit[n] = {j + k for j in range(len(w) - n + 1) if c[tuple(w[j : j + n])] > 1 for k in range(n)}
        seen, dup, chars = set(), 0, 0
        for line in t.split("\n"):
            if ws := re.findall(r"[^\x20\x09-\x0D]+", line):
                dup += line in seen
                chars += sum(map(len, ws)) * (line in seen)
                seen.add(line)
        size = sum(map(len, w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), size, len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit[5])), i
        failed = len(w) < 10 or 100 * len(hit[5]) > 20 * len(w)
        shares = {n: sum(len(w[j]) for j in hit[n]) / max(size, 1) for n in hit}
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and chars / max(size, 1) <= quality_rules.LINE_LIMIT and all(shares[n] <= quality_rules.LIMITS[n] for n in hit))
    kept = quality_rules.filter_quality(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.quality_measures(df.limit(0)).count() == 0


def brute_contamination(text, items, window=10):
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(pat, lower(text))
    hit, names = set(), set()
    for name, t in items:
        iw = re.findall(pat, lower(t))
        size = min(window, len(iw))
        for j in range(len(iw) - size + 1 if size else 0):
            for k in range(len(w) - size + 1):
                if w[k : k + size] == iw[j : j + size]:
                    hit |= set(range(k, k + size))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_decontamination(spark):
    r = random.Random(2)
    items = [(k, prose(r, r.choice([3, 9, 10, 14, 25]))) for k in range(12)] + [(12, None), (13, ""), (14, "Solo"), (0, "twice named item here")]
    texts = []
    for k in range(40):
        parts = [prose(r, r.randrange(0, 30))]
        for _ in range(r.randrange(3)):
            it = r.choice(items)[1] or ""
            parts += [it.upper() if k % 2 else it, prose(r, r.randrange(0, 4))]
        texts.append(" , ".join(parts))
    texts += [items[4][1] * 1, " ".join([items[5][1]] * 30)] + odd_texts()
    df = clashing(table(spark, texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in decontam.contamination(df, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, names = brute_contamination(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, names), i
    clean = decontam.remove_spans(df, bench)
    assert clean.columns == df.columns
    for x in clean.select("doc_id", "text", "n_chars").collect():
        if not got[x["doc_id"]]["n_hit"]:
            assert x["text"] == texts[x["doc_id"]]
        else:
            assert x["n_chars"] == len(x["text"]) < len(texts[x["doc_id"]])
    assert decontam.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(df.limit(0), bench).count() == 0


def test_decontamination_in_item_blocks(spark, monkeypatch):
    r = random.Random(5)
    items = [(k, prose(r, 12)) for k in range(9)]
    texts = [prose(r, 5) + " " + t + " " + prose(r, 5) for _, t in items]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), table(spark, texts)
    whole = sorted(map(str, decontam.contamination(df, bench).collect()))
    monkeypatch.setattr(decontam, "ITEM_BYTES", 300)
    assert len(decontam._item_blocks(bench, "item_id", "text", 10)) > 2
    assert sorted(map(str, decontam.contamination(df, bench).collect())) == whole


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0

    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii_base_patterns():
    r = random.Random(4)
    for k in range(6000):
        t = "".join(r.choices("a1@.-+ ()%0Zé\n" if k % 2 else "0123.. -+", k=r.randrange(60)))
        assert pii.base_spans(t) == brute_pii(t)
    assert pii.base_spans("1" * 50_000 + ".2.3") == [] and pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]


def brute_decode(field, text):
    """The best segmentation of each run by trying them all."""

    def best(run, j):
        if j == 0:
            return 0.0
        top = best(run, j - 1)
        for i in range(max(0, j - pii.MAX_TOKENS), j):
            s = field.weights[pii.features(text, run[i][0], run[j - 1][1], j - i, run[i][2])].sum(0).max()
            top = max(top, best(run, i) + s)
        return top

    return sum(best(r, len(r)) for r in pii.token_runs(text))


def test_pii_field(spark):
    field = pii.train_field(10 * pii.written())
    for text, gold in pii.written():
        assert sorted(field.decode(text)) == sorted(gold)
        got = 0.0
        for run in pii.token_runs(text):
            at = {(a, z): (i, j) for j in range(len(run)) for i in range(j + 1) for a, z in [(run[i][0], run[j][1])]}
            for kind, a, z in field.decode(text):
                if (a, z) in at:
                    i, j = at[a, z]
                    got += field.weights[pii.features(text, a, z, j - i + 1, run[i][2])].sum(0)[pii.KINDS.index(kind)]
        assert got == pytest.approx(brute_decode(field, text))
    texts = ["write a.b@c.de or +1 (017) 555-7713", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" 1.2.3.4", *odd_texts()]
    df = clashing(table(spark, texts))
    found = {x["doc_id"]: x for x in pii.find_pii(df, field).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in found[i]["base"]] == brute_pii(t or "")
        assert set(map(tuple, found[i]["base"])) <= set(map(tuple, found[i]["spans"]))
    clean = pii.redact(df, field)
    assert clean.columns == df.columns
    out = {x["doc_id"]: x["text"] for x in clean.collect()}
    assert out[0] == "write [EMAIL] or [PHONE]" and out[1] == 'token = "[SECRET]" [IP]' and out[2] is None and out[9] == texts[9]
    assert pii.find_pii(df.limit(0), field).count() == 0


def test_pii_added_spans_on_held_out_forms():
    """Forms that the base patterns don't know, with other words and numbers than the written examples: found; numbers of other kinds: left alone."""
    field = pii.train_field(10 * pii.written())
    r = random.Random(20)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    around = lambda n: " ".join(r.choices("we met near the harbour and then left for dinner again before noon".split(), k=n))

    def code(n):
        return "".join(r.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ", k=n - 4)) + digits(4)

    forms = [
        lambda: ("secret", ' api_key = "', code(r.randrange(18, 40)), '" '),
        lambda: ("secret", " password: ", code(r.randrange(18, 30)), " "),
        lambda: ("phone", r.choice([" call ", " tel "]), f"({digits(3)}) {digits(3)}-{digits(4)}", " "),
        lambda: ("phone", r.choice([" fax ", " phone "]), f"{digits(3)}-{digits(3)}-{digits(4)}", " "),
    ]
    for form in forms:
        right = 0
        for _ in range(100):
            kind, before, span, after = form()
            head = around(5) + before
            right += field.decode(head + span + after + around(4)) == [(kind, len(head), len(head) + len(span))]
        assert right >= 90
    other = [lambda: f"in {r.randrange(1900, 2030)} we sold {digits(3)} of {digits(5)}", lambda: f"version {digits(1)}.{digits(2)}.{digits(1)} at {digits(2)}:{digits(2)}", lambda: f"order {digits(9)} on {digits(1)}/{digits(2)}/2024", lambda: f"pages {digits(2)}-{digits(3)} and {digits(2)}.{digits(2)}"]
    assert sum(bool(field.decode(f"{around(4)} {form()} {around(3)}")) for form in other for _ in range(100)) <= 8


def test_pii_sample(spark):
    """Equal texts count once, long texts give pieces, nulls and empty tables none."""
    long = " ".join(f'token = "{k:040x}"' for k in range(2000))
    df = clashing(table(spark, ["a 1"] * 500 + [None, "", long]))
    seen = []
    real, pii.train_field = pii.train_field, lambda examples: seen.append([x for x in examples if x not in pii.written()])
    try:
        pii.train(df, rows=20)
        pii.train(df.limit(0))
    finally:
        pii.train_field = real
    assert 15 <= len(seen[0]) <= 20 and len({t for t, _ in seen[0]}) == len(seen[0]) and seen[1] == []
    assert sum(len(t) > 1000 and len(g) > 20 for t, g in seen[0]) > 10


def test_labelled_sample_passes_over_a_text_that_does_not_fit(spark):
    docs = table(spark, ["x" * 5000 if k % 7 == 0 else f"text {k}" for k in range(50)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    texts, y = labelled.sample(docs, labels, "toxic", max_bytes=4000)
    import zlib

    want = [k for k in range(50) if k % 7 and zlib.crc32(str(k).encode()) % 5]
    assert sorted(texts.to_pylist()) == sorted(f"text {k}" for k in want) and len(y) == len(want)


def test_quality_densities_by_formula():
    import numpy as np

    r = np.random.default_rng(1)
    y = (r.random(400) < 0.4).astype(int)
    x = r.normal(size=(400, 4)) @ r.normal(size=(4, 4)) + y[:, None]
    m = quality_model.fit(x, y)
    pooled, diagonal = m.shrinkage
    z = (x - x.mean(0)) / x.std(0)
    cov = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = ((y == 0).sum() * cov[0] + (y == 1).sum() * cov[1]) / len(y)
    density = []
    for k in (0, 1):
        c = (1 - pooled) * cov[k] + pooled * common
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(4)
        v = z - z[y == k].mean(0)
        density.append((y == k).mean() * np.exp(-0.5 * np.einsum("ij,jk,ik->i", v, np.linalg.inv(c), v)) / np.sqrt(np.linalg.det(c)))
    assert np.allclose(m.posterior(x), density[1] / (density[0] + density[1]))
    assert m.shrinkage in quality_model.GRID


def test_bpe_matches_the_library(spark):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    pool = [chr(c) for c in [*range(0x500), *range(0x3040, 0x3080), *range(0x1F300, 0x1F340)]]
    texts = ["".join(r.choices(pool, k=r.randrange(80))) for _ in range(300)] + ["ab" * 3000, "a" * 257, "it's I'LL", "<|endoftext|>"] + odd_texts()
    df = clashing(table(spark, texts))
    got = {x["doc_id"]: x for x in bpe.digests(df, path, public.PATTERN).collect()}
    full = {x["doc_id"]: x for x in bpe.encode(df, path, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        assert full[i]["ids"] == ids and bytes(full[i]["decoded"]) == (t or "").encode()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digests(df.limit(0), path, public.PATTERN).count() == 0


def test_long_pieces_take_the_same_merges():
    import public_tokenizers as public

    b = bpe.Bpe(bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)
    r = random.Random(8)
    for _ in range(50):
        p = "".join(r.choices("abethin", k=r.randrange(2, 250))).encode()
        assert b.merge_long(p).tolist() == b.merge_rows([p])[0].tolist()


def full_local(template, text):
    """Best unbanded local alignment score."""
    best, above = 0, [0] * (len(text) + 1)
    for a in template:
        row = [0]
        for j, x in enumerate(text):
            row.append(max(0, above[j] + (1 if a == x else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_license_scan(spark):
    r = random.Random(9)
    texts, want = [], []
    for name, t in licenses.TEMPLATES.items():
        w = t.split()
        for k in range(4, len(w) - 4, 17):
            w[k] = "changed"
        texts.append(prose(r, 40) + " é " + " ".join(w) + "\n" + prose(r, 20))
        want.append(name)
    texts += [prose(r, 200), "Released under the MIT License. " * 5, *odd_texts()]
    df = clashing(table(spark, texts))
    rows = licenses.license_matches(df).collect()
    index = licenses.Index(licenses.TEMPLATES)
    import numpy as np
    import pyarrow as pa

    from recurra.llm import textnum as tn

    for i, name in enumerate(want):
        mine = [x for x in rows if x["doc_id"] == i and x["license"] == name]
        assert mine, name
        assert texts[i][mine[0]["start"] : mine[0]["end"]].split()[0].lower() in licenses.TEMPLATES[name].lower()
        data, off = tn.buffers(pa.array([texts[i]]))
        words = tn.words(data, off, tn.PUNCTUATION, lower=True).hash
        own = index.words[index.names.index(name)]
        scores = [s[2] for s in licenses.scan(data, off, index) if index.names[s[1]] == name]
        assert max(scores) == full_local(own.tolist(), words.tolist())
        assert isinstance(mine[0]["coverage"], float) and np.isclose(mine[0]["coverage"], mine[0]["n_matched"] / len(own))
        shown = texts[i][mine[0]["start"] : mine[0]["end"]]
        common = [v for v in licenses.TEMPLATES[name].split() if v in shown.split()]
        assert mine[0]["coverage"] >= 0.9 * len(common) / len(licenses.TEMPLATES[name].split()) and len(shown.split()) <= 1.3 * len(licenses.TEMPLATES[name].split())
    assert sum(x["doc_id"] == len(want) + 1 and x["license"] == "mit-line" for x in rows) == 5
    assert not [x for x in rows if x["doc_id"] == len(want) or x["doc_id"] > len(want) + 1]
    assert licenses.license_matches(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.Index({"short": "two words"})


def test_license_lines_with_changed_words_and_whole_notices(spark):
    """Lines of the tables, a line without a common 3-word gram, pairs of words with one between, ends of notices."""
    r = random.Random(19)
    lines = {"Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0-short"}, "Licensed under CC BY 4.0.": {"cc-by-4.0-short"}, "Released under our MIT License.": {"mit-line"}, "Released under the MIT License.": {"mit-line"}, "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0-line"}}
    w = licenses.TEMPLATES["zlib"].split()
    texts = [f"{prose(r, 30)} {line}\n{prose(r, 30)}" for line in lines] + [" ".join(licenses.TEMPLATES["mit"].split()[:65])]
    texts += [" ".join(x if k % 4 else "changed" for k, x in enumerate(w)), f"Released under our MIT License. {prose(r, 9)} " * 3]
    rows = licenses.license_matches(table(spark, texts)).collect()
    for i, want in enumerate(lines.values()):
        assert {x["license"] for x in rows if x["doc_id"] == i} == want, texts[i]
    assert not [x for x in rows if x["doc_id"] == len(lines)]  # a notice's first part isn't the whole of it
    assert {x["license"] for x in rows if x["doc_id"] == len(lines) + 1} == {"zlib"}
    assert [x["license"] for x in rows if x["doc_id"] == len(lines) + 2] == ["mit-line"] * 3
    mit = licenses.license_matches(table(spark, [licenses.TEMPLATES["mit"]])).collect()
    assert [(x["license"], x["coverage"], x["end"]) for x in mit] == [("mit", 1.0, len(licenses.TEMPLATES["mit"]) - 1)]


def classifier_tables(spark, n=400):
    r = random.Random(10)
    texts, rows = [], []
    for k in range(n):
        toxic, good = k % 4 == 0, k % 3 != 0
        t = prose(r, r.randrange(20, 80))
        if toxic:
            t += " " + " ".join(r.choice(["grobnik", "velmarx", "idiot"]) + r.choice(["", "en", "s"]) for _ in range(4))
        if not good:
            t = " ".join(w + r.choice(["###", "$$$", "!!"]) for w in t.split())
        texts.append(t)
        rows.append((k, int(good), int(toxic)))
    texts += odd_texts()
    rows += [(n, None, None), (None, 1, 1), (n + 1, 1, 0)]
    return table(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), n


@pytest.mark.parametrize("model, label, cut", [(toxicity, "toxic", 0.5), (quality_model, "quality", 0.3)])
def test_classifiers_on_held_out_rows(spark, model, label, cut):
    docs, labels, n = classifier_tables(spark)
    df = clashing(docs)
    fitted = model.train(df, labels)
    got = {x["doc_id"]: x for x in labelled.scored(df, fitted, cut).collect()}
    truth = {x["doc_id"]: x[label] for x in labels.collect() if x["doc_id"] is not None and x["doc_id"] < n}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in truth)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= cut) for x in got.values())
    right = sum(got[i]["predicted"] == truth[i] for i in held) / len(held)
    assert right > 0.95
    assert labelled.scored(df.limit(0), fitted, cut).count() == 0
    none = model.train(df, labels.limit(0))
    assert labelled.scored(df, none, cut).count() == n + len(odd_texts())


def test_label_model_learns_voters():
    import numpy as np

    r = np.random.default_rng(0)
    y = r.random(3000) < 0.3
    right = [0.95, 0.9, 0.6, 0.8]
    v = np.stack([np.where(r.random(3000) < a, y, ~y) for a in right], 1)
    v = np.concatenate([v, v[:, 1:2], np.where(r.random(3000) < 0.98, y, ~y)[:, None]], 1)  # a copied voter, and the given label
    v = np.where(v, 1, 2)
    m = toxicity.LabelModel(v, np.where(v[:, -1] == 1, 0.9, 0.1))
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.97
    assert m.parent[4] == 1 or m.parent[1] == 4  # the copy depends on its source


def test_label_model_posteriors_by_enumeration():
    """The posterior of each row against both joint probabilities, written out; unlabelled rows have one too."""
    import numpy as np

    r = np.random.default_rng(2)
    y = r.random(500) < 0.4
    v = np.stack([np.where(r.random(500) < 0.2, 0, np.where(np.where(r.random(500) < a, y, ~y), 1, 2)) for a in (0.9, 0.8, 0.7)], 1)
    given = np.where(r.random(500) < 0.5, 0, np.where(y, 1, 2))
    v = np.concatenate([v, given[:, None]], 1)
    m = toxicity.LabelModel(v, np.where(given == 1, 0.9, np.where(given == 2, 0.1, 0.4)))
    for row, p in zip(v[:60], m.posterior(v)[:60]):
        joint = []
        for label, prior in ((0, 1 - m.prior), (1, m.prior)):
            for j, answer in enumerate(row):
                prior *= m.tables[j, label, row[m.parent[j]] if m.parent[j] >= 0 else 0, answer]
            joint.append(prior)
        assert np.isclose(p, joint[1] / sum(joint))
    assert ((m.posterior(v) > 0.5) == y)[given == 0].mean() > 0.85 and m.label_right.min() > 0.95


def test_toxicity_patterns():
    import pyarrow as pa

    found = toxicity.patterns_found(pa.array(["you are a stupid thing", "du bist ein Trottel", "tu es minable", "eres un idiota", "GO AWAY NOW RIGHT THIS minute", "what???", "f**k it", "a calm sentence about you", ""]))
    assert found.any(1).tolist() == [True] * 7 + [False] * 2
    assert toxicity.seeds_found(pa.array(["Idiot and basura", "none"])).tolist() == [[1, 1, 1, 1], [0, 0, 0, 0]]


def test_labelled_sample_is_not_emptied_by_a_long_text(spark):
    """A text of nearly all the bytes gives way to the others, whichever hash it has; one class alone is refused."""
    texts = [f"text {k} of some words" for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    held = {r.i for r in spark.range(300).select(F.col("id").alias("i"), labelled.held_out(F.col("id")).alias("h")).where("h").collect()}
    rest = [k for k in range(300) if k not in held]
    for k in rest[:5]:
        docs = table(spark, [*texts[:k], "x" * 9900, *texts[k + 1 :]])
        got, y = labelled.sample(docs, labels, "toxic", max_bytes=10_000)
        assert len(got) == len(y) == len(rest) - 1 and set(got.to_pylist()) == {texts[j] for j in rest if j != k} and set(y) == {0, 1}
    rare = spark.createDataFrame([(k, int(k == rest[0])) for k in range(300)], "doc_id long, toxic int")
    with pytest.raises(ValueError, match="one class"):
        labelled.sample(table(spark, [*texts[: rest[0]], "x" * 9900, *texts[rest[0] + 1 :]]), rare, "toxic", max_bytes=10_000)
    assert len(labelled.sample(docs.limit(0), labels, "toxic")[0]) == 0
