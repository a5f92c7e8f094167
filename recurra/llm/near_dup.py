"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification, components.

1. Each text becomes its set of word shingles (64-bit hashes), a signature of BANDS * ROWS minima, one key per band,
   and two sums over the set that stand for the set. Rows of equal sets are one class from then on (its
   representative is the smallest id), so exact copies cost one pre-aggregated exchange however many they are.
2. Representatives that share a band key are candidates. No bucket emits all its pairs: a round compares one pivot
   per bucket with the members outside the pivot's component. Signatures are compared in batches; after each batch a
   pair is dropped if the posterior chance (uniform prior) that its similarity reaches the threshold, given the
   matches so far, is below MISS. What survives is verified on the full shingle sets, and links update components.
3. Pivot rounds go on while they merge many components. What then remains are band buckets whose members lie in several
   components, many of texts that share a passage but not enough of it. A set reaches the threshold with another only
   if that share of its shingles is found elsewhere. A quarter of the shingles, by hash, counts how many are, one row
   each and no pairs; members for which the chance of such a count is below MISS (Chernoff's bound) are dropped.
4. Buckets that still hold several components (chains of links, texts just below the threshold) are compared in cells
   bounded in rows and in shingles: every member outside the bucket's largest component with all the others, signatures
   first, then the full sets of those with a survivor. A pair is compared in the last of the bands that it shares
   alone. No pair leaves its cell; of a member's links to one component in a cell one leaves.

The chance to lose a pair at the threshold itself is (1 - 0.8**ROWS)**BANDS = 5e-8 in banding, MISS in pruning, and
2 * MISS in the third step (for either text).

Defined results: a null or wordless text has no shingles, links with nothing and is its own component; fewer words
than a shingle has make one shingle of them all; a row with a null id takes no part (component null, kept); rows that
share an id are one vertex with several texts; ids may be of any type that has an order; an empty table gives an empty
table; other columns are never read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import textnum as tn
from recurra.llm.components import components
from recurra.llm.scratch import Scratch, small_batches, tasks

BANDS, ROWS = 32, 4
N_HASHES = BANDS * ROWS
MISS = 1e-6
BATCH = 16
_rng = np.random.Generator(np.random.PCG64(7))
MULTIPLY = _rng.integers(0, 2**31, N_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 2**32, N_HASHES, dtype=np.uint32)
#: Rows of a cell of the residual grid (members compared, and members that they are compared with), and shingles of either.
GRID_SMALL, GRID_ALL, GRID_SHINGLES = 256, 1024, 1 << 19
#: Bits of the largest Bloom filter (8 MB); more ids than an eighth of it go without one.
BLOOM_BITS = 1 << 26
#: One shingle of so many counts what a text shares.
SHARE = 4
#: Ids of dropped documents, and their bytes as text, that are broadcast to take them out (a hash table of about 100 MB).
GONE_IDS, GONE_BYTES = 1 << 21, 1 << 25


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, in order, and n_texts + 1 offsets into them; repeats are kept."""
    w = tn.words(data, off, tn.BLANKS, lower=True)
    h, ok = tn.ngrams(w, n)
    count = w.counts()
    short = np.flatnonzero((count > 0) & (count < n))
    acc = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        has = count[short] > k
        acc[has] += w.hash[w.first[short[has]] + k] * np.uint64(2 * k + 3)
    at = w.first[short]
    h[at] = tn.mix(acc + count[short].astype(np.uint64))
    ok[at] = True
    first = np.zeros(len(off), np.int64)
    np.cumsum(np.where(count < n, np.minimum(count, 1), count - n + 1), out=first[1:])
    return h[ok], first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True at one place of each different shingle of a text."""
    n = len(first) - 1
    key = h ^ tn.mix(np.repeat(np.arange(1, n + 1, dtype=np.uint64), np.diff(first)))
    order = np.argsort(key)
    new = np.ones(len(h), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[new]] = True
    return out


def signature(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima per text under N_HASHES functions; texts without shingles have the greatest value everywhere."""
    out = np.full((len(first) - 1, N_HASHES), 2**32 - 1, np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        x, at = (h >> np.uint64(32)).astype(np.uint32), first[:-1][some]
        y = np.empty_like(x)
        for k in range(N_HASHES):
            np.multiply(x, MULTIPLY[k], out=y)
            y += ADD[k]
            out[some, k] = np.minimum.reduceat(y, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    acc = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        acc = tn.mix(acc * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return tn.mix(acc + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


SIGNATURE = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text) with sizes, set sums, signatures and band keys."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tn.blocks(b.column(1)):
                h, first = shingles(data, off, shingle)
                one = distinct(h, first)
                sig = signature(h, first)
                n = _sums(one.astype(np.uint64), first).view(np.int64)
                keys = band_keys(sig)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * N_HASHES), j - i, [None, pa.py_buffer(np.ascontiguousarray(sig))])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                sums = [pa.array(_sums(tn.mix(h ^ np.uint64(c)) * one, first).view(np.int64)) for c in (0x1234567, 0x89ABCDEF01)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), *sums, fixed.cast(pa.binary()), bands], [x.split()[0] for x in SIGNATURE.split(", ")])

    return docs.mapInArrow(tn.released(make), SIGNATURE)


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """By number of compared minima: the fewest matches with which P(similarity >= threshold) is still >= miss.

    With a uniform prior and m matches of n the posterior is Beta(m + 1, n - m + 1), whose upper tail at t equals
    P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(BATCH, N_HASHES + 1, BATCH):
        log = [math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) + i * math.log(threshold) + (n + 1 - i) * math.log(1 - threshold) for i in range(n + 2)]
        tail, m = 0.0, 0
        while m <= n and (tail := tail + math.exp(log[m])) < miss:
            m += 1
        out[n] = m
    return out


def surviving(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs of signatures (rows of left and right) outlive the batches."""
    at, got, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, m in least.items():
        got = got + (left[at, done:n] == right[at, done:n]).sum(1, dtype=np.int32)
        ok = got >= m
        at, got, done = at[ok], got[ok], n
    return at


def _matrix(column: pa.Array) -> np.ndarray:
    data = column.cast(pa.large_binary())
    _, offs, buf = data.buffers()
    off = np.frombuffer(offs, np.int64, len(data) + 1, data.offset * 8)
    return np.frombuffer(buf, np.uint8)[off[0] : off[-1]].view(np.uint32).reshape(len(data), N_HASHES)


def _bits(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = tn.mix(ids.astype(np.int64).view(np.uint64))
    at = np.concatenate([h % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)]).astype(np.int64)
    return at >> 6, at & 63


@contextmanager
def only(docs: DataFrame, ids: DataFrame, at_most: int) -> Iterator[DataFrame]:
    """docs(doc_id, ...) without most rows that are not among ids(doc_id), of which there are `at_most`: a Bloom filter of 16 bits an id, so that few texts or signatures reach the next exchange. What it lets through besides is left to that join, and so is all where the filter would outgrow BLOOM_BITS. The filter lives as long as the context: run what reads the texts inside."""
    size = 1 << max(16, (16 * at_most).bit_length())
    if size > BLOOM_BITS:
        size = BLOOM_BITS
        if 8 * at_most > size:
            yield docs
            return

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, bit = _bits(b.column(0).to_numpy(zero_copy_only=False), size)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << bit.astype(np.uint64)).view(np.int64))], ["word", "bits"])

    found = ids.distinct().mapInArrow(tn.released(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most BLOOM_BITS / 64 rows
    table = np.zeros(size // 64, np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                word, bit = _bits(b.column(0).to_numpy(zero_copy_only=False), size)
                hit = ((shared.value[word] >> bit.astype(np.uint64)) & np.uint64(1)).astype(bool).reshape(2, -1).all(0)
                yield b.filter(pa.array(hit))

    try:
        yield docs.where("doc_id is not null").mapInArrow(tn.released(keep), docs.schema)
    finally:
        shared.destroy()


def prune(pairs: DataFrame, base: DataFrame, least: dict[int, int], scratch: Scratch) -> DataFrame:
    """The pairs(p, u), a written table, whose signatures outlive the batches."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = pa.array(surviving(_matrix(b.column(2)), _matrix(b.column(3)), least))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["p", "u"])

    ids = pairs.select(F.col("p").alias("doc_id")).unionByName(pairs.select(F.col("u").alias("doc_id")))
    with only(base.select("doc_id", "sig"), ids, 2 * pairs.count()) as sig:
        both = pairs.join(sig.withColumnsRenamed({"doc_id": "p", "sig": "sp"}), "p").join(sig.withColumnsRenamed({"doc_id": "u", "sig": "su"}), "u").select("p", "u", "sp", "su")
        return scratch.save(both.mapInArrow(tn.released(keep), "p long, u long"))


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, threshold: float, scratch: Scratch) -> DataFrame:
    """links(a, b): the pairs(p, u) whose full shingle sets reach the threshold. pairs is a written table.

    A pivot's text meets its partners' in groups of about 64: a pivot of very many partners is sent to as many groups.
    """
    spark = docs.sparkSession
    groups = pairs.groupBy("p").agg(F.ceil(F.count("*") / 64).alias("k"))
    pu = pairs.join(groups, "p").select("p", F.pmod(F.xxhash64("u"), "k").alias("s"), "u")
    percent = round(threshold * 100)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, owns = None, []  # rows that share the pivot's id may have different texts
        for b in batches:
            key = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            role, u = b.column(2).to_pylist(), b.column(3).to_pylist()
            links: list[tuple[int, int]] = []
            for i, j, data, off in tn.blocks(b.column(4)):
                h, first = shingles(data, off, shingle)
                for k in range(i, j):
                    mine = np.unique(h[first[k - i] : first[k - i + 1]])
                    if role[k] == 0:
                        if key[k] != head:
                            head, owns = key[k], []
                        if not any(np.array_equal(own, mine) for own in owns):
                            owns.append(mine)
                    elif key[k] == head:
                        for own in owns:
                            lo, hi = sorted((len(own), len(mine)))
                            if 100 * lo >= percent * hi:
                                both = np.concatenate([own, mine])
                                both.sort()
                                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                                if 100 * inter >= percent * (len(both) - inter):
                                    links.append((head[0], u[k]))
                                    break
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    with only(docs, pairs.select(F.col("p").alias("doc_id")).unionByName(pairs.select(F.col("u").alias("doc_id"))), 2 * pairs.count()) as texts:
        mine = pu.join(texts.withColumnRenamed("doc_id", "u"), "u").select("p", "s", F.lit(1).alias("role"), "u", "text")
        heads = pu.select("p", "s").distinct().join(texts.withColumnRenamed("doc_id", "p"), "p").select("p", "s", F.lit(0).alias("role"), F.col("p").alias("u"), "text")
        rows = heads.unionByName(mine).repartition(tasks(spark), "p", "s").sortWithinPartitions("p", "s", "role")
        return scratch.save(rows.mapInArrow(tn.released(check), "a long, b long"))


def possible(docs: DataFrame, members: DataFrame, shingle: int, threshold: float, miss: float, scratch: Scratch) -> DataFrame:
    """Of members(doc_id), a written table, those that may have a partner among them: sets of n shingles reach the threshold only with one that holds that share of them.

    Of a text's m shingles in the sample, k are another member's too. The text goes where m * D(k / m, threshold) exceeds
    log(1 / miss) below the threshold (D: Kullback-Leibler divergence), which bounds the chance of so few.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tn.blocks(b.column(1)):
                h, first = shingles(data, off, shingle)
                one = distinct(h, first)
                whole = pa.array(_sums(tn.mix(h) * one, first).view(np.int64))
                one &= h % np.uint64(SHARE) == 0
                at = np.concatenate([[0], np.cumsum(_sums(one.astype(np.uint64), first))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), whole, pa.ListArray.from_arrays(pa.array(at), pa.array(h[one].view(np.int64)))], ["doc_id", "whole", "keys"])

    with only(docs, members, members.count()) as texts:
        own = scratch.save(texts.join(members, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tn.released(sets), "doc_id long, whole long, keys array<long>"))
    rows = own.select("doc_id", "whole", F.explode("keys").alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    shared = rows.join(often, "key").groupBy("doc_id", "whole").agg(F.count("*").alias("k"))  # repeated rows count more than once, so more stay, never fewer
    q, t = F.greatest(F.col("k") / F.col("m"), F.lit(1e-9)), threshold
    far = q * F.log(q / t) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - t))).otherwise(0.0)
    counted = own.select("doc_id", "whole", F.size("keys").alias("m")).join(shared, ["doc_id", "whole"], "left").select("doc_id", "m", F.coalesce("k", F.lit(0)).alias("k"))
    out = scratch.save(counted.where((F.col("m") == 0) | (q >= t) | (F.col("m") * far <= -math.log(miss))).select("doc_id").distinct())
    scratch.drop(own)
    return out


def _standing(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (key, doc_id, c) of the buckets that lie in several components, with the largest, `big`, and its size."""
    at = buckets.join(comp.withColumnsRenamed({"v": "doc_id"}), "doc_id", "left").select("key", "doc_id", F.coalesce("c", "doc_id").alias("c"))
    per = at.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("nc"), F.max_by("c", F.struct("m", "c")).alias("big"), F.sum("m").alias("n"), F.max("m").alias("n_big")).where("nc > 1")
    return at.join(per, "key")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The tables of rows with equal first n_keys columns; such rows follow one another."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for n in range(n_keys):
            k = b.column(n).to_numpy()
            change |= k[1:] != k[:-1]
        edge = np.flatnonzero(change) + 1
        if kept and any(kept[-1].column(n)[-1].as_py() != b.column(n)[0].as_py() for n in range(n_keys)):
            yield pa.Table.from_batches(kept)
            kept = []
        for i, j in zip([0, *edge[:-1]], edge):
            yield pa.Table.from_batches([*kept, b.slice(i, j - i)])
            kept = []
        kept.append(b.slice(edge[-1] if len(edge) else 0))
    if kept:
        yield pa.Table.from_batches(kept)


def residual_links(standing: DataFrame, base: DataFrame, docs: DataFrame, least: dict[int, int], shingle: int, threshold: float, scratch: Scratch) -> DataFrame:
    """links(a, b) between components, for every member outside its bucket's largest component against all others.

    Cells of at most about GRID_SMALL by GRID_ALL members and GRID_SHINGLES shingles first compare signatures; members
    with a surviving partner stay. Their texts then meet in the same cells, where full sets are compared: pairs never
    leave a cell, links do, one for a member and a component.
    """
    spark = base.sparkSession
    weight = standing.join(base.groupBy("doc_id").agg(F.sum("n_shingles").alias("w")), "doc_id").groupBy("key").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("c") != F.col("big"), F.col("w"))).alias("w_out"))
    n_small = F.greatest(F.ceil((F.col("n") - F.col("n_big")) / GRID_SMALL), F.ceil(F.col("w_out") / GRID_SHINGLES))
    n_all = F.greatest(F.ceil(F.col("n") / GRID_ALL), F.ceil(F.col("w") / GRID_SHINGLES))
    rows = standing.join(weight, "key").withColumns({"ns": n_small, "na": n_all, "x": F.xxhash64("doc_id")})
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    small = rows.where("c <> big").select("key", F.pmod("x", "ns").alias("i"), cells("na").alias("j"), F.lit(0).alias("role"), "doc_id", "c")
    every = rows.select("key", cells("ns").alias("i"), F.pmod(F.hash("x"), "na").cast("long").alias("j"), F.lit(1).alias("role"), "doc_id", "c")
    percent = round(threshold * 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            role, c, sig = t.column("role").to_numpy(), t.column("c").to_numpy(), _matrix(t.column("sig").combine_chunks())
            theirs, live = np.flatnonzero(role == 1), np.zeros(len(role), bool)
            bands = band_keys(sig)
            later = bands[:, np.flatnonzero(bands[0] == t.column("key")[0].as_py())[0] + 1 :]
            for k in np.flatnonzero(role == 0):
                other = theirs[(c[theirs] != c[k]) & ~(later[theirs] == later[k]).any(1)]  # a pair that shares a later band meets there
                at = other[surviving(np.broadcast_to(sig[k], (len(other), N_HASHES)), sig[other], least)]
                live[at] = True
                live[k] |= len(at) > 0
            if live.any():
                yield from t.drop_columns("sig").filter(pa.array(live)).combine_chunks().to_batches()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            role, ids, c = (t.column(k).to_numpy() for k in ("role", "doc_id", "c"))
            sets = []
            for _, _, data, off in tn.blocks(t.column("text").combine_chunks()):
                h, first = shingles(data, off, shingle)
                sets += [np.unique(h[x:y]) for x, y in zip(first[:-1], first[1:])]
            theirs = np.flatnonzero(role == 1)
            if not len(theirs) or len(theirs) == len(role):
                continue
            own, place = np.unique(np.concatenate([sets[k] for k in theirs]), return_inverse=True)
            size = np.array([len(sets[k]) for k in theirs])
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            mark, a, b = np.zeros(len(own) + 1, np.int32), [], []
            for k in np.flatnonzero(role == 0):
                at = np.searchsorted(own, sets[k])
                at = at[own[np.minimum(at, len(own) - 1)] == sets[k]]
                mark[at] = 1
                inter = np.add.reduceat(mark[place], first)
                mark[at] = 0
                ok = theirs[(c[theirs] != c[k]) & (100 * inter >= percent * (size + len(sets[k]) - inter)) & (size > 0)]
                ok = ok[np.unique(c[ok], return_index=True)[1]]
                a += [int(ids[k])] * len(ok)
                b += ids[ok].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    with only(base.select("doc_id", "sig"), standing.select("doc_id"), standing.count()) as sig:
        members = small.unionByName(every).join(sig, "doc_id").select("key", "i", "j", "role", "doc_id", "c", "sig")
        live = scratch.save(dealt(members).mapInArrow(tn.released(compare), "key long, i long, j long, role int, doc_id long, c long"))
    with only(docs, live.select("doc_id"), live.count()) as texts:
        links = scratch.save(dealt(live.join(texts, "doc_id").select("key", "i", "j", "role", "doc_id", "c", "text")).mapInArrow(tn.released(check), "a long, b long"))
    scratch.drop(live)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs: classes of the transitive links of similarity >= threshold."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    least = least_matches(threshold, miss)
    given, number = docs, docs.select(id_col).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    vertex = docs[id_col].cast("long") if number else F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col]))
    docs = docs.select(vertex.alias("doc_id"), docs[text_col].cast("string").alias("text"))
    base = scratch.save(signatures(docs, shingle))
    known = base.where("doc_id is not null and n_shingles > 0")
    sets = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = scratch.save(known.select("doc_id", "k1", "k2").join(sets, ["k1", "k2"]).select("doc_id", "rep").distinct())

    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    rows = known.select("doc_id", "bands").join(reps, "doc_id").select("doc_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("p"), F.count("*").alias("n")).where("n > 1")
    bands = scratch.save(rows.join(shared, "key").where("doc_id <> p or n > 2"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Prunes and verifies pairs(p, u)."""
        pairs = scratch.save(pairs)
        left = prune(pairs, base, least, scratch)
        links = verify(left, docs, shingle, threshold, scratch)
        scratch.drop(pairs, left)
        return links

    def rounds(buckets: DataFrame, links: DataFrame, comp: DataFrame) -> tuple[DataFrame | None, DataFrame, DataFrame]:
        """Pivot rounds while they help: the members that still stand in several components of a bucket, if any, links and components."""
        spread = None
        for turn in itertools.count(1):
            standing = scratch.save(_standing(buckets, comp))
            now = standing.where("c <> big").count()
            if not now:
                scratch.drop(standing)
                return None, links, comp
            if spread is not None and now > 0.8 * spread:
                return standing, links, comp
            # another pivot for each bucket, from its largest component
            pivot = standing.where("c = big").groupBy("key").agg(F.min_by("doc_id", F.xxhash64(F.lit(turn), "doc_id")).alias("p"))
            pairs = standing.where("c <> big").join(pivot, "key").select(F.least("p", "doc_id").alias("p"), F.greatest("p", "doc_id").alias("u")).distinct()
            links = links.unionByName(linked(pairs))
            scratch.drop(standing, comp)
            comp, spread = components(links, scratch), now

    links = linked(bands.where("doc_id <> p").select("p", F.col("doc_id").alias("u")).distinct())
    comp = components(links, scratch)
    buckets = bands.where("n > 2 and doc_id <> p").select("key", "doc_id")
    standing, links, comp = rounds(buckets, links, comp)
    if standing is not None:
        left = scratch.save(standing.select("doc_id").distinct())
        scratch.drop(standing)
        standing = scratch.save(_standing(buckets.join(possible(docs, left, shingle, threshold, miss, scratch), "doc_id", "left_semi"), comp))
        comp = components(links.unionByName(residual_links(standing, base, docs, least, shingle, threshold, scratch)), scratch)

    own = members.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("doc_id", F.coalesce("c", "rep").alias("component"))
    own = own.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = base.select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    if not number:  # vertices are hashes of ids: back to the ids, and to the smallest of each class
        ids = given.select(vertex.alias("v"), given[id_col].alias("id")).where("v is not null").distinct()
        least_id = out.select("doc_id", "component_id").distinct().join(ids, F.col("doc_id") == F.col("v")).groupBy("component_id").agg(F.min("id").alias("least_id"))
        out = out.join(least_id, "component_id", "left").join(ids, F.col("doc_id") == F.col("v"), "left").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least_id").alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    scratch.drop_all_but(out)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns; rows that share such an id all stay.

    Up to GONE_IDS dropped ids are broadcast, so that no text moves; beyond that the join deals all rows by id.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select("doc_id").distinct()
    n, size = gone.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("doc_id").cast("string"))), F.lit(0))).first()
    if n <= GONE_IDS and size <= GONE_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a AS v, b AS c FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.c = l.a),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id, w.doc_id <= coalesce(c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON v = w.doc_id
"""
