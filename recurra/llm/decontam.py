"""Benchmark decontamination by an FM-index over each training shard.

A shard is a block of whole texts of about SHARD bytes. Its words become symbols of the benchmark's vocabulary; stretches of other words
become one separator, since no test phrase holds them, and stretches shorter than the shortest phrase are left out,
since none fits. The shard's suffix array (prefix doubling) gives the Burrows-Wheeler transform, kept as a wavelet
tree of bit ranks, and every SAMPLE-th text position of the suffix array. All test phrases are searched backwards at
once; ranges that stay are located by walking to sampled positions, and their spans of words are merged per text.

Benchmark items are cut into pieces of at most PIECE_WORDS windows (so one long item is many pieces), different pieces
are dealt to blocks of about ITEM_BYTES bytes, and each block is broadcast by itself: about 20 times its bytes, checked
against BLOCK_MEMORY when built. So the benchmark may grow: every block is one more search of each shard, without a
shuffle, and a worker holds one block at a time.

Defined results: null texts and items have no words, so nothing is found; an item without words has no phrase; an
item without id is named by the empty string; repeated rows and items are each treated alike; an empty benchmark
leaves everything clean; columns beside text pass through `remove_spans` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import textnum as tn
from recurra.llm.scratch import small_batches

SAMPLE = 16
ITEM_BYTES, PIECE_WORDS, BLOCK_MEMORY = 1 << 20, 4096, 64 << 20
SHARD = 1 << 19


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, most significant bit first, each stably split by it."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[~bit], s[bit]])
        # places of symbols at the last level, where equal symbols stand together
        self.base = np.zeros(n_symbols, np.int64)
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        self.base[s[head]] = head

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place."""
        for k, ones in enumerate(self.ones):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            o = ones[at]
            at = np.where(one, self.zeros[k] + o, at - o)
        return at - self.base[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for k, ones in enumerate(self.ones):
            o = ones[at]
            bit = ones[at + 1] - o
            symbol = symbol << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + o, at - o)
        return symbol, at - self.base[symbol]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s, by prefix doubling over the places not yet told apart.

    Separators (0) count as smaller than every other symbol and among themselves by place, so no comparison passes one.
    """
    n = len(s)
    zero = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + n
    rank[zero] = np.arange(len(zero))
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        key = rank[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        rank[order] = first[group]  # the place of the group's first suffix: ranks of decided suffixes don't change
        size = np.diff(np.append(first, n))
        open_ = size[group] > 1
        if not open_.any():
            return order
        at = np.flatnonzero(open_)
        pos = order[at]
        follow = np.where(pos + width < n, rank[np.minimum(pos + width, n - 1)], -1)
        inner = np.lexsort((follow, rank[pos]))
        order[at] = pos[inner]
        fine = rank.copy()
        p, f = order[at], follow[inner]
        r = rank[p]
        step = np.ones(len(at), bool)
        step[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
        fine[p] = at[np.flatnonzero(step)][np.cumsum(step) - 1]
        rank = fine
        width *= 2


class FmIndex:
    def __init__(self, s: np.ndarray, n_symbols: int):
        """s: symbols below n_symbols; 0 separates, and ends s."""
        self.n = len(s)
        order = suffix_array(s)
        self.tree = WaveletTree(s[order - 1].astype(np.int64), n_symbols)
        count = np.bincount(s, minlength=n_symbols)
        self.before = np.concatenate([[0], np.cumsum(count)])
        self.sampled = (order % SAMPLE == 0) | (s[order - 1] == 0)  # separators are ordered by place, so no walk may pass one
        self.place = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.sampled, out=self.place[1:])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (rows, as long as `length` says)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        on = np.arange(len(phrases))
        for k in range(phrases.shape[1]):
            on = on[(length[on] > k) & (lo[on] < hi[on])]
            if not len(on):
                break
            c = phrases[on, length[on] - 1 - k].astype(np.int64)
            lo[on], hi[on] = self.before[c] + self.tree.rank(c, lo[on]), self.before[c] + self.tree.rank(c, hi[on])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking left until a sampled one."""
        out, steps, on = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(on):
            hit = self.sampled[row[on]]
            out[on[hit]] = self.samples[self.place[row[on[hit]]]] + steps
            on = on[~hit]
            c, r = self.tree.access_rank(row[on])
            row[on] = self.before[c] + r
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, over the vocabulary of their words."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, off = tn.buffers(pa.array(texts, pa.string()))
        w = tn.words(data[off[0] : off[-1]], off - off[0], tn.PUNCTUATION, lower=True)
        self.vocabulary, symbol = np.unique(w.hash, return_inverse=True)
        symbol = symbol.astype(np.int64) + 1
        count = w.counts()
        whole = np.flatnonzero((count > 0) & (count < window))
        at = np.flatnonzero(w.first[w.doc + 1] - np.arange(len(symbol)) >= window)
        start = np.concatenate([at, w.first[whole]])
        length = np.concatenate([np.full(len(at), window), count[whole]]).astype(np.int64)
        table = np.zeros((len(start), window), np.int32)
        for k in range(window):
            has = length > k
            table[has, k] = symbol[start[has] + k]
        self.table, phrase = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        phrase = phrase.ravel()
        self.length = (self.table > 0).sum(1)
        names, item = np.unique(np.array(ids, dtype=object).astype(str), return_inverse=True) if ids else (np.zeros(0, str), np.zeros(0, np.int64))
        pair = np.unique(np.stack([phrase, item.ravel()[np.concatenate([w.doc[at], whole])]], 1), axis=0) if len(phrase) else np.zeros((0, 2), np.int64)
        self.names = names.tolist()
        self.item, self.first_item = pair[:, 1].astype(np.int32), np.searchsorted(pair[:, 0], np.arange(len(self.table) + 1)).astype(np.int32)
        self.least = int(self.length.min()) if len(self.length) else 0
        bits = 18
        self.shift = np.uint64(64 - bits)
        slot = (self.vocabulary >> self.shift).astype(np.int64)
        self.slot_key, self.slot_id = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.slot_key[slot], self.slot_id[slot] = self.vocabulary, np.arange(1, len(slot) + 1)
        self.crowded = np.bincount(slot, minlength=1 << bits) > 1

    def size(self) -> int:
        """Bytes of the arrays and names."""
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + sum(map(len, self.names))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for a word that no item holds."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = np.where(self.slot_key[slot] == hashes, self.slot_id[slot], 0)
        rest = np.flatnonzero(self.crowded[slot] & (out == 0))
        if len(rest):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[rest]), len(self.vocabulary) - 1)
            out[rest] = np.where(self.vocabulary[at] == hashes[rest], at + 1, 0)
        return out

    def occurrences(self, w: tn.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence in the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.table) or not len(w.hash):
            return none, none
        symbol = self.symbols(w.hash)
        inside = symbol > 0
        a, z = inside.copy(), inside.copy()
        edge = np.concatenate([[True], w.doc[1:] != w.doc[:-1]])
        a[1:] &= ~inside[:-1] | edge[1:]
        z[:-1] &= ~inside[1:] | edge[1:]
        start, end = np.flatnonzero(a), np.flatnonzero(z) + 1
        long = end - start >= self.least
        start, size = start[long], (end - start)[long]
        if not len(start):
            return none, none
        put = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        at = np.arange(int((size + 1).sum()))
        run = np.repeat(np.arange(len(size)), size + 1)
        word = start[run] + at - put[run]
        last = at - put[run] == size[run]
        s = np.where(last, 0, symbol[np.minimum(word, len(symbol) - 1)])
        index = FmIndex(s, len(self.vocabulary) + 1)
        lo, hi = index.search(self.table, self.length)
        n = np.maximum(hi - lo, 0)
        phrase = np.repeat(np.arange(len(n)), n)
        row = np.repeat(lo, n) + np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        return word[index.locate(row)], phrase


def find(data: np.ndarray, off: np.ndarray, phrases: Phrases) -> tuple[tn.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the shard, which are hit, and the different pairs (text, item)."""
    w = tn.words(data, off, tn.PUNCTUATION, lower=True)
    word, phrase = phrases.occurrences(w)
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, word, 1)
    np.subtract.at(step, word + phrases.length[phrase], 1)
    pair = np.unique(w.doc[word].astype(np.int64) * max(len(phrases.table), 1) + phrase)
    doc, phrase = np.divmod(pair, max(len(phrases.table), 1))
    n = phrases.first_item[phrase + 1] - phrases.first_item[phrase]
    item = phrases.item[np.repeat(phrases.first_item[phrase], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    found = np.unique(np.repeat(doc, n) * max(len(phrases.names), 1) + item)
    return w, np.cumsum(step[:-1]) > 0, *np.divmod(found, max(len(phrases.names), 1))


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """Broadcast Phrases, one for each block of pieces of items of about ITEM_BYTES."""
    spark = benchmark.sparkSession
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = F.translate(benchmark[text_col].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("i"), F.regexp_extract_all(low, F.lit(word), F.lit(0)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)), F.lit(PIECE_WORDS))
    pieces = items.select("i", "w", F.explode(starts).alias("at")).select("i", F.array_join(F.slice("w", F.col("at"), F.lit(PIECE_WORDS + window - 1)), " ").alias("t")).distinct()
    size = pieces.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    n = max(1, -(-size // ITEM_BYTES))
    out = []
    for k in range(n):
        rows = pieces.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        built = Phrases([r[0] for r in rows], [r[1] for r in rows], window)
        if built.size() > BLOCK_MEMORY:
            raise ValueError(f"a block of benchmark items takes {built.size()} bytes; at most {BLOCK_MEMORY} are broadcast: make ITEM_BYTES smaller")
        out.append(spark.sparkContext.broadcast(built))
    return out


def _cover(data: pa.Array, phrases: list) -> Iterator[tuple[int, int, np.ndarray, tn.Words, np.ndarray, list[list[str]]]]:
    """Of each shard: its rows and bytes, its words, which are hit by any block, and the items of each text."""
    for i, j, raw, off in tn.blocks(data, SHARD):
        hit, items, w = None, [[] for _ in range(j - i)], None
        for p in phrases:
            w, h, doc, item = find(raw, off, p.value)
            hit = h if hit is None else hit | h
            names = p.value.names
            for d, k in zip(doc.tolist(), item.tolist()):
                items[d].append(names[k])
            if len(phrases) > 2:  # Spark has no public way to let go of a value in a worker; without this one it would hold all blocks
                p.__dict__.pop("_value", None)
        yield i, j, off, w, hit, items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), spans (merged hit spans in bytes): one row per row of docs."""
    small_batches(docs.sparkSession)
    phrases = _item_blocks(benchmark, item_id, item_text, window)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = f"doc_id {own.dtypes[0][1]}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, w, hit, items in _cover(b.column(1), phrases):
                names = [sorted(set(x)) for x in items]
                start, end, first = spans(w, hit, off)
                pieces = pa.StructArray.from_arrays([pa.array((start - off[_owner(start, off)]).astype(np.int32)), pa.array((end - off[_owner(start, off)]).astype(np.int32))], ["start", "end"])
                c = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(w.counts()), pa.array(c[w.first[1:]] - c[w.first[:-1]]), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pieces)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"],
                )

    return own.mapInArrow(tn.released(search), schema)


def _owner(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, start, "right") - 1


def spans(w: tn.Words, hit: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the runs of hit words, and where each text's begin."""
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.concatenate([[True], w.doc[1:] != w.doc[:-1]])
    a, z = hit.copy(), hit.copy()
    a[1:] &= ~hit[:-1] | edge[1:]
    z[:-1] &= ~hit[1:] | edge[1:]
    start, end = w.start[a], w.end[z]
    return start, end, np.searchsorted(start, off)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the merged spans cut out of their texts, each leaving a line break, and `chars_col` recounted there."""
    small_batches(docs.sparkSession)
    phrases = _item_blocks(benchmark, item_id, item_text, window)
    names = docs.columns
    at, count = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, w, hit, _ in _cover(b.column(at), phrases):
                part = b.slice(i, j - i)
                start, end, first = spans(w, hit, off)
                rows = np.flatnonzero(np.diff(first))
                if len(rows):
                    texts = part.column(at).to_pylist()
                    for k in rows:
                        raw, out, done = texts[k].encode(), [], 0
                        for x, y in zip(start[first[k] : first[k + 1]] - off[k], end[first[k] : first[k + 1]] - off[k]):
                            out.append(raw[done:x])
                            done = y
                        texts[k] = b"\n".join([*out, raw[done:]]).decode()
                    columns = list(part.columns)
                    columns[at] = pa.array(texts, part.column(at).type)
                    if count is not None:
                        kept = part.column(count).to_pylist()
                        columns[count] = pa.array([len(texts[k]) if k in set(rows.tolist()) else kept[k] for k in range(j - i)], part.column(count).type)
                    part = pa.RecordBatch.from_arrays(columns, names)
                yield part

    return docs.mapInArrow(tn.released(clean), docs.schema)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
occ AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.l = bw.l),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i + unnest(range(l)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
       FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
