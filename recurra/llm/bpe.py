"""Byte-level BPE: encoding by merge ranks in numpy matrices, and decoding.

A text is cut by the pattern; pieces not seen before are encoded together. Pieces of like length are rows of one padded
matrix of token ids. Every round each row takes its leftmost pair of least rank (pair ranks come from a hash table
over id pairs), merges it and is compacted by one column; rows without a mergeable pair leave the matrix. Pieces
longer than LONG bytes, where such rounds would cost the square of the length, go through the same rule by a heap over
a linked list. Encoded pieces are remembered per Python worker up to a bounded number.

Every text is encoded by itself: no shuffle. The vocabulary (about 1 MB) is read on the driver and broadcast.

Defined results: null counts as empty text; empty text has no ids and decodes to no bytes; very long texts and pieces
are encoded whole; repeated rows are encoded each; an empty table gives an empty table; columns beside the id and text
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recurra.llm import textnum as tn
from recurra.llm.scratch import small_batches

NONE = np.int32(2**31 - 1)
LONG = 256
#: Cells of one matrix, and how many pieces of at most LONG bytes a worker remembers (about 70 MB).
CELLS, REMEMBERED = 1 << 19, 200_000
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PairTable:
    """Open-addressed hash table from pairs of ids to the id of their union; lookups are vectorised."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        self.shift, self.mask = np.uint64(64 - int(np.log2(size))), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):  # each turn, one key takes each free slot; the others move on
            s = (slot[todo] + self.probes) & self.mask
            free = np.flatnonzero(self.keys[s] == -1)
            _, firsts = np.unique(s[free], return_index=True)
            won = free[firsts]
            self.keys[s[won]], self.values[s[won]] = key[todo[won]], merged[todo[won]]
            todo = np.delete(todo, won)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        shape, key = key.shape, key.ravel()
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], NONE)
        miss = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for turn in range(1, self.probes):
            if not len(miss):
                break
            s = (slot[miss] + turn) & self.mask
            hit = self.keys[s] == key[miss]
            out[miss[hit]] = self.values[s[hit]]
            miss = miss[~hit & (self.keys[s] != -1)]
        return out.reshape(shape)


class Bpe:
    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens = tokens
        self.pieces = regex.compile(pattern).findall
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.byte_ids = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("a byte-level vocabulary needs every single byte")
        found = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        self.pairs = PairTable(*np.array(found or np.zeros((0, 3)), np.int64).T)
        self.seen: dict[str, tuple[str, int, bytes]] = {}
        self.long = False  # whether a long piece is among them

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of at most LONG bytes each, about equally long."""
        n, width = len(pieces), max(map(len, pieces))
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray] = [None] * n
        row = np.arange(n)
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), NONE, np.int32)
        while len(row):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            on = best != NONE
            for k in np.flatnonzero(~on):
                out[row[k]] = ids[k][ids[k] >= 0]
            row, ids, rank, at, best = row[on], ids[on], rank[on], at[on], best[on]
            if not len(row):
                break
            k = np.arange(len(row))
            ids[k, at] = best
            keep = np.ones(ids.shape, bool)
            keep[k, at + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            keep = np.ones(rank.shape, bool)
            keep[k, at] = False
            rank = rank[keep].reshape(len(row), -1)
            if rank.shape[1]:
                left = np.flatnonzero(at > 0)
                rank[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < rank.shape[1])
                rank[right, at[right]] = self.pairs.get(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same rule in n log n steps: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pairs.get(ids[:-1], ids[1:]).tolist()
        ids, n = ids.tolist(), len(piece)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = [*first, int(NONE)]
        heap = [(r, i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        none, tokens, get = int(NONE), self.tokens, self.ids.get
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], rank[j] = r, -1, none
            after[i] = k = after[j]
            rank[i] = none
            if k >= 0:
                before[k] = i
                rank[i] = get(tokens[r] + tokens[ids[k]], none)
                if rank[i] != none:
                    heapq.heappush(heap, (rank[i], i))
            if (h := before[i]) >= 0:
                rank[h] = get(tokens[ids[h]] + tokens[r], none)
                if rank[h] != none:
                    heapq.heappush(heap, (rank[h], h))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (i := self.ids.get(p)) is not None:  # a piece that is a token is that token
                out[k] = np.array([i], np.int32)
            elif len(p) > LONG:
                out[k] = self.merge_long(p)
            else:
                by.setdefault(next(b for b in BUCKETS if len(p) <= b), []).append(k)
        for width, at in by.items():
            step = max(1, CELLS // width)
            for i in range(0, len(at), step):
                for k, ids in zip(at[i : i + step], self.merge_rows([pieces[k] for k in at[i : i + step]])):
                    out[k] = ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def learn(self, texts: list[list[str]]) -> None:
        """Remembers what the pieces of these texts become."""
        if len(self.seen) > REMEMBERED or self.long:
            self.seen, self.long = {}, False
        new = list(set().union(*texts).difference(self.seen))
        raw = [p.encode() for p in new]
        for p, ids in zip(new, self.encode_pieces(raw)):
            ids = ids.tolist()
            self.seen[p] = (",".join(map(str, ids)), len(ids), self.decode(ids))
            self.long |= len(ids) > LONG

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, int, bytes]]:
        """Of each text: its ids in decimal joined by commas, their number, and the bytes that they decode to."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < 1 << 18):
                size += len(texts[j] or "")
                j += 1
            cut = [self.pieces(t or "") for t in texts[i:j]]
            self.learn(cut)
            seen = self.seen
            for pieces in cut:
                got = [seen[p] for p in pieces]
                yield ",".join([g[0] for g in got]), sum([g[1] for g in got]), b"".join([g[2] for g in got])
            i = j


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, row) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(path))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for b in batches:
            bpe = bpe or Bpe(shared.value, pattern)
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out = [row(*x) for x in bpe.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(x)) for x in zip(*out))], names)

    return docs.mapInArrow(tn.released(run), schema)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded binary: one row per row of docs."""
    own = _own(docs, id_col, text_col)
    return _mapped(own, path, pattern, f"doc_id {own.dtypes[0][1]}, n_tokens long, ids array<int>, decoded binary", lambda ids, n, raw: (n, np.fromstring(ids, np.int32, sep=","), raw))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same encoding and decoding, of which only digests leave the workers."""
    own = _own(docs, id_col, text_col)
    return _mapped(own, path, pattern, f"doc_id {own.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, n, raw: (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
