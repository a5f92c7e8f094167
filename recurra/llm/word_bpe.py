"""BPE of words with end marks: segment trees over the ranks of adjacent pairs, and decoding.

A text is cut at the vocabulary's special tokens; what lies between is brought to NFC, lowered and cut into words, and
the bytes of a word, the last one with the end mark, are its first symbols. A segment tree over the word's places holds
for each symbol the rank of its pair with the next one, so its root names the least rank and, of equal ones, the leftmost
place. A merge changes three leaves (the merged symbol, the one that went, the one before), and each leaf's way to the
root is computed anew; it ends when the root holds no pair. The trees of many words of like length are rows of one numpy
matrix and take a merge each a turn; a word of more than WIDE bytes has a tree of its own.

Every text is encoded by itself: no shuffle. The vocabulary (about 3 MB) is read on the driver and broadcast. A worker
remembers encoded words up to a bounded number of bytes, the older half going first.

Code points that Python's table of Unicode lacks (those of the last years) are symbols here and keep their case.

Defined results: null counts as empty text; empty text has no ids and decodes to the empty text; bytes that the vocabulary
lacks have no symbol; very long texts and words are encoded whole; repeated rows are encoded each; an empty table gives an
empty table; columns beside the id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recurra.llm import textnum as tn
from recurra.llm.bpe import NONE, PairTable
from recurra.llm.scratch import small_batches

#: No pair at a place; more than any rank with its place.
NO_PAIR = np.int64(2**62)
#: Bytes of a word up to which trees are rows of a matrix, and numbers of such a matrix at most.
WIDE, CELLS = 512, 1 << 20
#: Characters of texts taken together, and bytes of the words that a worker remembers (each of two halves).
PORTION, REMEMBERED = 1 << 19, 24 << 20


@dataclass
class Vocabulary:
    tokens: list[str]  # by id
    special: dict[str, int]
    first: np.ndarray  # ids of the bytes, -1 where there is none
    last: np.ndarray  # of the bytes with the end mark
    merges: np.ndarray  # (left, right, merged) by rank


def byte_names() -> list[str]:
    """The character that stands for each byte in token names: itself if it is printable, the others from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, special = whole["model"], {t["content"]: t["id"] for t in whole["added_tokens"]}
    ids = model["vocab"] | special
    tokens = [""] * (1 + max(ids.values()))
    for token, i in ids.items():
        tokens[i] = token
    end = model["end_of_word_suffix"] or ""
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs] or np.zeros((0, 3)), np.int64)
    byte = lambda mark: np.array([model["vocab"].get(c + mark, -1) for c in byte_names()], np.int64)
    return Vocabulary(tokens, special, byte(""), byte(end), merges)


def word_finder() -> Callable[[str], list[str]]:
    """Words of lowered text: contractions, runs of letters, single digits, runs of other symbols. Code points that Python's own table of Unicode doesn't know yet count as symbols, whatever the pattern library knows of them."""
    import regex

    new = {c for c in regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)) if unicodedata.category(c) == "Cn"}
    quick = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
    letters, digits = _ranges("L"), _ranges("N")
    exact = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+").findall
    return lambda text: quick(text) if text.isascii() or new.isdisjoint(text) else exact(text)


def _ranges(kind: str) -> str:
    """The inside of a character class: code points whose category begins so."""
    on = [unicodedata.category(chr(c)).startswith(kind) for c in range(0x110000)] + [False]
    edges = [c for c in range(0x110001) if on[c] != (c > 0 and on[c - 1])]
    return "".join(f"\\U{a:08x}-\\U{z - 1:08x}" for a, z in zip(edges[::2], edges[1::2]))


def normal(text: str) -> str:
    """NFC, then each character lowered by itself (the capital sigma has one lower form)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordBpe:
    def __init__(self, v: Vocabulary):
        import regex

        self.v = v
        self.words = word_finder()
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.table = PairTable(v.merges[:, 0], v.merges[:, 1], np.arange(len(v.merges)))
        self.ranks = {(int(a), int(b)): r for r, (a, b, _) in enumerate(v.merges.tolist())}
        self.merged = v.merges[:, 2].copy()
        self.seen: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.held = 0

    # ---- words

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of the words, one after the other, and n + 1 offsets."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        off = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=off[1:])
        ids = self.v.first[raw]
        ids[off[1:] - 1] = self.v.last[raw[off[1:] - 1]]
        known = ids >= 0
        return ids[known], np.concatenate([[0], np.cumsum(known)])[off]

    def merge_wide(self, ids: list[int]) -> list[int]:
        """One word by one tree: its leaves are rank * n + place, a node is the less of its two children."""
        n = len(ids)
        size = 1 << max(1, (n - 1).bit_length())
        none, ranks, merged = int(NO_PAIR), self.ranks, self.merged
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := ranks.get((ids[i], ids[i + 1]))) is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                less = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == less:
                    break
                tree[k] = less

        while (root := tree[1]) != none:
            rank, i = divmod(root, size)
            j = after[i]
            ids[i], ids[j] = int(merged[rank]), -1
            after[i] = k = after[j]
            put(j, none)
            r = None
            if k >= 0:
                before[k] = i
                r = ranks.get((ids[i], ids[k]))
            put(i, none if r is None else r * size + i)
            if (h := before[i]) >= 0:
                r = ranks.get((ids[h], ids[i]))
                put(h, none if r is None else r * size + h)
        return [i for i in ids if i >= 0]

    def merge_rows(self, flat: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
        """Words of 2 to size symbols (one after the other in flat), a tree a row: node k of a row at column k, leaves from column `size` on. Their ids, a word a row, with -1 between."""
        n = len(length)
        ids = np.full((n, size + 1), -1, np.int64)  # the last column stands for no neighbour
        ids[:, :size][np.arange(size) < length[:, None]] = flat
        place = np.arange(size)
        after = np.where(place + 1 < length[:, None], place + 1, size)
        after = np.hstack([after, np.full((n, 1), size)])
        before = np.broadcast_to(np.concatenate([[size], place]), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), NO_PAIR, np.int64)
        r = self.table.get(ids[:, : size - 1], ids[:, 1:size])
        at = np.nonzero(r != NONE)
        tree[at[0], size + at[1]] = r[at].astype(np.int64) * size + at[1]
        k = size
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        row = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while len(row):
            root = tree[row, 1]
            rank, i = root // size, root % size
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            ids[row, i], ids[row, j] = self.merged[rank], -1
            after[row, i] = k
            before[row, k] = i
            # three leaves: h with i, i with k, and j that went; a missing neighbour is column `size`, whose id -1 has no pair
            left, right, leaf = np.concatenate([ids[row, h], ids[row, i]]), np.concatenate([ids[row, i], ids[row, k]]), np.concatenate([h, i])
            r = self.table.get(left, right).astype(np.int64)
            value = np.where((r == NONE) | (left < 0) | (right < 0), NO_PAIR, r * size + leaf)
            rows, leaf, value = np.concatenate([row, row, row]), np.concatenate([leaf, j]), np.concatenate([value, np.full(len(row), NO_PAIR)])
            there = leaf < size
            rows, node = rows[there], leaf[there] + size
            tree[rows, node] = value[there]
            for _ in range(size.bit_length() - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] != NO_PAIR]
        return ids

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(place in words, ids) of each word, in any order."""
        flat, off = self.symbols(words)
        length = np.diff(off)
        for k in np.flatnonzero(length > WIDE).tolist():
            yield k, self.merge_wide(flat[off[k] : off[k + 1]].tolist())
        size = 2
        for k in np.flatnonzero(length < 2).tolist():
            yield k, flat[off[k] : off[k + 1]].tolist()
        while size < 2 * WIDE:
            at = np.flatnonzero((length <= size) & (length > max(1, size // 2)) & (length <= WIDE))
            step = max(1, CELLS // (4 * size))
            for a in range(0, len(at), step):
                some = at[a : a + step]
                n = length[some]
                places = np.repeat(off[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                ids = self.merge_rows(flat[places], n, size)
                ends = np.cumsum((ids >= 0).sum(1)).tolist()
                left, begin = ids[ids >= 0].tolist(), 0
                for k, end in zip(some.tolist(), ends):
                    yield k, left[begin:end]
                    begin = end
            size *= 2

    def learn(self, words: set[str]) -> None:
        """Puts what the words become into `seen`."""
        if self.held > REMEMBERED:
            self.old, self.seen, self.held = self.seen, {}, 0
        new = []
        for w in words.difference(self.seen):
            if (had := self.old.get(w)) is not None:
                self._keep(w, had)
            else:
                new.append(w)
        tokens = self.v.tokens
        for k, ids in self.encode_words([w.encode() for w in new]):
            self._keep(new[k], (" ".join(map(str, ids)), len(ids), " ".join([tokens[i] for i in ids])))

    def _keep(self, word: str, what: tuple[str, int, str]) -> None:
        self.seen[word] = what
        self.held += 300 + len(word) + len(what[0]) + 2 * len(what[2])

    # ---- texts

    def cut(self, text: str) -> list[str]:
        """Words and special tokens of a text; a special token is marked by a leading line feed, which no word holds."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self.words(normal(text))
        out, at = [], 0
        for m in found:
            out += self.words(normal(text[at : m.start()]))
            out.append("\n" + m[0])
            at = m.end()
        return out + self.words(normal(text[at:]))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, int, str]]:
        """Of each text: its ids in decimal joined by spaces, their number, and their tokens joined by spaces (what they decode to)."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < PORTION):
                size += len(texts[j] or "")
                j += 1
            cut = [self.cut(t or "") for t in texts[i:j]]
            every = set().union(*cut)
            marks = {w for w in every if w[0] == "\n"}
            self.learn(every - marks)
            seen = self.seen if not marks else self.seen | {w: (str(self.v.special[w[1:]]), 1, w[1:]) for w in marks}
            for words in cut:
                got = [g for w in words if (g := seen[w])[1]]
                yield " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])
            i = j


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(read_vocabulary(path))
    schema = f"doc_id {own.dtypes[0][1]}, n_tokens long, {schema}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for b in batches:
            bpe = bpe or WordBpe(shared.value)
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out = [row(*x) for x in bpe.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(x)) for x in zip(*out))], names)

    return own.mapInArrow(tn.released(run), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded string: one row per row of docs. path: a vocabulary file of a BPE model with an end mark."""
    return _mapped(docs, path, id_col, text_col, "ids array<int>, decoded string", lambda ids, n, raw: (n, np.fromstring(ids, np.int32, sep=" "), raw))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same encoding and decoding, of which only digests leave the workers."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return _mapped(docs, path, id_col, text_col, "ids_sha256 string, decoded_sha256 string", lambda ids, n, raw: (n, sha(ids), sha(raw)))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
