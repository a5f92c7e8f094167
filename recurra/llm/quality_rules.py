"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Words are runs of bytes other than blanks. For several n, a rolling 64-bit hash of every n-word window is taken in
numpy over blocks of whole texts; windows found twice or more in their text mark their words (first occurrence
included), and the share of word characters inside marked words is the n's coverage. Lines equal to an earlier line
of the text likewise. Every text is judged by itself: no shuffle, and no group that could grow.

Defined results: a null text counts as empty, has no words and is rejected by the base rule (fewer than 10 words);
repeated rows are judged each; an empty table gives an empty table; columns beside `text` pass through
`filter_quality` untouched, also ones named like the measures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recurra.llm import textnum as tn
from recurra.llm.scratch import small_batches

#: Largest share of word characters inside repeated n-grams, by n, and inside repeated lines.
LIMITS = {5: 0.30, 8: 0.25, 13: 0.20}
LINE_LIMIT = 0.30
#: With short n-grams, which stuttered text repeats without repeating five words. Of labelled clean documents that pass the
#: other rules the largest shares are 0.415 (2, 3 and 4 words) on the first 15,000 of check_s and 0.244 on sf0.1; limits for
#: 5 and 8 words cannot be lowered by much: 0.242 is the largest there. Single words have no limit, their share grows with length.
SHORT_LIMITS = {2: 0.50, 3: 0.45, 4: 0.45} | LIMITS
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
BASE_N = 5


def repeated(key: np.ndarray) -> np.ndarray:
    """Which keys are found twice or more."""
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(w: tn.Words, n: int, salt: np.ndarray) -> np.ndarray:
    """Which words lie in an n-word window found twice or more in their text."""
    h, ok = tn.ngrams(w, n)
    at = np.flatnonzero(ok)
    at = at[repeated(h[at] ^ salt[w.doc[at]])]
    step = np.zeros(len(h) + 1, np.int32)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    return np.cumsum(step[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def measure(data: np.ndarray, off: np.ndarray, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> dict[str, np.ndarray]:
    n_docs = len(off) - 1
    w = tn.words(data, off, tn.BLANKS)
    cp = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tn.code_points(data), out=cp[1:])
    chars = cp[w.end] - cp[w.start]
    salt = tn.mix(np.arange(1, n_docs + 1, dtype=np.uint64))
    out = {"n_words": w.counts(), "word_chars": per_text(chars, w.first), "n_symbols": per_text(SYMBOLS[data], off)}

    start, end = tn.runs(data != 10, off)
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[has_word], end[has_word]
    doc = np.searchsorted(off, start, "right") - 1
    key = tn.span_hashes(data, start, end) ^ salt[doc]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:][key[order][1:] == key[order][:-1]]] = True
    line_chars = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=line_chars[1:])
    in_lines = (line_chars[np.searchsorted(w.start, end)] - line_chars[np.searchsorted(w.start, start)]) * later
    out["n_dup_lines"] = np.bincount(doc, later, n_docs).astype(np.int64)
    whole = np.maximum(out["word_chars"], 1)
    out["dup_line_share"] = np.bincount(doc, in_lines, n_docs) / whole

    kept = out["dup_line_share"] <= line_limit
    for n in sorted({BASE_N, *limits}):
        inside = covered(w, n, salt)
        if n == BASE_N:
            out["n_repeat_words"] = per_text(inside, w.first)
        out[f"dup_{n}gram_share"] = per_text(chars * inside, w.first) / whole
        kept &= out[f"dup_{n}gram_share"] <= limits.get(n, 1.0)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["kept"] = kept & ~out["base_failed"]
    return out


def _columns(texts: pa.Array, **limits) -> dict[str, np.ndarray]:
    parts = [measure(data, off, **limits) for _, _, data, off in tn.blocks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double"


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row per row of docs: its id and all measures, `base_failed` and the verdict `kept`."""
    limits = dict(LIMITS if limits is None else limits)
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in MEASURES.split(", ")] + [f"dup_{n}gram_share" for n in sorted({BASE_N, *limits})]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = _columns(b.column(1), limits=limits, line_limit=line_limit)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[k]) for k in names)], [b.schema.names[0], *names])

    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(tn.released(judge), f"doc_id {own.dtypes[0][1]}, {MEASURES}, " + ", ".join(f"dup_{n}gram_share double" for n in sorted({BASE_N, *limits})))


def filter_quality(docs: DataFrame, text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns."""
    limits = dict(LIMITS if limits is None else limits)
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_columns(b.column(place), limits=limits, line_limit=line_limit)["kept"]))

    return docs.mapInArrow(tn.released(keep), docs.schema)


def op5_quality_rules_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With short n-grams too; no SQL."""
    return quality_measures(spark.read.parquet(f"{sf_dir}/documents.parquet"), limits=SHORT_LIMITS)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams and limits that SQL has; stuttered text passes, see op5_quality_rules_short."""
    return quality_measures(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _share(n: int) -> str:
    return f"""g{n} AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)),
h{n} AS (SELECT DISTINCT doc_id, i + unnest(range({n})) AS p FROM (SELECT doc_id, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1)),
c{n} AS (SELECT doc_id, count(*) AS k, sum(length(w[p])) AS c FROM h{n} JOIN w USING (doc_id) GROUP BY doc_id)"""


SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
{", ".join(_share(n) for n in (5, 8, 13))},
ln AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY k) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))) AS c FROM ln WHERE r > 1 GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(c5.k, 0) AS n_repeat_words,
  coalesce(dl.c, 0) AS lc, coalesce(c5.c, 0) AS a, coalesce(c8.c, 0) AS b, coalesce(c13.c, 0) AS c
  FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c8 USING (doc_id) LEFT JOIN c13 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lc / greatest(word_chars, 1) <= {LINE_LIMIT} AND a / greatest(word_chars, 1) <= {LIMITS[5]} AND b / greatest(word_chars, 1) <= {LIMITS[8]} AND c / greatest(word_chars, 1) <= {LIMITS[13]} AS kept,
  CAST(lc AS DOUBLE) / greatest(word_chars, 1) AS dup_line_share, CAST(a AS DOUBLE) / greatest(word_chars, 1) AS dup_5gram_share, CAST(b AS DOUBLE) / greatest(word_chars, 1) AS dup_8gram_share, CAST(c AS DOUBLE) / greatest(word_chars, 1) AS dup_13gram_share
FROM m
"""
