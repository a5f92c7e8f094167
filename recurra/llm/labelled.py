"""A bounded sample of labelled rows, and models applied to whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm import textnum as tn
from recurra.llm.scratch import small_batches

#: Rows of the sample, and bytes of its texts: the rows of smallest hash that fit; texts of more than a SHARE-th of the bytes take what the others leave.
MAX_ROWS, MAX_BYTES, SHARE = 6000, 32 << 20, 64


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is in neither part of the sample and not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most max_rows labelled rows that aren't held out; null labels don't count, rows that share an id count once (the least text and label).

    Which rows: those of smallest hash of the id, so a sample of the whole table that is the same on every run.
    """
    own = labels.select(labels[id_col].alias("i"), labels[label].cast("int").alias("y")).where("i is not null and y in (0, 1)").where(~held_out(F.col("i")))
    chosen = own.orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)
    table = _texts(docs, chosen, id_col, text_col, max_bytes)
    return table.column("t").combine_chunks(), table.column("y").to_numpy().astype(np.int64)


def unlabelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> pa.Array:
    """Texts of at most max_rows rows of docs without a label that aren't held out, chosen as in `sample`."""
    known = labels.where(labels[label].cast("int").isin(0, 1)).select(labels[id_col].alias("i"))
    ids = docs.select(docs[id_col].alias("i")).where("i is not null").where(~held_out(F.col("i"))).distinct()
    chosen = ids.join(known, "i", "left_anti").orderBy(F.xxhash64("i"), "i").limit(max_rows).select("i", F.lit(0).alias("y"))
    return _texts(docs, chosen, id_col, text_col, max_bytes).column("t").combine_chunks()


def _texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, max_bytes: int) -> pa.Table:
    """t, y of the ids chosen(i, y), at most MAX_ROWS rows of two numbers, as far as max_bytes go: lengths first, then the texts picked by them."""
    rows = docs.select(docs[id_col].alias("i"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    of = lambda ids: rows.join(F.broadcast(ids), "i").groupBy("i").agg(F.min("y").alias("y"), F.min("t").alias("t"))
    order = [F.xxhash64("i"), "i"]
    lengths = of(chosen).select("i", "y", F.octet_length("t").alias("n")).orderBy(*order).toArrow()
    n, y = lengths["n"].to_numpy(), lengths["y"].to_numpy()
    room, picked = max_bytes, []
    for k in np.argsort(n > max_bytes // SHARE, kind="stable").tolist():
        if n[k] <= room:
            picked.append(k)
            room -= int(n[k])
    picked = np.sort(np.array(picked, np.int64))
    if len(np.unique(y)) > len(np.unique(y[picked])) > 0:
        raise ValueError(f"{max_bytes} bytes of labelled texts hold one class alone: raise max_bytes")
    ids = docs.sparkSession.createDataFrame(lengths.take(pa.array(picked)).select(["i", "y"]), chosen.select("i", "y").schema)
    return of(ids).orderBy(*order).select("t", "y").toArrow()


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], cut: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs. score: of a block's bytes and offsets, made of what is broadcast with it."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tn.blocks(b.column(2)):
                s = np.clip(shared.value(data, off), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(tn.released(run), f"doc_id {own.dtypes[0][1]}, held_out boolean, score double, predicted int")
