"""Signals in long form, signal(dim int, t long, v double), from ordinary tables; masks and other preparations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions.windows import chunked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, path: str, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """signal(series_id, dim, t, v) and motif_loc(series_id, set_id, occ_id, dim, start, end) of a collection of labelled series: folders `signal` and `motif_loc` under path, or under one of its parts ('validation', 'test')."""
    root = f"{path}/{part}" if part else path
    return spark.read.parquet(f"{root}/signal"), spark.read.parquet(f"{root}/motif_loc")


def single(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """signal(dim, t, v) and motif_loc(set_id, occ_id, dim, start, end) of a collection of one series; more or none are refused."""
    sig, truth = collection(spark, path)
    if (n := len(sig.select("series_id").distinct().take(2))) != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} series under {path}: `collection` reads those")
    return sig.drop("series_id"), truth.drop("series_id")


def to_signal(df: DataFrame, t: Column, key: Column, v: Column, length: int | None = None) -> DataFrame:
    """Dense signal: v (an aggregate) by time bucket t and key; dims are the keys' ranks, missing cells 0.

    Aggregated before the exchange; the grid is one row per dim exploded, so the only shuffle is on (dim, t).
    """
    cells = df.groupBy(key.alias("key"), t.cast("long").alias("t")).agg(v.cast("double").alias("v"))
    keys = cells.groupBy("key").agg(F.max("t").alias("last"))
    rank = Window.orderBy("key")  # over the distinct keys only
    dims = keys.select("key", (F.row_number().over(rank) - 1).cast("int").alias("dim"), F.max("last").over(Window.partitionBy()).alias("last"))
    end = F.lit(length - 1) if length else F.col("last")
    grid = dims.select("key", "dim", F.explode(F.sequence(F.lit(0).cast("long"), end.cast("long"))).alias("t"))
    return grid.join(cells, ["key", "t"], "left").select("dim", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def _since(ts: str, start: str, unit_seconds: int) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.lit(start).cast("timestamp_ntz"), F.col(ts)) / unit_seconds)


def ev_signal(spark: SparkSession, sf_dir: str, minutes: int = 60, days: int = 30) -> DataFrame:
    """Value of events by type in time buckets since 2024-01-01."""
    return to_signal(table(spark, sf_dir, "events"), _since("ts", "2024-01-01 00:00:00", 60 * minutes), F.col("event_type"), F.sum(F.col("value").cast("decimal(18,2)")), days * 1440 // minutes)


def li_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily extended price by return flag since 1995-01-02."""
    return to_signal(table(spark, sf_dir, "lineitem"), _since("l_shipdate", "1995-01-02 00:00:00", 86400), F.col("l_returnflag"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).where("t >= 0")


def ord_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly number of orders by priority since 1995-01-01."""
    return to_signal(table(spark, sf_dir, "orders"), _since("o_orderdate", "1995-01-01 00:00:00", 604800), F.col("o_orderpriority"), F.count("*")).where("t >= 0")


def emb(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """The vectors, or their first `dims` elements, in order of their ids."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding" if dims is None else F.slice("embedding", 1, dims)).alias("dim", "v")).select("dim", "t", F.col("v").cast("double").alias("v"))


def with_holes(sig: DataFrame) -> DataFrame:
    """sig with stretches of one value, missing, NaN and infinite samples, by a rule on dim and t: to try the operators that look for them."""
    k = F.pmod(F.col("t") + 37 * F.col("dim"), F.lit(101))
    v = F.when(k < 9, 5.0).when(k == 40, F.lit(None)).when(k == 60, float("nan")).when(k == 80, F.when(F.col("dim") == 0, float("inf")).otherwise(float("-inf"))).otherwise(F.col("v"))
    return sig.withColumn("v", v.cast("double"))


def z_normalise(sig: DataFrame) -> DataFrame:
    """Every dim to mean 0 and population deviation 1; a constant dim to 0. Statistics are aggregated and joined, so no window holds a whole series."""
    stats = sig.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return sig.join(stats, "dim").select("dim", "t", F.when(F.col("s") > 1e-12, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0).alias("v"))


def block_max(sig: DataFrame, size: int) -> DataFrame:
    """Maximum of every block of `size` samples."""
    return sig.groupBy("dim", F.floor(F.col("t") / size).alias("t")).agg(F.max("v").alias("v"))


def reindex(positions: DataFrame, index: DataFrame) -> DataFrame:
    """positions(t, ...) with the label of index(t, label) for each."""
    return positions.join(index, "t")


def take_dims(sig: DataFrame, dims: list[int]) -> DataFrame:
    """The dims given, renumbered in that order."""
    new = F.create_map(*[F.lit(x) for k, d in enumerate(dims) for x in (d, k)])
    return sig.where(F.col("dim").isin(dims)).select(new[F.col("dim")].cast("int").alias("dim"), "t", "v")


def idle_mask(sig: DataFrame, half: int, threshold: float) -> DataFrame:
    """(t, idle): idle where some centred window of 2 * half + 1 samples around t's neighbourhood has variance below the threshold in every dim."""
    centred = Window.partitionBy("dim", "chunk").orderBy("t").rowsBetween(-half, half)
    var = F.when(F.count("v").over(centred) == 2 * half + 1, F.round(F.var_pop("v").over(centred), 9) < threshold).otherwise(False)
    flat = chunked(sig, half, half).select("own", "chunk", "t", var.alias("flat")).where("own = chunk")
    every = flat.groupBy("t").agg(F.bool_and("flat").alias("flat"))
    around = Window.partitionBy("chunk").orderBy("t").rowsBetween(-half, half)
    return chunked(every, half, half).select("own", "chunk", "t", F.max("flat").over(around).alias("idle")).where("own = chunk").select("t", "idle")


def start_mask(sig: DataFrame, idle: DataFrame, q: float) -> DataFrame:
    """(t, start): the non-idle samples nearest to the mean idle sample, up to the q-quantile of their squared distances."""
    both = sig.join(idle, "t")
    means = both.where("idle").groupBy("dim").agg(F.avg("v").alias("m"))
    d = both.join(means, "dim").groupBy("t", "idle").agg(F.sum((F.col("v") - F.col("m")) ** 2).alias("d"))
    cut = d.where("not idle").agg(F.percentile("d", F.lit(q)).alias("cut"))
    return d.join(F.broadcast(cut)).select("t", (~F.col("idle") & (F.col("d") <= F.col("cut"))).alias("start"))  # one row
