"""Sliding-window statistics as Column expressions: one window pass per (dim, chunk of time) gives every statistic asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Deviations below this count as constant, and residual norms below ETA as degenerate.
CONSTANT, ETA = 1e-7, 1e-9


#: Samples of a chunk: a long series is dealt to tasks in chunks that overlap by what the windows reach beyond.
CHUNK = 1 << 16


def chunked(sig: DataFrame, before: int, after: int, size: int | None = None) -> DataFrame:
    """sig with `chunk`: every row in the chunk of its t, and a copy in each neighbour whose windows reach it (`before` samples back, `after` ahead). Rows with t // size <> chunk are such copies."""
    size = max(size or CHUNK, 2 * (before + after) + 1)
    own = F.floor(F.col("t") / size)
    place = F.col("t") - own * size
    copies = F.array_compact(F.array(own, F.when(place < after, own - 1), F.when(place >= size - before, own + 1)))
    return sig.select("*", own.alias("own"), F.explode(copies).alias("chunk"))


def frame(w: int, *keys: str):
    return Window.partitionBy(*(keys or ("dim",)), "chunk").orderBy("t").rowsBetween(0, w - 1)


def statistics(w: int, *keys: str) -> dict[str, Column]:
    """Expressions by name, over windows of w samples that begin at each row."""
    o = frame(w, *keys)
    spread = (w * w - 1) / 12
    finite = F.coalesce(~F.isnan("v") & (F.abs("v") < float("inf")), F.lit(False))
    number = F.when(~F.isnan("v"), F.col("v"))  # neither null nor NaN
    sound = F.when(finite, F.col("v"))
    whole = F.bool_and(finite).over(o)
    return {
        "mean": F.avg("v").over(o),
        "std": F.stddev_pop("v").over(o),
        "slope": F.regr_slope("v", "t").over(o),
        "eta": F.sqrt(F.greatest(F.lit(0.0), w * (F.var_pop("v").over(o) - F.regr_slope("v", "t").over(o) ** 2 * spread))),
        "energy": F.sum(F.col("v") * F.col("v")).over(o),
        "low": F.min("v").over(o),
        "high": F.max("v").over(o),
        "finite": F.bool_and(finite).over(o),
        "constant": F.coalesce((F.max("v").over(o) == F.min("v").over(o)) & whole, F.lit(False)),
        "x": F.collect_list("v").over(o),
        # over what is left without missing samples; of one with infinite ones no deviation
        "nan_std": F.when(F.max(F.abs(number)).over(o) < float("inf"), F.stddev_pop(sound).over(o)),
        "nan_low": F.min(number).over(o),
        "nan_high": F.max(number).over(o),
        # of windows with any unsound sample: mean infinite, deviation 0, so that their distance is that of a constant one
        "valid_mean": F.when(whole, F.avg(sound).over(o)).otherwise(float("inf")),
        "valid_std": F.when(whole, F.stddev_pop(sound).over(o)).otherwise(0.0),
    }


def windows(sig: DataFrame, w: int, *names: str, override: str | None = None) -> DataFrame:
    """(dim, i, names...) for every complete window of w samples.

    override: a boolean column of sig that says at a window's first sample whether it is constant; null leaves that to the
    samples. A window with unsound samples is never constant, whatever the column says.
    """
    if w < 3:
        raise ValueError("windows have 3 samples at least")
    made = statistics(w)
    if override:
        made["constant"] = F.coalesce(made["finite"] & F.coalesce(F.col(override), made["constant"]), F.lit(False))
    return chunked(sig, 0, w - 1).select("own", "chunk", "dim", F.col("t").alias("i"), *(made[n].alias(n) for n in names), F.count("*").over(frame(w)).alias("n")).where((F.col("n") == w) & (F.col("own") == F.col("chunk"))).drop("n", "own", "chunk")


def z_norm(x: Column, mean: Column, std: Column) -> Column:
    """The window with mean 0 and deviation 1; a constant one keeps its scale."""
    return F.transform(x, lambda e: (e - mean) / F.when(std < CONSTANT, 1.0).otherwise(std))


def squash(d: Column, alpha: float = 10.0, beta: float = 0.0) -> Column:
    """Saturates a distance in [0, 2] onto [0, 2]; infinity becomes 2."""
    import math

    b = beta * beta
    top = F.tanh(alpha * (d * d - b)) - math.tanh(-alpha * b)
    return F.when(d == float("inf"), 2.0).otherwise(2 * F.sqrt(top / (math.tanh(alpha * (4 - b)) - math.tanh(-alpha * b))))


def replace_distance(d: Column, old: float, new: float) -> Column:
    """old replaced by new, within 1e-12."""
    return F.when(F.abs(d - old) <= 1e-12, F.lit(new)).otherwise(d)
