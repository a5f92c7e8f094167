"""Checks of a signal and small arrangements of dims, as aggregates and windows over few rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signal_checks(sig: DataFrame) -> DataFrame:
    """(dim, n, n_missing, n_infinite, low, high, dense): missing counts null and NaN; dense: as many samples as times from the first to the last."""
    v = F.col("v")
    bad = v.isNull() | F.isnan(v)
    return sig.groupBy("dim").agg(
        F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("n_missing"), F.count(F.when(F.abs(v) == float("inf"), 1)).alias("n_infinite"),
        F.min(F.when(~bad, v)).alias("low"), F.max(F.when(~bad, v)).alias("high"), (F.max("t") - F.min("t") + 1 == F.countDistinct("t")).alias("dense"),
    )


def too_small(distances: DataFrame, least: float = 1e-6) -> DataFrame:
    """(too_small): whether the mean of d is below `least`."""
    return distances.agg((F.avg("d") < least).alias("too_small"))


def finite_windows(sig: DataFrame, w: int) -> DataFrame:
    """(dim, i, finite) for every complete window."""
    from recurra.functions.windows import windows

    return windows(sig, w, "finite")


def include_order(pair_dims: DataFrame, include: list[int], discords: bool = False) -> DataFrame:
    """(k, dim) of pair_dims(dim, d): the included dims first in the order given, then by distance and dim; discords: the farthest first."""
    place = F.coalesce(*(F.when(F.col("dim") == d, k) for k, d in enumerate(dict.fromkeys(include))), F.lit(len(include)))
    d = F.when(place == len(include), F.col("d"))
    order = Window.orderBy(place, d.desc() if discords else d, "dim")  # one row a dim
    return pair_dims.select((F.row_number().over(order) - 1).alias("k"), "dim")


def equal_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equal): whether two series (t, v) have the same samples; missing ones equal missing ones, NaN equals NaN. Two empty series are equal."""
    both = a.select("t", F.col("v").alias("p"), F.lit(True).alias("in_a")).join(b.select("t", F.col("v").alias("q"), F.lit(True).alias("in_b")), "t", "full")
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("p").eqNullSafe(F.col("q"))
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def without_trivial(a: DataFrame, b: DataFrame, ignore_trivial: bool) -> bool:
    """Whether a window's own neighbourhood is left out of a join of two series: only in a self-join. Warns where the caller's wish and the series disagree."""
    equal = equal_series(a, b).first()[0]
    if equal and not ignore_trivial:
        warnings.warn("the series are equal, so this is a self-join: every window finds itself unless trivial matches are ignored", stacklevel=2)
    if ignore_trivial and not equal:
        warnings.warn("the series differ, so this is a join of two: trivial matches are not ignored", stacklevel=2)
    return ignore_trivial and equal


def relabel(cands: DataFrame) -> DataFrame:
    """(cand, label): candidates of equal dims numbered by descending number of positions, as dims/number."""
    d = F.array_join("dims", ",")
    n = F.row_number().over(Window.partitionBy(d).orderBy(F.desc(F.size("positions")), "cand"))
    return cands.select("cand", F.concat_ws("/", d, n.cast("string")).alias("label"))


def islands(flags: DataFrame, *keys: str) -> DataFrame:
    """(keys..., start, end exclusive) of the runs of true flags(keys..., t, on), for each value of the keys."""
    on = flags.where("on").select(*keys, "t", (F.col("t") - F.row_number().over(Window.partitionBy(*keys).orderBy("t"))).alias("g"))
    return on.groupBy(*keys, "g").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).drop("g")
