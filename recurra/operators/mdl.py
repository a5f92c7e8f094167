"""Description length of a window given another, by subspace."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_edges(bits: int = 8) -> list[float]:
    """Edges of 2**bits equally likely bins of the normal distribution."""
    n = 1 << bits
    return [NormalDist().inv_cdf(k / n) for k in range(1, n)]


def discretise(x: Column, bits: int = 8) -> Column:
    """Bin of each element: how many edges lie below it."""
    edges = F.array(*(F.lit(e) for e in bin_edges(bits)))
    return F.transform(x, lambda e: F.size(F.filter(edges, lambda b: b < e)))


def description_bits(pairs: DataFrame, bits: int = 8) -> DataFrame:
    """(k, bits) of pairs(k, dim, x, y, n_dims): z-normed windows x and y of the dims chosen for each k."""
    diff = F.zip_with(discretise(F.col("x"), bits), discretise(F.col("y"), bits), lambda a, b: a - b)
    d = pairs.select("k", "n_dims", F.size("x").alias("m"), "dim", F.explode(diff).alias("v"))
    g = d.groupBy("k").agg(F.first("n_dims").alias("nd"), F.first("m").alias("m"), F.countDistinct("dim").alias("s"), F.countDistinct("v").alias("nv"))
    return g.select("k", (bits * (2 * F.col("nd") * F.col("m") - F.col("s") * F.col("m")) + F.col("s") * F.col("m") * F.log2("nv") + F.col("nv") * bits).alias("bits"))


def window_bits(a: np.ndarray, b: np.ndarray, chosen: list[int], bits: int = 8) -> float:
    """The same for arrays (dims x samples) of z-normed windows."""
    edges = np.array(bin_edges(bits))
    diff = np.searchsorted(edges, a[chosen]) - np.searchsorted(edges, b[chosen])
    n, m = a.shape
    values = len(np.unique(diff))
    return bits * (2 * n * m - len(chosen) * m) + len(chosen) * m * math.log2(values) + values * bits
