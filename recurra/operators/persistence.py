"""Zero-dimensional persistence of weighted edges, automatic cuts, and thresholded components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024
#: Places whose edges are brought to a forest together, round by round; the last round takes what is left of a dim.
RANGES = (1 << 14, 1 << 19)


class Forest:
    """Union-find with a birth for each root; of two roots the smaller birth survives, of equal ones the second."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.birth: dict[int, float] = {}

    def born(self, x: int, w: float) -> None:
        if x not in self.up:
            self.up[x], self.birth[x] = x, w

    def root(self, x: int) -> int:
        top = x
        while self.up[top] != top:
            top = self.up[top]
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def join(self, a: int, b: int) -> int:
        """Joins two roots; the one that dies."""
        dies, stays = (b, a) if self.birth[a] < self.birth[b] else (a, b)
        self.up[dies] = stays
        return dies


def diagram(edges: list[tuple[float, int, int]]) -> list[tuple[float, float, int]]:
    """(birth, death, root) of edges (w, u, v) in order; surviving roots die at infinity."""
    f, out = Forest(), []
    for w, u, v in edges:
        f.born(u, w)
        f.born(v, w)
        a, b = f.root(u), f.root(v)
        if a != b:
            birth = max(f.birth[a], f.birth[b])
            out.append((birth, w, f.join(a, b)))
    return out + [(f.birth[r], float("inf"), r) for r in sorted({f.root(x) for x in f.up})]


def cut_components(edges: list[tuple[float, int, int]], birth_cut: float, gap_cut: float) -> list[tuple[int, int, float]]:
    """(position, root, birth): an edge of weight birth_cut or more that would bear a node is left out; roots join only while weight minus the later birth is below gap_cut."""
    f = Forest()
    own: dict[int, float] = {}
    for w, u, v in edges:
        if w >= birth_cut and (u not in f.up or v not in f.up):
            continue
        for x in (u, v):
            f.born(x, w)
            own.setdefault(x, w)
        a, b = f.root(u), f.root(v)
        if a != b and w - max(f.birth[a], f.birth[b]) < gap_cut:
            f.join(a, b)
    return [(x, f.root(x), own[x]) for x in sorted(f.up)]


def spanning(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the least spanning forest, in order of (w, u, v)."""
    order = np.lexsort((v, u, w))
    nodes, ends = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    up, kept = list(range(len(nodes))), []
    for at, a, b in zip(order.tolist(), ends[: len(u)].tolist(), ends[len(u) :].tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            kept.append(at)
    return np.array(kept, np.int64)


def forest(edges: DataFrame) -> DataFrame:
    """The edges(dim, u, v, w) of each dim's least spanning forest, edges of equal weight in order of (u, v).

    An edge that closes a circle of lesser ones within some of the edges does so within all, so ranges of places give their own forests
    first, wider ranges those of what these left: n - 1 edges of n windows at most come together, whatever the number of edges.
    """

    def run(t: pa.Table) -> pa.Table:
        return t.take(pa.array(spanning(*(t[c].to_numpy() for c in ("u", "v", "w")))))

    out = edges.select("dim", "u", "v", "w")
    for size in RANGES:
        out = out.groupBy("dim", F.floor(F.col("u") / size)).applyInArrow(run, out.schema)
    return out


def _edges_of(b: pa.Table) -> list[tuple[float, int, int]]:
    return sorted(zip(b["w"].to_pylist(), b["u"].to_pylist(), b["v"].to_pylist()))


def persistence(edges: DataFrame) -> DataFrame:
    """persistence(dim, birth, death, cluster) of edges(dim, u, v, w); edges of equal weight by (u, v).

    The elder rule is replayed on each dim's forest alone: no other edge joins components, and a node's least edge, which
    gives its birth, is in the forest.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = diagram(_edges_of(t))
        dim = t["dim"][0].as_py()
        return pa.table({"dim": pa.array([dim] * len(rows), pa.int32()), "birth": [r[0] for r in rows], "death": [r[1] for r in rows], "cluster": pa.array([r[2] for r in rows], pa.int64())})

    return forest(edges).groupBy("dim").applyInArrow(run, "dim int, birth double, death double, cluster long")


def components(edges: DataFrame, birth_cut: float, gap_cut: float) -> DataFrame:
    """(dim, pos, root, birth) of the thresholded union-find per dim, on forests.

    An edge of weight birth_cut or more counts only between nodes that lesser edges bear; the others are taken out first. Of what is
    left, an edge outside the forest joins nothing: along the path of lesser edges between its ends, each component had an edge whose
    weight was gap_cut or more beyond its birth, births only fall and weights only rise.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = cut_components(_edges_of(t), birth_cut, gap_cut)
        dim = t["dim"][0].as_py()
        return pa.table({"dim": pa.array([dim] * len(rows), pa.int32()), "pos": pa.array([r[0] for r in rows], pa.int64()), "root": pa.array([r[1] for r in rows], pa.int64()), "birth": pa.array([r[2] for r in rows], pa.float64())})

    low, high = (edges.select("dim", "u", "v", "w").where(x) for x in (F.col("w") < birth_cut, F.col("w") >= birth_cut))
    born = low.select("dim", F.explode(F.array("u", "v")).alias("node")).distinct()
    for end in ("u", "v"):
        high = high.join(born.withColumnRenamed("node", end), ["dim", end], "left_semi").select("dim", "u", "v", "w")
    return forest(low.unionByName(high)).groupBy("dim").applyInArrow(run, "dim int, pos long, root long, birth double")


def births(edges: DataFrame) -> DataFrame:
    """(dim, node, birth): the least weight of an edge at the node."""
    ends = edges.select("dim", F.explode(F.array("u", "v")).alias("node"), "w")
    return ends.groupBy("dim", "node").agg(F.min("w").alias("birth"))


def otsu_cut(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """(cut): Otsu's threshold over a histogram of `value` whose bins stand for their left edges; the last bin is no candidate.

    The between-class variance in closed form from cumulated shares; only `bins` rows are ever windowed.
    """
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = df.where(F.col(value).isNotNull()).join(F.broadcast(lim)).select(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int").alias("bin"))  # one row
    count = binned.groupBy("bin").agg(F.count("*").alias("c"))
    every = df.sparkSession.range(bins - 1).select(F.col("id").cast("int").alias("bin"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = every.join(count, "bin", "left").join(F.broadcast(lim)).select("bin", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("p"), (F.col("lo") + F.col("bin") * width).alias("edge"), "mean")
    h = h.select("bin", "edge", "mean", F.sum("p").over(upto).alias("P"), F.sum(F.col("p") * F.col("edge")).over(upto).alias("S"))
    inside = (F.col("P") > 0) & (F.col("P") < 1)
    var = F.when(inside, F.col("P") * (1 - F.col("P")) * (F.col("S") / F.col("P") - (F.col("mean") - F.col("S")) / (1 - F.col("P"))) ** 2)
    return h.select("bin", "edge", F.round(var, 9).alias("var")).agg(F.max_by("edge", F.when(F.col("var").isNotNull(), F.struct("var", (-F.col("bin")).alias("b")))).alias("cut"))


def falling(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """(g, next): every value with the next smaller or equal one in descending order. Values are dealt out by approximate quantiles; a part's last value finds its next among the parts' maxima."""
    g = df.select(F.col(value).alias("g"))
    edges = sorted(set(g.approxQuantile("g", [k / parts for k in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e > F.col("g"))) if edges else F.lit(0)
    g = g.select("g", part.alias("part"))
    tops = g.groupBy("part").agg(F.max("g").alias("top"))
    after = tops.select("part", F.lead("top").over(Window.orderBy("part")).alias("after"))  # a row a part
    down = Window.partitionBy("part").orderBy(F.desc("g"))
    return g.join(F.broadcast(after), "part").select("g", F.coalesce(F.lead("g").over(down), "after").alias("next")).where("next is not null")


def gap_cut(df: DataFrame, gap: str, jump: int = 2) -> DataFrame:
    """(cut): the gaps in descending order; the `jump`-th time the largest drop right of the one before, of equal drops the first; the middle of that drop. Null with too few gaps."""
    steps = falling(df.where(F.col(gap) > 0), gap)
    found = None
    for _ in range(jump):
        right = steps if found is None else steps.join(F.broadcast(found)).where("g <= low").drop("low", "high")  # one row
        found = right.agg(F.max_by(F.struct("g", "next"), F.struct(F.col("g") - F.col("next"), "g")).alias("b")).select(F.col("b.g").alias("high"), F.col("b.next").alias("low"))
    return found.select(((F.col("high") + F.col("low")) / 2).alias("cut"))


def squashed(df: DataFrame, *columns: str, alpha: float = 10.0, beta: float = 0.0) -> DataFrame:
    from recurra.functions.windows import squash

    return df.withColumns({c: squash(F.col(c), alpha, beta) for c in columns})


def candidates(parts: DataFrame) -> DataFrame:
    """cand(cand, dims array<int>, positions array<long>) of components(dim, pos, root)."""
    return parts.groupBy("dim", "root").agg(F.array_sort(F.collect_list("pos")).alias("positions")).select(F.concat_ws(":", F.col("dim").cast("string"), F.col("root").cast("string")).alias("cand"), F.array("dim").alias("dims"), "positions")


def ranks(cands: DataFrame, node_births: DataFrame) -> DataFrame:
    """(cand, pos, rank): the mean birth of the position over the candidate's dims where it has one."""
    at = cands.select("cand", F.explode("positions").alias("pos"), "dims").select("cand", "pos", F.explode("dims").alias("dim"))
    return at.join(node_births.withColumnRenamed("node", "pos"), ["dim", "pos"]).groupBy("cand", "pos").agg(F.avg("birth").alias("rank"))
