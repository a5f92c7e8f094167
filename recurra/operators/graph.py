"""Candidates as sets: containment edges, strongly connected merges, coverage, sinks and ancestors, greedy splits.

cand(cand string, dims array<int>, positions array<long>); edges(src, dst, weight). Containment is counted by an
equi-join on positions; components and ancestors come from operators.reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.operators import reach


def overlap_graph(cands: DataFrame, least: float = 0.8) -> DataFrame:
    """edges(src, dst, weight): |Pi & Pj| / |Pi| of ordered pairs, where it is `least` or more."""
    pos = cands.select("cand", F.size("positions").alias("n"), F.explode("positions").alias("pos"))
    pairs = pos.alias("a").join(pos.alias("b"), (F.col("a.pos") == F.col("b.pos")) & (F.col("a.cand") != F.col("b.cand")))
    shared = pairs.groupBy(F.col("a.cand").alias("src"), F.col("b.cand").alias("dst")).agg(F.count("*").alias("k"), F.first("a.n").alias("n"))
    return shared.select("src", "dst", (F.col("k") / F.col("n")).alias("weight")).where(F.col("weight") >= least)


def scc(cands: DataFrame, edges: DataFrame) -> DataFrame:
    """(cand, scc): candidates that reach one another; a component is named by its smallest member."""
    found = reach.components(edges).withColumnsRenamed({"v": "cand", "c": "scc"})
    return cands.select("cand").distinct().join(found, "cand", "left").select("cand", F.coalesce("scc", "cand").alias("scc"))


def scc_merge(cands: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates of each component as one: union of dims, intersection of positions."""
    j = cands.join(members, "cand")
    size = members.groupBy("scc").agg(F.count("*").alias("k"))
    dims = j.select("scc", F.explode("dims").alias("d")).groupBy("scc").agg(F.array_sort(F.collect_set("d")).alias("dims"))
    held = j.select("scc", F.explode("positions").alias("p")).groupBy("scc", "p").agg(F.count("*").alias("c")).join(size, "scc").where("c = k")
    pos = held.groupBy("scc").agg(F.array_sort(F.collect_list("p")).alias("positions"))
    return dims.join(pos, "scc", "left").select(F.col("scc").alias("cand"), "dims", F.coalesce("positions", F.array().cast("array<bigint>")).alias("positions"))


def coverage(cands: DataFrame) -> DataFrame:
    """(cand, coverage): number of dims times number of positions."""
    return cands.select("cand", (F.size("dims") * F.size("positions")).cast("long").alias("coverage"))


def optimal_n(cover: DataFrame) -> DataFrame:
    """(n): how many candidates come before the largest drop of coverage in descending order, of equal drops the first; the drop to nothing counts."""
    down = Window.orderBy(F.desc("coverage"), "cand")
    drops = cover.select(F.row_number().over(down).alias("k"), (F.col("coverage") - F.lead("coverage", 1, 0).over(down)).alias("drop"))
    return drops.agg(F.max_by("k", F.struct("drop", (-F.col("k")).alias("b"))).cast("long").alias("n"))


def total_coverage(cover: DataFrame, n: int) -> DataFrame:
    return cover.orderBy(F.desc("coverage"), "cand").limit(n).agg(F.coalesce(F.sum("coverage"), F.lit(0)).alias("total"))


def sinks_ancestors(cands: DataFrame, edges: DataFrame) -> DataFrame:
    """(sink, ancestor, sink_coverage, ancestor_coverage): nodes without outgoing edges, and what reaches them."""
    c = coverage(cands)
    return (
        reach.sinks(edges).select("sink", F.col("v").alias("ancestor"))
        .join(c.withColumnsRenamed({"cand": "sink", "coverage": "sink_coverage"}), "sink")
        .join(c.withColumnsRenamed({"cand": "ancestor", "coverage": "ancestor_coverage"}), "ancestor")
    )


def split_sets(cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sink, ancestor, part, dims, positions): the shared part and the two rests of every pair; empty ones are left out."""
    s, a = cands.alias("s"), cands.alias("a")
    j = pairs.join(s, F.col("sink") == F.col("s.cand")).join(a, F.col("ancestor") == F.col("a.cand"))
    inter = F.array_intersect("s.positions", "a.positions")
    part = lambda name, dims, pos: F.struct(F.lit(name).alias("part"), F.array_sort(dims).alias("dims"), F.array_sort(pos).alias("positions"))
    parts = F.array(
        part("both", F.array_union("s.dims", "a.dims"), inter),
        part("sink", F.col("s.dims"), F.array_except("s.positions", "a.positions")),
        part("ancestor", F.col("a.dims"), F.array_except("a.positions", "s.positions")),
    )
    return j.select("sink", "ancestor", F.explode(parts).alias("p")).select("sink", "ancestor", "p.*").where(F.size("positions") > 0)


def roles(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc, role): source, sink, intermediate or isolated among the condensed edges."""
    m = members
    e = edges.join(m.withColumnsRenamed({"cand": "src", "scc": "a"}), "src").join(m.withColumnsRenamed({"cand": "dst", "scc": "b"}), "dst").where("a <> b").select("a", "b").distinct()
    out, into = e.groupBy(F.col("a").alias("scc")).agg(F.count("*").alias("o")), e.groupBy(F.col("b").alias("scc")).agg(F.count("*").alias("i"))
    r = m.select("scc").distinct().join(out, "scc", "left").join(into, "scc", "left")
    role = F.when(F.col("o").isNull() & F.col("i").isNull(), "isolated").when(F.col("i").isNull(), "source").when(F.col("o").isNull(), "sink").otherwise("intermediate")
    return r.select("scc", role.alias("role"))


# ---- the greedy split over a collected candidate set: thousands of candidates at most, after the cuts


@dataclass(frozen=True)
class Candidate:
    name: str
    dims: frozenset
    positions: frozenset

    @property
    def coverage(self) -> int:
        return len(self.dims) * len(self.positions)


def _links(cands: list[Candidate], least: float) -> list[list[int]]:
    where: dict[int, list[int]] = {}
    for k, c in enumerate(cands):
        for p in c.positions:
            where.setdefault(p, []).append(k)
    out = []
    for k, c in enumerate(cands):
        n: dict[int, int] = {}
        for p in c.positions:
            for o in where[p]:
                n[o] = n.get(o, 0) + 1
        out.append(sorted(o for o, m in n.items() if o != k and m >= least * len(c.positions)))
    return out


def _reaches(links: list[list[int]]) -> list[set[int]]:
    out = []
    for k in range(len(links)):
        seen: set[int] = set()
        stack = list(links[k])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(links[x])
        out.append(seen)
    return out


def merged(cands: list[Candidate], least: float) -> list[Candidate]:
    """Mutually reachable candidates as one, in descending coverage."""
    reached = _reaches(_links(cands, least))
    done: set[int] = set()
    out = []
    for k, c in enumerate(cands):
        if k not in done:
            group = [k, *sorted(o for o in reached[k] if k in reached[o] and o != k)]
            done.update(group)
            if len(group) > 1:
                pos = frozenset.intersection(*(cands[o].positions for o in group))
                c = Candidate("+".join(cands[o].name for o in group), frozenset().union(*(cands[o].dims for o in group)), pos)
            out.append(c)
    return sorted(out, key=lambda c: (-c.coverage, c.name))


def best_count(cands: list[Candidate]) -> int:
    v = [c.coverage for c in cands] + [0]
    return max(range(len(cands)), key=lambda k: (v[k] - v[k + 1], -k)) + 1 if cands else 0


def covered(cands: list[Candidate], n: int | None) -> int:
    return sum(c.coverage for c in cands[: best_count(cands) if n is None else n])


def resolve(cands: list[Candidate], least: float = 0.8, n: int | None = None) -> list[Candidate]:
    """Merges, then splits sinks by ancestors while the best split raises the coverage of the top n; the top n."""
    now = merged(cands, least)
    while True:
        reached = _reaches(links := _links(now, least))
        best, gain = None, 0
        for s, out in enumerate(links):
            if out:
                continue
            for a in (k for k in range(len(now)) if s in reached[k]):
                x, y = now[s], now[a]
                inter = x.positions & y.positions
                parts = [Candidate(f"({x.name}&{y.name})", x.dims | y.dims, inter), Candidate(f"({x.name}-{y.name})", x.dims, x.positions - inter), Candidate(f"({y.name}-{x.name})", y.dims, y.positions - inter)]
                trial = merged([c for k, c in enumerate(now) if k not in (s, a)] + [p for p in parts if p.positions], least)
                if covered(trial, n) - covered(now, n) > gain:
                    best, gain = trial, covered(trial, n) - covered(now, n)
        if best is None:
            return now[: best_count(now) if n is None else n]
        now = best
