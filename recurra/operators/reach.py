"""Strongly connected components, and which sinks a node reaches, by taking nodes out of the graph.

A node with one way out at most, or one way in at most, is taken out: edges to it lead on to where its own lead. That
adds no edge, and of neighbours that could go, the one of smaller hash goes first, so a fixed share of a chain or tree goes in a
round: their rounds grow with the logarithm of their length. What is left (two ways or more into and out of nearly every node)
is coloured; that takes as many rounds as its paths are long. Then rounds are replayed backwards. Every table has at most a row for
each node and edge, and for the sinks a row for each answer. A round's tables are written to the shared folder and
deleted at the end. edges(src, dst): nulls, loops and repeats don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.sources.tables import dropped, saved

#: Nodes are taken out as long as a round makes the edges fewer by one of so many.
SHARE = 20


@dataclass
class Round:
    """edges(src, dst, end) before the round; taken(v, hub, forward): the nodes that went, hub their only neighbour on one side (forward: the side they lead to)."""

    edges: DataFrame
    taken: DataFrame


def _plain(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").distinct()


def _nodes(edges: DataFrame, turn: int) -> DataFrame:
    """(v, hub, forward, h): nodes that could go; h orders them. Ends never do."""
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o"), F.min("dst").alias("w"))
    into = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("i"), F.min("src").alias("u"), F.bool_or("end").alias("end"))
    n = out.join(into, "v", "full").where(~F.coalesce("end", F.lit(False))).select("v", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"), "w", "u")
    forward = F.col("o") <= 1
    return n.where("o <= 1 or i <= 1").select("v", F.when(forward, F.col("w")).otherwise(F.col("u")).alias("hub"), forward.alias("forward"), F.struct(F.xxhash64("v", F.lit(turn)), "v").alias("h"))


def _round(edges: DataFrame, turn: int) -> tuple[Round, DataFrame]:
    """Takes nodes out, no two of them neighbours; the edges that are left."""
    could = _nodes(edges, turn)
    a, b = could.select(F.col("v").alias("src"), F.col("h").alias("hs")), could.select(F.col("v").alias("dst"), F.col("h").alias("hd"))
    both = edges.join(a, "src").join(b, "dst")
    later = both.select(F.when(F.col("hs") < F.col("hd"), F.col("dst")).otherwise(F.col("src")).alias("v")).distinct()
    taken = saved(could.join(later, "v", "left_anti").select("v", "hub", "forward"))
    gone = taken.select("v")
    rest = edges.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst", "end")
    to = edges.join(gone, F.col("dst") == F.col("v")).select("v", "src")
    on = edges.join(gone, F.col("src") == F.col("v")).select("v", "dst", "end")
    left = saved(_plain(rest.unionByName(to.join(on, "v").select("src", "dst", "end"))))
    return Round(edges, taken), left


def _shrunk(edges: DataFrame, turn: int) -> tuple[list[Round], DataFrame]:
    """Rounds until one takes too few; the edges that are left."""
    rounds: list[Round] = []
    n = edges.count()
    while n:
        r, edges = _round(edges, turn + len(rounds))
        rounds.append(r)
        before, n = n, edges.count()
        if (before - n) * SHARE < before:
            break
    return rounds, edges


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, c) of the nodes whose component is now known, and the edges between others that may share one.

    A node's colour is the smallest node that reaches it. Those of its colour that reach that node are its component; an edge
    between colours lies in none.
    """
    colour = saved(edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct().select("v", F.col("v").alias("c"), F.lit(True).alias("moved")))
    while not colour.where("moved").isEmpty():
        got = edges.join(colour.where("moved"), F.col("src") == F.col("v")).groupBy("dst").agg(F.min("c").alias("m"))
        less = F.coalesce(F.col("m") < F.col("c"), F.lit(False))
        now = saved(colour.join(got, F.col("v") == F.col("dst"), "left").select("v", F.when(less, F.col("m")).otherwise(F.col("c")).alias("c"), less.alias("moved")))
        dropped(colour)
        colour = now
    s, t = colour.select(F.col("v").alias("src"), "c"), colour.select(F.col("v").alias("dst"), "c")
    inner = saved(edges.join(s, "src").join(t, ["dst", "c"]).select("src", "dst", "end", "c"))
    known = front = saved(colour.where("v = c").select("v", "c"))
    while not front.isEmpty():
        back = inner.join(front.select(F.col("v").alias("dst")), "dst").select(F.col("src").alias("v"), "c").distinct()
        more = saved(back.join(known, "v", "left_anti"))
        both = saved(known.unionByName(more))
        dropped(known, front)
        known, front = both, more
    done = known.select("v")
    left = saved(inner.join(done.withColumnRenamed("v", "src"), "src", "left_anti").join(done.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst", "end"))
    dropped(front, colour, inner)
    return known, left


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each node of an edge and the smallest node of its component; nodes that no edge has aren't there."""
    given = saved(edges.select("src", "dst"))
    nodes = given.select(F.explode(F.array("src", "dst")).alias("v")).where("v is not null").distinct()
    left = saved(_plain(given.select("src", "dst", F.lit(False).alias("end"))))
    rounds: list[Round] = []
    known: DataFrame | None = None
    while not left.isEmpty():
        more, core = _shrunk(left, len(rounds))
        rounds += more
        if core.isEmpty():
            break
        part, left = _coloured(core)
        before, known = known, part if known is None else saved(known.unionByName(part))
        dropped(core, before, part if before is not None else None)
    if known is None:
        known = saved(nodes.limit(0).select("v", F.col("v").alias("c")))
    for r in reversed(rounds):
        # v is in its hub's component if a neighbour on its other side is: known has no row for those that are alone
        own = lambda name: known.select(F.col("v").alias(name), F.col("c").alias("c_" + name))
        into = r.edges.join(r.taken.where("forward"), F.col("dst") == F.col("v")).select("v", "hub", F.col("src").alias("other"))
        out = r.edges.join(r.taken.where("not forward"), F.col("src") == F.col("v")).select("v", "hub", F.col("dst").alias("other"))
        named = into.unionByName(out).join(own("hub"), "hub", "left").join(own("other"), "other", "left")
        named = named.select("v", F.coalesce("c_hub", "hub").alias("c")).where(F.coalesce("c_hub", "hub") == F.coalesce("c_other", "other"))
        now = saved(known.unionByName(named.distinct()))
        dropped(known, r.edges, r.taken)
        known = now
    named = nodes.join(known, "v", "left").select("v", F.coalesce("c", "v").alias("k"))
    least = named.groupBy("k").agg(F.min("v").alias("c"))
    out = saved(named.join(least, "k").select("v", "c"))
    dropped(known, left, given)
    return out


def sinks(edges: DataFrame) -> DataFrame:
    """(sink, v): the nodes without a way out (a loop is one), and the nodes that reach them."""
    edges = given = saved(edges.select("src", "dst").where("src is not null and dst is not null"))
    ends = edges.select(F.col("dst").alias("sink")).distinct().join(edges.select(F.col("src").alias("sink")).distinct(), "sink", "left_anti")
    marked = edges.join(ends.withColumnRenamed("sink", "dst").withColumn("end", F.lit(True)), "dst", "left")
    left = saved(_plain(marked.select("src", "dst", F.coalesce("end", F.lit(False)).alias("end"))))
    dropped(given)
    rounds, core = _shrunk(left, 0)
    found = front = saved(core.where("end").select(F.col("dst").alias("sink"), F.col("src").alias("v")).distinct())
    while not front.isEmpty():
        back = core.join(front, F.col("dst") == F.col("v")).select("sink", F.col("src").alias("v")).distinct()
        more = saved(back.join(found, ["sink", "v"], "left_anti"))
        both = saved(found.unionByName(more))
        dropped(found, front)
        found, front = both, more
    if front is not found:
        dropped(front)
    for r in reversed(rounds):
        on = r.edges.join(r.taken.select("v"), F.col("src") == F.col("v")).select("v", "dst", "end")
        direct = on.where("end").select(F.col("dst").alias("sink"), "v")
        further = on.join(found.withColumnRenamed("v", "dst"), "dst").select("sink", "v")
        now = saved(found.unionByName(direct.unionByName(further).distinct()))
        dropped(found, r.edges, r.taken)
        found = now
    dropped(core, left)
    return found
