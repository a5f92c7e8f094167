"""Occurrences from candidates: runs of positions, greedy placement with occupancy per dim, extension to the right or both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(cands: DataFrame, longest: int, ratio: float = 0.4) -> DataFrame:
    """(cand, start, end, length, n_dims, score): runs of consecutive positions (end inclusive), kept if their score min(length, longest) * dims is `ratio` or more of the candidate's best."""
    order = Window.partitionBy("cand").orderBy("pos")
    pos = cands.select("cand", F.size("dims").alias("n_dims"), F.explode("positions").alias("pos")).withColumn("island", F.col("pos") - F.row_number().over(order))
    runs = pos.groupBy("cand", "n_dims", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("length"))
    scored = runs.withColumn("score", F.least(F.col("length"), F.lit(longest)) * F.col("n_dims"))
    return scored.withColumn("best", F.max("score").over(Window.partitionBy("cand"))).where(F.col("score") >= ratio * F.col("best")).select("cand", "start", "end", "length", "n_dims", "score")


def place(cands: list[tuple[str, frozenset, frozenset]], rank: dict[tuple[str, int], float], n: int, shortest: int, longest: int, ratio: float = 0.4, both_ways: bool = True) -> list[tuple[str, int, int]]:
    """(cand, start, end exclusive) of the occurrences placed: segments by score, in each the position of least rank whose buffer [start - 1, end + 1) is free on the candidate's dims. Then each grows to `longest` while the next start belongs to the candidate and the cells beyond are free."""
    found = []
    for name, dims, positions in cands:
        runs: list[list[int]] = []
        for p in sorted(positions):
            if runs and runs[-1][-1] == p - 1:
                runs[-1].append(p)
            else:
                runs.append([p])
        top = max((min(len(r), longest) for r in runs), default=0)
        found += [(-min(len(r), longest) * len(dims), len(found) + k, name, dims, r) for k, r in enumerate(runs) if min(len(r), longest) >= ratio * top]
    busy: dict[int, set[int]] = {}
    out = []
    by_name = {name: (dims, positions) for name, dims, positions in cands}

    def free(dims: frozenset, a: int, z: int) -> bool:
        return all(t not in busy.get(d, ()) for d in dims for t in range(a, z))

    def take(dims: frozenset, a: int, z: int) -> None:
        for d in dims:
            busy.setdefault(d, set()).update(range(a, z))

    for *_, name, dims, run in sorted(found, key=lambda f: f[:2]):
        for p in sorted(run, key=lambda p: (rank.get((name, p), float("inf")), p)):
            a, z = max(0, p - 1), min(n, p + shortest + 1)
            if p + shortest <= n and free(dims, a, z):
                take(dims, a, z)
                out.append([name, p, p + shortest])
                break
    for o in out:
        dims, positions = by_name[o[0]]
        grown = True
        while grown and o[2] - o[1] < longest:
            grown = False
            if o[2] - shortest + 1 in positions and o[2] + 1 < n and free(dims, o[2] + 1, o[2] + 2):
                take(dims, o[2] + 1, o[2] + 2)
                o[2] += 1
                grown = True
            elif both_ways and o[1] - 1 in positions and o[1] >= 2 and free(dims, o[1] - 2, o[1] - 1):
                take(dims, o[1] - 2, o[1] - 1)
                o[1] -= 1
                grown = True
    return [(name, a, z) for name, a, z in out]


def mask(occurrences: DataFrame) -> DataFrame:
    """(motif, t): the samples of occurrence(motif, start, end exclusive)."""
    return occurrences.select("motif", F.explode(F.sequence("start", F.col("end") - 1)).alias("t")).distinct()
