"""Evaluation of found motifs: masks, intervals, overlaps, assignments, and scores."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mask_to_intervals(mask: DataFrame) -> DataFrame:
    """(label, start, end), 1-based and inclusive, of mask(label, t); labels without samples have none."""
    island = F.col("t") - F.row_number().over(Window.partitionBy("label").orderBy("t"))
    return mask.withColumn("g", island).groupBy("label", "g").agg((F.min("t") + 1).alias("start"), (F.max("t") + 1).alias("end")).select("label", "start", "end")


def sample_prf(real: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) of equally named labels of two masks(label, t); 0 where undefined."""
    both = real.join(pred, ["label", "t"]).groupBy("label").agg(F.count("*").alias("hit"))
    r, p = real.groupBy("label").agg(F.count("*").alias("r")), pred.groupBy("label").agg(F.count("*").alias("p"))
    j = r.join(p, "label", "full").join(both, "label", "left").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("hit", "r", "p")))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return j.select("label", safe(F.col("hit"), F.col("p")).alias("precision"), safe(F.col("hit"), F.col("r")).alias("recall"), safe(2 * F.col("hit"), F.col("r") + F.col("p")).alias("f1"))


def overlap_matrix(real: DataFrame, pred: DataFrame) -> DataFrame:
    """(real, pred, n): common samples of each pair of labels that has any."""
    return real.withColumnRenamed("label", "real").join(pred.withColumnRenamed("label", "pred"), "t").groupBy("real", "pred").agg(F.count("*").alias("n"))


def interval_overlaps(a: DataFrame, b: DataFrame, size: int = 64) -> DataFrame:
    """(a, b, rate) of intervals(id, start, end exclusive) that meet: intersection over hull. Intervals are dealt to buckets of `size` samples, so the join is an equality."""
    cut = lambda d, n: d.select(F.col("id").alias(n), F.col("start").alias(n + "s"), F.col("end").alias(n + "e"), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("bucket"))
    j = cut(a, "a").join(cut(b, "b"), "bucket").where("as < be and bs < ae").where(F.floor(F.greatest("as", "bs") / size) == F.col("bucket"))
    return j.select("a", "b", ((F.least("ae", "be") - F.greatest("as", "bs")) / (F.greatest("ae", "be") - F.least("as", "bs"))).alias("rate"))


def dim_prf(real: DataFrame, pred: DataFrame) -> DataFrame:
    """(motif, precision, recall, f1, jaccard) of dims(motif, dims array)."""
    j = real.withColumnRenamed("dims", "r").join(pred.withColumnRenamed("dims", "p"), "motif")
    k = F.size(F.array_intersect("r", "p"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return j.select("motif", safe(k, F.size("p")).alias("precision"), safe(k, F.size("r")).alias("recall"), safe(2 * k, F.size("r") + F.size("p")).alias("f1"), safe(k, F.size(F.array_union("r", "p"))).alias("jaccard"))


def assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total weight, min(shape) of them (shortest augmenting paths with potentials)."""
    if weight.size == 0:
        return []
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


Interval = tuple[int, int]


def _common(a: Interval, b: Interval) -> int:
    return max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1)


def _disjoint(a: list[Interval]) -> bool:
    return all(x[1] < y[0] for x, y in zip(a, a[1:]))


def _meetings(a: list[Interval], b: list[Interval]) -> Iterator[tuple[int, int, int]]:
    """(place in a, place in b, common samples) of the pairs that meet, of two sorted lists of disjoint intervals, in one walk over both."""
    i = j = 0
    while i < len(a) and j < len(b):
        if n := _common(a[i], b[j]):
            yield i, j, n
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1


def matched(meetings: Iterable[tuple]) -> Iterator[tuple]:
    """Of meetings (a, b, weight, ...) in the order of such a walk, a choice of greatest total weight that takes no a and no b twice; of equal ones that of the earliest meetings.

    A meeting clashes with a run of meetings just before it alone, those of its a or those of its b, so one pass over each chain finds the best; memory follows the longest chain.
    """
    chain: list[tuple] = []
    best, before, run_a, run_b = [0], [], 0, 0  # best total of the first meetings; of each meeting, how many come before all that it clashes with

    def chosen() -> list[tuple]:
        out, k = [], len(chain)
        while k:
            if best[k] > best[k - 1]:
                out.append(chain[k - 1])
                k = before[k - 1]
            else:
                k -= 1
        return out[::-1]

    for m in meetings:
        same_a, same_b = bool(chain) and chain[-1][0] == m[0], bool(chain) and chain[-1][1] == m[1]
        if not same_a and not same_b:
            yield from chosen()
            chain, best, before = [], [0], []
        k = len(chain)
        run_a, run_b = run_a if same_a else k, run_b if same_b else k
        chain.append(m)
        before.append(min(run_a, run_b))
        best.append(max(best[-1], m[2] + best[before[-1]]))
    yield from chosen()


def event_prf(real: list[Interval], pred: list[Interval], threshold: float) -> tuple[float, float, float]:
    """Precision, recall and F1 of inclusive intervals: assigned pairs count where the common length reaches the share of the predicted (real) one, lengths as end minus start. Lists of disjoint intervals take time by their length, others by its cube."""
    a, b = sorted(real), sorted(pred)
    if _disjoint(a) and _disjoint(b):
        pairs = [(a[i], b[j]) for i, j, _ in matched(_meetings(a, b))]
    else:
        w = np.array([[_common(r, p) for p in pred] for r in real]).reshape(len(real), len(pred))
        pairs = [(real[i], pred[j]) for i, j in assignment(w) if w[i, j] > 0]
    right = lambda k: sum(min(r[1], p[1]) - max(r[0], p[0]) >= threshold * ((r, p)[k][1] - (r, p)[k][0]) for r, p in pairs)
    precision, recall = right(1) / len(pred) if pred else 0.0, right(0) / len(real) if real else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def event_hits(real: DataFrame, pred: DataFrame, pairs: DataFrame, thresholds: list[float], size: int = 64) -> DataFrame:
    """(real, pred, threshold, right_pred, right_real): the assigned pairs of events that event_prf counts, for each of pairs(real, pred) of labels that has any. real, pred: intervals(label, start, end inclusive), those of a label disjoint.

    Events are dealt to buckets of `size` samples to find those that meet. The events of a pair of labels are matched in one task, as they come in order; it holds one chain of them at a time.
    """
    cut = lambda x, n: x.join(F.broadcast(pairs), F.col("label") == F.col(n)).select("real", "pred", F.struct("start", "end").alias("a" if n == "real" else "b"), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("bucket"))
    low, high = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    met = cut(real, "real").join(cut(pred, "pred"), ["real", "pred", "bucket"]).where((low <= high) & (F.floor(low / size) == F.col("bucket")))
    rows = met.select("real", "pred", F.col("a.start").alias("a"), F.col("b.start").alias("b"), (high - low + 1).alias("n"), (F.col("a.end") - F.col("a.start")).alias("size_a"), (F.col("b.end") - F.col("b.start")).alias("size_b"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = []

        def meetings() -> Iterator[tuple]:
            for x in batches:
                schema[:] = [x.schema]
                real, pred, a, b, *rest = (c.to_pylist() for c in x.columns)
                yield from zip(zip(real, pred, a), zip(real, pred, b), *rest)

        found = matched(meetings())
        while part := list(itertools.islice(found, 10000)):
            cells = zip(*((*a, b[2], *rest) for a, b, *rest in part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema[0].types)], schema[0].names)

    each = rows.repartition("real", "pred").sortWithinPartitions("real", "pred", "a", "b").mapInArrow(choose, rows.schema)
    right = lambda length: F.sum((F.col("n") - 1 >= F.col("threshold") * F.col(length)).cast("long"))
    return each.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).groupBy("real", "pred", "threshold").agg(right("size_b").alias("right_pred"), right("size_a").alias("right_real"))


def averaged(pairs: list[tuple[int, float, float]], sizes: list[float], weighted: bool = False) -> tuple[float, float, float]:
    """Precision, recall and F1 of (real, precision, recall) pairs averaged over the real motifs: alike (1/N each, paired or not), or by their sizes."""
    total = sum(sizes)
    w = [(x / total if total else 0.0) if weighted else 1 / len(sizes) for x in sizes]
    out = np.zeros(3)
    for i, p, r in pairs:
        out += w[i] * np.array([p, r, 2 * p * r / (p + r) if p + r else 0.0])
    return tuple(float(x) for x in out)


def sample_score(overlap: np.ndarray, real: list[int], pred: list[int], weighted: bool = False) -> tuple[float, float, float]:
    """Mean sample precision, recall, F1 over real labels, paired by greatest overlap; real, pred: samples of each label. weighted: by number of real samples."""
    return averaged([(i, overlap[i, j] / pred[j] if pred[j] else 0.0, overlap[i, j] / real[i] if real[i] else 0.0) for i, j in assignment(overlap)], real, weighted) if len(real) else (0.0, 0.0, 0.0)


def event_score(real: list[tuple[list[Interval], set[int]]], pred: list[tuple[list[Interval], set[int]]], threshold: float | list[float], weighted: bool = False, dims: bool = False) -> tuple:
    """Mean event precision, recall, F1 over real motifs (events, dims), each paired with a predicted one by common samples (times the Jaccard index of dims if `dims`). Real motifs without a pair count 0, predicted ones don't count; weighted by number of real events. dims: precision, recall, F1 of dims too. A list of thresholds gives a list of such results."""
    if isinstance(threshold, (list, tuple, np.ndarray)):
        return [event_score(real, pred, float(t), weighted, dims) for t in threshold]
    if not real or not pred:
        return (0.0,) * (6 if dims else 3)
    own = [[d for _, d in x] for x in (real, pred)]
    pairs = motif_pairs(np.array([[_shared(x, y) for y, _ in pred] for x, _ in real]), *own, dims)
    return motif_means([(i, j, *event_prf(real[i][0], pred[j][0], threshold)[:2]) for i, j in pairs], [len(ev) for ev, _ in real], *own, weighted, dims)


def motif_pairs(shared: np.ndarray, real: list[set[int]], pred: list[set[int]], dims: bool) -> list[tuple[int, int]]:
    """Real and predicted motifs (their dims) paired by common samples, times the Jaccard index of dims if `dims`."""
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    return assignment(shared * np.array([[jac(c, d) if dims else 1 for d in pred] for c in real]))


def motif_means(pairs: list[tuple[int, int, float, float]], sizes: list[int], real: list[set[int]], pred: list[set[int]], weighted: bool, dims: bool) -> tuple:
    """event_score's means of pairs (real, pred, precision, recall); sizes: events of each real motif."""
    out = averaged([(i, p, r) for i, _, p, r in pairs], sizes, weighted)
    if dims:
        part = lambda a, b: len(a & b) / len(b) if b else 0.0
        out += averaged([(i, part(real[i], pred[j]), part(pred[j], real[i])) for i, j, *_ in pairs], sizes, weighted)
    return out


def _shared(a: list[Interval], b: list[Interval]) -> int:
    """Common samples of two lists of disjoint intervals."""
    return sum(n for *_, n in _meetings(sorted(a), sorted(b)))


def multivariate_overlap(a: dict[int, Interval], b: dict[int, Interval]) -> float:
    """The least intersection over hull of two occurrences (dim: start, end exclusive) over their dims; a dim that one lacks has 0."""
    if not a or a.keys() != b.keys():
        return 0.0
    return min(max(0, min(a[d][1], b[d][1]) - max(a[d][0], b[d][0])) / (max(a[d][1], b[d][1]) - min(a[d][0], b[d][0])) for d in a)


def subspaces_overlap(a: set[int], b: set[int], threshold: float) -> bool:
    """Whether the Jaccard index of two sets of dims reaches the threshold."""
    return bool(a | b) and len(a & b) >= threshold * len(a | b)


def best_matches(overlaps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(gt, occ, disc): every ground-truth occurrence's discovered set of greatest rate, if above the threshold; of equals the smallest. overlaps(gt, occ, disc, rate)."""
    best = overlaps.where(F.col("rate") > threshold).groupBy("gt", "occ").agg(F.max_by("disc", F.struct("rate", (-F.col("disc")).alias("d"))).alias("disc"))
    return best


def set_scores(matrix: np.ndarray, missed: np.ndarray, spurious: np.ndarray, off_target: bool = False) -> dict[str, float]:
    """Micro and macro precision, recall, F1 of a matching matrix (ground truth x discovered) with unmatched margins, after the assignment of greatest diagonal. off_target: discovered sets without a partner count as wrong. Means are over the paired sets (precision), the real ones (recall, and F1 where fewer are discovered)."""
    g, d = matrix.shape
    pairs = assignment(matrix)
    hit = sum(matrix[i, j] for i, j in pairs)
    cols = list(range(d)) if off_target else [j for _, j in pairs]
    found = matrix[:, cols].sum() + spurious[cols].sum() if cols else 0
    gold = matrix.sum() + missed.sum()
    p, r = hit / found if found else 0.0, hit / gold if gold else 0.0
    each = []
    for i, j in pairs:
        pi = matrix[i, j] / (matrix[:, j].sum() + spurious[j]) if matrix[:, j].sum() + spurious[j] else 0.0
        ri = matrix[i, j] / (matrix[i].sum() + missed[i]) if matrix[i].sum() + missed[i] else 0.0
        each.append((pi, ri, 2 * pi * ri / (pi + ri) if pi + ri else 0.0))
    mine, m = np.array(each).reshape(-1, 3).sum(0), min(g, d)
    found_sets = d if off_target else m
    over = (found_sets, g, found_sets if d >= g else g)
    macro = [float(x / n) if n else 0.0 for x, n in zip(mine, over)]
    return {"micro_precision": p, "micro_recall": r, "micro_f1": 2 * p * r / (p + r) if p + r else 0.0, "macro_precision": macro[0], "macro_recall": macro[1], "macro_f1": macro[2]}


def adjusted_mutual_information(table: np.ndarray) -> float:
    """AMI (arithmetic mean of entropies) of a contingency table of two labelings."""
    n = table.sum()
    a, b = table.sum(1), table.sum(0)
    entropy = lambda x: -sum(v / n * math.log(v / n) for v in x if v)
    mi = sum(table[i, j] / n * math.log(n * table[i, j] / (a[i] * b[j])) for i, j in zip(*np.nonzero(table)))
    lg, expected = math.lgamma, 0.0
    for x in a:
        for y in b:
            for k in range(int(max(1, x + y - n)), int(min(x, y)) + 1):
                p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                expected += k / n * math.log(n * k / (x * y)) * math.exp(p)
    top = (entropy(a) + entropy(b)) / 2 - expected
    return (mi - expected) / top if abs(top) > 1e-12 else 1.0


def tied(matrix: np.ndarray) -> bool:
    """Whether another column could take a row's place on the assigned diagonal at no loss (more columns than rows)."""
    pairs = assignment(matrix)
    return matrix.shape[0] < matrix.shape[1] and any((matrix[i] == matrix[i, j]).sum() > 1 for i, j in pairs)


def break_ties(matrix: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of greatest diagonal; of equal ones that with the fewest occurrences of other rows in the assigned columns."""
    others = matrix.sum(0) - matrix
    return assignment(matrix * (others.sum() + 1.0) - others)
