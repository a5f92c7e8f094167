"""Queries over the given tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import kernels, windows
from recurra.operators import checks, extract, graph, mdl, metrics, neighbours, pan, search, warped
from recurra.operators import persistence as ps
from recurra.plans import methods, synthetic
from recurra.sources import signals as sg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def emb_query(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Registers f over the vectors, an element a dim."""
    QUERIES[f.__name__] = lambda spark, d: f(sg.emb(spark, d))
    return f


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(c, n).alias(c)


# ---- windows


@query
def win_mean_std(spark, d):
    return windows.windows(sg.ev_signal(spark, d), 24, "mean", "std").select("dim", "i", _r("mean"), _r("std", 4))


@query
def win_slope_resid(spark, d):
    return windows.windows(sg.ev_signal(spark, d), 24, "slope", "eta").select("dim", "i", _r("slope"), _r("eta", 4))


@query
def win_energy(spark, d):
    return windows.windows(sg.ev_signal(spark, d), 24, "energy").select("dim", "i", _r("energy", 4))


@query
def win_minmax(spark, d):
    return windows.windows(sg.li_day(spark, d), 28, "low", "high")


@query
def win_constant(spark, d):
    return windows.windows(sg.with_holes(sg.li_day(spark, d)), 7, "constant", "finite")


@query
def win_constant_override(spark, d):
    """Constancy with some windows declared constant and others not."""
    k = F.col("t") % 50
    s = sg.with_holes(sg.li_day(spark, d)).withColumn("told", F.when(k < 5, True).when(k < 25, False))
    return windows.windows(s, 7, "constant", override="told")


@query
def win_nan_rules(spark, d):
    """Statistics that pass over missing and infinite samples, and those that need whole windows."""
    w = windows.windows(sg.with_holes(sg.li_day(spark, d)), 7, "nan_std", "nan_low", "nan_high", "valid_mean", "valid_std")
    return w.select("dim", "i", _r("nan_std", 3), "nan_low", "nan_high", _r("valid_mean", 3), _r("valid_std", 3))


# ---- signals


@emb_query
def znorm_signal(sig):
    return sg.z_normalise(sig).select("dim", "t", _r("v"))


@query
def znorm_windows(spark, d):
    w = windows.windows(sg.ord_week(spark, d), 8, "mean", "std", "x")
    z = windows.z_norm(F.col("x"), F.col("mean"), F.col("std"))
    return w.select("dim", "i", F.round(F.aggregate(z, F.lit(0.0), lambda a, e: a + F.abs(e)), 5).alias("weight"))


@query
def block_max_downsample(spark, d):
    return sg.block_max(sg.li_day(spark, d), 28)


@query
def reindex_positions(spark, d):
    s = sg.ord_week(spark, d)
    return sg.reindex(s, s.select("t").distinct().withColumn("day", F.col("t") * 7)).select("dim", "t", "day", "v")


@query
def dimension_subset(spark, d):
    return sg.take_dims(sg.ev_signal(spark, d), [4, 1])


@query
def idle_mask(spark, d):
    s = sg.ord_week(spark, d)
    o = Window.partitionBy("dim").orderBy("t").rowsBetween(-3, 3)
    cut = s.select(F.round(F.var_pop("v").over(o), 9).alias("s")).agg(F.percentile("s", F.lit(0.6))).first()[0]
    return sg.idle_mask(s, 3, cut if cut is not None else 0.0)


@query
def start_mask(spark, d):
    s = sg.ord_week(spark, d)
    return sg.start_mask(s, s.select("t", (F.col("t") % 5 == 0).alias("idle")).distinct(), 0.1)


# ---- distances


def _closest(name: str, metric: str, w: int, multi: bool) -> None:
    QUERIES[name] = lambda spark, d: neighbours.closest_pairs(sg.ord_week(spark, d) if multi else sg.ev_signal(spark, d), w, metric, 100, multi)


for _name, _metric in (("dist_znorm", "znorm"), ("dist_unit", "unit"), ("dist_detrended", "detrended")):
    _closest(_name, _metric, 24, False)
for _name, _metric in (("dist_mv_unit", "unit"), ("dist_mv_detrended", "detrended"), ("dist_mv_raw", "raw")):
    _closest(_name, _metric, 8, True)


def distance_profile(sig: DataFrame, w: int, place: int) -> DataFrame:
    """(dim, i, d): z-normed distance of every window to the one at `place`, with the rules for constant windows (both: 0, one: root of w)."""
    return search.profile(sig, search.query_at(sig, w, place), w)


@emb_query
def query_profile(sig):
    return distance_profile(sig, 16, 100).select("dim", "i", _r("d", 4))


@emb_query
def query_profile_pnorm(sig):
    return search.profile(sig, search.query_at(sig, 16, 100), 16, "pnorm", 3.0).select("dim", "i", _r("d", 5))


def _match(sig: DataFrame, place: int, zone: int) -> DataFrame:
    """Matches of a window by mean distance over dims, at most mean - 2 sd (at least the least), greedily apart."""
    p = distance_profile(sig, 16, place).groupBy("i").agg(F.round(F.avg("d"), 4).alias("d"))
    cut = p.agg(F.greatest(F.avg("d") - 2 * F.stddev_pop("d"), F.min("d")).alias("cut"))
    near = p.join(F.broadcast(cut)).where("d <= cut")  # one row
    return greedy(near, zone)


@query
def query_match(spark, d):
    """Windows of 16 hours like that from hour 200 on, over all event types."""
    return _match(sg.ev_signal(spark, d), 200, 4)


@query
def query_match_whole(spark, d):
    """The same of the vectors' elements."""
    return _match(sg.emb(spark, d), 100, 4)


def greedy(found: DataFrame, zone: int) -> DataFrame:
    """(i, d) kept in order of (d, i), each more than `zone` from those kept before; found is what a threshold left."""
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.struct("d", "i"))), F.array().cast("array<struct<d:double,i:bigint>>"), lambda acc, y: F.when(F.forall(acc, lambda z: F.abs(z["i"] - y["i"]) > zone), F.concat(acc, F.array(y))).otherwise(acc)
    )
    return found.agg(kept.alias("k")).select(F.explode("k").alias("k")).select("k.i", "k.d")


def _nn(spark, d) -> DataFrame:
    return neighbours.knn(sg.ev_signal(spark, d), 24)


@query
def ktanh_transform(spark, d):
    return _nn(spark, d).select("dim", "i", F.round(windows.squash(F.col("d")), 6).alias("d"))


# ---- neighbours


@query
def knn1_profile(spark, d):
    """The ten windows of each event type nearest to another window at least a window apart."""
    order = Window.partitionBy("dim").orderBy("d", "i")
    return _nn(spark, d).withColumn("n", F.row_number().over(order)).where("n <= 10").select("dim", "i", "j", "d")


@query
def knn_k_exclusion(spark, d):
    return neighbours.knn(sg.ord_week(spark, d), 8, 3)


@query
def profile_from_neighbours(spark, d):
    sig = sg.ev_signal(spark, d)
    win = windows.windows(sig, 24, "mean", "std", "x")
    a, b = (win.select("dim", F.col("i").alias(k), *(F.col(c).alias(k + c) for c in ("mean", "std", "x"))) for k in "ij")
    dot = F.aggregate(F.zip_with("ix", "jx", lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    square = F.greatest(F.lit(0.0), 48 * (1 - (dot - 24 * F.col("imean") * F.col("jmean")) / (24 * F.col("istd") * F.col("jstd"))))
    return _nn(spark, d).select("dim", "i", "j").join(a, ["dim", "i"]).join(b, ["dim", "j"]).select("dim", "i", "j", F.round(F.sqrt(square), 4).alias("d"))


@query
def filtration_edges(spark, d):
    return neighbours.filtration(_nn(spark, d))


def _k_dims(spark, d, keep: Callable, schema: str) -> DataFrame:
    return neighbours.per_pair(sg.ord_week(spark, d), 8, "znorm", keep, schema)


@query
def kdim_profile(spark, d):
    def make(x: np.ndarray, a: int) -> dict[str, np.ndarray]:
        s = np.cumsum(np.sort(x, 0), 0) / (np.arange(len(x)) + 1)[:, None, None]
        s[:, np.abs(np.arange(x.shape[2]) - (a + np.arange(x.shape[1]))[:, None]) <= 2] = np.nan
        best = np.fmin.reduce(np.round(s, 5), 2)
        k, i = np.nonzero(~np.isnan(best))
        return {"k": k, "i": i + a, "d": best[k, i]}

    return _k_dims(spark, d, make, "k long, i long, d double")


@query
def subspace_of_pair_whole(spark, d):
    """The dims of every pair of different windows, nearest first."""

    def make(x: np.ndarray, a: int) -> dict[str, np.ndarray]:
        order = np.argsort(x, 0, kind="stable")
        ok = ~np.isnan(np.take_along_axis(x, order, 0))
        ok &= np.arange(x.shape[1])[:, None] + a != np.arange(x.shape[2])
        k, p, q = np.nonzero(ok)
        return {"k": k, "i": p + a, "j": q, "dim": order[k, p, q].astype(np.int32)}

    return _k_dims(spark, d, make, "k long, i long, j long, dim int")


@query
def subspace_of_pair(spark, d):
    """The rows of subspace_of_pair_whole that the SQL takes: 1 of 1,600 pairs."""
    return subspace_of_pair_whole(spark, d).where("i % 40 = 0 and j % 40 = 20")


@query
def mdl_bits(spark, d):
    win = windows.windows(sg.ord_week(spark, d), 8, "mean", "std", "x").withColumn("z", windows.z_norm(F.col("x"), F.col("mean"), F.col("std")))
    a, b = win.where("i = 10").select("dim", F.col("z").alias("x")), win.where("i = 100").select("dim", F.col("z").alias("y"))
    both = a.join(b, "dim").withColumn("d", F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    ranked = both.withColumn("r", F.row_number().over(Window.orderBy("d", "dim")) - 1)  # one row a dim
    pairs = ranked.withColumn("k", F.explode(F.sequence("r", F.lit(4)))).withColumn("n_dims", F.lit(5))
    return mdl.description_bits(pairs.select(F.col("k").cast("long").alias("k"), "dim", "x", "y", "n_dims")).select("k", _r("bits"))


def _ab(spark, d, flip: bool) -> DataFrame:
    def make(batches):
        import pyarrow as pa

        for r in neighbours.rows_of(batches):
            s = [kernels.Series(x, 24) for x in (r["x"][4], r["x"][0])[:: 1 if flip else -1]]
            for a, z in neighbours.blocks(r, len(s[1].windows)):
                best = np.fmin.reduce(np.round(np.sqrt(kernels.squared(s[0], a, z, "znorm", s[1])), 5), 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, z)), pa.array(best, from_pandas=True)], ["i", "d"])

    return neighbours.by_part(neighbours.stacked(sg.ev_signal(spark, d)), 24, F.size(F.col("x")[0])).mapInArrow(make, "i long, d double")


@query
def ab_join_profile(spark, d):
    """Nearest window of the last event type for each window of the first."""
    return _ab(spark, d, False)


@query
def mpdist(spark, d):
    """The (5 % of all samples + 1)-th smallest of both join profiles."""
    both = _ab(spark, d, False).unionByName(_ab(spark, d, True)).where("d is not null")
    k = 1 + int(np.ceil(0.05 * sg.ev_signal(spark, d).where("dim in (0, 4)").count()))
    return both.orderBy("d").limit(k).agg(F.max("d").alias("distance"))


@query
def topk_merge(spark, d):
    """The best three different neighbours of all dims' lists together."""
    both = neighbours.knn(sg.ord_week(spark, d), 8, 3).select("i", "j", "d").distinct()
    return both.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where("n <= 3").drop("n")


@query
def pan_contrast(spark, d):
    """Sigmoid of the percentile rank of the nearest distance, and its binary form; ranks from counts by value, so only distinct distances are sorted together."""
    nn = _nn(spark, d)
    by = nn.groupBy("d").agg(F.count("*").alias("c"))
    ranked = by.select("d", (F.sum("c").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1))).alias("below"), F.sum("c").over(Window.partitionBy()).alias("n"))
    r = F.coalesce("below", F.lit(0)) / (F.col("n") - 1)
    return nn.join(ranked, "d").select("dim", "i", F.round(1 / (1 + F.exp(-10 * (r - 0.2))), 6).alias("contrast"), (r <= 0.2).alias("on"))


#: Window lengths of the pan profile, in hours.
LENGTHS = (8, 12, 16, 20, 24, 28, 32)


@query
def pan_profile(spark, d):
    """The nearest neighbour of every window of each event type at every length."""
    return pan.pan_profile(sg.ev_signal(spark, d), LENGTHS)


@query
def pan_length_contrast(spark, d):
    """Contrast over lengths and places."""
    return pan.contrast(pan.pan_profile(sg.ev_signal(spark, d), LENGTHS))


@query
def pan_partial(spark, d):
    """Contrast after three lengths of the tree, spread over all lengths."""
    return pan.spread(pan.contrast(pan.pan_profile(sg.ev_signal(spark, d), LENGTHS, 3)), LENGTHS, 3)


# ---- persistence


@query
def node_births(spark, d):
    return ps.births(neighbours.filtration(_nn(spark, d)))


@query
def otsu_birth_cut(spark, d):
    return ps.otsu_cut(ps.births(neighbours.filtration(_nn(spark, d))), "birth").select(_r("cut"))


@query
def persistence_gap_cut(spark, d):
    return ps.gap_cut(_nn(spark, d), "d").select(_r("cut"))


@query
def persistence_diagram(spark, d):
    return ps.persistence(ps.squashed(neighbours.filtration(_nn(spark, d)), "w")).select("dim", _r("birth"), _r("death"), "cluster")


@query
def threshold_components(spark, d):
    return ps.components(neighbours.filtration(_nn(spark, d)), 1.0, 0.1).select("dim", "pos", "root", _r("birth"))


@query
def candidate_ranks(spark, d):
    e = neighbours.filtration(_nn(spark, d))
    parts = ps.components(e, 1.0, 0.1)
    return ps.ranks(ps.candidates(parts), ps.births(e)).select("cand", "pos", _r("rank"))


# ---- candidates as sets


def example_candidates(spark, d) -> DataFrame:
    """Hours in which an event type exceeds its 80th and 90th percentile, and a thinned copy for two types."""
    s = sg.ev_signal(spark, d)
    s = s.join(s.groupBy("dim").agg(F.percentile("v", F.lit(0.8)).alias("c8"), F.percentile("v", F.lit(0.9)).alias("c9")), "dim")
    c = F.array_compact(F.array(F.when(F.col("v") > F.col("c8"), 8), F.when(F.col("v") > F.col("c9"), 9), F.when(F.col("dim").isin(0, 1) & (F.col("v") > F.col("c8")) & (F.col("t") % 97 != 3), 7)))
    return s.select("dim", "t", F.explode(c).alias("c")).groupBy("dim", "c").agg(F.array_sort(F.collect_list("t")).alias("positions")).select(F.concat_ws(":", F.col("dim").cast("string"), F.col("c").cast("string")).alias("cand"), F.array("dim").alias("dims"), "positions")


@query
def overlap_graph(spark, d):
    return graph.overlap_graph(example_candidates(spark, d)).select("src", "dst", _r("weight"))


def _scc(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = example_candidates(spark, d)
    e = graph.overlap_graph(c)
    return c, e, graph.scc(c, e)


@query
def scc_merge(spark, d):
    c, _, m = _scc(spark, d)
    return graph.scc_merge(c, m).select("cand", F.array_join("dims", ",").alias("dims"), F.size("positions").cast("long").alias("n_positions"))


@query
def scc_roles(spark, d):
    _, e, m = _scc(spark, d)
    return graph.roles(m, e)


@query
def coverage(spark, d):
    c, _, m = _scc(spark, d)
    return graph.coverage(graph.scc_merge(c, m))


@query
def optimal_n(spark, d):
    c, _, m = _scc(spark, d)
    return graph.optimal_n(graph.coverage(graph.scc_merge(c, m)))


@query
def sinks_ancestors(spark, d):
    c = example_candidates(spark, d)
    return graph.sinks_ancestors(c, graph.overlap_graph(c))


@query
def split_sets(spark, d):
    c = example_candidates(spark, d)
    s = graph.sinks_ancestors(c, graph.overlap_graph(c)).select("sink", "ancestor")
    return graph.split_sets(c, s).select("sink", "ancestor", "part", F.size("positions").cast("long").alias("n_positions"))


@query
def segments_scored(spark, d):
    return extract.segments(example_candidates(spark, d), 3)


# ---- evaluation


def _masks(spark, d) -> tuple[DataFrame, DataFrame]:
    e = sg.table(spark, d, "embeddings")
    real = e.select("label", F.col("vec_id").alias("t"))
    first = e.where((F.col("embedding")[0] > 0) & (F.col("label") < 8)).select("label", F.col("vec_id").alias("t"))
    second = e.where((F.col("embedding")[1] > 0.1) & (F.col("label") < 9)).select("label", (F.col("vec_id") + 1).alias("t"))
    return real, first.union(second).distinct()


def _events(mask: DataFrame) -> DataFrame:
    iv = metrics.mask_to_intervals(mask)
    return iv.select("label", (F.col("label") * 100000 + F.col("start") - 1).cast("long").alias("id"), (F.col("start") - 1).alias("start"), "end")


def _labelled_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gt, occ, disc, rate). Numbers of events are unique within a label only, so labels go with them through the join."""
    a, b = (x.withColumn("id", F.struct("label", "id")) for x in (a, b))
    return metrics.interval_overlaps(a, b).select(F.col("a.label").alias("gt"), F.col("a.id").alias("occ"), F.col("b.label").alias("disc"), "rate")


@query
def mask_to_intervals(spark, d):
    return metrics.mask_to_intervals(_masks(spark, d)[0])


@query
def sample_prf(spark, d):
    return metrics.sample_prf(*_masks(spark, d)).select("label", _r("precision"), _r("recall"), _r("f1"))


@query
def overlap_matrix(spark, d):
    return metrics.overlap_matrix(*_masks(spark, d))


@query
def interval_overlap(spark, d):
    a, b = (_events(m) for m in _masks(spark, d))
    return metrics.interval_overlaps(a, b).select("a", "b", _r("rate"))


@query
def gt_best_match(spark, d):
    return metrics.best_matches(_labelled_overlaps(*(_events(m) for m in _masks(spark, d))))


def _dim_prf(s: DataFrame) -> DataFrame:
    sets = lambda x: x.groupBy((F.col("t") % 50).alias("motif")).agg(F.collect_set("dim").alias("dims"))
    out = metrics.dim_prf(sets(s.where("v > 0 and t < 400")), sets(s.where("v > 50 and t >= 400")))
    return out.select("motif", *(_r(c) for c in ("precision", "recall", "f1", "jaccard")))


@query
def dim_prf(spark, d):
    """Dims of the hours before 400 against those of all later hours."""
    return _dim_prf(sg.ev_signal(spark, d))


@query
def start_end_masks(spark, d):
    e = sg.table(spark, d, "embeddings")
    return extract.mask(e.select(F.col("label").cast("int").alias("motif"), F.col("vec_id").alias("start"), (F.col("vec_id") + 3).alias("end")))


@query
def event_scores(spark, d):
    """Event precision, recall and F1 at several thresholds, macro and weighted; with dims in the pairing, those of dims too. Counts alone come to the driver, no events."""
    real, pred = (m.distinct() for m in _masks(spark, d))
    events = [metrics.mask_to_intervals(m) for m in (real, pred)]
    size = [dict(x.groupBy("label").count().collect()) for x in events]
    a, b = sorted(size[0]), sorted(size[1])
    shared = np.zeros((len(a), len(b)), np.int64)
    for r in metrics.overlap_matrix(real, pred).collect():
        shared[a.index(r["real"]), b.index(r["pred"])] = r["n"]
    own, thresholds = [[{x % 3, 3} for x in y] for y in (a, b)], (0.25, 0.5, 0.75)
    pairs = [metrics.motif_pairs(shared, *own, dm) if shared.size else [] for dm in (False, True)]
    label = real.schema["label"].dataType.simpleString()
    both = spark.createDataFrame(sorted({(a[i], b[j]) for p in pairs for i, j in p}), f"real {label}, pred {label}")
    hits = {r[:3]: r[3:] for r in metrics.event_hits(*events, both, thresholds).collect()}

    def means(th, wt, dm):
        right = [(i, j, *hits.get((a[i], b[j], th), (0, 0))) for i, j in pairs[dm]]
        found = [(i, j, p / size[1][b[j]], r / size[0][a[i]]) for i, j, p, r in right]
        return metrics.motif_means(found, [size[0][x] for x in a], *own, wt, dm) if found else (0.0,) * (6 if dm else 3)

    rows = [(th, wt, dm, *(round(x, 6) for x in means(th, wt, dm)), *([None] * 3 * (not dm))) for th in thresholds for wt in (False, True) for dm in (False, True)]
    return spark.createDataFrame(rows, "threshold double, weighted boolean, with_dims boolean, precision double, recall double, f1 double, dim_precision double, dim_recall double, dim_f1 double")


@query
def sample_scores(spark, d):
    """Sample precision, recall, F1 of the labels assigned by greatest overlap, and their means alike (real -1) and by size (real -2)."""
    real, pred = _masks(spark, d)
    rows = metrics.overlap_matrix(real, pred).collect()
    size = [dict(m.groupBy("label").count().collect()) for m in (real, pred)]
    a, b = sorted(size[0]), sorted(size[1])
    w = np.zeros((len(a), len(b)))
    for r in rows:
        w[a.index(r["real"]), b.index(r["pred"])] = r["n"]
    out = [(int(a[i]), int(b[j]), float(w[i, j] / size[1][b[j]]), float(w[i, j] / size[0][a[i]]), float(2 * w[i, j] / (size[0][a[i]] + size[1][b[j]]))) for i, j in metrics.assignment(w)]
    out += [(-1 - k, -1, *metrics.sample_score(w, [size[0][x] for x in a], [size[1][x] for x in b], k == 1)) for k in (0, 1)]
    return spark.createDataFrame(out, "real int, pred int, precision double, recall double, f1 double")


@query
def set_scores(spark, d):
    """Micro and macro scores of the matching matrix, and adjusted mutual information of the labelings."""
    a, b = (_events(m) for m in _masks(spark, d))
    hit = metrics.best_matches(_labelled_overlaps(a, b)).groupBy("gt", "disc").count().collect()
    n = [dict(x.groupBy("label").count().collect()) for x in (a, b)]
    g, k = sorted(n[0]), sorted(n[1])
    m = np.zeros((len(g), len(k)))
    for r in hit:
        m[g.index(r["gt"]), k.index(r["disc"])] = r["count"]
    margins = np.array([n[0][x] for x in g]) - m.sum(1), np.maximum(np.array([n[1][x] for x in k]) - m.sum(0), 0)
    s = metrics.set_scores(m, *margins) | {f"{key}_off_target": v for key, v in metrics.set_scores(m, *margins, off_target=True).items()}
    s["ami"] = metrics.adjusted_mutual_information(m) if m.any() else 0.0
    return spark.createDataFrame([(key, float(v)) for key, v in s.items()], "score string, value double")


# ---- methods


def _found(spark, f: methods.Found) -> DataFrame:
    rows = [(m, ",".join(map(str, x.dims)), int(a), int(z)) for m, x in enumerate(f.motifs) for a, z in x.spans]
    return spark.createDataFrame(rows, "motif int, dims string, start long, end long")


#: Weekly orders by priority hold motifs at every size; hourly events are noise, in which the automatic cuts rightly find none.
MAIN = dict(wlen=8, max_wlen=12, n_patterns=3)


@query
def coordinated_motifs(spark, d):
    return _found(spark, methods.LinkedMotifs(**MAIN).fit(sg.ord_week(spark, d)))


@query
def retuned_motifs(spark, d):
    """Under other cuts and numbers, from one neighbour search."""
    with methods.LinkedMotifs(**MAIN).prepared(sg.ord_week(spark, d)) as tail:
        found = [tail.found(), tail.found(n_patterns=2), tail.found(ratio=0.8)]
    return spark.createDataFrame([(k, m, ",".join(map(str, x.dims)), len(x.spans)) for k, f in enumerate(found) for m, x in enumerate(f.motifs)], "run int, motif int, dims string, n int")


@query
def sdim_motifs_auto_radius(spark, d):
    """One reference, within mean - 2 sd of its distances."""
    return _found(spark, methods.sdim_motifs(sg.ord_week(spark, d), 8, 2, ratio=None, single=True))


@query
def sdim_motifs(spark, d):
    return _found(spark, methods.sdim_motifs(sg.ord_week(spark, d), 8, 2))


@query
def multidim_motifs(spark, d):
    return _found(spark, methods.multidim_motifs(sg.ord_week(spark, d), 8, 2))


@query
def leitmotifs(spark, d):
    return _found(spark, methods.leitmotifs(sg.ord_week(spark, d), [8, 12], 2))


@query
def principal_motifs(spark, d):
    return _found(spark, methods.principal_motifs(sg.ord_week(spark, d), [8], 2))


@query
def subspace_merge(spark, d):
    sets = methods.subspace_motifs(sg.ord_week(spark, d), 8, 0.5)
    rows = [(k, n, int(dim), int(a), int(z)) for k, s in enumerate(sets) for n, o in enumerate(s.occurrences) for dim, (a, z) in sorted(o.items())]
    return spark.createDataFrame(rows, "set_id int, occ_id int, dim int, start long, end long")


@query
def synthetic_signal(spark, d):
    return synthetic.signals(spark, 4, seed=7)


# ---- checks and small operators


@query
def signal_checks(spark, d):
    return checks.signal_checks(sg.with_holes(sg.li_day(spark, d)).where("t % 1000 <> 999 or dim <> 1"))


@query
def distances_too_small(spark, d):
    return checks.too_small(_nn(spark, d), 0.5)


@emb_query
def dist_single(sig):
    """z-normed distance of one pair of windows per dim."""
    return distance_profile(sig, 16, 100).where("i = 40").select("dim", _r("d", 4))


@emb_query
def sliding_dot(sig):
    return search.profile(sig, search.query_at(sig, 16, 5), 16, "dot").select("dim", "i", F.round("d", 6).alias("qt"))


@query
def distance_matrix_whole(spark, d):
    """Distances of every window of every dim to every window of every dim (p-norm, p = 2)."""

    def make(batches):
        import pyarrow as pa

        for r in neighbours.rows_of(batches):
            parts = [kernels.Series(x, 8) for x in r["x"]]
            m = len(parts[0].windows)
            for a, z in neighbours.blocks(r, m):
                for p, one in enumerate(parts):
                    for q, other in enumerate(parts):
                        v = np.round(np.sqrt(kernels.squared(one, a, z, "raw", other)), 6).ravel()
                        columns = [np.full(len(v), p, np.int32), np.full(len(v), q, np.int32), np.repeat(np.arange(a, z), m), np.tile(np.arange(m), z - a), v]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim_i", "dim_j", "i", "j", "d"])

    return neighbours.by_part(neighbours.stacked(sg.ord_week(spark, d)), 8, F.size(F.col("x")[0])).mapInArrow(make, "dim_i int, dim_j int, i long, j long, d double")


@query
def distance_matrix(spark, d):
    """A part of distance_matrix_whole, as the SQL has it. Distances of every window of one signal's first dim to every tenth window of the last (p-norm, p = 2)."""
    win = windows.windows(sg.ord_week(spark, d), 8, "x")
    a, b = win.where("dim = 0").select("i", "x"), win.where("dim = 4 and i % 10 = 0").select(F.col("i").alias("j"), F.col("x").alias("y"))
    s = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, e: acc + e)
    return a.join(F.broadcast(b)).select("i", "j", F.round(F.sqrt(s), 6).alias("d"))  # a stated query set: every tenth window


@emb_query
def replace_distance(sig):
    return distance_profile(sig, 16, 100).select("dim", "i", F.round(windows.replace_distance(F.round("d", 4), 0.0, -1.0), 4).alias("d"))


@emb_query
def pair_neighbours(sig):
    """Windows nearer to one of two references than 0.98 times the distance between these, greedily a window apart."""
    p = distance_profile(sig, 16, 100).groupBy("i").agg(F.avg("d").alias("a")).join(distance_profile(sig, 16, 300).groupBy("i").agg(F.avg("d").alias("b")), "i")
    cut = p.where("i = 300").select((F.col("a") * 0.98).alias("cut"))
    near = p.select("i", F.round(F.least("a", "b"), 4).alias("d")).join(F.broadcast(cut)).where("d < cut").drop("cut")  # one row
    return greedy(near, 15)


@query
def subspace_include(spark, d):
    """Dims of a pair in order, two of them included first."""
    return checks.include_order(distance_profile(sg.ord_week(spark, d), 8, 10).where("i = 100").select("dim", F.round("d", 6).alias("d")), [3, 1])


@query
def subspace_discords(spark, d):
    """Dims of a pair, one included first, then the farthest first."""
    return checks.include_order(distance_profile(sg.ord_week(spark, d), 8, 10).where("i = 100").select("dim", F.round("d", 6).alias("d")), [3], discords=True)


@query
def equal_dims(spark, d):
    """Whether the first event type's series equals itself, and each other type's."""
    s = sg.ev_signal(spark, d)
    first = s.where("dim = 0").select("t", "v")
    out = None
    for k in range(5):
        one = checks.equal_series(first, s.where(F.col("dim") == k).select("t", "v")).select(F.lit(k).alias("dim"), "equal")
        out = one if out is None else out.unionByName(one)
    return out


@query
def total_coverage(spark, d):
    c, _, m = _scc(spark, d)
    return graph.total_coverage(graph.coverage(graph.scc_merge(c, m)), 3)


@query
def relabelled(spark, d):
    return checks.relabel(example_candidates(spark, d))


@query
def run_islands(spark, d):
    return checks.islands(sg.ev_signal(spark, d).select("dim", "t", (F.col("v") > 0).alias("on")), "dim")


@query
def linkage_rates(spark, d):
    """Mean and least overlap rate over all pairs of dims of two motifs' occurrences: of vectors 2 k and 2 k + 1, all elements."""
    e = sg.table(spark, d, "embeddings").select(F.col("vec_id").alias("m"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 10)).alias("s"))
    a, b = e.where("m % 2 = 0").select((F.col("m") / 2).cast("long").alias("k"), "s"), e.where("m % 2 = 1").select(F.floor(F.col("m") / 2).alias("k"), F.col("s").alias("t"))
    rate = lambda x, y: F.greatest(F.lit(0), F.least(x, y) + 20 - F.greatest(x, y)) / (F.greatest(x, y) + 20 - F.least(x, y))
    rates = a.join(b, "k").select("k", F.flatten(F.transform("s", lambda x: F.transform("t", lambda y: rate(x, y)))).alias("r")).where("size(r) > 0")
    mean = F.aggregate("r", F.lit(0.0), lambda acc, y: acc + y) / F.size("r")
    return rates.select("k", F.round(mean, 6).alias("average"), F.round(F.array_min("r"), 6).alias("complete"))


@query
def set_spans(spark, d):
    """Start and end over all dims of each occurrence of subspace motifs, as one interval: the weeks in which two or more priorities have more orders than a quarter above their mean, each dim with the run that it has there."""
    s = sg.ord_week(spark, d)
    on = s.join(F.broadcast(s.groupBy("dim").agg(F.avg("v").alias("m"))), "dim").where("v > 1.25 * m").select(F.col("dim").alias("label"), "t")  # one row a dim
    runs = metrics.mask_to_intervals(on).select(F.col("label").alias("dim"), (F.col("start") - 1).alias("start"), "end")
    peaks = on.groupBy("t").agg(F.count("*").alias("n")).where("n >= 2").select("t", (F.col("n") - 2).cast("int").alias("motif"))
    parts = peaks.join(runs, (F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
    return parts.groupBy("motif", F.col("t").alias("occ")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


@query
def warped_motifs(spark, d):
    return warped.warped_motifs(sg.ord_week(spark, d), 8, 16)


@query
def synthetic_truth(spark, d):
    return synthetic.truth(spark, 4, seed=7)
