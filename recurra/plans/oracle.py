"""SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from recurra.operators.mdl import bin_edges

EV = """ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS dim FROM (SELECT DISTINCT event_type FROM events)),
cell AS (SELECT dim, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS t, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events JOIN ty USING (event_type) GROUP BY ALL),
sig AS (SELECT dim, t, coalesce(v, 0) AS v FROM (SELECT dim, unnest(range(720)) AS t FROM ty) LEFT JOIN cell USING (dim, t))"""
LI = """cell AS (SELECT l_returnflag AS key, (epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1995-01-02')) // 86400000000 AS t, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY ALL),
sig AS (SELECT dim, t, coalesce(v, 0) AS v FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS dim, unnest(range((SELECT max(t) + 1 FROM cell))) AS t FROM (SELECT DISTINCT key FROM cell)) LEFT JOIN cell USING (key, t))"""
OW = """cell AS (SELECT o_orderpriority AS key, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) // 604800000000 AS t, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL),
sig AS (SELECT dim, t, coalesce(v, 0) AS v FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS dim, unnest(range((SELECT max(t) + 1 FROM cell))) AS t FROM (SELECT DISTINCT key FROM cell)) LEFT JOIN cell USING (key, t))"""
EMB = """sig AS (SELECT vec_id AS t, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def win(w: int) -> str:
    spread = (w * w - 1) / 12
    return f"""win AS (SELECT dim, t AS i, avg(v) OVER o AS mean, stddev_pop(v) OVER o AS sd, regr_slope(v, t) OVER o AS slope,
 sqrt(greatest(0, {w} * (var_pop(v) OVER o - (regr_slope(v, t) OVER o) ** 2 * {spread}))) AS eta, sum(v * v) OVER o AS energy,
 min(v) OVER o AS low, max(v) OVER o AS high, list(v) OVER o AS x, count(*) OVER o AS n
 FROM sig WINDOW o AS (PARTITION BY dim ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) QUALIFY n = {w})"""


HOLES = """hole AS (SELECT dim, t, CASE WHEN k < 9 THEN 5.0 WHEN k = 40 THEN NULL WHEN k = 60 THEN 'nan'::DOUBLE WHEN k = 80 THEN CASE WHEN dim = 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE v END AS v
  FROM (SELECT *, (t + 37 * dim) % 101 AS k FROM sig))"""
HOLE_WIN = """hw AS (SELECT * FROM (SELECT dim, t AS i, count(*) OVER o AS n, count(s) OVER o AS n_sound, count(f) OVER o AS n_number, avg(s) OVER o AS mean, stddev_pop(s) OVER o AS sd, min(f) OVER o AS low, max(f) OVER o AS high
  FROM (SELECT *, CASE WHEN NOT isnan(v) THEN v END AS f, CASE WHEN isfinite(v) THEN v END AS s FROM hole) WINDOW o AS (PARTITION BY dim ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) WHERE n = 7)"""


def dist(metric: str, w: int, a: str = "a", b: str = "b") -> str:
    """Squared distance of windows a and b; NULL where one is degenerate."""
    q = f"list_dot_product({a}.x, {b}.x)"
    if metric == "raw":
        return f"greatest(0, {a}.energy + {b}.energy - 2 * {q})"
    if metric == "detrended":
        r = f"({q} - {w} * ({a}.mean * {b}.mean + {(w * w - 1) / 12} * {a}.slope * {b}.slope)) / ({a}.eta * {b}.eta)"
        return f"CASE WHEN {a}.eta > 1e-6 AND {b}.eta > 1e-6 THEN greatest(0, 2 * (1 - {r})) END"
    r = f"({q} - {w} * {a}.mean * {b}.mean) / ({w} * {a}.sd * {b}.sd)"
    return f"CASE WHEN {a}.sd > 1e-9 AND {b}.sd > 1e-9 THEN greatest(0, {2 * w if metric == 'znorm' else 2} * (1 - {r})) END"


def pairs(metric: str, w: int, where: str) -> str:
    return f"pair AS (SELECT a.dim, a.i, b.i AS j, round(sqrt({dist(metric, w)}), 6) AS d FROM win a JOIN win b ON a.dim = b.dim AND {where})"


def top_pairs(metric: str, w: int, multi: bool) -> str:
    source = OW if multi else EV
    if multi:
        d = f"SELECT -1 AS dim, a.i, b.i AS j, round(sqrt(sum({dist(metric, w)}) / count(*)), 6) AS d, count(*) AS nn, count({dist(metric, w)}) AS mm FROM win a JOIN win b ON a.dim = b.dim AND b.i - a.i >= {w} GROUP BY a.i, b.i HAVING nn = mm"
    else:
        d = f"SELECT a.dim, a.i, b.i AS j, round(sqrt({dist(metric, w)}), 6) AS d FROM win a JOIN win b ON a.dim = b.dim AND b.i - a.i >= {w}"
    return f"WITH {source}, {win(w)}, pair AS ({d}) SELECT CAST(dim AS INTEGER) AS dim, i, j, d FROM pair WHERE d IS NOT NULL ORDER BY d, dim, i, j LIMIT 100"


KNN1 = f"""{EV}, {win(24)}, half AS (SELECT a.dim, a.i, b.i AS j, round(sqrt({dist('detrended', 24)}), 6) AS d FROM win a JOIN win b ON a.dim = b.dim AND b.i - a.i >= 24),
pair AS (SELECT dim, i, j, d FROM half WHERE d IS NOT NULL UNION ALL SELECT dim, j, i, d FROM half WHERE d IS NOT NULL),
nn AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY dim, i ORDER BY d, j) = 1)"""

PAN = " UNION ALL ".join(
    f"""SELECT CAST(dim AS INTEGER) AS dim, CAST({w} AS INTEGER) AS w, i, j, d FROM (WITH {EV}, {win(w)}, half AS (SELECT a.dim, a.i, b.i AS j, round(sqrt({dist('znorm', w)}), 6) AS d FROM win a JOIN win b ON a.dim = b.dim AND b.i - a.i >= {w}),
pair AS (SELECT dim, i, j, d FROM half WHERE d IS NOT NULL UNION ALL SELECT dim, j, i, d FROM half WHERE d IS NOT NULL) SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY dim, i ORDER BY d, j) = 1)"""
    for w in (8, 12, 16, 20, 24, 28, 32)
)
LEVELS = "level AS (SELECT dim, w, i, least(1.0, round(d / (2 * sqrt(w)), 6)) AS level FROM pan), ranked AS (SELECT *, percent_rank() OVER (PARTITION BY dim ORDER BY level) AS r FROM level)"
CONTRAST = "level, round(1 / (1 + exp(-10 * (r - 0.2))), 6) AS contrast, level <= 0.2 AS on"

OWK = f"""{OW}, {win(8)}, half AS (SELECT a.dim, a.i, b.i AS j, round(sqrt({dist('detrended', 8)}), 6) AS d FROM win a JOIN win b ON a.dim = b.dim AND b.i - a.i >= 8),
pair AS (SELECT dim, i, j, d FROM half WHERE d IS NOT NULL UNION ALL SELECT dim, j, i, d FROM half WHERE d IS NOT NULL),
greedy AS (SELECT dim, i, list_reduce(list_sort(list({{'d': d, 'j': j}})), lambda acc, y: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda p: abs(p.j - y.j) < 8)) = 0 THEN list_append(acc, y) ELSE acc END, CAST([] AS STRUCT(d DOUBLE, j BIGINT)[])) AS k FROM pair GROUP BY dim, i),
knn AS (SELECT dim, i, unnest(range(len(k))) AS rank, unnest(k) AS y FROM greedy)"""

FILT = """near AS (SELECT dim, least(i, j) AS u, greatest(i, j) AS v, min(d) AS w FROM nn GROUP BY ALL),
tim AS (SELECT dim, i AS u, lead(i) OVER o AS v, greatest(d, lead(d) OVER o) AS w FROM nn WINDOW o AS (PARTITION BY dim ORDER BY i)),
edge AS (SELECT dim, u, v, w, 'near' AS kind FROM near UNION ALL SELECT dim, u, v, w, 'time' FROM tim WHERE v = u + 1),
birth AS (SELECT dim, node, min(w) AS birth FROM (SELECT dim, u AS node, w FROM edge UNION ALL SELECT dim, v, w FROM edge) GROUP BY ALL)"""

CAND = f"""{EV}, cut AS (SELECT dim, quantile_cont(v, 0.8) AS c8, quantile_cont(v, 0.9) AS c9 FROM sig GROUP BY dim),
raw AS (SELECT dim, c, t FROM (SELECT dim, t, v, c8, c9 FROM sig JOIN cut USING (dim)), (VALUES (8), (9)) k(c) WHERE v > CASE WHEN c = 8 THEN c8 ELSE c9 END
  UNION ALL SELECT dim, 7, t FROM sig JOIN cut USING (dim) WHERE dim IN (0, 1) AND v > c8 AND t % 97 <> 3),
cpos AS (SELECT dim || ':' || c AS cand, dim, t FROM raw), cn AS (SELECT cand, dim, count(*) AS n FROM cpos GROUP BY ALL),
ov AS (SELECT a.cand AS src, b.cand AS dst, count(*) AS k FROM cpos a JOIN cpos b ON a.t = b.t AND a.cand <> b.cand GROUP BY ALL),
edge AS (SELECT src, dst, k / n AS weight FROM ov JOIN cn ON src = cand WHERE k / n >= 0.8)"""
REACH = """reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src),
mem AS (SELECT c.cand, least(c.cand, coalesce(min(r.dst), c.cand)) AS scc FROM cn c LEFT JOIN (SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src) r ON c.cand = r.src GROUP BY c.cand),
mpos AS (SELECT scc, t FROM cpos JOIN mem USING (cand) GROUP BY scc, t HAVING count(*) = (SELECT count(*) FROM mem m WHERE m.scc = mem.scc)),
merged AS (SELECT scc AS cand, list_sort(list(DISTINCT dim)) AS dims FROM cn JOIN mem USING (cand) GROUP BY scc),
cover AS (SELECT cand, len(dims) * (SELECT count(*) FROM mpos WHERE scc = cand) AS coverage FROM merged)"""

MASKS = """rm AS (SELECT label, vec_id AS t FROM embeddings), pm AS (SELECT label, vec_id AS t FROM embeddings WHERE embedding[1] > 0 AND label < 8 UNION SELECT label, vec_id + 1 FROM embeddings WHERE embedding[2] > 0.1 AND label < 9)"""
INTERVALS = """iv AS (SELECT label, min(t) + 1 AS start, max(t) + 1 AS "end" FROM (SELECT label, t, t - row_number() OVER (PARTITION BY label ORDER BY t) AS g FROM m) GROUP BY label, g)"""
OTSU = """lim AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, count(x) AS n FROM val),
hist AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * 1024) AS INTEGER), 1023) AS bin, count(*) AS c FROM val, lim GROUP BY 1),
cum AS (SELECT b.bin, lo + b.bin * ((hi - lo) / 1024) AS edge, mean, sum(coalesce(c, 0) / n) OVER o AS p, sum(coalesce(c, 0) / n * (lo + b.bin * ((hi - lo) / 1024))) OVER o AS s
  FROM (SELECT unnest(range(1023)) AS bin) b LEFT JOIN hist USING (bin), lim WINDOW o AS (ORDER BY b.bin ROWS UNBOUNDED PRECEDING)),
otsu AS (SELECT edge AS cut FROM cum WHERE p > 0 AND p < 1 ORDER BY round(p * (1 - p) * (s / p - (mean - s) / (1 - p)) ** 2, 9) DESC, bin LIMIT 1)"""
_EDGES = "[" + ", ".join(repr(e) for e in bin_edges()) + "]"
KDIM = f"""{OW}, {win(8)}, pair AS (SELECT a.dim, a.i, b.i AS j, sqrt({dist('znorm', 8)}) AS d FROM win a JOIN win b ON a.dim = b.dim AND abs(a.i - b.i) > 2),
ord AS (SELECT i, j, dim, row_number() OVER o - 1 AS k, sum(d) OVER (PARTITION BY i, j ORDER BY d, dim ROWS UNBOUNDED PRECEDING) AS s FROM pair WHERE d IS NOT NULL WINDOW o AS (PARTITION BY i, j ORDER BY d, dim))"""

ORACLE: dict[str, str] = {
    "win_mean_std": f"WITH {EV}, {win(24)} SELECT CAST(dim AS INTEGER) AS dim, i, round(mean, 6) AS mean, round(sd, 4) AS std FROM win",
    "win_slope_resid": f"WITH {EV}, {win(24)} SELECT CAST(dim AS INTEGER) AS dim, i, round(slope, 6) AS slope, round(eta, 4) AS eta FROM win",
    "win_energy": f"WITH {EV}, {win(24)} SELECT CAST(dim AS INTEGER) AS dim, i, round(energy, 4) AS energy FROM win",
    "win_minmax": f"WITH {LI}, {win(28)} SELECT CAST(dim AS INTEGER) AS dim, i, low, high FROM win",
    "win_constant_override": f"WITH {LI}, {HOLES}, {HOLE_WIN} SELECT CAST(dim AS INTEGER) AS dim, i, CASE WHEN n_sound < 7 THEN false WHEN i % 50 < 5 THEN true WHEN i % 50 < 25 THEN false ELSE low = high END AS constant FROM hw",
    "win_constant": f"WITH {LI}, {HOLES}, {HOLE_WIN} SELECT CAST(dim AS INTEGER) AS dim, i, n_sound = 7 AND low = high AS constant, n_sound = 7 AS finite FROM hw",
    "win_nan_rules": f"""WITH {LI}, {HOLES}, {HOLE_WIN} SELECT CAST(dim AS INTEGER) AS dim, i, round(CASE WHEN n_number = n_sound AND n_sound > 0 THEN sd END, 3) AS nan_std, low AS nan_low, high AS nan_high,
round(CASE WHEN n_sound = 7 THEN mean ELSE 'inf'::DOUBLE END, 3) AS valid_mean, round(CASE WHEN n_sound = 7 THEN sd ELSE 0 END, 3) AS valid_std FROM hw""",
    "znorm_signal": f"WITH {EMB} SELECT CAST(dim AS INTEGER) AS dim, t, round((v - avg(v) OVER (PARTITION BY dim)) / stddev_pop(v) OVER (PARTITION BY dim), 6) AS v FROM sig",
    "znorm_windows": f"WITH {OW}, {win(8)} SELECT CAST(dim AS INTEGER) AS dim, i, round(list_sum(list_transform(x, lambda e: abs((e - mean) / CASE WHEN sd < 1e-7 THEN 1 ELSE sd END))), 5) AS weight FROM win",
    "block_max_downsample": f"WITH {LI} SELECT CAST(dim AS INTEGER) AS dim, t // 28 AS t, max(v) AS v FROM sig GROUP BY ALL",
    "reindex_positions": f"WITH {OW} SELECT CAST(dim AS INTEGER) AS dim, t, date_diff('day', DATE '1995-01-01', CAST(epoch_ms(788918400000 + t * 604800000) AS DATE)) AS day, v FROM sig",
    "dimension_subset": f"WITH {EV} SELECT CAST(CASE dim WHEN 4 THEN 0 WHEN 1 THEN 1 END AS INTEGER) AS dim, t, v FROM sig WHERE dim IN (4, 1)",
    "idle_mask": f"WITH {OW}, f AS (SELECT dim, t, CASE WHEN count(*) OVER o = 7 THEN round(var_pop(v) OVER o, 9) < (SELECT quantile_cont(s, 0.6) FROM (SELECT round(var_pop(v) OVER o2, 9) AS s FROM sig WINDOW o2 AS (PARTITION BY dim ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))) ELSE false END AS flat FROM sig WINDOW o AS (PARTITION BY dim ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), e AS (SELECT t, bool_and(flat) AS flat FROM f GROUP BY t) SELECT t, bool_or(flat) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS idle FROM e",
    "start_mask": f"WITH {OW}, idle AS (SELECT t, t % 5 = 0 AS idle FROM (SELECT DISTINCT t FROM sig)), m AS (SELECT dim, avg(v) AS m FROM sig JOIN idle USING (t) WHERE idle GROUP BY dim), d AS (SELECT t, idle, round(sum((v - m) ** 2), 9) AS d FROM sig JOIN idle USING (t) JOIN m USING (dim) GROUP BY t, idle) SELECT t, NOT idle AND d <= (SELECT quantile_cont(d, 0.1) FROM d WHERE NOT idle) AS start FROM d",
    "dist_znorm": top_pairs("znorm", 24, False),
    "dist_unit": top_pairs("unit", 24, False),
    "dist_detrended": top_pairs("detrended", 24, False),
    "dist_mv_unit": top_pairs("unit", 8, True),
    "dist_mv_detrended": top_pairs("detrended", 8, True),
    "dist_mv_raw": top_pairs("raw", 8, True),
    "query_profile": f"WITH {EMB}, {win(16)}, q AS (SELECT * FROM win WHERE i = 100) SELECT CAST(b.dim AS INTEGER) AS dim, b.i, round(sqrt(CASE WHEN a.sd < 1e-7 AND b.sd < 1e-7 THEN 0 WHEN a.sd < 1e-7 OR b.sd < 1e-7 THEN 16 ELSE greatest(0, 32 * (1 - (list_dot_product(a.x, b.x) - 16 * a.mean * b.mean) / (16 * a.sd * b.sd))) END), 4) AS d FROM win b JOIN q a USING (dim)",
    "query_profile_pnorm": f"WITH {EMB}, {win(16)}, q AS (SELECT * FROM win WHERE i = 100) SELECT CAST(b.dim AS INTEGER) AS dim, b.i, round(list_sum(list_transform(list_zip(a.x, b.x), lambda e: abs(e[1] - e[2]) ** 3)) ** (1 / 3.0), 5) AS d FROM win b JOIN q a USING (dim)",
    "ktanh_transform": f"WITH {KNN1} SELECT CAST(dim AS INTEGER) AS dim, i, round(2 * sqrt(tanh(10 * d * d) / tanh(40)), 6) AS d FROM nn",
    "knn1_profile": f"WITH {KNN1} SELECT CAST(dim AS INTEGER) AS dim, i, j, d FROM nn QUALIFY row_number() OVER (PARTITION BY dim ORDER BY d, i) <= 10",
    "knn_k_exclusion": f"WITH {OWK} SELECT CAST(dim AS INTEGER) AS dim, i, CAST(rank AS INTEGER) AS rank, y.j AS j, y.d AS d FROM knn",
    "filtration_edges": f"WITH {KNN1}, {FILT} SELECT CAST(dim AS INTEGER) AS dim, u, v, w, kind FROM edge",
    "node_births": f"WITH {KNN1}, {FILT} SELECT CAST(dim AS INTEGER) AS dim, node, birth FROM birth",
    "otsu_birth_cut": f"WITH {KNN1}, {FILT}, val AS (SELECT birth AS x FROM birth), {OTSU} SELECT round(cut, 6) AS cut FROM otsu",
    "persistence_gap_cut": f"""WITH {KNN1}, g AS (SELECT d AS g, row_number() OVER o AS k, lead(d) OVER o AS nx FROM nn WHERE d > 0 WINDOW o AS (ORDER BY d DESC)),
dr AS (SELECT k, g, nx, g - nx AS dr FROM g WHERE nx IS NOT NULL), f AS (SELECT k FROM dr ORDER BY dr DESC, k LIMIT 1), s AS (SELECT * FROM dr WHERE k > (SELECT k FROM f) ORDER BY dr DESC, k LIMIT 1) SELECT round((g + nx) / 2, 6) AS cut FROM s""",
    "kdim_profile": f"WITH {KDIM} SELECT k, i, min(round(s / (k + 1), 5)) AS d FROM ord GROUP BY k, i",
    "subspace_of_pair": f"WITH {KDIM} SELECT k, i, j, CAST(dim AS INTEGER) AS dim FROM ord WHERE i % 40 = 0 AND j % 40 = 20",
    "mdl_bits": f"""WITH {KDIM}, ch AS (SELECT k, dim FROM ord WHERE i = 10 AND j = 100), ks AS (SELECT a.k, b.dim FROM ch a JOIN ch b ON b.k <= a.k),
z AS (SELECT dim, i, list_transform(list_transform(x, lambda e: (e - mean) / CASE WHEN sd < 1e-7 THEN 1 ELSE sd END), lambda e: len(list_filter({_EDGES}, lambda b: b < e))) AS x FROM win WHERE i IN (10, 100)),
df AS (SELECT k, ks.dim, unnest(a.x) - unnest(b.x) AS v FROM ks JOIN z a ON a.dim = ks.dim AND a.i = 10 JOIN z b ON b.dim = ks.dim AND b.i = 100)
SELECT k, round(8 * (80 - 8 * count(DISTINCT dim)) + count(DISTINCT dim) * 8 * log2(count(DISTINCT v)) + count(DISTINCT v) * 8, 6) AS bits FROM df GROUP BY k""",
    "ab_join_profile": f"WITH {EV}, {win(24)} SELECT a.i, min(round(sqrt({dist('znorm', 24)}), 5)) AS d FROM win a JOIN win b ON a.dim = 0 AND b.dim = 4 GROUP BY a.i",
    "mpdist": f"WITH {EV}, {win(24)}, p AS (SELECT a.i, b.i AS j, round(sqrt({dist('znorm', 24)}), 5) AS d FROM win a JOIN win b ON a.dim = 0 AND b.dim = 4), u AS (SELECT min(d) AS d FROM p GROUP BY i UNION ALL SELECT min(d) FROM p GROUP BY j) SELECT d AS distance FROM u QUALIFY row_number() OVER (ORDER BY d) = 1 + ceil(0.05 * (SELECT count(*) FROM sig WHERE dim IN (0, 4)))",
    "topk_merge": f"WITH {OWK}, u AS (SELECT DISTINCT i, y.j AS j, y.d AS d FROM knn) SELECT i, j, d FROM u QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 3",
    "pan_contrast": f"WITH {KNN1}, p AS (SELECT dim, i, percent_rank() OVER (ORDER BY d) AS r FROM nn) SELECT CAST(dim AS INTEGER) AS dim, i, round(1 / (1 + exp(-10 * (r - 0.2))), 6) AS contrast, r <= 0.2 AS on FROM p",
    "pan_profile": PAN,
    "pan_length_contrast": f"WITH pan AS ({PAN}), {LEVELS} SELECT dim, w, i, {CONTRAST} FROM ranked",
    "pan_partial": f"WITH whole AS ({PAN}), pan AS (SELECT * FROM whole WHERE w IN (20, 12, 28)), {LEVELS}, stand AS (SELECT * FROM (VALUES (8, 12), (12, 12), (16, 12), (20, 20), (24, 20), (28, 28), (32, 28)) AS v(length, x)) SELECT dim, CAST(length AS INTEGER) AS w, length = x AS own, i, {CONTRAST} FROM ranked JOIN stand ON w = x",
    "overlap_graph": f"WITH {CAND} SELECT src, dst, round(weight, 6) AS weight FROM edge",
    "scc_merge": f"WITH RECURSIVE {CAND}, {REACH} SELECT cand, array_to_string(dims, ',') AS dims, (SELECT count(*) FROM mpos WHERE scc = cand) AS n_positions FROM merged",
    "scc_roles": f"WITH RECURSIVE {CAND}, {REACH}, ce AS (SELECT DISTINCT a.scc AS a, b.scc AS b FROM edge JOIN mem a ON src = a.cand JOIN mem b ON dst = b.cand WHERE a.scc <> b.scc) SELECT DISTINCT scc, CASE WHEN scc NOT IN (SELECT a FROM ce) AND scc NOT IN (SELECT b FROM ce) THEN 'isolated' WHEN scc NOT IN (SELECT b FROM ce) THEN 'source' WHEN scc NOT IN (SELECT a FROM ce) THEN 'sink' ELSE 'intermediate' END AS role FROM mem",
    "coverage": f"WITH RECURSIVE {CAND}, {REACH} SELECT cand, coverage FROM cover",
    "optimal_n": f"WITH RECURSIVE {CAND}, {REACH}, o AS (SELECT row_number() OVER o AS k, coverage - lead(coverage, 1, 0) OVER o AS d FROM cover WINDOW o AS (ORDER BY coverage DESC, cand)) SELECT k AS n FROM o ORDER BY d DESC, k LIMIT 1",
    "sinks_ancestors": f"WITH RECURSIVE {CAND}, {REACH} SELECT dst AS sink, src AS ancestor, (SELECT n FROM cn WHERE cand = dst) AS sink_coverage, (SELECT n FROM cn WHERE cand = src) AS ancestor_coverage FROM reach WHERE dst NOT IN (SELECT src FROM edge)",
    "split_sets": f"""WITH RECURSIVE {CAND}, {REACH}, pr AS (SELECT dst AS sink, src AS ancestor FROM reach WHERE dst NOT IN (SELECT src FROM edge)),
c2 AS (SELECT sink, ancestor, 'both' AS part, (SELECT count(*) FROM cpos a JOIN cpos b USING (t) WHERE a.cand = sink AND b.cand = ancestor) AS n FROM pr
 UNION ALL SELECT sink, ancestor, 'sink', (SELECT count(*) FROM cpos WHERE cand = sink AND t NOT IN (SELECT t FROM cpos WHERE cand = ancestor)) FROM pr
 UNION ALL SELECT sink, ancestor, 'ancestor', (SELECT count(*) FROM cpos WHERE cand = ancestor AND t NOT IN (SELECT t FROM cpos WHERE cand = sink)) FROM pr) SELECT sink, ancestor, part, n AS n_positions FROM c2 WHERE n > 0""",
    "segments_scored": f"""WITH {CAND}, r AS (SELECT cand, min(t) AS start, max(t) AS "end", count(*) AS length FROM (SELECT cand, t, t - row_number() OVER (PARTITION BY cand ORDER BY t) AS g FROM cpos) GROUP BY cand, g), s AS (SELECT *, least(length, 3) AS score, max(least(length, 3)) OVER (PARTITION BY cand) AS best FROM r) SELECT cand, start, "end", length, CAST(1 AS INTEGER) AS n_dims, score FROM s WHERE score >= 0.4 * best""",
    "mask_to_intervals": f"WITH {MASKS}, m AS (SELECT * FROM rm), {INTERVALS} SELECT label, start, \"end\" FROM iv",
    "sample_prf": f"WITH {MASKS}, h AS (SELECT label, count(*) AS h FROM rm JOIN pm USING (label, t) GROUP BY label), r AS (SELECT label, count(*) AS r FROM rm GROUP BY label), p AS (SELECT label, count(*) AS p FROM pm GROUP BY label) SELECT label, round(CASE WHEN coalesce(p, 0) > 0 THEN coalesce(h, 0) / p ELSE 0 END, 6) AS precision, round(CASE WHEN coalesce(r, 0) > 0 THEN coalesce(h, 0) / r ELSE 0 END, 6) AS recall, round(2 * coalesce(h, 0) / (coalesce(r, 0) + coalesce(p, 0)), 6) AS f1 FROM r FULL JOIN p USING (label) LEFT JOIN h USING (label)",
    "overlap_matrix": f"WITH {MASKS} SELECT rm.label AS real, pm.label AS pred, count(*) AS n FROM rm JOIN pm USING (t) GROUP BY ALL",
    "interval_overlap": f"""WITH {MASKS}, a AS (SELECT label * 100000 + min(t) AS id, min(t) AS s, max(t) + 1 AS e FROM (SELECT label, t, t - row_number() OVER (PARTITION BY label ORDER BY t) AS g FROM rm) GROUP BY label, g), b AS (SELECT label * 100000 + min(t) AS id, min(t) AS s, max(t) + 1 AS e FROM (SELECT label, t, t - row_number() OVER (PARTITION BY label ORDER BY t) AS g FROM pm) GROUP BY label, g)
SELECT a.id AS a, b.id AS b, round((least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)), 6) AS rate FROM a JOIN b ON a.s < b.e AND b.s < a.e""",
    "gt_best_match": f"""WITH {MASKS}, a AS (SELECT label, label * 100000 + min(t) AS id, min(t) AS s, max(t) + 1 AS e FROM (SELECT label, t, t - row_number() OVER (PARTITION BY label ORDER BY t) AS g FROM rm) GROUP BY label, g), b AS (SELECT label, min(t) AS s, max(t) + 1 AS e FROM (SELECT label, t, t - row_number() OVER (PARTITION BY label ORDER BY t) AS g FROM pm) GROUP BY label, g),
o AS (SELECT a.label AS gt, a.id AS occ, b.label AS disc, (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) AS rate FROM a JOIN b ON a.s < b.e AND b.s < a.e) SELECT gt, occ, disc FROM o WHERE rate > 0.5 QUALIFY row_number() OVER (PARTITION BY gt, occ ORDER BY rate DESC, disc) = 1""",
    "dim_prf": f"WITH {EV}, r AS (SELECT t % 50 AS motif, list(DISTINCT dim) AS r FROM sig WHERE v > 0 AND t < 400 GROUP BY 1), p AS (SELECT t % 50 AS motif, list(DISTINCT dim) AS p FROM sig WHERE v > 50 AND t >= 400 GROUP BY 1) SELECT motif, round(len(list_intersect(r, p)) / len(p), 6) AS precision, round(len(list_intersect(r, p)) / len(r), 6) AS recall, round(2 * len(list_intersect(r, p)) / (len(r) + len(p)), 6) AS f1, round(len(list_intersect(r, p)) / len(list_distinct(list_concat(r, p))), 6) AS jaccard FROM r JOIN p USING (motif)",
    "start_end_masks": f"WITH {EMB}, o AS (SELECT label AS motif, vec_id AS s, vec_id + 3 AS e FROM embeddings) SELECT DISTINCT CAST(motif AS INTEGER) AS motif, unnest(range(s, e)) AS t FROM o",
    "profile_from_neighbours": f"WITH {KNN1} SELECT CAST(n.dim AS INTEGER) AS dim, n.i, n.j, round(sqrt({dist('znorm', 24)}), 4) AS d FROM nn n JOIN win a ON n.dim = a.dim AND n.i = a.i JOIN win b ON n.dim = b.dim AND n.j = b.i",
}


def _profile(w: int) -> str:
    return f"sqrt(CASE WHEN a.sd < 1e-7 AND b.sd < 1e-7 THEN 0 WHEN a.sd < 1e-7 OR b.sd < 1e-7 THEN {w} ELSE greatest(0, {2 * w} * (1 - (list_dot_product(a.x, b.x) - {w} * a.mean * b.mean) / ({w} * a.sd * b.sd))) END)"


ORACLE |= {
    "query_match": f"""WITH {EV}, {win(16)}, q AS (SELECT * FROM win WHERE i = 200),
p AS (SELECT b.i, round(avg({_profile(16)}), 4) AS d FROM win b JOIN q a USING (dim) GROUP BY b.i),
r AS (SELECT greatest(avg(d) - 2 * stddev_pop(d), min(d)) AS r FROM p),
g AS (SELECT list_reduce(list_sort(list({{'d': d, 'i': i}})), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: abs(z.i - y.i) <= 4)) = 0 THEN list_append(acc, y) ELSE acc END, CAST([] AS STRUCT(d DOUBLE, i BIGINT)[])) AS k FROM p, r WHERE d <= r)
SELECT unnest(k).i AS i, unnest(k).d AS d FROM g""",
    "query_match_whole": f"""WITH {EMB}, {win(16)}, q AS (SELECT * FROM win WHERE i = 100),
p AS (SELECT b.i, round(avg({_profile(16)}), 4) AS d FROM win b JOIN q a USING (dim) GROUP BY b.i),
r AS (SELECT greatest(avg(d) - 2 * stddev_pop(d), min(d)) AS r FROM p),
g AS (SELECT list_reduce(list_sort(list({{'d': d, 'i': i}})), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: abs(z.i - y.i) <= 4)) = 0 THEN list_append(acc, y) ELSE acc END, CAST([] AS STRUCT(d DOUBLE, i BIGINT)[])) AS k FROM p, r WHERE d <= r)
SELECT unnest(k).i AS i, unnest(k).d AS d FROM g""",
    "signal_checks": f"""WITH {LI}, {HOLES} SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n, count(*) FILTER (v IS NULL OR isnan(v)) AS n_missing, count(*) FILTER (isinf(v)) AS n_infinite,
min(v) FILTER (NOT isnan(v)) AS low, max(v) FILTER (NOT isnan(v)) AS high, max(t) - min(t) + 1 = count(DISTINCT t) AS dense FROM hole WHERE t % 1000 <> 999 OR dim <> 1 GROUP BY dim""",
    "set_spans": f"""WITH {OW}, m AS (SELECT dim, avg(v) AS m FROM sig GROUP BY dim), hot AS (SELECT dim, t FROM sig JOIN m USING (dim) WHERE v > 1.25 * m),
run AS (SELECT dim, min(t) AS s, max(t) + 1 AS e FROM (SELECT dim, t, t - row_number() OVER (PARTITION BY dim ORDER BY t) AS g FROM hot) GROUP BY dim, g),
pk AS (SELECT t, CAST(count(*) - 2 AS INTEGER) AS motif FROM hot GROUP BY t HAVING count(*) >= 2) SELECT motif, t AS occ, min(s) AS start, max(e) AS "end" FROM pk JOIN run ON s <= t AND t < e GROUP BY motif, t""",
    "distances_too_small": f"WITH {KNN1} SELECT avg(d) < 0.5 AS too_small FROM nn",
    "dist_single": f"WITH {EMB}, {win(16)} SELECT CAST(b.dim AS INTEGER) AS dim, round({_profile(16)}, 4) AS d FROM win a JOIN win b ON a.dim = b.dim AND a.i = 100 AND b.i = 40",
    "sliding_dot": f"WITH {EMB}, {win(16)} SELECT CAST(b.dim AS INTEGER) AS dim, b.i, round(list_dot_product(a.x, b.x), 6) AS qt FROM win a JOIN win b ON a.dim = b.dim AND a.i = 5",
    "distance_matrix": f"WITH {OW}, {win(8)} SELECT a.i, b.i AS j, round(list_distance(a.x, b.x), 6) AS d FROM win a JOIN win b ON a.dim = 0 AND b.dim = 4 AND b.i % 10 = 0",
    "replace_distance": f"WITH {EMB}, {win(16)}, p AS (SELECT b.dim, b.i, round({_profile(16)}, 4) AS d FROM win a JOIN win b ON a.dim = b.dim AND a.i = 100) SELECT CAST(dim AS INTEGER) AS dim, i, CASE WHEN d = 0 THEN -1 ELSE d END AS d FROM p",
    "pair_neighbours": f"""WITH {EMB}, {win(16)}, p AS (SELECT b.i, avg({_profile(16)}) FILTER (a.i = 100) AS a, avg({_profile(16)}) FILTER (a.i = 300) AS b FROM win a JOIN win b ON a.dim = b.dim AND a.i IN (100, 300) GROUP BY b.i),
n AS (SELECT i, round(least(a, b), 4) AS d FROM p WHERE round(least(a, b), 4) < (SELECT a * 0.98 FROM p WHERE i = 300)),
g AS (SELECT list_reduce(list_sort(list({{'d': d, 'i': i}})), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: abs(z.i - y.i) <= 15)) = 0 THEN list_append(acc, y) ELSE acc END, CAST([] AS STRUCT(d DOUBLE, i BIGINT)[])) AS k FROM n) SELECT unnest(k).i AS i, unnest(k).d AS d FROM g""",
    "subspace_discords": f"WITH {OW}, {win(8)}, p AS (SELECT b.dim, round({_profile(8)}, 6) AS d FROM win a JOIN win b ON a.dim = b.dim AND a.i = 10 AND b.i = 100) SELECT CAST(row_number() OVER (ORDER BY dim <> 3, d DESC, dim) - 1 AS INTEGER) AS k, CAST(dim AS INTEGER) AS dim FROM p",
    "equal_dims": f"WITH {EV} SELECT CAST(b.dim AS INTEGER) AS dim, bool_and(a.v = b.v) AS equal FROM sig a JOIN sig b ON a.dim = 0 AND a.t = b.t GROUP BY b.dim",
    "subspace_include": f"WITH {OW}, {win(8)}, p AS (SELECT b.dim, round({_profile(8)}, 6) AS d FROM win a JOIN win b ON a.dim = b.dim AND a.i = 10 AND b.i = 100) SELECT CAST(row_number() OVER (ORDER BY CASE dim WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN dim NOT IN (1, 3) THEN d END, dim) - 1 AS INTEGER) AS k, CAST(dim AS INTEGER) AS dim FROM p",
    "total_coverage": f"WITH RECURSIVE {CAND}, {REACH} SELECT CAST(sum(coverage) AS BIGINT) AS total FROM (SELECT coverage FROM cover ORDER BY coverage DESC, cand LIMIT 3)",
    "relabelled": f"WITH {CAND} SELECT cand, dim || '/' || row_number() OVER (PARTITION BY dim ORDER BY n DESC, cand) AS label FROM cn",
    "run_islands": f"WITH {EV} SELECT CAST(dim AS INTEGER) AS dim, min(t) AS start, max(t) + 1 AS \"end\" FROM (SELECT dim, t, t - row_number() OVER (PARTITION BY dim ORDER BY t) AS g FROM sig WHERE v > 0) GROUP BY dim, g",
    "linkage_rates": """WITH e AS (SELECT vec_id AS m, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 10) AS BIGINT) AS s FROM embeddings),
r AS (SELECT a.m // 2 AS k, greatest(0, least(a.s, b.s) + 20 - greatest(a.s, b.s)) / (greatest(a.s, b.s) + 20 - least(a.s, b.s)) AS r FROM e a JOIN e b ON a.m % 2 = 0 AND b.m = a.m + 1) SELECT k, round(avg(r), 6) AS average, round(min(r), 6) AS complete FROM r GROUP BY k""",
}
