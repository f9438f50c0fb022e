"""Queries over shape, resolvability, spectra, stability and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators import carve, dependence, iterative, metrics, permutation, resolve, shape, simulate
from tidespan.operators.renewal import PRIME
from tidespan.plans.context import Context
from tidespan.plans.define import Queries, r
from tidespan.plans.oracle import sql
from tidespan.plans.queries_renewal import DRAWS, SEED

QUERIES = query = Queries()

_PAIRS = "pairs AS (SELECT record, seq, value AS y, t_us::DOUBLE AS x FROM reads)"


def pairs(c: Context) -> DataFrame:
    return c.reads.select("record", "seq", F.col("t_us").cast("double").alias("x"), F.col("value").alias("y"))


@query(sql("""SELECT record, any_value(n) AS n, round(CASE WHEN any_value(n) >= 3 AND sum(l * (n - l)) > 0 THEN 1 - any_value(n) * sum(step)::DOUBLE / (2 * sum(l * (n - l))) END, 8) AS xi FROM (
  SELECT *, abs(lead(rk) OVER (PARTITION BY record ORDER BY x, seq) - rk) AS step FROM (SELECT *, count(*) OVER (PARTITION BY record ORDER BY y RANGE UNBOUNDED PRECEDING) AS rk, count(*) OVER (PARTITION BY record ORDER BY y DESC RANGE UNBOUNDED PRECEDING) AS l, count(*) OVER (PARTITION BY record) AS n FROM pairs)) GROUP BY record""", _PAIRS))
def xi(c: Context) -> DataFrame:
    return shape.chatterjee(pairs(c), ["record"]).select("record", "n", r("xi", 8))


_SPEAR = _PAIRS + ", ranks AS (SELECT *, rank() OVER (PARTITION BY record ORDER BY x) + (count(*) OVER (PARTITION BY record, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY record ORDER BY y) + (count(*) OVER (PARTITION BY record, y) - 1) / 2 AS ry FROM pairs)"


@query(sql("SELECT record, count(*) AS n, round(CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END, 8) AS rho FROM ranks GROUP BY record", _SPEAR))
def spearman(c: Context) -> DataFrame:
    return shape.spearman(pairs(c), ["record"]).select("record", "n", r("rho", 8))


@query(sql("""SELECT record, n, round(CASE WHEN va > 1e-18 AND vb > 1e-18 THEN sqrt(greatest(v, 0) / sqrt(va * vb)) END, 6) AS dcor FROM (SELECT d.record, any_value(n) AS n, avg((dx - r1.mx - r2.mx + gx) * (dy - r1.my - r2.my + gy)) AS v, avg((dx - r1.mx - r2.mx + gx) * (dx - r1.mx - r2.mx + gx)) AS va, avg((dy - r1.my - r2.my + gy) * (dy - r1.my - r2.my + gy)) AS vb
  FROM dist d JOIN rowm r1 ON r1.record = d.record AND r1.i = d.i JOIN rowm r2 ON r2.record = d.record AND r2.i = d.j JOIN totm t ON t.record = d.record GROUP BY d.record)""",
  _PAIRS, """dist AS (SELECT a.record, a.seq AS i, b.seq AS j, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, count(*) OVER (PARTITION BY a.record, a.seq) AS n FROM pairs a JOIN pairs b USING (record)),
rowm AS (SELECT record, i, avg(dx) AS mx, avg(dy) AS my FROM dist GROUP BY ALL), totm AS (SELECT record, avg(dx) AS gx, avg(dy) AS gy FROM dist GROUP BY ALL)"""))
def dcor(c: Context) -> DataFrame:
    return shape.distance_correlation(pairs(c), ["record"]).select("record", "n", r("dcor", 6))


@query()
def xi_p(c: Context) -> DataFrame:
    return permutation.xi_p_value(pairs(c), ["record"]).select("record", "n", r("xi", 8), r("p", 9), "method")


def _number(what: str, at: int) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}', {what})), {at}, 8))::BIGINT"


_KEY = f"((h * bk + bc) % {PRIME})"
_DEPEND = f"""dp0 AS (SELECT record, seq, t_us, value AS q, sigma AS s FROM reads WHERE sigma IS NOT NULL AND isfinite(sigma)),
dpn AS (SELECT r.record, count(d.seq) AS n, CASE WHEN count(d.seq) = 0 THEN 'no read with a known sigma' WHEN min(s) < 0 THEN 'a sigma is negative' WHEN count(d.seq) < 10 THEN 'fewer than 10 reads' WHEN max(q) = min(q) OR max(s) = min(s) THEN 'zero variance' ELSE '' END AS reason FROM reads r LEFT JOIN dp0 d ON d.record = r.record AND d.seq = r.seq GROUP BY r.record),
dp1 AS (SELECT record, seq, q, s, row_number() OVER (PARTITION BY record ORDER BY t_us, seq) AS j, n, {_number("record, seq", 1)} % {PRIME} AS h, rank() OVER (PARTITION BY record ORDER BY q) + (count(*) OVER (PARTITION BY record, q) - 1) / 2 AS rq, rank() OVER (PARTITION BY record ORDER BY s) + (count(*) OVER (PARTITION BY record, s) - 1) / 2 AS rs,
  count(*) OVER (PARTITION BY record ORDER BY s RANGE UNBOUNDED PRECEDING) AS at_most, count(*) OVER (PARTITION BY record ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS at_least, avg(s) OVER (PARTITION BY record) AS mean_s FROM dp0 JOIN (SELECT record, n FROM dpn WHERE reason = '') USING (record)),
dp2 AS (SELECT *, 10 * (row_number() OVER (PARTITION BY record ORDER BY q, j) - 1) // n AS tenth FROM dp1),
fac AS (SELECT b, {_number("b", 1)} % {PRIME - 1} + 1 AS bk, {_number("b", 9)} % {PRIME} AS bc FROM (SELECT unnest(range(0, {DRAWS + 1})) AS b)),
shuf AS (SELECT record, b, s, rs, at_most, at_least, row_number() OVER (PARTITION BY record, b ORDER BY CASE WHEN b > 0 THEN {_KEY} * {_KEY} % {PRIME} END, j) AS j FROM dp2, fac),
met AS (SELECT x.record, b, x.j, n, q, rq, tenth, mean_s, y.s, y.rs, y.at_most, y.at_least FROM dp2 x JOIN shuf y ON y.record = x.record AND y.j = x.j),
met2 AS (SELECT *, abs(lead(at_most) OVER (PARTITION BY record, b ORDER BY q, j) - at_most) AS step FROM met),
plain AS (SELECT record, b, abs(corr(q, s)) AS pearson_abs, abs(corr(rq, rs)) AS spearman_abs, 1 - any_value(n) * sum(step)::DOUBLE / (2 * sum(at_least * (n - at_least))) AS chatterjee_xi FROM met2 GROUP BY record, b),
tens AS (SELECT record, b, (max(m) - min(m)) / any_value(mean_s) AS decile_spread FROM (SELECT record, b, tenth, avg(s) AS m, any_value(mean_s) AS mean_s FROM met GROUP BY ALL) GROUP BY record, b),
aq AS (SELECT x.record, x.j, list(abs(x.q - y.q) ORDER BY y.j) AS row, avg(abs(x.q - y.q)) AS mean FROM dp2 x JOIN dp2 y USING (record) GROUP BY x.record, x.j),
cq AS (SELECT a.record, a.j, list_transform(list_zip(a.row, m.means), lambda z: z[1] - z[2] - a.mean + m.whole) AS row FROM aq a JOIN (SELECT record, list(mean ORDER BY j) AS means, avg(mean) AS whole FROM aq GROUP BY record) m USING (record)),
bs0 AS (SELECT x.record, avg(abs(x.s - y.s)) AS mean, x.j, list(abs(x.s - y.s) ORDER BY y.j) AS row FROM dp2 x JOIN dp2 y USING (record) GROUP BY x.record, x.j),
scales AS (SELECT a.record, sqrt(a.v * b.v) AS scale FROM (SELECT record, avg(list_inner_product(row, row) / len(row)) AS v FROM cq GROUP BY record) a JOIN (SELECT record, avg(list_inner_product(row, row) / len(row)) AS v FROM (SELECT a.record, list_transform(list_zip(a.row, m.means), lambda z: z[1] - z[2] - a.mean + m.whole) AS row FROM bs0 a JOIN (SELECT record, list(mean ORDER BY j) AS means, avg(mean) AS whole FROM bs0 GROUP BY record) m USING (record)) GROUP BY record) b USING (record)),
ss AS (SELECT record, b, list(s ORDER BY j) AS s FROM shuf GROUP BY record, b),
dc AS (SELECT y.record, y.b, sqrt(greatest(0, avg(list_inner_product(c.row, list_transform(z.s, lambda v: abs(v - y.s))) / len(c.row))) / any_value(scale)) AS distance_correlation FROM shuf y JOIN cq c ON c.record = y.record AND c.j = y.j JOIN ss z ON z.record = y.record AND z.b = y.b JOIN scales k ON k.record = y.record GROUP BY y.record, y.b),
lm AS (SELECT record, b, member, round(v, 9) AS v FROM (UNPIVOT (SELECT record, b, pearson_abs, spearman_abs, chatterjee_xi, distance_correlation, decile_spread FROM plain JOIN tens USING (record, b) JOIN dc USING (record, b)) ON pearson_abs, spearman_abs, chatterjee_xi, distance_correlation, decile_spread INTO NAME member VALUE v)),
lp AS (SELECT *, count(*) OVER (PARTITION BY record, member ORDER BY v DESC RANGE UNBOUNDED PRECEDING)::DOUBLE / {DRAWS + 1} AS p FROM lm),
ll AS (SELECT record, b, min(p) AS least FROM lp GROUP BY record, b),
pp AS (SELECT record, any_value(seen) AS seen, avg((least <= seen + 1e-12)::INT) AS panel_p FROM (SELECT *, max(least) FILTER (b = 0) OVER (PARTITION BY record) AS seen FROM ll) GROUP BY record)"""


@query(sql("SELECT record, n, member, v AS value, round(p, 9) AS p, p <= seen + 1e-12 AS attains, round(panel_p, 9) AS panel_p, reason FROM dpn LEFT JOIN (SELECT * FROM lp WHERE b = 0) USING (record) LEFT JOIN pp USING (record)", _DEPEND))
def dependence_panel(c: Context) -> DataFrame:
    """Does sigma depend on the value: five members on the same 999 shuffles, and the panel's min-P."""
    return dependence.panel(c.obs, DRAWS, SEED).select("record", "n", "member", r("value", 9), r("p", 9), "attains", r("panel_p", 9), "reason")


@query()
def dependence_p(c: Context) -> DataFrame:
    """Does the value depend on time: xi, rho and distance correlation with their permutation p-values."""
    return permutation.paired_permutation(pairs(c), ["record"], ("xi", "rho", "dcor"), draws=DRAWS).select("record", "n", "statistic", r("value", 8), r("p", 9), "method")


_POOLED = """pooled AS (SELECT rr.record, rr.label, rr.seq, margin AS x, (death_us - t_us) / 1e6 AS y, count(*) OVER (PARTITION BY rr.record, rr.label) AS n FROM rows_ rr JOIN wins w ON w.record = rr.record AND w.label = rr.label AND w.island = rr.island WHERE in_spec AND birth_seen AND NOT censored),
prank AS (SELECT *, count(*) OVER (PARTITION BY record, label ORDER BY y RANGE UNBOUNDED PRECEDING) AS rk, count(*) OVER (PARTITION BY record, label ORDER BY y DESC RANGE UNBOUNDED PRECEDING) AS l, rank() OVER (PARTITION BY record, label ORDER BY x) + (count(*) OVER (PARTITION BY record, label, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY record, label ORDER BY y) + (count(*) OVER (PARTITION BY record, label, y) - 1) / 2 AS ry FROM pooled),
pstep AS (SELECT *, abs(lead(rk) OVER (PARTITION BY record, label ORDER BY x, seq) - rk) AS step FROM prank)"""


@query(sql("""SELECT record, label, any_value(n) AS n, round(CASE WHEN any_value(n) >= 3 AND sum(l * (n - l)) > 0 THEN 1 - any_value(n) * sum(step)::DOUBLE / (2 * sum(l * (n - l))) END, 8) AS xi,
  round(CASE WHEN any_value(n) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END, 8) AS rho FROM pstep GROUP BY record, label""", _POOLED))
def pooled_shape(c: Context) -> DataFrame:
    return shape.pooled_shape(carve.read_table(c.rows, c.wins.filter("birth_seen and not censored"))).select("record", "label", "n", r("xi", 8), r("rho", 8))


@query(sql("SELECT record, round(avg((k > 1)::INT), 9) AS tied FROM (SELECT *, count(*) OVER (PARTITION BY record, value) AS k FROM reads) GROUP BY record"))
def tie_fraction(c: Context) -> DataFrame:
    return shape.tie_fraction(c.reads, ["record"], "value").select("record", r("tied", 9))


@query(sql("""SELECT record, label, island, any_value(n) AS n, round(max(margin), 6) AS peak_margin, round(avg(margin), 6) AS mean_margin, round((arg_min(t_us, (-margin, t_us)) - min(birth_us)) / 1e6 / nullif((max(death_us) - min(birth_us)) / 1e6, 0), 6) AS peak_fraction FROM (
  SELECT rr.record, rr.label, rr.island, margin, t_us, birth_us, death_us, count(*) OVER (PARTITION BY rr.record, rr.label, rr.island) AS n FROM rows_ rr JOIN wins w ON w.record = rr.record AND w.label = rr.label AND w.island = rr.island WHERE in_spec) WHERE n >= 5 GROUP BY ALL"""))
def window_shape(c: Context) -> DataFrame:
    return shape.window_shape(carve.read_table(c.rows, c.wins)).select("record", "label", "island", "n", r("peak_margin"), r("mean_margin"), r("peak_fraction"))


@query(sql("""SELECT record, label, count(*) AS n_windows, round(median(n), 6) AS median_reads, round(median(peak), 6) AS median_peak, round(median(mean), 6) AS median_mean FROM (
  SELECT rr.record, rr.label, rr.island, count(*) AS n, max(margin) AS peak, avg(margin) AS mean FROM rows_ rr JOIN wins w ON w.record = rr.record AND w.label = rr.label AND w.island = rr.island WHERE in_spec GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL"""))
def shape_medians(c: Context) -> DataFrame:
    return shape.shape_medians(shape.window_shape(carve.read_table(c.rows, c.wins))).select("record", "label", "n_windows", r("median_reads"), r("median_peak"), r("median_mean"))


@query(sql("""SELECT record, count(*) AS n, sum((t_us / 1e6 BETWEEN 946684800 AND 4102444800)::INT)::BIGINT AS n_plausible, sum((t_us BETWEEN 946684800 AND 4102444800)::INT)::BIGINT AS n_plausible_as_given FROM reads GROUP BY record"""))
def unix_seconds(c: Context) -> DataFrame:
    """Times in seconds are plausible; microseconds passed as seconds are not."""
    ok, raw = metrics.plausible_unix_s(F.col("t_us") / 1e6), metrics.plausible_unix_s(F.col("t_us"))
    return c.reads.groupBy("record").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_plausible"), F.count_if(raw).alias("n_plausible_as_given"))


@query(sql("""SELECT label, k, count(*) AS n_windows, round(avg(y), 6) AS mean, round(stddev_samp(y) / sqrt(count(*)), 6) AS se FROM (SELECT label, k, m + (k / 24.0 - a) / (a1 - a) * (m1 - m) AS y FROM sh2 JOIN range(25) g(k) ON k >= a * 24 AND (k < a1 * 24 OR (a1 >= 1 AND k <= a1 * 24)) WHERE a1 > a) GROUP BY ALL""",
  "sh0 AS (SELECT w.record, w.label, w.island, t_us, seq, margin, (t_us - birth_us) / 1e6 AS age FROM rows_ JOIN wins w USING (record, label, island) WHERE in_spec)",
  "sh1 AS (SELECT *, count(*) OVER p AS n_in, max(age) OVER p AS top, max(margin) OVER p AS peak FROM sh0 WINDOW p AS (PARTITION BY record, label, island))",
  "sh2 AS (SELECT *, age / top AS a, margin / peak AS m, lead(age / top) OVER o AS a1, lead(margin / peak) OVER o AS m1 FROM sh1 WHERE n_in >= 5 AND top > 0 AND peak > 0 WINDOW o AS (PARTITION BY record, label, island ORDER BY t_us, seq))"))
def shape_curve(c: Context) -> DataFrame:
    return shape.shape_curve(carve.read_table(c.rows, c.wins)).select("label", "k", "n_windows", r("mean"), r("se"))


@query(sql("SELECT record, count(*) AS n, sum((sigma IS NULL)::INT)::BIGINT AS n_sigma_unknown, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, round(avg(sigma), 6) AS mean_sigma, round(median(sigma / nullif(abs(value), 0)), 6) AS median_relative, round(stddev_pop(value) / nullif(abs(avg(value)), 0), 6) AS cv FROM reads GROUP BY record"))
def signal_summary(c: Context) -> DataFrame:
    return shape.signal_band(c.reads).select("record", "n", "n_sigma_unknown", *[r(x) for x in ("mean", "sd", "median", "mean_sigma", "median_relative", "cv")])


@query(sql("""SELECT s.record, s.label, s.in_spec, s.in_spec_uncertain, s.out_of_spec, s.out_of_spec_uncertain, coalesce(p.n_windows, 0) AS n_windows, round(p.purity, 8) AS mean_purity FROM (SELECT record, label, count(*) FILTER (in_spec AND confident) AS in_spec, count(*) FILTER (in_spec AND NOT confident) AS in_spec_uncertain, count(*) FILTER (NOT in_spec AND confident) AS out_of_spec,
  count(*) FILTER (NOT in_spec AND NOT confident) AS out_of_spec_uncertain FROM rows_ GROUP BY ALL) s LEFT JOIN (SELECT record, label, count(*) AS n_windows, avg(q) AS purity FROM (SELECT record, label, island, avg(confident::INT) AS q FROM rows_ WHERE in_spec GROUP BY ALL) GROUP BY ALL) p USING (record, label)"""))
def distinguish_band(c: Context) -> DataFrame:
    return shape.distinguish_band(c.rows, c.wins).select("record", "label", "in_spec", "in_spec_uncertain", "out_of_spec", "out_of_spec_uncertain", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), r("mean_purity", 8))


@query(sql("SELECT record, label, side, count(*) FILTER (death_kind = 'crossing') AS n_crossing, count(*) FILTER (death_kind = 'gap_start') AS n_gap_start, count(*) FILTER (death_kind = 'scan_end') AS n_scan_end, round(sum(duration_s), 5) AS total_s FROM wins GROUP BY ALL"))
def reliability_band(c: Context) -> DataFrame:
    return shape.reliability_band(c.wins).select("record", "label", "side", "n_crossing", "n_gap_start", "n_scan_end", r("total_s", 5))


@query(sql("SELECT record, t_us, round(avg(value), 8) AS value, round(CASE WHEN count(sigma) = count(*) THEN sqrt(sum(sigma * sigma)) / count(*) END, 8) AS sigma FROM reads GROUP BY record, t_us"))
def collapsed_reads(c: Context) -> DataFrame:
    return resolve.collapse_repeated(c.reads).select("record", "t_us", r("value", 8), r("sigma", 8))


@query(sql("""SELECT record, round(scale, 6) AS scale, round(scale / sd, 6) AS ratio, round(ms / scale, 6) AS sigma_ratio FROM (SELECT record, sqrt(avg(pow(a * q0 + (1 - a) * q2 - value, 2) / (a * a + (1 - a) * (1 - a) + 1))) AS scale FROM (SELECT *, (t2 - t_us)::DOUBLE / (t2 - t0) AS a FROM (SELECT *, lag(t_us) OVER w AS t0, lead(t_us) OVER w AS t2, lag(value) OVER w AS q0, lead(value) OVER w AS q2
  FROM obs WINDOW w AS (PARTITION BY record, segment ORDER BY t_us, seq)) WHERE t0 IS NOT NULL AND t2 > t0) GROUP BY record) JOIN (SELECT record, stddev_samp(value) AS sd, avg(sigma) AS ms FROM obs GROUP BY record) USING (record)"""))
def gsjs(c: Context) -> DataFrame:
    return resolve.second_difference(c.obs).select("record", r("scale"), r("ratio"), r("sigma_ratio"))


@query(sql("SELECT record, round((var_samp(value) - avg(sigma * sigma)) / nullif(var_samp(value), 0), 8) AS share FROM reads GROUP BY record"))
def self_consistency(c: Context) -> DataFrame:
    return resolve.self_consistency(c.reads).select("record", r("share", 8))


@query(sql("""SELECT record, label, count(*) AS n_lags, round(1 - covar_pop(ln(n / p), ln(m)) / nullif(var_pop(ln(m)), 0), 6) AS exponent FROM (SELECT x.record, x.label, l.m, count(*) FILTER (x.in_spec AND NOT y.in_spec) / l.m AS n, count(*) / l.m AS p FROM ci x, (VALUES (1.0::DOUBLE), (2.0), (3.0), (5.0), (8.0), (13.0), (20.0)) l(m), ci y
  WHERE y.record = x.record AND y.label = x.label AND y.segment = x.segment AND y.k = x.k + m GROUP BY x.record, x.label, l.m) WHERE n > 0 AND p > 0 GROUP BY record, label HAVING count(*) >= 2""", "ci AS (SELECT record, label, segment, in_spec, row_number() OVER (PARTITION BY record, label, segment ORDER BY t_us, seq) AS k FROM rows_)"))
def count_exponent(c: Context) -> DataFrame:
    return resolve.count_exponent(c.rows).select("record", "label", "n_lags", r("exponent"))


@query(sql("""SELECT record, label, count(*) FILTER (good AND n = 1) AS clean, count(*) FILTER (good AND n <> 1) AS merged, count(*) FILTER (NOT good) AS unbracketed FROM (SELECT d.record, d.label, coalesce(b.in_spec AND NOT a.in_spec, false) AS good, a.ch - b.ch AS n FROM bracket d LEFT JOIN chg b ON b.record = d.record AND b.label = d.label AND b.rn = d.br LEFT JOIN chg a ON a.record = d.record AND a.label = d.label AND a.rn = d.ar) GROUP BY ALL""",
  """chg AS (SELECT *, sum(c0) OVER (PARTITION BY record, label, segment ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS ch FROM (SELECT *, coalesce((lag(in_spec) OVER (PARTITION BY record, label, segment ORDER BY t_us, seq) <> in_spec)::INT, 0) AS c0 FROM rows_)),
bracket AS (SELECT * FROM (SELECT *, max(CASE WHEN confident THEN rn END) OVER (PARTITION BY record, label, segment ORDER BY rn ROWS UNBOUNDED PRECEDING) AS br, min(CASE WHEN confident THEN rn END) OVER (PARTITION BY record, label, segment ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ar, lead(in_spec) OVER (PARTITION BY record, label, segment ORDER BY rn) AS nx FROM chg) WHERE in_spec AND NOT nx)"""))
def crossing_placement(c: Context) -> DataFrame:
    return resolve.crossing_placement(c.rows).select("record", "label", "clean", "merged", "unbracketed")


_GRID = """spans AS (SELECT record, (max(t_us) - min(t_us)) / 1e6 AS span_s, count(*) AS n, min(t_us) AS t0, median(dt_us) FILTER (dt_us > 0) / 1e6 AS step, floor((max(t_us) - min(t_us)) / (2 * median(dt_us) FILTER (dt_us > 0)))::BIGINT AS top FROM obs GROUP BY record HAVING max(t_us) > min(t_us)),
ks AS (SELECT *, unnest(range(1, top + 1)) AS k FROM spans WHERE top >= 1),
wave AS (SELECT o.record, k, 2 * pi() * k / span_s * (t_us - t0) / 1e6 AS ph, ks.n AS n FROM obs o JOIN ks USING (record)),
means AS (SELECT record, t_us, avg(value) AS y FROM obs GROUP BY record, t_us),
flat AS (SELECT record FROM means GROUP BY record HAVING max(y) = min(y)),
trig AS (SELECT o.record, k, span_s, step, k / span_s AS f, y, cos(2 * pi() * k / span_s * (t_us - t0) / 1e6) AS c, sin(2 * pi() * k / span_s * (t_us - t0) / 1e6) AS s FROM means o JOIN ks USING (record) WHERE record NOT IN (SELECT record FROM flat)),
moments AS (SELECT record, k, count(*) AS n, any_value(step) AS step, any_value(f) AS f, avg(y * c) - avg(y) * avg(c) AS yc, avg(y * s) - avg(y) * avg(s) AS ys, avg(c * c) - avg(c) * avg(c) AS cc, avg(s * s) - avg(s) * avg(s) AS ss, avg(c * s) - avg(c) * avg(s) AS cs FROM trig GROUP BY record, k),
dens AS (SELECT record, k, f, 2 * step * (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (cc * ss - cs * cs) * n / 2 AS density FROM moments WHERE cc * ss - cs * cs > 1e-9)"""


@query(sql("SELECT record, k, round((pow(sum(cos(ph)), 2) + pow(sum(sin(ph)), 2)) / any_value(n * n), 8) AS window_power FROM wave GROUP BY record, k", _GRID))
def spectral_window(c: Context) -> DataFrame:
    """On the grid up to the band edge."""
    return resolve.spectral_window(c.obs).select("record", "k", r("window", 8, "window_power"))


@query(sql("SELECT record, k, round(density / 1e6, 5) AS density FROM dens", _GRID))
def lomb_scargle(c: Context) -> DataFrame:
    """On the grid up to the band edge."""
    return resolve.lomb_scargle(c.obs).filter("density is not null").select("record", "k", r(F.col("density") / 1e6, 5, "density"))


@query(sql("""SELECT record, k, round(v / max(v) OVER (PARTITION BY record), 6) AS share FROM (SELECT *, sum(area) OVER (PARTITION BY record ORDER BY k ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT *, coalesce((f - lag(f) OVER w) * (4 * pi() * pi() * f * f * density + 4 * pi() * pi() * pow(lag(f) OVER w, 2) * lag(density) OVER w) / 2, 4 * pi() * pi() * density * f * f * f / 3) AS area FROM dens WINDOW w AS (PARTITION BY record ORDER BY k)))""", _GRID))
def g10(c: Context) -> DataFrame:
    return resolve.derivative_variance(resolve.lomb_scargle(c.obs)).select("record", "k", r("share"))


@query(sql("""SELECT record, m, count(*) AS n_terms, round(sqrt(sum(pow(x - 2 * a + b, 2)) / (2.0 * m * m * count(*))), 6) AS adev FROM (SELECT p.record, m, p.x, coalesce(q.x, 0) AS a, coalesce(z.x, 0) AS b FROM ph p JOIN factors f USING (record, segment) LEFT JOIN ph q ON q.record = p.record AND q.segment = p.segment AND q.i = p.i - m LEFT JOIN ph z ON z.record = p.record AND z.segment = p.segment AND z.i = p.i - 2 * m WHERE p.i >= 2 * m) GROUP BY record, m HAVING count(*) >= 8""",
  "ph AS (SELECT record, segment, i, sum(y) OVER (PARTITION BY record, segment ORDER BY i ROWS UNBOUNDED PRECEDING) AS x FROM (SELECT record, segment, row_number() OVER w AS i, value - avg(value) OVER (PARTITION BY record, segment) AS y FROM obs WINDOW w AS (PARTITION BY record, segment ORDER BY t_us, seq)))",
  "factors AS (SELECT record, segment, unnest(range(1, count(*) // 2 + 1)) AS m FROM obs GROUP BY record, segment)"))
def allan(c: Context) -> DataFrame:
    """At all factors with eight terms or more."""
    return resolve.allan_deviation(c.obs).select("record", "m", "n_terms", r("adev"))


@query(sql("SELECT record, label, side, round(sum(duration_s), 5) AS exposure_s, count(*) FILTER (NOT censored) AS exits, count(*) FILTER (birth_seen AND NOT censored) AS n_complete, round(sum(duration_s) / nullif(count(*) FILTER (NOT censored), 0), 5) AS mean_dwell_s FROM wins GROUP BY ALL"))
def dwells(c: Context) -> DataFrame:
    return resolve.dwells(c.wins).select("record", "label", "side", r("exposure_s", 5), "exits", "n_complete", r("mean_dwell_s", 5))


@query(sql("SELECT record, round((max(m) - min(m)) / any_value(sd), 8) AS spread FROM (SELECT record, part, avg(value) AS m FROM (SELECT *, ntile(10) OVER (PARTITION BY record ORDER BY t_us, seq) AS part FROM reads) GROUP BY ALL) JOIN (SELECT record, stddev_samp(value) AS sd FROM reads GROUP BY record HAVING count(*) >= 10) USING (record) GROUP BY record"))
def decile_spread(c: Context) -> DataFrame:
    return resolve.decile_spread(c.reads).select("record", r("spread", 8))


_FID = "fx AS (SELECT record, seq, (value - first_value(value) OVER (PARTITION BY record ORDER BY t_us, seq)) / 100.0 AS x FROM reads), fl AS (SELECT *, sqrt(1 + x * x) AS lam FROM fx)"


@query(sql("SELECT record, seq, round(x, 8) AS x, round((1 + 1 / (lam * lam) + x * x / (lam * lam) * pow(cos(lam * pi() / 4), 2) + sin(lam * pi() / 2) / lam) / 3, 8) AS fidelity FROM fl", _FID))
def fidelity(c: Context) -> DataFrame:
    return metrics.detuning(c.reads, F.lit(100.0)).select("record", "seq", r("x", 8), r(metrics.fidelity(F.col("x")), 8, "fidelity"))


@query(sql("SELECT p_partkey, p_brand, l_suppkey, round(price, 2) AS price, CASE WHEN n IS NULL THEN 'not declared' WHEN n > 1 THEN 'declared more than once' ELSE '' END AS reason FROM (SELECT DISTINCT l_suppkey, p_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) LEFT JOIN (SELECT p_brand, p_partkey, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p_retailprice) END AS price FROM part GROUP BY ALL) USING (p_brand, p_partkey)"))
def declared_lookup(c: Context) -> DataFrame:
    rows = c.table("lineitem").join(c.table("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_partkey", "p_brand").distinct()
    out = metrics.declared_lookup(rows, c.table("part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("price")), ["p_brand", "p_partkey"], "price")
    return out.select("p_partkey", "p_brand", "l_suppkey", r("price", 2), "reason")


@query(sql("SELECT record, count(*) AS n, count(*) FILTER (NOT coalesce(value < 450, false)) AS n_bad, CASE WHEN count(*) FILTER (NOT coalesce(value < 450, false)) > 0 THEN 'a read is at or above the cut or unknown' ELSE '' END AS reason FROM reads GROUP BY record"))
def guard(c: Context) -> DataFrame:
    return metrics.guard(c.reads, "value", 450.0)


@query(sql("SELECT user_id AS record, count(*) AS n_raw, count(*) FILTER (ts IS NULL) AS n_no_time, count(*) FILTER (ts IS NOT NULL AND (value IS NULL OR NOT isfinite(value))) AS n_not_finite FROM events GROUP BY user_id"))
def stage_counts(c: Context) -> DataFrame:
    return metrics.stage_counts(c.events_raw)


@query(sql("SELECT record, round(avg((value <= 5)::INT), 9) AS clipped FROM reads GROUP BY record"))
def clipped_fraction(c: Context) -> DataFrame:
    return metrics.clipped_fraction(c.reads, 5.0).select("record", r("clipped", 9))


@query(sql("SELECT record, seq, round((t_us - min(t_us) OVER (PARTITION BY record)) / 1e6, 6) AS t_rel_s, round(value - avg(value) OVER (PARTITION BY record), 5) AS delta FROM reads"))
def normalised_reads(c: Context) -> DataFrame:
    return metrics.normalised(c.reads).select("record", "seq", r("t_rel_s"), r("delta", 5))


@query(sql("SELECT record, label, island, round(min(abs(margin)), 6) AS nearest FROM rows_ GROUP BY ALL"))
def nearest_margins(c: Context) -> DataFrame:
    return c.rows.groupBy("record", "label", "island").agg(r(F.min(F.abs("margin")), 6, "nearest"))


@query()
def two_lobe_fit(c: Context) -> DataFrame:
    return iterative.two_lobe_fit(c.reads).select("record", "n", "reason", r("bic_delta", 4), "bimodal", r("separation", 4), r("spread", 4))


@query()
def sim_arms(c: Context) -> DataFrame:
    return simulate.rejection_rates(c.spark, simulate.design(sizes=(20, 50), replicates=20), n_draws=39)


@query(sql("""SELECT record, count(*) AS n, count(*) FILTER (abs(x) <= 2.27688 AND 1 - fid <= 0.1) AS n_within FROM (SELECT record, x, (1 + 1 / (lam * lam) + x * x / (lam * lam) * pow(cos(lam * pi() / 4), 2) + sin(lam * pi() / 2) / lam) / 3 AS fid FROM fl) GROUP BY record""", _FID))
def within_infidelity(c: Context) -> DataFrame:
    """Reads whose detuning is within the threshold of an infidelity of 0.1."""
    x = F.abs("x")
    return metrics.detuning(c.reads.filter("value is not null and not isnan(value) and abs(value) < double('inf')"), F.lit(100.0)).groupBy("record").agg(F.count("*").alias("n"), F.count_if(x <= metrics.detuning_threshold(0.1)).alias("n_within"))


@query(sql("""SELECT record, seq, CASE WHEN hi <= 2.27688 THEN round(1 - (1 + 1 / (1 + lo * lo) + lo * lo / (1 + lo * lo) * pow(cos(sqrt(1 + lo * lo) * pi() / 4), 2) + sin(sqrt(1 + lo * lo) * pi() / 2) / sqrt(1 + lo * lo)) / 3, 8) END AS least,
  CASE WHEN hi <= 2.27688 THEN round(1 - (1 + 1 / (1 + hi * hi) + hi * hi / (1 + hi * hi) * pow(cos(sqrt(1 + hi * hi) * pi() / 4), 2) + sin(sqrt(1 + hi * hi) * pi() / 2) / sqrt(1 + hi * hi)) / 3, 8) END AS most
  FROM (SELECT record, seq, greatest(abs(x) - sigma / 100, 0) AS lo, abs(x) + sigma / 100 AS hi FROM (SELECT *, (value - first_value(value) OVER (PARTITION BY record ORDER BY t_us, seq)) / 100.0 AS x FROM reads) WHERE sigma IS NOT NULL)"""))
def infidelity_bounds(c: Context) -> DataFrame:
    rows = metrics.detuning(c.reads.filter("value is not null and not isnan(value) and abs(value) < double('inf')"), F.lit(100.0)).filter("sigma_x is not null")
    least, most = metrics.infidelity_bounds(F.col("x"), F.col("sigma_x"))
    return rows.select("record", "seq", r(least, 8, "least"), r(most, 8, "most"))


@query("SELECT user_id AS record, count(*) AS n, count(*) FILTER (epoch_us(ts) / 1e6 BETWEEN 946684800 AND 4102444800) AS n_seconds, count(*) FILTER (epoch_us(ts) / 1e3 BETWEEN 946684800 AND 4102444800) AS n_milliseconds, count(*) FILTER (value BETWEEN 946684800 AND 4102444800) AS n_values FROM events GROUP BY user_id")
def clock_plausibility(c: Context) -> DataFrame:
    """Which of a record's numbers can be Unix seconds."""
    ok = metrics.plausible_unix_s
    return c.events_raw.groupBy("record").agg(F.count("*").alias("n"), F.count_if(ok(F.col("t_us") / 1e6)).alias("n_seconds"), F.count_if(ok(F.col("t_us") / 1e3)).alias("n_milliseconds"), F.count_if(ok(F.col("value"))).alias("n_values"))
