"""Queries over durations, curves, comparisons, intervals, spells and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators import cycles, iterative, survival
from tidespan.plans.context import Context
from tidespan.plans.define import Queries, r, whole
from tidespan.plans.oracle import sql

QUERIES = query = Queries()
LS = ("label", "side")
TAU = 86_400.0


@query(sql("SELECT record, label, side, birth_us, event, round(age, 6) AS age, round(age_lo, 6) AS age_lo, round(age_hi, 6) AS age_hi FROM ev"))
def event_table(c: Context) -> DataFrame:
    return c.events.select("record", "label", "side", "birth_us", "event", r("age"), r("age_lo"), r("age_hi"))


@query(sql("SELECT record, label, side, sum((NOT birth_seen)::INT)::BIGINT AS n_unseen FROM wins GROUP BY ALL"))
def unseen_births(c: Context) -> DataFrame:
    return survival.unseen_births(c.wins)


@query(sql("SELECT record, label, side, birth_us FROM ev WHERE age < 0 OR age IS NULL OR age_lo > age OR age_hi < age"))
def event_table_errors(c: Context) -> DataFrame:
    return survival.event_table_errors(c.events).select("record", "label", "side", "birth_us")


@query(sql("SELECT label, side, round(age, 6) AS age, deaths::BIGINT AS deaths, censorings::BIGINT AS censorings, at_risk::BIGINT AS at_risk FROM risk"))
def risk_table(c: Context) -> DataFrame:
    return survival.risk_table(c.events, LS, pooled=True).select("label", "side", r("age"), "deaths", "censorings", "at_risk")


@query(sql("SELECT label, side, round(age, 6) AS age, round(survival, 9) AS survival, round(CASE WHEN isfinite(greenwood) THEN greenwood END, 9) AS greenwood FROM curve"))
def kaplan_meier(c: Context) -> DataFrame:
    return c.curve.select("label", "side", r("age"), r("survival", 9), r("greenwood", 9))


@query(sql("SELECT label, side, round(age, 6) AS age, round(survival, 9) AS survival, round(pow(survival, exp(width)), 8) AS lower, round(pow(survival, exp(-width)), 8) AS upper FROM band"))
def km_band(c: Context) -> DataFrame:
    return survival.loglog_band(c.curve).select("label", "side", r("age"), r("survival", 9), r("lower", 8), r("upper", 8))


@query(sql("SELECT record, label, side, round(age, 6) AS age, round(survival, 9) AS survival FROM rcurve"))
def kaplan_meier_records(c: Context) -> DataFrame:
    return c.record_curve.select("record", "label", "side", r("age"), r("survival", 9))


_STEPS = "steps_ AS (SELECT label, side, age, survival, coalesce(lead(age) OVER (PARTITION BY label, side ORDER BY age), top) AS after FROM (SELECT *, max(age) OVER (PARTITION BY label, side) AS top FROM curve) WHERE deaths > 0), probs AS (SELECT * FROM (VALUES (0.25), (0.5), (0.75)) v(p))"


@query(sql("""SELECT label, side, p::DOUBLE AS p, round(CASE WHEN abs(s - (1 - p)) <= 1.490116e-08 THEN (age + after) / 2 ELSE age END, 6) AS quantile FROM (
  SELECT label, side, p, min(age) AS age, arg_min(after, age) AS after, arg_min(survival, age) AS s FROM steps_, probs WHERE survival <= 1 - p + 1.490116e-08 GROUP BY ALL)""", _STEPS))
def km_quantiles(c: Context) -> DataFrame:
    each = [survival.survival_quantile(c.curve, p, key=LS, pooled=True).withColumn("p", F.lit(p)) for p in (0.25, 0.5, 0.75)]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("label", "side", "p", r("quantile"))


@query(sql("SELECT label, side, round(age, 6) AS age, round(hazard, 9) AS hazard, round(hazard * exp(-1.959963984540054 * sqrt(hazard_var) / nullif(hazard, 0)), 8) AS hazard_lower, round(hazard * exp(1.959963984540054 * sqrt(hazard_var) / nullif(hazard, 0)), 8) AS hazard_upper FROM curve"))
def nelson_aalen(c: Context) -> DataFrame:
    return survival.hazard_band(c.curve).select("label", "side", r("age"), r("hazard", 9), r("hazard_lower", 8), r("hazard_upper", 8))


_RMST = f"""ra0 AS (SELECT *, min(age) OVER w AS first_age FROM curve WINDOW w AS (PARTITION BY label, side)),
ra1 AS (SELECT *, least(coalesce(lead(age) OVER (PARTITION BY label, side ORDER BY age), {TAU}), {TAU}) AS upto FROM ra0 WHERE deaths > 0 OR age = first_age),
ra2 AS (SELECT *, greatest(0, upto - least(age, {TAU})) * survival AS area FROM ra1),
ra3 AS (SELECT *, sum(area) OVER (PARTITION BY label, side ORDER BY age DESC ROWS UNBOUNDED PRECEDING) AS beyond FROM ra2),
rm AS (SELECT label, side, sum(area) + least(min(age), {TAU}) AS rmst, sum(CASE WHEN d > 0 AND age < {TAU} AND beyond > 0 THEN beyond * beyond * d / (m * nullif(m - d, 0)) ELSE 0 END) AS rmst_var FROM ra3 GROUP BY ALL)"""


@query(sql("SELECT label, side, round(rmst, 4) AS rmst, round(sqrt(rmst_var), 4) AS rmst_se FROM rm", _RMST))
def rmst(c: Context) -> DataFrame:
    return survival.restricted_mean(c.curve, TAU, LS, pooled=True).select("label", "side", r("rmst", 4), r(F.sqrt("rmst_var"), 4, "rmst_se"))


@query(sql(f"""SELECT label, side, count(*) AS n, round(avg(least(age_lo, {TAU})), 4) AS lower_area, round(avg(CASE WHEN event THEN least(age_hi, {TAU}) ELSE {TAU} END), 4) AS upper_area,
  round(avg(CASE WHEN event THEN least(age_hi, {TAU}) ELSE {TAU} END) - avg(least(age_lo, {TAU})), 4) AS width FROM ev GROUP BY ALL"""))
def placement_bracket(c: Context) -> DataFrame:
    return survival.placement_bracket(c.events, TAU, LS).select("label", "side", "n", r("lower_area", 4), r("upper_area", 4), r("width", 4))


@query(sql(f"""SELECT label, side, round(CASE WHEN lo[(n + 1) // 2] < 1e17 THEN (lo[(n + 1) // 2] + lo[n // 2 + 1]) / 2 END, 6) AS median_lower, round(CASE WHEN hi[n // 2 + 1] < 1e17 THEN (hi[(n + 1) // 2] + hi[n // 2 + 1]) / 2 END, 6) AS median_upper, round(width, 4) AS width_censoring
  FROM (SELECT label, side, count(*) AS n, list_sort(list(age_lo)) AS lo, list_sort(list(CASE WHEN event THEN age_hi ELSE 1e18 END)) AS hi, avg(CASE WHEN event THEN least(age, {TAU}) ELSE {TAU} END) - avg(least(age, {TAU})) AS width FROM ev GROUP BY ALL)"""))
def placement_medians(c: Context) -> DataFrame:
    return survival.bracket_medians(c.events, TAU, LS).select("label", "side", r("median_lower"), r("median_upper"), r("width_censoring", 4))


@query(sql("SELECT k.label, k.side, k.at_s, round(coalesce((SELECT arg_max(survival, age) FROM curve c WHERE c.label = k.label AND c.side = k.side AND c.age <= k.at_s), 1.0), 9) AS survival FROM (SELECT DISTINCT label, side, at_s FROM ev, (VALUES (3600.0::DOUBLE), (36000.0), (86400.0), (604800.0)) v(at_s)) k"))
def step_evaluation(c: Context) -> DataFrame:
    at = c.events.select(*LS).distinct().select(*LS, F.explode(F.array(*[F.lit(x) for x in (3600.0, 36000.0, 86400.0, 604800.0)])).alias("at"))
    return survival.step_at(c.curve, at, LS).select(*LS, F.col("at").alias("at_s"), r("survival", 9))


@query(sql("""SELECT side, a, b, round(separation, 6) AS separation, row_number() OVER (PARTITION BY side ORDER BY separation DESC, a, b) AS rank FROM (SELECT side, a, b, sum(abs(fa - fb) * (log10(upto) - log10(age))) AS separation FROM filled GROUP BY ALL)""",
  """names AS (SELECT DISTINCT side, label FROM curve), pr AS (SELECT x.side, x.label AS a, y.label AS b FROM names x JOIN names y ON x.side = y.side AND x.label < y.label),
grid AS (SELECT DISTINCT pr.*, c.age FROM pr JOIN curve c ON c.side = pr.side AND c.label IN (pr.a, pr.b) WHERE c.age > 0),
vals AS (SELECT g.*, x.survival AS sa, y.survival AS sb FROM grid g LEFT JOIN curve x ON x.side = g.side AND x.label = g.a AND x.age = g.age LEFT JOIN curve y ON y.side = g.side AND y.label = g.b AND y.age = g.age),
filled AS (SELECT side, a, b, age, lead(age) OVER w AS upto, coalesce(last_value(sa IGNORE NULLS) OVER w, 1.0) AS fa, coalesce(last_value(sb IGNORE NULLS) OVER w, 1.0) AS fb FROM vals WINDOW w AS (PARTITION BY side, a, b ORDER BY age))"""))
def km_pair_rank(c: Context) -> DataFrame:
    return survival.log_time_separation(c.curve, ("side",), "label").select("side", "a", "b", r("separation"), "rank")


_GROUPS = "gev AS (SELECT *, 'g' || (record % 4) AS grp FROM ev)"
_LOGRANK = _GROUPS + """, lr0 AS (SELECT label, side, age, sum((grp = 'g0')::INT) AS ca, sum((grp = 'g1')::INT) AS cb, sum((grp = 'g0' AND event)::INT) AS da, sum((grp = 'g1' AND event)::INT) AS db FROM gev WHERE grp IN ('g0', 'g1') GROUP BY ALL),
lr1 AS (SELECT *, sum(ca) OVER w AS na, sum(cb) OVER w AS nb FROM lr0 WINDOW w AS (PARTITION BY label, side ORDER BY age DESC ROWS UNBOUNDED PRECEDING)),
lr AS (SELECT label, side, sum(da - (da + db) * na::DOUBLE / (na + nb)) AS oe, sum(CASE WHEN na + nb > 1 THEN na::DOUBLE * nb * (da + db) * (na + nb - da - db) / ((na + nb)::DOUBLE * (na + nb) * (na + nb - 1)) ELSE 0 END) AS v FROM lr1 WHERE da + db > 0 GROUP BY ALL)"""


@query(sql("SELECT label, side, round(oe, 6) AS o_minus_e, round(v, 6) AS variance, round(oe / sqrt(v), 6) AS z, CASE WHEN v > 0 THEN '' ELSE 'zero variance' END AS reason FROM lr", _LOGRANK))
def logrank(c: Context) -> DataFrame:
    return survival.log_rank(c.events.join(c.groups, "record"), "grp", "g0", "g1", LS).select(*LS, r("o_minus_e"), r("variance"), r("z"), "reason")


@query(sql("SELECT label, side, round(min(top), 6) AS tau, arg_min(grp, (top, grp)) AS tau_record, count(*) AS n_records FROM (SELECT label, side, grp, max(age) AS top FROM gev GROUP BY ALL) GROUP BY ALL", _GROUPS))
def comparison_tau(c: Context) -> DataFrame:
    return survival.comparison_tau(c.events.join(c.groups, "record"), "grp", LS).select(*LS, r("tau"), "tau_record", "n_records")


_GRM = _GROUPS + f""", gk AS (SELECT label, side, grp, age, sum(event::INT)::DOUBLE AS d, sum(count(*)) OVER (PARTITION BY label, side, grp ORDER BY age DESC)::DOUBLE AS m FROM gev GROUP BY label, side, grp, age),
gs AS (SELECT *, product(1 - d / m) OVER (PARTITION BY label, side, grp ORDER BY age ROWS UNBOUNDED PRECEDING) AS s, min(age) OVER (PARTITION BY label, side, grp) AS a0 FROM gk),
gt AS (SELECT *, least(coalesce(lead(age) OVER (PARTITION BY label, side, grp ORDER BY age), {TAU}), {TAU}) AS upto FROM gs WHERE d > 0 OR age = a0),
gu AS (SELECT *, greatest(0, upto - least(age, {TAU})) * s AS area FROM gt),
gb AS (SELECT *, sum(area) OVER (PARTITION BY label, side, grp ORDER BY age DESC ROWS UNBOUNDED PRECEDING) AS beyond FROM gu),
gr AS (SELECT label, side, grp, sum(area) + least(min(age), {TAU}) AS mean, sum(CASE WHEN d > 0 AND age < {TAU} AND beyond > 0 THEN beyond * beyond * d / (m * nullif(m - d, 0)) ELSE 0 END) AS var FROM gb GROUP BY ALL)"""


def group_means(c: Context) -> DataFrame:
    key = (*LS, "grp")
    curve = survival.product_limit(survival.risk_table(c.events.join(c.groups, "record"), key, pooled=True), key, pooled=True)
    return survival.restricted_mean(curve, TAU, key, pooled=True).select(*key, F.col("rmst").alias("mean"), F.col("rmst_var").alias("var"))


@query(sql("SELECT a.label, a.side, a.grp AS first, b.grp AS second, round(a.mean - b.mean, 4) AS difference, round(sqrt(a.var + b.var), 4) AS se FROM gr a JOIN gr b ON a.label = b.label AND a.side = b.side AND a.grp < b.grp", _GRM))
def rmst_diff(c: Context) -> DataFrame:
    a, b = group_means(c).alias("a"), group_means(c).alias("b")
    met = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.side") == F.col("b.side")) & (F.col("a.grp") < F.col("b.grp")))
    return met.select("a.label", "a.side", F.col("a.grp").alias("first"), F.col("b.grp").alias("second"), r(F.col("a.mean") - F.col("b.mean"), 4, "difference"), r(F.sqrt(F.col("a.var") + F.col("b.var")), 4, "se"))


@query(sql("""SELECT label, side, k, round(q, 5) AS q, round(tau2, 3) AS tau2, round(pooled, 4) AS pooled, round(se, 4) AS se, round(tau2 / nullif(tau2 + (k - 1) / c, 0), 6) AS i2 FROM (
  SELECT label, side, any_value(k) AS k, any_value(q) AS q, any_value(c) AS c, any_value(tau2) AS tau2, sum(mean / (var + tau2)) / sum(1 / (var + tau2)) AS pooled, sqrt(1 / sum(1 / (var + tau2))) AS se FROM gr JOIN dl USING (label, side) WHERE var > 0 GROUP BY ALL)""",
  _GRM, """w0 AS (SELECT label, side, count(*) AS k, sum(1 / var) AS sw, sum(1 / (var * var)) AS sww, sum(mean / var) AS swy FROM gr WHERE var > 0 GROUP BY ALL HAVING count(*) >= 3),
dl AS (SELECT label, side, k, q, c, greatest(0, (q - k + 1) / c) AS tau2 FROM (SELECT label, side, any_value(k) AS k, sum((mean - swy / sw) * (mean - swy / sw) / var) AS q, any_value(sw - sww / sw) AS c FROM gr JOIN w0 USING (label, side) WHERE var > 0 GROUP BY ALL))"""))
def dl_pooled(c: Context) -> DataFrame:
    return survival.pool_random_effects(group_means(c), LS).select(*LS, "k", r("q", 5), r("tau2", 3), r("pooled", 4), r("se", 4), r("i2"))


@query()
def q_profile(c: Context) -> DataFrame:
    return iterative.q_profile(group_means(c), LS).select(*LS, "k", r("tau2_lower", 3), r("tau2_upper", 3), r("prediction_lower", 3), r("prediction_upper", 3))


@query()
def turnbull(c: Context) -> DataFrame:
    return iterative.turnbull(c.events).select("record", "label", "side", r("lo"), r("hi"), r("mass", 8), r("survival_after", 8), r("log_likelihood"), "converged")


# intervals between events

_GAPS = "buys AS (SELECT record, (t_us - lag(t_us) OVER (PARTITION BY record ORDER BY t_us, seq)) / 1e6 AS x, t_us FROM reads WHERE event_type = 'purchase')"


def purchases(c: Context) -> DataFrame:
    return survival.inter_event(c.events_raw.filter("event_type = 'purchase'"), ("record",))


@query(sql("SELECT record, count(x) AS n, round(avg(x), 4) AS mean_s, round(stddev_pop(x), 4) AS std_s, round(min(x), 6) AS min_s, round(max(x), 6) AS max_s FROM buys GROUP BY record", _GAPS))
def intervals(c: Context) -> DataFrame:
    return survival.interval_stats(purchases(c), ("record",)).select("record", "n", r("mean_s", 4), r("std_s", 4), r("min_s"), r("max_s"))


@query(sql("""SELECT least(49, floor((log10(x) - lo) / nullif(hi - lo, 0) * 50))::BIGINT AS bin, dropped, count(*) AS n FROM buys, (SELECT min(log10(x)) FILTER (x > 0) AS lo, max(log10(x)) FILTER (x > 0) AS hi, count(*) FILTER (x <= 0) AS dropped FROM buys) WHERE x > 0 GROUP BY ALL""", _GAPS))
def log_interval_hist(c: Context) -> DataFrame:
    return survival.log_histogram(purchases(c))


_HIST = "vh AS (SELECT side, label, least(39, floor((duration_s - lo) / (hi - lo) * 40))::BIGINT AS bin, count(*) AS n FROM (SELECT *, min(duration_s) OVER w AS lo, max(duration_s) OVER w AS hi FROM wins WINDOW w AS (PARTITION BY label, side)) WHERE hi > lo GROUP BY ALL)"


@query(sql("SELECT * FROM vh", _HIST))
def histograms(c: Context) -> DataFrame:
    return survival.linear_histogram(c.wins, "duration_s", LS)


@query(sql("SELECT label, side, min(bin) AS limit_bin, (min(total) - min(seen))::BIGINT AS n_beyond FROM (SELECT *, sum(n) OVER (PARTITION BY label, side ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY label, side) AS total FROM vh) WHERE seen >= 0.99 * total GROUP BY ALL", _HIST))
def histogram_limit(c: Context) -> DataFrame:
    return survival.view_limit(survival.linear_histogram(c.wins, "duration_s", LS), LS)


@query(sql("""SELECT s.bin, coalesce(n, 0) AS n, q1_s, median_s, q3_s, p90_s FROM (SELECT unnest(range(0, top + 1)) AS bin FROM binspan) s LEFT JOIN (
  SELECT least(top, floor((t_us / 86400000000.0 - d0) / 14)::BIGINT) AS bin, count(*) AS n, round(quantile_cont(x, 0.25), 4) AS q1_s, round(quantile_cont(x, 0.5), 4) AS median_s, round(quantile_cont(x, 0.75), 4) AS q3_s, round(quantile_cont(x, 0.9), 4) AS p90_s FROM buys, binspan WHERE x IS NOT NULL GROUP BY ALL) USING (bin)""",
  _GAPS, "binspan AS (SELECT d0, greatest(0, ceil((d1 - d0) / 14)::BIGINT - 1) AS top FROM (SELECT min(t_us / 86400000000.0) AS d0, max(t_us / 86400000000.0) AS d1 FROM buys WHERE x IS NOT NULL))"))
def binned_intervals(c: Context) -> DataFrame:
    return survival.binned_intervals(purchases(c), F.col("t_us") / 86_400_000_000.0).select("bin", "n", r("q1_s", 4), r("median_s", 4), r("q3_s", 4), r("p90_s", 4))


@query(sql("SELECT record, round(stddev_pop(value) / nullif(abs(avg(value)), 0), 8) AS cv FROM reads GROUP BY record"))
def variation(c: Context) -> DataFrame:
    return survival.variation(c.reads, "value", ("record",)).select("record", r("cv", 8))


# spells and cycles


@query(sql("SELECT record, run, status, start_us, end_us, gap_after, n_identical::BIGINT AS n_identical, n_conflicting::BIGINT AS n_conflicting FROM spell"))
def spells(c: Context) -> DataFrame:
    return c.spells.select("record", "run", "status", "start_us", "end_us", "gap_after", "n_identical", "n_conflicting")


@query(sql("SELECT record, run FROM (SELECT *, lead(start_us) OVER (PARTITION BY record ORDER BY start_us, run) AS ahead FROM spell) WHERE status IS NULL OR end_us < start_us OR ahead < end_us"))
def spell_errors(c: Context) -> DataFrame:
    return cycles.spell_errors(c.spells).select("record", "run")


@query(sql("SELECT record, stretch, lo_us, hi_us, count(*) AS n_spells FROM live GROUP BY ALL"))
def stretches(c: Context) -> DataFrame:
    return c.live.groupBy("record", "stretch", "lo_us", "hi_us").agg(F.count("*").alias("n_spells"))


@query(sql("SELECT record, stretch, cal_start AS start_us, cal_end AS end_us, merged::BIGINT AS n_merged FROM cals"))
def merged_calibrations(c: Context) -> DataFrame:
    return cycles.calibrations(c.live).select("record", "stretch", "start_us", "end_us", "n_merged")


@query(sql("SELECT record, stretch, start_us, end_us, event, round(length_s, 6) AS length_s FROM cyc"))
def cycle_table(c: Context) -> DataFrame:
    return cycles.cycles(c.live).select("record", "stretch", "start_us", "end_us", "event", r("length_s"))


@query(sql("""SELECT record, count(*) AS n_stretches, sum((f IS NULL OR f > lo_us)::INT)::BIGINT AS n_dropped, coalesce(any_value(g), 0)::BIGINT AS n_merged FROM (SELECT record, stretch, lo_us, min(start_us) FILTER (status = 'calibrating') AS f FROM live GROUP BY ALL)
  LEFT JOIN (SELECT record, sum(merged) AS g FROM cals GROUP BY record) USING (record) GROUP BY record"""))
def dropped_births(c: Context) -> DataFrame:
    return cycles.dropped_births(c.live)


_CYC_KM = "ck AS (SELECT length_s AS age, sum(event::INT)::DOUBLE AS d, sum(count(*)) OVER (ORDER BY length_s DESC)::DOUBLE AS m FROM cyc GROUP BY length_s), cs AS (SELECT *, product(1 - d / m) OVER (ORDER BY age ROWS UNBOUNDED PRECEDING) AS s FROM ck)"


@query(sql("SELECT round(age, 6) AS age, round(s, 9) AS survival FROM cs", _CYC_KM))
def cycle_survival(c: Context) -> DataFrame:
    table = cycles.cycle_events(cycles.cycles(c.live))
    return survival.product_limit(survival.risk_table(table, ("label",), pooled=True), ("label",), pooled=True).select(r("age"), r("survival", 9))


@query(sql("""SELECT round(rmst, 4) AS mtbc_s, round(sqrt(v), 4) AS se, round(rmst - 1.959963984540054 * sqrt(v), 3) AS lower, round(rmst + 1.959963984540054 * sqrt(v), 3) AS upper FROM (SELECT sum(area) + least(min(age), 86400.0) AS rmst, sum(CASE WHEN d > 0 AND age < 86400.0 AND beyond > 0 THEN beyond * beyond * d / (m * nullif(m - d, 0)) ELSE 0 END) AS v FROM (
  SELECT *, sum(area) OVER (ORDER BY age DESC ROWS UNBOUNDED PRECEDING) AS beyond FROM (SELECT *, greatest(0, least(coalesce(lead(age) OVER (ORDER BY age), 86400.0), 86400.0) - least(age, 86400.0)) * s AS area FROM (SELECT *, min(age) OVER () AS a0 FROM cs) WHERE d > 0 OR age = a0)))""", _CYC_KM))
def mtbc(c: Context) -> DataFrame:
    table = cycles.cycle_events(cycles.cycles(c.live))
    mean = survival.restricted_mean(survival.product_limit(survival.risk_table(table, ("label",), pooled=True), ("label",), pooled=True), TAU, ("label",), pooled=True)
    half = survival.normal_quantile(0.975) * F.sqrt("rmst_var")
    return mean.select(r("rmst", 4, "mtbc_s"), r(F.sqrt("rmst_var"), 4, "se"), r(F.col("rmst") - half, 3, "lower"), r(F.col("rmst") + half, 3, "upper"))


@query(sql("SELECT record, stretch, count(*) FILTER (event) AS n, round(sum(length_s), 6) AS tau FROM cyc GROUP BY ALL HAVING count(*) FILTER (event) >= 2 AND max(length_s) FILTER (event) > min(length_s) FILTER (event)"))
def cycle_battery_segments(c: Context) -> DataFrame:
    return cycles.battery_segments(cycles.cycles(c.live)).select("record", "stretch", "n", r("tau"))


@query(sql("SELECT record, count(*) FILTER (event) AS n, round(coalesce(sum(length_s) FILTER (event), 0) + arg_max(CASE WHEN event THEN 0 ELSE length_s END, start_us), 6) AS tau FROM cyc GROUP BY record"))
def cycle_observed_clock(c: Context) -> DataFrame:
    return cycles.observed_clock(cycles.cycles(c.live)).select("record", "n", r("tau"))


@query(sql("""SELECT record, status, round(us / 1e6, 6) AS seconds, round(us / nullif((r1 - r0)::DOUBLE, 0), 9) AS share FROM (SELECT record, status, sum(end_us - start_us) AS us FROM spell GROUP BY ALL UNION ALL
  SELECT record, 'not listed', max(end_us) - min(start_us) - sum(end_us - start_us) FROM spell GROUP BY record) JOIN (SELECT record, min(start_us) AS r0, max(end_us) AS r1 FROM spell GROUP BY record) USING (record)"""))
def status_shares(c: Context) -> DataFrame:
    return cycles.status_shares(c.spells).select("record", "status", r("seconds"), r("share", 9))


@query(sql("""SELECT x.record, x.cycle, x.stretch, round((hi_us - lo_us) / 1e6, 6) AS stretch_s, round(length_s, 6) AS length_s, event, opens, round(prev_s, 6) AS prev_s, coalesce(arg_min(l.status, l.start_us), 'none') AS status_at_start,
  round(coalesce(sum(l.end_us - l.start_us) FILTER (l.status = 'measuring'), 0) / 1e6 / length_s, 8) AS share_measuring, round(coalesce(sum(l.end_us - l.start_us) FILTER (l.status = 'idle'), 0) / 1e6 / length_s, 8) AS share_idle
  FROM numbered x LEFT JOIN (SELECT record, stretch, start_us, end_us, status FROM live WHERE status <> 'calibrating' AND end_us > start_us) l ON l.record = x.record AND l.stretch = x.stretch AND l.start_us >= x.start_us AND l.start_us < x.end_us GROUP BY x.record, x.cycle, x.stretch, lo_us, hi_us, length_s, event, opens, prev_s""",
  "numbered AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY start_us, end_us) - 1 AS cycle, lag(length_s) OVER (PARTITION BY record, stretch ORDER BY start_us) AS prev_s, row_number() OVER (PARTITION BY record, stretch ORDER BY start_us) = 1 AS opens FROM cyc)"))
def cycle_context(c: Context) -> DataFrame:
    return cycles.cycle_context(c.live, ["measuring", "idle"]).select("record", whole("cycle"), "stretch", r("stretch_s"), r("length_s"), "event", "opens", r("prev_s"), "status_at_start", r("share_measuring", 8), r("share_idle", 8))


@query(sql("""SELECT record, period, round((upto - x0) / 3.6e9, 8) AS exposure_h, (SELECT count(*) FROM calx k WHERE k.record = e.record AND (SELECT count(*) FROM cuts q WHERE q.record = k.record AND q.x <= k.x) = period) AS n_calibrations,
  (SELECT count(*) FROM cycx k WHERE k.record = e.record AND k.event AND (SELECT count(*) FROM cuts q WHERE q.record = k.record AND q.x <= k.x) = period) AS n_complete,
  (SELECT count(*) FROM cycx k WHERE k.record = e.record AND NOT k.event AND (SELECT count(*) FROM cuts q WHERE q.record = k.record AND q.x <= k.x) = period) AS n_censored FROM edge e""",
  """offs AS (SELECT *, coalesce(sum(hi_us - lo_us) OVER (PARTITION BY record ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT DISTINCT record, stretch, lo_us, hi_us FROM live)),
tot AS (SELECT record, sum(hi_us - lo_us)::BIGINT AS total FROM offs GROUP BY record), calx AS (SELECT record, off + cal_start - lo_us AS x FROM cals JOIN offs USING (record, stretch, lo_us)), cycx AS (SELECT record, off + start_us - lo_us AS x, event FROM cyc JOIN offs USING (record, stretch, lo_us)),
cands AS (SELECT record, x FROM calx UNION SELECT record, off FROM offs UNION SELECT record, total FROM tot),
cuts AS (SELECT record, k, arg_min(x, (abs(x * 4 - total * k), x)) AS x FROM tot JOIN cands USING (record), (VALUES (1), (2), (3)) v(k) GROUP BY record, k),
marks AS (SELECT record, k, x FROM cuts UNION ALL SELECT record, 0, 0 FROM tot UNION ALL SELECT record, 4, total FROM tot), edge AS (SELECT record, k::BIGINT AS period, x AS x0, lead(x) OVER (PARTITION BY record ORDER BY k) AS upto FROM marks QUALIFY upto IS NOT NULL)"""))
def cycle_periods(c: Context) -> DataFrame:
    return cycles.cycle_periods(c.live).select("record", "period", r("exposure_h", 8), "n_calibrations", "n_complete", "n_censored")
