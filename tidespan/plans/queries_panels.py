"""Queries that compose estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators import carve, dependence, panels, renewal, resolve, survey, survival
from tidespan.plans import queries_metrics, queries_renewal, queries_survival, queries_windows
from tidespan.plans.context import LADDER, Context
from tidespan.plans.define import Queries, r
from tidespan.plans.oracle import sql
from tidespan.plans.queries_metrics import _GRID
from tidespan.plans.queries_renewal import _LEDGER, _LONG, _RANK, _USE, DRAWS, SEED, _orders
from tidespan.plans.queries_survival import _GRM, _STEPS

QUERIES = query = Queries()
_DV = "dv AS (SELECT *, sum(area) OVER (PARTITION BY record ORDER BY k ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT *, coalesce((f - lag(f) OVER w) * (4 * pi() * pi() * f * f * density + 4 * pi() * pi() * pow(lag(f) OVER w, 2) * lag(density) OVER w) / 2, 4 * pi() * pi() * density * f * f * f / 3) AS area FROM dens WINDOW w AS (PARTITION BY record ORDER BY k)))"


@query(sql("SELECT record, round(max(w), 7) AS maximum FROM (SELECT o.record, k, (pow(sum(cos(2 * pi() * fs * (0.5 + k / steps) * (t_us - t0) / 1e6)), 2) + pow(sum(sin(2 * pi() * fs * (0.5 + k / steps) * (t_us - t0) / 1e6)), 2)) / any_value(m * m) AS w FROM obs o JOIN fine USING (record) GROUP BY o.record, k) GROUP BY record",
  "fine AS (SELECT *, unnest(range(0, steps::BIGINT + 1)) AS k FROM (SELECT *, 2 * ceil(2 * span_s * fs) AS steps FROM (SELECT record, 1e6 / median(dt_us) FILTER (dt_us > 0) AS fs, count(*) AS m, min(t_us) AS t0, (max(t_us) - min(t_us)) / 1e6 AS span_s FROM obs GROUP BY record) WHERE fs IS NOT NULL))"))
def band_maximum(c: Context) -> DataFrame:
    """In steps of 1 / (4 T) at most."""
    return resolve.band_maximum(c.obs).select("record", r("maximum", 7))


@query(sql("SELECT record, round(CASE WHEN edge > 1e-12 * peak THEN 2 * s2 * step / edge END, 6) AS ratio FROM (SELECT record, avg(sigma * sigma) AS s2 FROM (SELECT record, t_us, CASE WHEN count(sigma) = count(*) THEN sqrt(sum(sigma * sigma)) / count(*) END AS sigma FROM obs GROUP BY record, t_us) GROUP BY record) JOIN (SELECT record, any_value(step) AS step, avg(density) FILTER (f >= 0.9::DOUBLE * 0.5 / step) AS edge, max(density) AS peak FROM dens JOIN spans USING (record) GROUP BY record) USING (record) WHERE edge IS NOT NULL", _GRID))
def noise_floor(c: Context) -> DataFrame:
    """On the grid up to the band edge."""
    return panels.noise_floor(c.obs, resolve.lomb_scargle(c.obs)).select("record", r("ratio"))


@query(sql("SELECT record, round(a / nullif(v0 + (top / 10 - f0) / (f - f0) * (v - v0), 0), 4) AS g10 FROM (SELECT *, coalesce(lag(f) OVER w, 0) AS f0, coalesce(lag(v) OVER w, 0) AS v0, max(f) OVER (PARTITION BY record) AS top, max(v) OVER (PARTITION BY record) AS a FROM dv WINDOW w AS (PARTITION BY record ORDER BY k)) WHERE f0 < top / 10 AND f >= top / 10", _GRID, _DV))
def g10_ratio(c: Context) -> DataFrame:
    return panels.tenth_ratio(resolve.derivative_variance(resolve.lomb_scargle(c.obs))).select("record", r("g10", 4))


_PARTS = {q.name: q.oracle for module in (queries_metrics, queries_windows) for q in module.query.all} | {q.name: q.oracle for q in query.all}
_TOLD = (("difference_ratio", "fewer than three reads in a segment"), ("noise_floor_ratio", "no spectrum or no known error"), ("g10", "no frequency around a tenth"), ("maximum", "no spacing"), ("consistency", "no known error"), ("spread", "fewer than ten reads"))


@query(f"""SELECT record, d.scale AS scale, d.difference_ratio, d.sigma_ratio, n.ratio AS noise_floor_ratio, g.g10 AS g10, b.maximum AS maximum, s.share AS consistency, t.spread AS spread, {", ".join(f"CASE WHEN {x} IS NULL THEN '{why}' ELSE 'ok' END AS {name}_status" for x, (name, why) in zip(("d.difference_ratio", "n.ratio", "g.g10", "b.maximum", "s.share", "t.spread"), _TOLD, strict=True))},
  p.panel_p AS dependence_p, p.members AS dependence_members, CASE WHEN p.panel_p IS NULL THEN p.reason ELSE 'ok' END AS dependence_p_status FROM (SELECT DISTINCT record FROM ({_PARTS["gap_stats"]})) LEFT JOIN (SELECT record, scale, ratio AS difference_ratio, sigma_ratio FROM ({_PARTS["gsjs"]})) d USING (record)
  LEFT JOIN ({_PARTS["noise_floor"]}) n USING (record) LEFT JOIN ({_PARTS["g10_ratio"]}) g USING (record) LEFT JOIN ({_PARTS["band_maximum"]}) b USING (record) LEFT JOIN ({_PARTS["self_consistency"]}) s USING (record) LEFT JOIN ({_PARTS["decile_spread"]}) t USING (record)
  LEFT JOIN (SELECT record, any_value(panel_p) AS panel_p, coalesce(string_agg(member, ',' ORDER BY member) FILTER (attains), '') AS members, any_value(reason) AS reason FROM ({_PARTS["dependence_panel"]}) GROUP BY record) p USING (record)""")
def tellability(c: Context) -> DataFrame:
    """Whether each record can tell its own changes, in one row: noise, spectra, schedule, consistency, and whether errors depend on values."""
    out = panels.tellability(c.obs, dependence.panel(c.obs, DRAWS, SEED))
    told = {"scale": 6, "difference_ratio": 6, "sigma_ratio": 6, "noise_floor_ratio": 6, "g10": 4, "maximum": 7, "consistency": 8, "spread": 8, "dependence_p": 9}
    return out.select("record", *[r(n, d) for n, d in told.items()], "dependence_members", *[f"{n}_status" for n, _ in _TOLD], "dependence_p_status")


@query(f"""SELECT record, label, lower, upper, ratio AS run_ratio, exponent, coalesce(clean, 0) AS clean, coalesce(merged, 0) AS merged, coalesce(unbracketed, 0) AS unbracketed
  FROM ({_PARTS["in_spec_bounds"]}) b LEFT JOIN ({_PARTS["run_length"]}) l USING (record, label) LEFT JOIN ({_PARTS["count_exponent"]}) e USING (record, label) LEFT JOIN ({_PARTS["crossing_placement"]}) p USING (record, label)""")
def threshold_tellability(c: Context) -> DataFrame:
    out = panels.threshold_tellability(c.rows, c.wins)
    return out.select("record", "label", r("lower", 9), r("upper", 9), r("run_ratio", 9), r("exponent"), "clean", "merged", "unbracketed")


@query(sql("""SELECT record, label, quantity, round(value, 6) AS value FROM (SELECT record, label, 'occupancy' AS quantity, sum(CASE WHEN in_spec THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0) AS value FROM rows_ GROUP BY ALL UNION ALL SELECT record, label, 'observed_s', sum(held_us) / 1e6 FROM rows_ GROUP BY ALL)"""))
def long_panel(c: Context) -> DataFrame:
    return panels.long_table(carve.occupancy(c.rows), ["record", "label"], ["occupancy", "observed_s"]).select("record", "label", "quantity", r("value"))


@query(sql("""SELECT record, label, n_reads, round(occ, 9) AS occupancy, round(ttf, 6) AS ttf_s, n_windows, n_censored, n_unseen FROM (SELECT record, label, count(*) AS n_reads, sum(CASE WHEN in_spec THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0) AS occ, (min(t_us) FILTER (NOT in_spec) - min(t_us)) / 1e6 AS ttf FROM rows_ GROUP BY ALL)
  JOIN (SELECT record, label, count(*) FILTER (side = 'in_spec') AS n_windows, count(*) FILTER (side = 'in_spec' AND censored) AS n_censored, count(*) FILTER (side = 'in_spec' AND NOT birth_seen) AS n_unseen FROM wins GROUP BY ALL) USING (record, label)"""))
def within_panel(c: Context) -> DataFrame:
    out = panels.within_panel(carve.occupancy(c.rows), carve.time_to_first_failure(c.rows), c.wins, carve.in_spec_bounds(c.rows))
    return out.select("record", "label", "n_reads", r("occupancy", 9), r("ttf_s"), "n_windows", "n_censored", "n_unseen")


@query(sql("""SELECT w.record, w.label, w.island, w.birth_us FROM wins w JOIN (SELECT record, label FROM rows_ GROUP BY ALL HAVING sum(CASE WHEN in_spec THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0) >= 0.5) USING (record, label)"""))
def culled_timelines(c: Context) -> DataFrame:
    return panels.cull_timelines(c.wins.select("record", "label", "island", "birth_us"), carve.occupancy(c.rows), 0.5)


@query(sql("SELECT record, label FROM wins WHERE (record, birth_us) NOT IN (SELECT record, t_us FROM obs)"))
def same_carve(c: Context) -> DataFrame:
    return panels.same_carve(c.wins, c.rows)


@query(sql("SELECT record FROM (SELECT DISTINCT record, 'g' || (record % 4) AS grp FROM obs) GROUP BY record HAVING count(*) > 1"))
def repeated_members(c: Context) -> DataFrame:
    return panels.repeated_members(c.groups)


@query(sql("SELECT label, side, max(q) FILTER (p = 0.25) AS q25, max(q) FILTER (p = 0.5) AS q50, max(q) FILTER (p = 0.75) AS q75 FROM (SELECT label, side, p, round(CASE WHEN abs(s - (1 - p)) <= 1.490116e-08 THEN (age + after) / 2 ELSE age END, 6) AS q FROM (SELECT label, side, p, min(age) AS age, arg_min(after, age) AS after, arg_min(survival, age) AS s FROM steps_, probs WHERE survival <= 1 - p + 1.490116e-08 GROUP BY ALL)) GROUP BY label, side", _STEPS))
def summary_table(c: Context) -> DataFrame:
    q = queries_survival.km_quantiles(c)
    return survey.summary_table(q, ["label", "side"], [0.25, 0.5, 0.75]).select("label", "side", F.col("`0.25`").alias("q25"), F.col("`0.5`").alias("q50"), F.col("`0.75`").alias("q75"))


@query(sql("SELECT label, side, grp, quantity, round(value, 4) AS value FROM (SELECT label, side, grp, 'mean' AS quantity, mean AS value FROM gr UNION ALL SELECT label, side, grp, 'se', sqrt(var) FROM gr)", _GRM))
def comparison_long(c: Context) -> DataFrame:
    rows = queries_survival.group_means(c).withColumn("se", F.sqrt("var"))
    return panels.long_table(rows, ["label", "side", "grp"], ["mean", "se"]).select("label", "side", "grp", "quantity", r("value", 4))


@query(sql("""SELECT a.label, a.side, a.record AS first, b.record AS second, va.v AS first_verdicts, vb.v AS second_verdicts FROM (SELECT DISTINCT record, label, side FROM wins) a JOIN (SELECT DISTINCT record, label, side FROM wins) b ON b.record = a.record + 1 AND a.label = b.label AND a.side = b.side
  LEFT JOIN att va ON va.record = a.record AND va.label = a.label AND va.side = a.side LEFT JOIN att vb ON vb.record = b.record AND vb.label = b.label AND vb.side = b.side""",
  _USE, _RANK, _orders(DRAWS), _LONG, _LEDGER, "att AS (SELECT record, label, side, array_to_string(list_sort(list(check_name || '=' || verdict)), ',') AS v FROM led GROUP BY ALL)"))
def pair_checks(c: Context) -> DataFrame:
    """All neighbouring records compared, each with the verdicts of its own checks."""
    cells = c.wins.select("record", "label", "side").distinct()
    pairs = cells.withColumn("second", F.col("record") + 1).join(cells.withColumnRenamed("record", "second"), ["label", "side", "second"], "left_semi").withColumnRenamed("record", "first")
    att = renewal.attachments(queries_renewal.ledger(c)).select(*renewal.CELL, F.array_join("verdicts", ",").alias("verdicts"))
    return panels.with_checks(pairs.select("label", "side", "first", "second"), att)


@query(sql("SELECT check_name, regexp_replace(reason, '[0-9]+', '#', 'g') AS reason, count(*) AS n FROM led WHERE verdict = 'not computed' GROUP BY ALL", _USE, _RANK, _orders(DRAWS), _LONG, _LEDGER))
def unanswered(c: Context) -> DataFrame:
    return survey.unanswered_reasons(queries_renewal.ledger(c)).select(F.col("check").alias("check_name"), "reason", F.col("count").alias("n"))


@query(sql("SELECT record, label, side, round(exp(-h), 8) AS survival_from_hazard FROM (SELECT record, label, side, sum(d / m) AS h FROM rrisk GROUP BY ALL)"))
def hazard_survival(c: Context) -> DataFrame:
    last = c.record_curve.groupBy("record", "label", "side").agg(F.max("hazard").alias("h"))
    return last.select("record", "label", "side", r(F.exp(-F.col("h")), 8, "survival_from_hazard"))


@query(sql("SELECT record, label, side FROM (SELECT DISTINCT record FROM reads), ladder, (VALUES ('in_spec'), ('out_of_spec')) s(side) WHERE (record, label, side) NOT IN (SELECT record, label, side FROM wins)"))
def cells_not_carved(c: Context) -> DataFrame:
    """Cells of a ledger of every record, rung and side that the carve does not have."""
    rungs, sides = F.array(*[F.lit(g.label) for g in LADDER]), F.array(F.lit(carve.IN), F.lit(carve.OUT))
    return survey.cross_check(c.wins, c.obs.select("record").distinct().withColumn("label", F.explode(rungs)).withColumn("side", F.explode(sides)))


@query(sql("""SELECT record, label, side, unnest(CASE WHEN count(*) < 12 THEN ['trend', 'dependence', 'shape'] ELSE ['trend'] END) AS check_name, CASE WHEN count(*) < 12 THEN 'not computed' ELSE 'open' END AS verdict FROM wins GROUP BY record, label, side"""))
def expanded_checks(c: Context) -> DataFrame:
    """Cells of fewer than twelve windows stand for all checks, the others for one."""
    few = F.col("n") < 12
    rows = c.wins.groupBy("record", "label", "side").agg(F.count("*").alias("n")).select("record", "label", "side", F.when(few, "(all)").otherwise("trend").alias("check"), F.when(few, "not computed").otherwise("open").alias("verdict"))
    return survey.expand_all(rows, ["trend", "dependence", "shape"]).withColumnRenamed("check", "check_name")


@query(sql("SELECT label || '/' || side AS grp, round(min(age), 6) AS age FROM curve WHERE abs(survival - exp(-hazard)) > 0.0005 GROUP BY ALL"))
def estimators_part(c: Context) -> DataFrame:
    """The first age at which the product-limit curve and the one of the summed hazard part."""
    rows = c.curve.select(F.concat_ws("/", "label", "side").alias("grp"), "age", "survival", F.exp(-F.col("hazard")).alias("by_hazard"))
    return panels.divergence(rows, "survival", "by_hazard", "age", 0.0005).select("grp", r(F.col("level"), 6, "age"))
