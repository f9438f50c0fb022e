"""Queries over reads and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators import carve, long_records
from tidespan.plans.context import GAP_MULT, Context
from tidespan.plans.define import Queries, r, whole
from tidespan.plans.oracle import sql

QUERIES = query = Queries()


@query(sql("""SELECT record, count(*) AS n_reads, sum(is_gap::INT)::BIGINT AS n_gaps, sum(coalesce(dt_us <= 0, false)::INT)::BIGINT AS n_repeated, round(median(dt_us / 1e6) FILTER (dt_us > 0), 6) AS median_spacing_s, round(max(gap_us) / 1e6, 6) AS gap_threshold_s,
  round(sum(dt_us / 1e6 * dt_us / 1e6) FILTER (NOT is_gap) / nullif(sum(dt_us / 1e6) FILTER (NOT is_gap), 0), 4) AS effective_spacing_s,
  round(stddev_pop(dt_us / 1e6) FILTER (NOT is_gap) / nullif(avg(dt_us / 1e6) FILTER (NOT is_gap), 0), 6) AS spacing_cv FROM obs GROUP BY record"""))
def gap_stats(c: Context) -> DataFrame:
    return carve.gap_stats(c.obs).select("record", "n_reads", "n_gaps", "n_repeated", r("median_spacing_s"), r("gap_threshold_s"), r("effective_spacing_s", 4), r("spacing_cv"))


@query(sql("SELECT record, segment, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_reads FROM obs GROUP BY record, segment"))
def segments(c: Context) -> DataFrame:
    return carve.segments(c.obs)


@query(sql("SELECT record, t_us - dt_us AS before_us, t_us AS after_us FROM obs WHERE is_gap"))
def gap_spans(c: Context) -> DataFrame:
    return carve.gap_spans(c.obs)


_WINDOW = ["record", "label", "island", "prev_us", "birth_us", "last_us", "death_us", "birth_kind", "death_kind", "birth_seen", "censored", "n_reads"]


@query(sql(f"SELECT {', '.join(_WINDOW)}, round(duration_s, 6) AS duration_s, round(min_margin, 6) AS min_margin FROM wins WHERE side = 'in_spec'"))
def windows_in_spec(c: Context) -> DataFrame:
    return c.wins.filter(F.col("side") == carve.IN).select(*_WINDOW, r("duration_s"), r("min_margin"))


@query(sql(f"SELECT {', '.join(_WINDOW)}, round(duration_s, 6) AS duration_s, round(min_margin, 6) AS min_margin FROM wins WHERE side = 'out_of_spec'"))
def windows_out_of_spec(c: Context) -> DataFrame:
    return c.wins.filter(F.col("side") == carve.OUT).select(*_WINDOW, r("duration_s"), r("min_margin"))


@query(sql(f"SELECT {', '.join(_WINDOW)}, side, round(duration_s, 6) AS duration_s, round(min_margin, 6) AS min_margin FROM wins"))
def windows_in_pieces(c: Context) -> DataFrame:
    """All windows, carved the way of records too long for one task: every record of more than 20 reads goes in pieces."""
    obs = long_records.observed_reads(c.reads, GAP_MULT, 20)
    return carve.windows(long_records.threshold_reads(obs, c.ladder)).select(*_WINDOW, "side", r("duration_s"), r("min_margin"))


@query(sql("""SELECT w.record, w.label, rows_.seq, round(margin, 6) AS margin, round(CASE WHEN in_spec THEN (t_us - birth_us) / 1e6 END, 6) AS age_s, round(CASE WHEN in_spec THEN (death_us - t_us) / 1e6 END, 6) AS left_s, in_spec,
  CASE WHEN in_spec THEN 'in_spec' ELSE 'out_of_spec' END || CASE WHEN confident THEN '' ELSE '_uncertain' END AS state FROM rows_ JOIN wins w USING (record, label, island)"""))
def window_read_table(c: Context) -> DataFrame:
    return carve.read_table(c.rows, c.wins).select("record", "label", "seq", r("margin"), r("age_s"), r("left_s"), "in_spec", "state")


@query(sql("""SELECT r.record, r.label FROM (SELECT record, label, coalesce(sum(dt_us) FILTER (NOT is_gap), 0) AS a FROM rows_ GROUP BY ALL) r JOIN (SELECT record, label, sum(death_us - birth_us) AS b FROM wins GROUP BY ALL) w USING (record, label) WHERE a <> b"""))
def tiling_errors(c: Context) -> DataFrame:
    return carve.tiling_errors(c.rows, c.wins).select("record", "label")


_TIMELINE = """tl0 AS (SELECT *, {v} AS v, lag({v}) OVER (PARTITION BY record, label ORDER BY t_us, seq) AS pv FROM rows_), tl1 AS (SELECT *, sum((pv IS NULL OR is_gap OR v <> pv)::BIGINT) OVER (PARTITION BY record, label ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM tl0)"""
_STATE = "side || CASE WHEN confident THEN '' ELSE '_uncertain' END"


@query(sql("SELECT record, label, run, v AS state, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_reads FROM tl1 GROUP BY ALL", _TIMELINE.format(v=_STATE)))
def timeline_states(c: Context) -> DataFrame:
    return carve.timeline(c.rows, "state")


@query(sql("SELECT record, label, run, v AS in_spec, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_reads FROM tl1 GROUP BY ALL", _TIMELINE.format(v="in_spec")))
def timeline_compliance(c: Context) -> DataFrame:
    return carve.timeline(c.rows, "in_spec")


@query(sql("""SELECT record, label, birth_us AS start_us, last_us AS end_us, side AS state FROM wins WHERE last_us > birth_us UNION ALL
  SELECT record, label, last_us, death_us, 'crossing' FROM wins WHERE death_us > last_us"""))
def timeline_pieces(c: Context) -> DataFrame:
    held = c.wins.filter("last_us > birth_us").select("record", "label", F.col("birth_us").alias("start_us"), F.col("last_us").alias("end_us"), F.col("side").alias("state"))
    return held.unionByName(c.wins.filter("death_us > last_us").select("record", "label", F.col("last_us").alias("start_us"), F.col("death_us").alias("end_us"), F.lit("crossing").alias("state")))


@query(sql("""SELECT s.record, s.label, g.before_us AS start_us, g.after_us AS end_us, 'unobserved' AS state FROM (SELECT record, label FROM rows_ GROUP BY ALL) s JOIN (SELECT record, t_us - dt_us AS before_us, t_us AS after_us FROM obs WHERE is_gap) g USING (record)
  UNION ALL SELECT record, label, prev_us, t_us, 'observed' FROM rows_ WHERE prev_us IS NOT NULL AND NOT is_gap AND prev_us < t_us"""))
def gap_split_timeline(c: Context) -> DataFrame:
    # one span per step of the record; those that are gaps come back as unobserved
    spans = c.rows.filter("prev_us is not null and prev_us < t_us").select("record", "label", F.col("prev_us").alias("start_us"), F.col("t_us").alias("end_us"), F.lit("observed").alias("state"))
    gaps = carve.gap_spans(c.obs).select("record", F.col("before_us").alias("g0"), F.col("after_us").alias("g1"))
    met = spans.join(gaps, (spans.record == gaps.record) & (spans.start_us == gaps.g0) & (spans.end_us == gaps.g1), "left")
    return met.select(spans.record, "label", "start_us", "end_us", F.when(F.col("g0").isNotNull(), "unobserved").otherwise(F.col("state")).alias("state"))


@query(sql("SELECT record, label, count(*) AS n_reads, round(sum(held_us) / 1e6, 6) AS observed_s, round(sum(CASE WHEN in_spec THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0), 9) AS occupancy FROM rows_ GROUP BY record, label"))
def occupancy(c: Context) -> DataFrame:
    return carve.occupancy(c.rows).select("record", "label", "n_reads", r("observed_s"), r("occupancy", 9))


@query(sql("SELECT record, label, seq, round(coalesce(sum(CASE WHEN in_spec THEN 0 ELSE held_us END) OVER (PARTITION BY record, label ORDER BY t_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1e6, 6) AS out_s FROM rows_"))
def cum_time_out(c: Context) -> DataFrame:
    return carve.cumulative_out(c.rows).select("record", "label", "seq", r("out_s"))


@query(sql("""SELECT record, label, seq, round(sum(step) OVER (PARTITION BY record, label ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING), 3) AS damage FROM (SELECT *, CASE WHEN is_gap OR dt_us IS NULL THEN 0.0
  ELSE 0.5 * (lag(greatest(-margin, 0.0)) OVER (PARTITION BY record, label ORDER BY t_us, seq) + greatest(-margin, 0.0)) * dt_us / 1e6 END AS step FROM rows_)"""))
def cum_damage(c: Context) -> DataFrame:
    return carve.cumulative_damage(c.rows).select("record", "label", "seq", r("damage", 3))


@query(sql("SELECT record, label, round((min(t_us) FILTER (NOT in_spec) - min(t_us)) / 1e6, 6) AS ttf_s FROM rows_ GROUP BY record, label"))
def ttf(c: Context) -> DataFrame:
    return carve.time_to_first_failure(c.rows).select("record", "label", r("ttf_s"))


@query(sql("""SELECT record, label, round(sum(CASE WHEN in_spec AND NOT u THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0), 9) AS lower, round(sum(CASE WHEN in_spec OR u THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0), 9) AS upper
  FROM (SELECT *, NOT confident OR coalesce(next_in <> in_spec, false) AS u FROM rows_) GROUP BY record, label"""))
def in_spec_bounds(c: Context) -> DataFrame:
    return carve.in_spec_bounds(c.rows).select("record", "label", r("lower", 9), r("upper", 9))


@query(sql("""SELECT record, label, round(share, 9) AS share, round(mean_run, 9) AS mean_run, round(mean_run * (1 - share), 9) AS ratio FROM (SELECT record, label, avg(in_spec::INT) AS share FROM rows_ GROUP BY ALL)
  LEFT JOIN (SELECT record, label, sum(n_reads - censored::INT)::DOUBLE / nullif(sum((NOT censored)::INT), 0) AS mean_run FROM wins WHERE side = 'in_spec' GROUP BY ALL) USING (record, label)"""))
def run_length(c: Context) -> DataFrame:
    return carve.run_length(c.rows, c.wins).select("record", "label", r("share", 9), r("mean_run", 9), r("ratio", 9))


@query(sql("""SELECT x.record, x.label, lag, round((sum(x.v * y.v) * (any_value(x.n) - any_value(x.a)) ** 2 - sum((x.v <> y.v)::INT) * any_value(x.a) * (any_value(x.n) - any_value(x.a)) + sum(((x.v + y.v) = 0)::INT) * any_value(x.a) ** 2)::DOUBLE / (count(*) * any_value(x.a) * (any_value(x.n) - any_value(x.a)))::DOUBLE, 5) AS rho FROM acf x JOIN acf y ON x.record = y.record AND x.label = y.label AND x.segment = y.segment AND y.k - x.k BETWEEN 1 AND 10, LATERAL (SELECT y.k - x.k AS lag) WHERE x.a > 0 AND x.a < x.n GROUP BY x.record, x.label, lag""",
  "acf AS (SELECT record, label, segment, in_spec::INT AS v, sum(in_spec::INT) OVER (PARTITION BY record, label) AS a, count(*) OVER (PARTITION BY record, label) AS n, row_number() OVER (PARTITION BY record, label, segment ORDER BY t_us, seq) AS k FROM rows_)"))
def in_spec_acf(c: Context) -> DataFrame:
    return carve.in_spec_autocorrelation(c.rows).select("record", "label", "lag", r("rho", 5))


@query(sql("""SELECT label, count(DISTINCT record) AS n_records, round(avg(occ), 9) AS mean_occupancy, sum((occ >= 0.5)::INT)::BIGINT AS n_mostly_in FROM (SELECT record, label, sum(CASE WHEN in_spec THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0) AS occ FROM rows_ GROUP BY ALL) GROUP BY label"""))
def flagship_compliance(c: Context) -> DataFrame:
    return carve.occupancy(c.rows).groupBy("label").agg(F.count_distinct("record").alias("n_records"), r(F.avg("occupancy"), 9, "mean_occupancy"), F.count_if(F.col("occupancy") >= 0.5).alias("n_mostly_in"))


@query(sql("""SELECT c_custkey AS record, label, count(*) AS n_orders, round(avg((v >= threshold)::INT), 9) AS share FROM (SELECT c_custkey, o_totalprice AS v FROM customer JOIN orders ON o_custkey = c_custkey), (VALUES ('p100k', 100000.0), ('p200k', 200000.0)) l(label, threshold) GROUP BY ALL"""))
def order_rungs(c: Context) -> DataFrame:
    reads = c.table("customer").join(c.table("orders"), F.col("o_custkey") == F.col("c_custkey"))
    rungs = carve.ladder_frame(c.spark, [carve.Rung("p100k", 100_000.0), carve.Rung("p200k", 200_000.0)])
    m = carve.margin(F.col("o_totalprice"), F.col("threshold"), F.col("big_is_good"))
    return reads.crossJoin(F.broadcast(rungs)).groupBy(F.col("c_custkey").alias("record"), "label").agg(F.count("*").alias("n_orders"), r(F.avg(carve.is_in_spec(m).cast("double")), 9, "share"))
