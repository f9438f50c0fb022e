"""The same domain in DuckDB SQL: common table expressions that oracle queries build on, written independently of the DataFrames."""

BASE = """
reads AS (SELECT user_id AS record, epoch_us(ts) AS t_us, event_id AS seq, value, CASE WHEN event_id % 7 <> 0 THEN 0.1 * value END AS sigma, event_type
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND isfinite(value)),
steps AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY record ORDER BY t_us, seq) AS dt_us, count(*) OVER (PARTITION BY record) AS n FROM reads),
spacing AS (SELECT record, 4.0 * median(dt_us) FILTER (dt_us > 0) AS gap_us FROM steps GROUP BY record),
flagged AS (SELECT s.*, g.gap_us, coalesce(s.dt_us > g.gap_us, false) AS is_gap FROM steps s JOIN spacing g USING (record)),
obs AS (SELECT *, sum(is_gap::BIGINT) OVER (PARTITION BY record ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM flagged),
ladder AS (SELECT * FROM (VALUES ('r20', 20.0::DOUBLE), ('r50', 50.0::DOUBLE), ('r100', 100.0::DOUBLE)) v(label, threshold)),
marked AS (SELECT o.*, label, threshold, value - threshold AS margin, value >= threshold AS in_spec, coalesce(abs(value - threshold) >= sigma, false) AS confident FROM obs o, ladder WHERE n >= 2),
edged AS (SELECT *, lag(t_us) OVER w AS prev_us, lag(in_spec) OVER w AS prev_in, lead(t_us) OVER w AS next_us, lead(is_gap) OVER w AS next_gap, lead(in_spec) OVER w AS next_in, row_number() OVER w AS rn
  FROM marked WINDOW w AS (PARTITION BY record, label ORDER BY t_us, seq)),
rows_ AS (SELECT *, CASE WHEN in_spec THEN 'in_spec' ELSE 'out_of_spec' END AS side, (prev_in IS NULL OR is_gap OR in_spec <> prev_in) AS starts, (next_in IS NULL OR next_gap OR in_spec <> next_in) AS ends,
  CASE WHEN coalesce(next_gap, true) THEN 0 ELSE next_us - t_us END AS held_us,
  sum((prev_in IS NULL OR is_gap OR in_spec <> prev_in)::BIGINT) OVER (PARTITION BY record, label ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM edged),
runs AS (SELECT record, label, island, side, any_value(segment) AS segment, min(t_us) AS birth_us, max(t_us) AS last_us, count(*) AS n_reads, min(margin) AS min_margin,
  max(CASE WHEN starts THEN CASE WHEN prev_us IS NULL THEN 'scan_start' WHEN is_gap THEN 'gap_resume' ELSE 'crossing' END END) AS birth_kind,
  max(CASE WHEN ends THEN CASE WHEN next_us IS NULL THEN 'scan_end' WHEN next_gap THEN 'gap_start' ELSE 'crossing' END END) AS death_kind,
  max(CASE WHEN starts THEN prev_us END) AS before_us, max(CASE WHEN ends THEN next_us END) AS after_us FROM rows_ GROUP BY ALL),
wins AS (SELECT *, birth_kind = 'crossing' AS birth_seen, death_kind <> 'crossing' AS censored, CASE WHEN death_kind = 'crossing' THEN after_us ELSE last_us END AS death_us,
  CASE WHEN birth_kind = 'crossing' THEN before_us END AS prev_us, (CASE WHEN death_kind = 'crossing' THEN after_us ELSE last_us END - birth_us) / 1e6 AS duration_s FROM runs),
ev AS (SELECT record, label, side, birth_us, duration_s AS age, NOT censored AS event, (last_us - birth_us) / 1e6 AS age_lo, CASE WHEN NOT censored THEN (death_us - prev_us) / 1e6 END AS age_hi FROM wins WHERE birth_seen),
risk AS (SELECT label, side, age, sum(event::INT) AS deaths, sum((NOT event)::INT) AS censorings, sum(count(*)) OVER (PARTITION BY label, side ORDER BY age DESC) AS at_risk FROM ev GROUP BY label, side, age),
terms AS (SELECT label, side, age, deaths::DOUBLE AS d, at_risk::DOUBLE AS m, deaths, censorings, at_risk FROM risk),
curve AS (SELECT label, side, age, deaths, censorings, at_risk, d, m, product(1 - d / m) OVER w AS survival, sum(CASE WHEN d = 0 THEN 0 WHEN d = m THEN 'inf'::DOUBLE ELSE d / (m * (m - d)) END) OVER w AS greenwood,
  sum(d / m) OVER w AS hazard, sum(d / (m * m)) OVER w AS hazard_var FROM terms WINDOW w AS (PARTITION BY label, side ORDER BY age ROWS UNBOUNDED PRECEDING)),
rrisk AS (SELECT record, label, side, age, sum(event::INT)::DOUBLE AS d, sum(count(*)) OVER (PARTITION BY record, label, side ORDER BY age DESC)::DOUBLE AS m FROM ev GROUP BY record, label, side, age),
rcurve AS (SELECT *, product(1 - d / m) OVER (PARTITION BY record, label, side ORDER BY age ROWS UNBOUNDED PRECEDING) AS survival FROM rrisk),
band AS (SELECT *, CASE WHEN survival > 0 AND survival < 1 THEN 1.959963984540054 * sqrt(greenwood) / abs(ln(survival)) END AS width FROM curve),
samples AS (SELECT record, t_us, count(*) AS n, count(DISTINCT status) AS kinds, arg_max(status, seq) AS status FROM (SELECT *, coalesce(CASE event_type WHEN 'error' THEN 'offline' WHEN 'click' THEN 'calibrating' WHEN 'view' THEN 'measuring'
  WHEN 'signup' THEN 'idle' WHEN 'purchase' THEN 'tuning' END, 'other') AS status FROM (SELECT user_id AS record, epoch_us(ts) AS t_us, event_id AS seq, event_type FROM events)) GROUP BY record, t_us),
polled AS (SELECT *, coalesce(t_us - lag(t_us) OVER w > 86400000000, false) AS gap, lag(status) OVER w AS prev_status, lead(t_us) OVER w AS next_us FROM samples WINDOW w AS (PARTITION BY record ORDER BY t_us)),
srun AS (SELECT *, lead(gap) OVER w AS next_gap, sum((gap OR prev_status IS NULL OR status <> prev_status)::BIGINT) OVER (PARTITION BY record ORDER BY t_us ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM polled WINDOW w AS (PARTITION BY record ORDER BY t_us)),
stail AS (SELECT *, row_number() OVER (PARTITION BY record, run ORDER BY t_us DESC) AS back FROM srun),
spell AS (SELECT record, run, status, min(t_us) AS start_us, max(CASE WHEN back = 1 THEN CASE WHEN next_us IS NULL OR next_gap THEN t_us ELSE next_us END END) AS end_us, bool_or(back = 1 AND coalesce(next_gap, false)) AS gap_after,
  sum(CASE WHEN kinds = 1 THEN n - 1 ELSE 0 END) AS n_identical, sum(CASE WHEN kinds > 1 THEN n - 1 ELSE 0 END) AS n_conflicting FROM stail GROUP BY record, run, status),
cutmark AS (SELECT *, status = 'offline' AND end_us > start_us AS outage FROM spell),
cutrun AS (SELECT *, outage OR coalesce(lag(gap_after) OVER w, false) OR coalesce(lag(outage) OVER w, false) AS cut FROM cutmark WINDOW w AS (PARTITION BY record ORDER BY run)),
stretched AS (SELECT *, sum(cut::INT) OVER (PARTITION BY record ORDER BY run ROWS UNBOUNDED PRECEDING) AS st0 FROM cutrun),
bounded AS (SELECT *, min(start_us) OVER (PARTITION BY record, st0) AS lo_us, max(end_us) OVER (PARTITION BY record, st0) AS hi_us FROM stretched WHERE NOT outage),
live AS (SELECT *, dense_rank() OVER (PARTITION BY record ORDER BY lo_us) - 1 AS stretch FROM bounded WHERE hi_us > lo_us),
caljoin AS (SELECT *, coalesce(lag(end_us) OVER (PARTITION BY record, stretch ORDER BY start_us, run) = start_us, false) AS joined FROM live WHERE status = 'calibrating'),
calnum AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY record, stretch ORDER BY start_us, run ROWS UNBOUNDED PRECEDING) AS c FROM caljoin),
cals AS (SELECT record, stretch, lo_us, hi_us, c, min(start_us) AS cal_start, max(end_us) AS cal_end, sum(joined::INT) AS merged FROM calnum GROUP BY ALL),
cyc0 AS (SELECT *, lead(cal_start) OVER (PARTITION BY record, stretch ORDER BY cal_start) AS next_cal FROM cals),
cyc AS (SELECT record, stretch, lo_us, hi_us, cal_end AS start_us, coalesce(next_cal, hi_us) AS end_us, next_cal IS NOT NULL AS event, (coalesce(next_cal, hi_us) - cal_end) / 1e6 AS length_s FROM cyc0 WHERE next_cal IS NOT NULL OR hi_us > cal_end)
"""


def sql(select: str, *more: str) -> str:
    """An oracle: the base, further expressions, and the final select."""
    return "WITH " + ",\n".join([BASE.strip(), *[m.strip() for m in more]]) + "\n" + select.strip()
