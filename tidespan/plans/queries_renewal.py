"""Queries over renewal segments, checks and surveys of their verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators import assumptions, carve, cycle_panels, cycles, deal, renewal, survey
from tidespan.plans.context import Context
from tidespan.plans.define import Queries, r
from tidespan.plans.oracle import sql

QUERIES = query = Queries()
DRAWS, SEED = 999, 7
#: Null cells over which the bench is judged at once.
BENCH_CELLS = 100
GROUPS = {"trend": renewal.TREND, "dependence": renewal.DEPENDENCE}

_SIDE = """sg0 AS (SELECT record, label, side, segment, duration_s AS x, sum(duration_s) OVER (PARTITION BY record, label, side, segment) AS tau, censored, birth_us, island FROM wins WHERE birth_seen),
sg AS (SELECT record, label, side, segment, row_number() OVER (PARTITION BY record, label, side, segment ORDER BY birth_us, island) AS i, x, tau FROM sg0 WHERE NOT censored)"""
_CAL = """cg0 AS (SELECT record, label, side, segment, birth_us, island, min(birth_us) OVER (PARTITION BY record, label, side, segment) AS first_us, (birth_us - lag(birth_us) OVER (PARTITION BY record, label, side, segment ORDER BY birth_us, island)) / 1e6 AS x FROM wins WHERE birth_seen),
cg AS (SELECT g.record, label, side, g.segment, row_number() OVER (PARTITION BY g.record, label, side, g.segment ORDER BY birth_us, island) AS i, x, (end_us - first_us) / 1e6 AS tau FROM cg0 g JOIN (SELECT record, segment, max(t_us) AS end_us FROM obs GROUP BY ALL) s USING (record, segment) WHERE x IS NOT NULL)"""
_USABLE = """us0 AS (SELECT *, count(*) OVER w AS n, min(x) OVER w AS lo, max(x) OVER w AS hi FROM sg WINDOW w AS (PARTITION BY record, label, side, segment)),
us AS (SELECT record, label, side, segment, i, x, tau, n FROM us0 WHERE n >= 3 AND lo > 0 AND hi > lo),
gam AS (SELECT record, label, side, segment, stddev_samp(x) / avg(x) AS gamma FROM us GROUP BY ALL)"""
_USE = _SIDE + ", " + _USABLE
_CELL = "record, label, side"
_RANK = f"""rk0 AS (SELECT *, rank() OVER (PARTITION BY {_CELL} ORDER BY x) + (count(*) OVER (PARTITION BY {_CELL}, x) - 1) / 2 AS rnk FROM us),
rk1 AS (SELECT *, rnk - avg(rnk) OVER (PARTITION BY {_CELL}) AS c FROM rk0), rk AS (SELECT * FROM (SELECT *, sum(c * c) OVER (PARTITION BY {_CELL}) AS cc FROM rk1) WHERE cc > 0)"""


def _orders(b: int) -> str:
    """The gaps in b shuffled orders beside the observed one, and the statistics of each."""
    p = renewal.PRIME
    number = lambda what, at: f"('0x' || substr(md5(concat_ws('|', '{SEED}', {what})), {at}, 8))::BIGINT"
    return f"""hashed AS (SELECT *, {number("record, label, side, segment, i", 1)} % {p} AS h FROM rk), factors AS (SELECT b, {number("b", 1)} % {p - 1} + 1 AS bk, {number("b", 9)} % {p} AS bc FROM (SELECT unnest(range(0, {b + 1})) AS b)),
ord AS (SELECT *, row_number() OVER (PARTITION BY {_CELL}, b, segment ORDER BY CASE WHEN b > 0 THEN (((h * bk + bc) % {p}) * ((h * bk + bc) % {p})) % {p} END, i) AS pos FROM hashed, factors),
t0 AS (SELECT *, sum(x) OVER (PARTITION BY {_CELL}, b, segment ORDER BY pos ROWS UNBOUNDED PRECEDING) AS t, sum(x) OVER (PARTITION BY {_CELL}, b, segment) AS total FROM ord),
t1 AS (SELECT *, CASE WHEN tau <= total * (1 + 1e-12) THEN n - 1 ELSE n END AS m FROM t0), t2 AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY {_CELL}, b, segment ORDER BY pos), 0) AS p, pos - 1 AS j FROM t1 WHERE pos <= m),
t3 AS (SELECT {_CELL}, b, segment, any_value(m)::DOUBLE AS m, any_value(tau) AS tau, sum(t) AS st, sum(CASE WHEN j >= 1 THEN (m - j) * (m - j) * ln((tau - p) / nullif(tau - t, 0)) + j * j * ln(t / nullif(p, 0)) ELSE 0 END) AS head,
  sum(j * j * (t - p) / tau - j * m * (t * t - p * p) / (tau * tau)) AS walk, min(t) AS ta, max(t) AS tz FROM t2 GROUP BY ALL),
tr AS (SELECT {_CELL}, b, count(*) AS n_segments, sum(m)::BIGINT AS n_events, sqrt(12) * sum((st - m * tau / 2) / (tau * gamma * gamma)) / sqrt(sum(m / (gamma * gamma))) AS c1,
  sum((head + m * m * (ln(tau / nullif(tau - ta, 0)) + ln(tau / tz) - 1)) / (gamma * gamma * m)) AS c2, sum((walk + m * m * (tz * tz / (tau * tau) - tz / tau + 1.0::DOUBLE / 3)) / (gamma * gamma * m)) AS cvm FROM t3 JOIN gam USING (record, label, side, segment) GROUP BY ALL),
ahead AS (SELECT {_CELL}, b, c, cc, lead(c, 1) OVER w AS y1, lead(c, 2) OVER w AS y2, lead(c, 3) OVER w AS y3, lead(c, 4) OVER w AS y4, lead(c, 5) OVER w AS y5 FROM ord WINDOW w AS (PARTITION BY {_CELL}, b, segment ORDER BY pos)),
wide AS (SELECT {_CELL}, b, any_value(cc) AS cc, [count(y1), count(y2), count(y3), count(y4), count(y5)] AS np, [sum(c * y1), sum(c * y2), sum(c * y3), sum(c * y4), sum(c * y5)] AS sy FROM ahead GROUP BY ALL),
a0 AS (SELECT {_CELL}, b, lag, np[lag] AS n_pairs, sy[lag] / cc AS r FROM wide, (SELECT unnest(range(1, 6)) AS lag) WHERE np[lag] >= 2),
a1 AS (SELECT *, CASE WHEN max(r) OVER w - min(r) OVER w > 1e-12 THEN (r - avg(r) OVER w) / nullif(stddev_pop(r) OVER w, 0) END AS z FROM a0 WINDOW w AS (PARTITION BY {_CELL}, lag)),
dp AS (SELECT {_CELL}, b, CASE WHEN count(z) = count(*) THEN max(abs(z)) END AS c5, CASE WHEN count(z) = count(*) THEN sum(z * z) END AS c6 FROM a1 GROUP BY ALL)"""


_LONG = f"""lg AS (SELECT {_CELL}, b, 'c1' AS check_name, round(abs(c1), 9) AS s FROM tr UNION ALL SELECT {_CELL}, b, 'c2', round(c2, 9) FROM tr UNION ALL SELECT {_CELL}, b, 'cvm', round(cvm, 9) FROM tr UNION ALL SELECT {_CELL}, b, 'c5', round(c5, 9) FROM dp UNION ALL SELECT {_CELL}, b, 'c6', round(c6, 9) FROM dp),
pv AS (SELECT {_CELL}, check_name, any_value(seen) AS statistic, (1 + sum((b > 0 AND s >= seen)::INT))::DOUBLE / count(*) AS p, CASE WHEN any_value(first) IS NOT NULL THEN sum((s >= first)::INT)::DOUBLE / count(*) END AS null_p
  FROM (SELECT *, max(s) FILTER (b = 0) OVER w AS seen, max(s) FILTER (b = 1) OVER w AS first FROM lg WINDOW w AS (PARTITION BY {_CELL}, check_name)) WHERE seen IS NOT NULL GROUP BY ALL),
mp AS (SELECT *, CASE WHEN check_name IN ('c1', 'c2', 'cvm') THEN 'trend' ELSE 'dependence' END AS grp, count(s) OVER (PARTITION BY {_CELL}, check_name) = count(*) OVER (PARTITION BY {_CELL}, check_name) AS ok, count(*) OVER (PARTITION BY {_CELL}, check_name ORDER BY s DESC RANGE UNBOUNDED PRECEDING)::DOUBLE / count(*) OVER (PARTITION BY {_CELL}, check_name) AS p FROM lg),
gp AS (SELECT {_CELL}, grp, any_value(k) AS n_members, avg((least <= seen + 1e-12)::INT) AS p FROM (SELECT *, max(least) FILTER (b = 0) OVER (PARTITION BY {_CELL}, grp) AS seen FROM (SELECT {_CELL}, grp, b, min(p) AS least, count(*) AS k FROM mp WHERE ok GROUP BY ALL)) GROUP BY ALL)"""


def gaps(c: Context) -> DataFrame:
    return renewal.usable(renewal.side_gaps(c.wins))


@query(sql("SELECT record, label, side, segment, i, round(x, 6) AS x, round(tau, 6) AS tau FROM sg", _SIDE))
def segments_side(c: Context) -> DataFrame:
    return renewal.side_gaps(c.wins).select(*renewal.CELL, "segment", "i", r("x"), r("tau"))


@query(sql("SELECT record, label, side, segment, i, round(x, 6) AS x, round(tau, 6) AS tau FROM cg", _CAL))
def segments_calendar(c: Context) -> DataFrame:
    return renewal.calendar_gaps(c.wins, carve.segments(c.obs)).select(*renewal.CELL, "segment", "i", r("x"), r("tau"))


@query(sql("SELECT record, label, side, segment, round(gamma, 8) AS gamma FROM gam", _USE))
def gamma_hat(c: Context) -> DataFrame:
    return renewal.gamma(gaps(c)).select(*renewal.CELL, "segment", r("gamma", 8))


def observed(c: Context) -> DataFrame:
    g = gaps(c)
    return renewal.trend_statistics(renewal.draws(renewal.mid_ranks(g), 0, SEED), renewal.gamma(g))


@query(sql("SELECT record, label, side, n_segments, n_events, round(c1, 6) AS c1 FROM tr", _USE, _RANK, _orders(0)))
def c1(c: Context) -> DataFrame:
    return observed(c).select(*renewal.CELL, "n_segments", "n_events", r("c1"))


@query(sql("SELECT record, label, side, round(c2, 6) AS c2 FROM tr", _USE, _RANK, _orders(0)))
def c2(c: Context) -> DataFrame:
    return observed(c).select(*renewal.CELL, r("c2"))


@query(sql("SELECT record, label, side, round(cvm, 6) AS cvm FROM tr", _USE, _RANK, _orders(0)))
def cvm(c: Context) -> DataFrame:
    return observed(c).select(*renewal.CELL, r("cvm"))


@query(sql("SELECT record, label, side, lag, n_pairs, round(r, 8) AS rho FROM a0 WHERE b = 0", _USE, _RANK, _orders(0)))
def rank_acf(c: Context) -> DataFrame:
    return renewal.rank_autocorrelation(renewal.draws(renewal.mid_ranks(gaps(c)), 0, SEED)).select(*renewal.CELL, "lag", "n_pairs", r("r", 8, "rho"))


def tests(c: Context) -> DataFrame:
    return renewal.cell_tests(gaps(c), DRAWS, SEED, GROUPS)


@query(sql("SELECT record, label, side, check_name, round(statistic, 5) AS statistic, round(p, 9) AS p FROM pv", _USE, _RANK, _orders(DRAWS), _LONG))
def battery_perm_p(c: Context) -> DataFrame:
    return tests(c).filter("check <> grp").select(*renewal.CELL, F.col("check").alias("check_name"), r("statistic", 5), r("p", 9))


@query(sql("SELECT record, label, side, grp, n_members, round(p, 9) AS p FROM gp", _USE, _RANK, _orders(DRAWS), _LONG))
def min_p_groups(c: Context) -> DataFrame:
    return tests(c).filter("check = grp").select(*renewal.CELL, "grp", "n_members", r("p", 9))


@query(sql("SELECT record, label, side, segment, any_value(n) AS n, CASE WHEN any_value(n) < 3 THEN 'fewer than 3 gaps' WHEN min(x) <= 0 THEN 'a gap is not positive' ELSE 'all gaps are equal' END AS reason FROM us0 WHERE NOT (n >= 3 AND lo > 0 AND hi > lo) GROUP BY record, label, side, segment", _USE))
def segment_reasons(c: Context) -> DataFrame:
    """Why a segment is left out of the checks."""
    return renewal.unusable(renewal.side_gaps(c.wins))


@query(sql("SELECT record, label, side, count(*) AS n, count(DISTINCT x) AS n_distinct, round(avg((k > 1)::INT), 9) AS tied FROM (SELECT *, count(*) OVER (PARTITION BY record, label, side, x) AS k FROM us) GROUP BY ALL", _USE))
def tie_stats(c: Context) -> DataFrame:
    return renewal.tie_statistics(gaps(c)).select(*renewal.CELL, "n", "n_distinct", r("tied", 9))


_LEDGER = f"""ties AS (SELECT record, label, side, count(*) AS n, count(DISTINCT x) AS n_distinct FROM us GROUP BY ALL), cells AS (SELECT DISTINCT record, label, side FROM wins),
sizes AS (SELECT check_name, n AS n_bench, avg((null_p <= 0.05)::INT) AS rate, count(*) AS replicates FROM pv JOIN ties USING (record, label, side) WHERE null_p IS NOT NULL GROUP BY ALL),
acc AS (SELECT check_name, n_bench, rate, replicates, abs((rate - 0.05) / sqrt(0.05 * 0.95 / replicates)) <= {renewal.bench_bound(BENCH_CELLS)!r} AS accepted FROM sizes),
near AS (SELECT check_name, n, arg_min(accepted, (abs(n_bench - n), n_bench)) AS accepted FROM acc, (SELECT DISTINCT n FROM ties) GROUP BY ALL),
scored AS (SELECT record, label, side, check_name, p FROM pv UNION ALL SELECT record, label, side, grp, p FROM gp),
led AS (SELECT record, label, side, check_name, p, CASE WHEN p IS NULL THEN 'not computed' WHEN check_name IN ('c5', 'c6', 'dependence') AND coalesce(n_distinct, 0) < 5 THEN 'ties' WHEN p <= 0.05 THEN 'fail' WHEN coalesce(n, 0) < 8 OR NOT (check_name IN ('trend', 'dependence') OR coalesce(accepted, false)) THEN 'inconclusive' ELSE 'pass' END AS verdict,
  CASE WHEN p IS NOT NULL THEN '' WHEN n IS NULL THEN 'no usable segment' WHEN check_name IN ('c5', 'c6', 'dependence') THEN 'a lag has no spread or too few pairs' ELSE 'no event is read' END AS reason
  FROM cells CROSS JOIN (VALUES ('c1'), ('c2'), ('cvm'), ('c5'), ('c6'), ('trend'), ('dependence')) k(check_name) LEFT JOIN scored USING (record, label, side, check_name) LEFT JOIN ties USING (record, label, side) LEFT JOIN near USING (check_name, n))"""


def ledger(c: Context) -> DataFrame:
    """Verdicts of all cells, checks and groups. The bench is measured on the cells themselves, their order shuffled once."""
    scored, ties = deal.once(tests(c)), renewal.tie_statistics(gaps(c))
    bench = renewal.bench_acceptance(renewal.bench_sizes(scored.filter("check <> grp"), ties), 0.05, BENCH_CELLS)
    return renewal.ledger(c.wins, scored, ties, renewal.TREND + renewal.DEPENDENCE, bench, tuple(GROUPS), least=8)


@query(sql("SELECT check_name, n_bench, replicates, round(rate, 9) AS rate, accepted FROM acc", _USE, _RANK, _orders(DRAWS), _LONG, _LEDGER))
def bench_acceptance(c: Context) -> DataFrame:
    """How often each check rejects shuffled gaps, by their number, and whether that is near its nominal size."""
    sizes = renewal.bench_sizes(deal.once(tests(c)).filter("check <> grp"), renewal.tie_statistics(gaps(c)))
    return sizes.join(renewal.bench_acceptance(sizes, 0.05, BENCH_CELLS), ["check", "n_bench"]).select(F.col("check").alias("check_name"), "n_bench", "replicates", r("rate", 9), "accepted")


_ASSUMED = "known AS (SELECT * FROM (VALUES " + ", ".join(f"('{a.name}', '{k}')" for a in assumptions.REGISTRY for k in a.checks) + ") v(assumption, check_name))"


@query(sql("""SELECT record, label, side, assumption, count(*) AS n_asked, count(*) FILTER (verdict = 'fail') AS n_failed, count(*) FILTER (verdict = 'not computed') AS n_unanswered,
  CASE WHEN count(*) FILTER (verdict = 'fail') > 0 THEN 'contradicted' WHEN count(*) FILTER (verdict <> 'pass') > 0 THEN 'open' ELSE 'not contradicted' END AS standing FROM led JOIN known USING (check_name) GROUP BY ALL""", _USE, _RANK, _orders(DRAWS), _LONG, _LEDGER, _ASSUMED))
def assumption_standing(c: Context) -> DataFrame:
    """What the ledger says of each assumption that a check of the cell diagnoses."""
    return assumptions.standing(ledger(c))


@query(sql("SELECT record, label, side, check_name, round(p, 9) AS p, verdict FROM led", _USE, _RANK, _orders(DRAWS), _LONG, _LEDGER))
def ledger_verdicts(c: Context) -> DataFrame:
    return ledger(c).select(*renewal.CELL, F.col("check").alias("check_name"), r("p", 9), "verdict")


@query(sql("SELECT label, side, check_name, count(*) FILTER (verdict = 'pass') AS n_pass, count(*) FILTER (verdict = 'fail') AS n_fail, count(*) FILTER (verdict = 'inconclusive') AS n_inconclusive, count(*) FILTER (verdict = 'ties') AS n_ties, count(*) FILTER (verdict = 'not computed') AS n_not_computed, round(count(*) FILTER (verdict = 'fail') / nullif(count(*) FILTER (verdict IN ('pass', 'fail')), 0)::DOUBLE, 9) AS rejection_share FROM led GROUP BY ALL", _USE, _RANK, _orders(DRAWS), _LONG, _LEDGER))
def survey_summary(c: Context) -> DataFrame:
    return survey.verdict_counts(ledger(c), ["label", "side", "check"]).withColumnRenamed("check", "check_name").withColumn("rejection_share", r("rejection_share", 9))


@query(sql("SELECT record, label, side, max(verdict) FILTER (check_name = 'c1') AS c1, max(verdict) FILTER (check_name = 'c2') AS c2, max(verdict) FILTER (check_name = 'cvm') AS cvm, max(verdict) FILTER (check_name = 'c5') AS c5, max(verdict) FILTER (check_name = 'c6') AS c6 FROM led GROUP BY ALL", _USE, _RANK, _orders(DRAWS), _LONG, _LEDGER))
def survey_pivot(c: Context) -> DataFrame:
    return renewal.outcome_grid(ledger(c), list(renewal.TREND + renewal.DEPENDENCE))


@query(sql("SELECT record, label, side, array_to_string(list_sort(list(check_name || '=' || verdict)), ',') AS verdicts, coalesce(array_to_string(list_sort(list(check_name) FILTER (verdict = 'not computed')), ','), '') AS unanswered FROM led GROUP BY ALL", _USE, _RANK, _orders(DRAWS), _LONG, _LEDGER))
def check_attachments(c: Context) -> DataFrame:
    return renewal.attachments(ledger(c)).select(*renewal.CELL, F.array_join("verdicts", ",").alias("verdicts"), F.array_join("unanswered", ",").alias("unanswered"))


@query(sql("""SELECT g.grp, label, count(*) AS n_records, count(occ) AS n_computed, round(avg(occ), 9) AS mean_share, round(min(lower), 9) AS least_lower, round(max(upper), 9) AS largest_upper FROM (SELECT record, label, sum(CASE WHEN in_spec THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0) AS occ,
  sum(CASE WHEN in_spec AND NOT u THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0) AS lower, sum(CASE WHEN in_spec OR u THEN held_us ELSE 0 END)::DOUBLE / nullif(sum(held_us)::DOUBLE, 0) AS upper FROM (SELECT *, NOT confident OR coalesce(next_in <> in_spec, false) AS u FROM rows_) GROUP BY ALL)
  JOIN (SELECT DISTINCT record, 'g' || (record % 4) AS grp FROM obs) g USING (record) GROUP BY ALL"""))
def compliance_survey(c: Context) -> DataFrame:
    each = survey.record_compliance(carve.occupancy(c.rows), carve.in_spec_bounds(c.rows))
    return survey.compliance(each.join(c.groups, "record")).select("grp", "label", "n_records", "n_computed", r("mean_share", 9), r("least_lower", 9), r("largest_upper", 9))


@query()
def cvm_limit(c: Context) -> DataFrame:
    """Asymptotic p-values of the observed statistics."""
    return survey.asymptotic(observed(c)).select(*renewal.CELL, r("c1_p"), r("c2_p"), r("cvm_p"))


_C3 = f"""cr AS (SELECT {_CELL}, b, segment, pos, rnk / count(*) OVER (PARTITION BY {_CELL}, b) AS u FROM ord),
cv AS (SELECT * FROM (SELECT {_CELL}, b, segment, pos, u AS u0, lead(u, 1) OVER w AS u1, lead(u, 2) OVER w AS u2, lead(u, 3) OVER w AS u3, lead(u, 4) OVER w AS u4, lead(u, 5) OVER w AS u5 FROM cr WINDOW w AS (PARTITION BY {_CELL}, b, segment ORDER BY pos)) WHERE u5 IS NOT NULL),
cn AS (SELECT {_CELL}, count(*) FILTER (b = 0) AS m FROM cv GROUP BY ALL),
ci AS (SELECT x.record, x.label, x.side, x.b, sum({" * ".join(f"(1 - greatest(x.u{k}, y.u{k}))" for k in range(6))}) AS prod, {", ".join(f"avg(1 - greatest(x.u{k}, y.u{k})) AS k{k}" for k in range(6))} FROM cv x JOIN cv y ON x.record = y.record AND x.label = y.label AND x.side = y.side AND x.b = y.b GROUP BY x.record, x.label, x.side, x.b, x.segment, x.pos),
cs AS (SELECT {_CELL}, b, (sum(prod) / count(*) - 2 * sum({" * ".join(f"k{k}" for k in range(6))}) + count(*) * {" * ".join(f"avg(k{k})" for k in range(6))}) AS s FROM ci GROUP BY ALL HAVING count(*) >= 2),
cp AS (SELECT {_CELL}, any_value(seen) AS statistic, (sum((b > 0 AND s > seen - 3.7e-11)::INT) + 0.5::DOUBLE) / 1001 AS p FROM (SELECT *, max(s) FILTER (b = 0) OVER (PARTITION BY {_CELL}) AS seen FROM cs) GROUP BY ALL)"""


@query(sql("SELECT u.record, u.label, u.side, n, coalesce(m, 0) AS n_vectors, n_segments, 5 AS lag, round(statistic, 7) AS statistic, round(p, 9) AS p, CASE WHEN coalesce(m, 0) < 2 THEN 'fewer than two vectors' ELSE '' END AS reason FROM (SELECT record, label, side, count(*) AS n, count(DISTINCT segment) AS n_segments FROM us GROUP BY ALL) u LEFT JOIN cn USING (record, label, side) LEFT JOIN cp USING (record, label, side)", _USE, _RANK, _orders(1000), _C3))
def c3(c: Context) -> DataFrame:
    """Serial independence at lags 1 to 5 jointly, all cells, 1,000 shuffles."""
    from tidespan.operators import copula

    # statistics of two vectors often end in a 5 at the eighth digit, so they are rounded as the SQL's engine rounds: a product, then a quotient
    return copula.serial_independence(gaps(c).filter("record is not null")).select(*renewal.CELL, "n", "n_vectors", "n_segments", "lag", (F.round(F.col("statistic") * 1e7) / 1e7).alias("statistic"), r("p", 9), "reason")


_CYC_USE = """ncyc AS (SELECT *, sum(length_s) OVER (PARTITION BY record, stretch) AS tau_w, sum(CASE WHEN event THEN length_s ELSE 0 END) OVER (PARTITION BY record) + last_value(CASE WHEN event THEN 0 ELSE length_s END) OVER (PARTITION BY record ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tau_e FROM cyc),
sg AS (SELECT record, 'cycles' AS label, 'within_stretch' AS side, stretch AS segment, row_number() OVER (PARTITION BY record, stretch ORDER BY start_us, end_us) AS i, length_s AS x, tau_w AS tau FROM ncyc WHERE event
  UNION ALL SELECT record, 'cycles', 'end_to_end', 0, row_number() OVER (PARTITION BY record ORDER BY start_us, end_us), length_s, tau_e FROM ncyc WHERE event), """ + _USABLE
_CYC_LEDGER = _LEDGER.replace("FROM wins)", "FROM (SELECT DISTINCT record, 'cycles' AS label FROM cyc), (VALUES ('within_stretch'), ('end_to_end')) v(side))")
_CYC_MEANS = """ck AS (SELECT record, length_s AS age, sum(event::INT)::DOUBLE AS d, sum(count(*)) OVER (PARTITION BY record ORDER BY length_s DESC)::DOUBLE AS m FROM cyc GROUP BY record, length_s),
cks AS (SELECT *, product(1 - d / m) OVER (PARTITION BY record ORDER BY age ROWS UNBOUNDED PRECEDING) AS s, lead(age) OVER (PARTITION BY record ORDER BY age) AS nxt FROM ck), ctop AS (SELECT record, max(age) AS top FROM ck GROUP BY record),
cpair AS (SELECT a.record AS first, b.record AS second, least(a.top, b.top) AS tau FROM ctop a JOIN ctop b ON b.record = a.record + 1),
casked AS (SELECT record, record AS first, NULL::BIGINT AS second, top AS tau FROM ctop UNION ALL SELECT first, first, second, tau FROM cpair UNION ALL SELECT second, first, second, tau FROM cpair),
crm AS (SELECT record, first, second, tau, sum(area) + least(min(age), tau) AS mean, sqrt(sum(CASE WHEN d > 0 AND age < tau AND beyond > 0 THEN beyond * beyond * d / (m * nullif(m - d, 0)) ELSE 0 END)) AS se FROM (SELECT *, sum(area) OVER (PARTITION BY record, first, second ORDER BY age DESC ROWS UNBOUNDED PRECEDING) AS beyond
  FROM (SELECT record, first, second, tau, age, d, m, greatest(0, least(coalesce(nxt, tau), tau) - least(age, tau)) * s AS area FROM cks JOIN casked USING (record))) GROUP BY record, first, second, tau),
catt AS (SELECT record, side, array_to_string(list_sort(list(check_name || '=' || verdict)), ',') AS verdicts FROM led GROUP BY record, side)"""


def cycle_tables(c: Context) -> tuple[DataFrame, DataFrame]:
    """Spells in stretches and the cycles between them, each computed once: what follows reads them many times over."""
    live = deal.once(c.live)
    return live, deal.once(cycles.cycles(live))


def cycle_ledger(table: DataFrame) -> DataFrame:
    return cycle_panels.checks(table, DRAWS, SEED, GROUPS, BENCH_CELLS, least=8)


@query(sql("SELECT record, side AS clock, check_name, round(p, 9) AS p, verdict, reason FROM led", _CYC_USE, _RANK, _orders(DRAWS), _LONG, _CYC_LEDGER))
def cycle_checks(c: Context) -> DataFrame:
    """The battery and its groups on each device's cycles, within stretches and end to end."""
    return cycle_ledger(deal.once(cycles.cycles(c.live))).select("record", F.col("side").alias("clock"), F.col("check").alias("check_name"), r("p", 9), "verdict", "reason")


@query(sql("""SELECT live_.record, n_stretches, n_dropped, coalesce(n_merged0, 0) AS n_merged, coalesce(n_complete, 0) AS n_complete, coalesce(n_censored, 0) AS n_censored, round(mean, 4) AS mtbc_s, round(se, 4) AS mtbc_se, w.verdicts AS within_stretch, e.verdicts AS end_to_end
  FROM (SELECT record, count(*) AS n_stretches, count(*) FILTER (first_us IS NULL OR first_us > lo_us) AS n_dropped FROM (SELECT record, stretch, lo_us, min(start_us) FILTER (status = 'calibrating') AS first_us FROM live GROUP BY ALL) GROUP BY record) live_
  LEFT JOIN (SELECT record, count(*) FILTER (event) AS n_complete, count(*) FILTER (NOT event) AS n_censored FROM cyc GROUP BY record) USING (record) LEFT JOIN (SELECT record, coalesce(sum(merged), 0)::BIGINT AS n_merged0 FROM cals GROUP BY record) USING (record)
  LEFT JOIN (SELECT * FROM crm WHERE second IS NULL) USING (record) LEFT JOIN catt w ON w.record = live_.record AND w.side = 'within_stretch' LEFT JOIN catt e ON e.record = live_.record AND e.side = 'end_to_end'""", _CYC_USE, _RANK, _orders(DRAWS), _LONG, _CYC_LEDGER, _CYC_MEANS))
def cycle_panel(c: Context) -> DataFrame:
    """A row a device of what its cycles say, with the verdicts of its own checks."""
    live, table = cycle_tables(c)
    out = cycle_panels.panel(table, live, cycles.dropped_births(live), cycle_ledger(table))
    return out.select("record", "n_stretches", "n_dropped", "n_merged", "n_complete", "n_censored", r("mtbc_s", 4), r("mtbc_se", 4), "within_stretch", "end_to_end")


@query(sql("""SELECT p.first, p.second, round(p.tau, 6) AS tau, round(a.mean, 4) AS mean_a, round(a.se, 4) AS se_a, x.verdicts AS verdicts_a, round(b.mean, 4) AS mean_b, round(b.se, 4) AS se_b, y.verdicts AS verdicts_b, round(a.mean - b.mean, 4) + 0.0::DOUBLE AS difference FROM cpair p
  JOIN crm a ON a.first = p.first AND a.second = p.second AND a.record = p.first JOIN crm b ON b.first = p.first AND b.second = p.second AND b.record = p.second LEFT JOIN catt x ON x.record = p.first AND x.side = 'within_stretch' LEFT JOIN catt y ON y.record = p.second AND y.side = 'within_stretch'""", _CYC_USE, _RANK, _orders(DRAWS), _LONG, _CYC_LEDGER, _CYC_MEANS))
def cycle_comparison(c: Context) -> DataFrame:
    """Neighbouring devices compared by their cycles, descriptively."""
    table = deal.once(cycles.cycles(c.live))
    pairs = table.select(F.col("record").alias("first"), (F.col("record") + 1).alias("second")).distinct()
    out = cycle_panels.compare(table, pairs, cycle_ledger(table))
    return out.select("first", "second", r("tau"), r("mean_a", 4), r("se_a", 4), "verdicts_a", r("mean_b", 4), r("se_b", 4), "verdicts_b", (r("difference", 4) + F.lit(0.0)).alias("difference"))
