"""Queries on episodes, change points, period comparisons, settings and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweetframe.functions.scalars import two_proportion_p
from sweetframe.operators import compare, episodes, profiles, settings
from sweetframe.plans._base import query, readings
from sweetframe.plans.glucose import CV, PERIOD, PERIOD_DOUBLES, per_patient, share
from sweetframe.sources import cohort

MIN15 = 900_000_000
EPISODES = f"""
SELECT patient_id, min(ts) AS start, max(ts) AS "end", (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 AS minutes, min(sgv) AS nadir, arg_min(ts, (sgv, ts)) AS nadir_ts, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN lag_risen <> risen AND epoch_us(ts) - lag_at >= {MIN15} THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY ts) AS run FROM (
    SELECT *, lag(risen) OVER w AS lag_risen, lag(epoch_us(ts)) OVER w AS lag_at FROM (
      SELECT *, sum(CASE WHEN sgv < 70 THEN 0 ELSE 1 END) OVER (PARTITION BY patient_id ORDER BY ts) AS risen FROM r) WHERE sgv < 70 WINDOW w AS (PARTITION BY patient_id ORDER BY ts)))
GROUP BY patient_id, run HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 >= 15"""
HYPO = f"""SELECT x.*, CAST(CASE WHEN nadir < 54 THEN 2 ELSE 1 END AS INT) AS level, hour(nadir_ts) < 6 AS nocturnal, EXISTS (SELECT 1 FROM t c WHERE c.carbs > 0 AND c.patient_id = x.patient_id AND epoch_us(c.ts) >= epoch_us(x.start) - {MIN15} AND epoch_us(c.ts) <= epoch_us(x."end") + {MIN15}) AS rescue FROM ({EPISODES}) x"""


def _hypo(spark, d):
    return episodes.hypo_episodes(readings(spark, d), cohort.treatments(spark, d))


@query("hypo_episodes", HYPO)
def hypo_episodes(spark, d):
    return _hypo(spark, d)


@query(
    "hypo_report",
    f"""SELECT p.patient_id, p.readings, count(start) AS episodes, count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2, count(*) FILTER (nocturnal) AS nocturnal, count(*) FILTER (rescue) AS with_rescue, coalesce(avg(minutes), 0) AS mean_minutes, CAST(coalesce(sum(minutes), 0) AS BIGINT) AS total_minutes,
      count(start) / 30 * 7 AS per_week, least(100.0, 100.0 * p.readings / (288 * 30)) AS pct_active, least(100.0, 100.0 * p.readings / (288 * 30)) < 70 AS undercounted FROM (SELECT patient_id, count(*) AS readings FROM r GROUP BY 1) p LEFT JOIN ({HYPO}) USING (patient_id) GROUP BY 1, 2""",
    "mean_minutes per_week pct_active",
)
def hypo_report(spark, d):
    return episodes.hypo_report(_hypo(spark, d), readings(spark, d))


CANDIDATES = f"""
WITH x AS (SELECT *, epoch_us(ts) AS us, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY ts) AS INT) AS place FROM r),
lows AS (SELECT a.patient_id, a.place AS first, a.id, a.ts, a.sgv AS v, a.us, arg_min(b.place, (b.sgv, b.place)) AS lp, min(b.sgv) AS nadir, arg_min(b.us, (b.sgv, b.place)) AS lat FROM x a JOIN x b ON b.patient_id = a.patient_id AND b.place BETWEEN a.place + 1 AND a.place + 3 GROUP BY ALL),
down AS (SELECT *, v - nadir AS fall FROM lows WHERE v - nadir >= 30 AND nadir < 70 AND lat > us AND v - nadir >= 2 * (lat - us) / 6e7),
up AS (SELECT d.*, arg_min(b.place, (-b.sgv, b.place)) AS recovery, max(b.sgv) AS high, arg_min(b.us, (-b.sgv, b.place)) AS hat FROM down d JOIN x b ON b.patient_id = d.patient_id AND b.place BETWEEN d.lp + 1 AND d.lp + 3 GROUP BY ALL)
SELECT patient_id, first, recovery, id, ts, make_timestamp(lat) AS nadir_ts, nadir, fall, rise FROM (SELECT *, high - nadir AS rise FROM up) up
WHERE rise >= 30 AND hat > lat AND rise >= 2 * (hat - lat) / 6e7 AND (hat - us) / 6e7 <= 30 AND NOT EXISTS (SELECT 1 FROM t c WHERE c.carbs > 10 AND c.patient_id = up.patient_id AND abs(epoch_us(c.ts) - up.lat) <= {MIN15})"""


def _candidates(spark, d):
    return episodes.compression_candidates(readings(spark, d), cohort.treatments(spark, d))


@query("compression_candidates", CANDIDATES)
def compression_candidates(spark, d):
    return _candidates(spark, d)


# the greedy choice as a recursion: from each kept candidate to the first one after its recovery
@query(
    "compression_lows",
    f"""WITH RECURSIVE c AS ({CANDIDATES}),
kept AS (SELECT patient_id, min(first) AS first FROM c GROUP BY 1 UNION ALL SELECT k.patient_id, (SELECT min(n.first) FROM c n WHERE n.patient_id = k.patient_id AND n.first > (SELECT o.recovery FROM c o WHERE o.patient_id = k.patient_id AND o.first = k.first)) FROM kept k WHERE k.first IS NOT NULL)
SELECT c.* FROM c JOIN kept ON kept.patient_id = c.patient_id AND kept.first = c.first""",
)
def compression_lows(spark, d):
    return episodes.compression_lows(_candidates(spark, d))


def signal(series: str, sigma: float) -> str:
    return f"""
WITH q AS (SELECT patient_id, ts, i, n, sd, CAST(greatest(10, n // 12) AS BIGINT) AS w, sum(v) OVER (PARTITION BY patient_id ORDER BY ts) - v AS s FROM (
  SELECT patient_id, ts, v, row_number() OVER (PARTITION BY patient_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY patient_id) AS n, stddev_samp(v) OVER (PARTITION BY patient_id) AS sd FROM ({series})) WHERE n >= 30)
SELECT patient_id, ts, i, w, n, shift, sd FROM (
  SELECT a.*, round((b.s - 2 * a.s + c.s) / a.w, 9) AS shift FROM q a JOIN q b ON b.patient_id = a.patient_id AND b.i = a.i + a.w JOIN q c ON c.patient_id = a.patient_id AND c.i = a.i - a.w WHERE a.i < a.n - a.w)
WHERE abs(shift) > {sigma} * sd"""


HOURLY = "SELECT patient_id, date_trunc('hour', ts) AS ts, avg(sgv) AS v FROM r GROUP BY 1, 2"
DAILY = "SELECT patient_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, sum(insulin) AS v FROM t WHERE insulin > 0 GROUP BY 1, 2"


def _bg_signal(spark, d, sigma: float = 0.25):
    series = profiles.hourly_mean(readings(spark, d)).select("patient_id", F.col("hour").alias("ts"), F.col("mean_mgdl").alias("value"))
    return episodes.change_point_signal(series, sigma)


@query("change_point_signal", signal(HOURLY, 0.25), "shift sd")
def change_point_signal(spark, d):
    return _bg_signal(spark, d)


def picked(found: str) -> str:
    """The greedy choice as a recursion: from the best place of each stretch to the first one a stretch after it."""
    best = "(SELECT arg_min(x.i, (-abs(x.shift), x.i)) FROM sig x WHERE x.patient_id = g.patient_id AND x.i >= g.start AND x.i < g.start + x.w)"
    return f"""
WITH RECURSIVE sig AS ({found}),
g AS (SELECT patient_id, min(i) AS start FROM sig GROUP BY 1
  UNION ALL SELECT g.patient_id, (SELECT min(n.i) FROM sig n WHERE n.patient_id = g.patient_id AND n.i >= {best} + n.w) FROM g WHERE g.start IS NOT NULL)
SELECT p.patient_id, p.i AS place, p.ts, p.shift, CASE WHEN p.shift > 0 THEN 'up' ELSE 'down' END AS direction, coalesce(s.switches, 0) AS switches, s.last_switch, s.switch_times
FROM (SELECT patient_id, {best} AS best FROM g WHERE start IS NOT NULL) b JOIN sig p ON p.patient_id = b.patient_id AND p.i = b.best
LEFT JOIN (SELECT patient_id, count(*) AS switches, max(ts) AS last_switch, string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z'), ',' ORDER BY ts) AS switch_times FROM t WHERE event_type = 'Profile Switch' GROUP BY 1) s ON s.patient_id = p.patient_id"""


@query("change_points_bg", picked(signal(HOURLY, 0.25)), "shift")
def change_points_bg(spark, d):
    switches = cohort.treatments(spark, d).where("event_type = 'Profile Switch'")
    return episodes.with_switches(episodes.change_points(_bg_signal(spark, d)), switches)


@query("change_points_tdd", picked(signal(DAILY, 0.25)), "shift")
def change_points_tdd(spark, d):
    t = cohort.treatments(spark, d)
    series = profiles.daily_tdd(t).select("patient_id", F.col("day").cast("timestamp").alias("ts"), F.col("tdd").alias("value"))
    return episodes.with_switches(episodes.change_points(episodes.change_point_signal(series, 0.25)), t.where("event_type = 'Profile Switch'"))


HALVES = "(SELECT r.*, CASE WHEN (m - epoch_us(ts)) < 1209600000000 THEN 'b' ELSE 'a' END AS period FROM r JOIN (SELECT patient_id, max(epoch_us(ts)) AS m FROM r GROUP BY 1) USING (patient_id) WHERE m - epoch_us(ts) < 2419200000000)"


def sides(columns: list[str]) -> str:
    return ", ".join(f"max({c}) FILTER (period = '{p}') AS {c}_{p}" for c in columns for p in "ab")


COMPARED = ["n", "mean_mgdl", "tir_percent", "gmi_percent"]


@query(
    "compare_periods",
    f"""SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN delta_tir > 1 THEN 'TIR up' WHEN delta_tir < -1 THEN 'TIR down' END, CASE WHEN delta_gmi >= 0.05 THEN 'GMI up' WHEN delta_gmi <= -0.05 THEN 'GMI down' END, CASE WHEN delta_mean >= 5 THEN 'mean up' WHEN delta_mean <= -5 THEN 'mean down' END), ''), 'similar') AS summary FROM (
      SELECT *, mean_mgdl_b - mean_mgdl_a AS delta_mean, tir_percent_b - tir_percent_a AS delta_tir, gmi_percent_b - gmi_percent_a AS delta_gmi FROM (
      SELECT patient_id, {sides(COMPARED)} FROM (SELECT patient_id, period, count(*) AS n, avg(sgv) AS mean_mgdl, {share('sgv BETWEEN 70 AND 180')} AS tir_percent, 3.31 + 0.02392 * avg(sgv) AS gmi_percent FROM {HALVES} GROUP BY 1, 2) GROUP BY 1))""",
    " ".join(f"{c}_{p}" for c in COMPARED[1:] for p in "ab") + " delta_mean delta_tir delta_gmi",
)
def compare_periods(spark, d):
    return compare.compare_periods(readings(spark, d))


NAMES = ["n", *PERIOD_DOUBLES.split()]
DELTAS = ("tir_percent", "tbr_lt54_percent", "gri", "mean_mgdl")
lap = lambda m: f"NOT ({m}_ci_hi_a < {m}_ci_lo_b OR {m}_ci_hi_b < {m}_ci_lo_a) AS {m}_overlap"


@query("time_period_compare", f"SELECT *, {', '.join(f'{c}_b - {c}_a AS delta_{c}' for c in DELTAS)}, {lap('tir')}, {lap('tbr_lt54')} FROM (SELECT patient_id, {sides(NAMES)} FROM (SELECT patient_id, period, {PERIOD} FROM {HALVES} GROUP BY 1, 2) GROUP BY 1)", " ".join(f"{c}_{p}" for c in NAMES[1:] for p in "ab") + " " + " ".join(f"delta_{c}" for c in DELTAS))
def time_period_compare(spark, d):
    return compare.time_period_compare(readings(spark, d))


def phi_p(s1: str, n1: str, s2: str, n2: str) -> str:
    z = f"(abs({s1} / {n1} - {s2} / {n2}) / se)"
    tt = f"(1 / (1 + 0.2316419 * {z}))"
    poly = f"{tt} * (0.31938153 + {tt} * (-0.356563782 + {tt} * (1.781477937 + {tt} * (-1.821255978 + {tt} * 1.330274429))))"
    return f"CASE WHEN {n1} = 0 OR {n2} = 0 OR se = 0 THEN 1.0::DOUBLE ELSE greatest(0, least(1, 2 * (1 - (1 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {poly})))) END"


def with_se(x: str, s1: str, n1: str, s2: str, n2: str) -> str:
    pool = f"(({s1} + {s2}) / ({n1} + {n2}))"
    return f"SELECT *, sqrt({pool} * (1 - {pool}) * (1 / {n1} + 1 / {n2})) AS se FROM ({x})"


TESTS = f"SELECT patient_id, id, {phi_p('s1', 'n1', 's2', 'n2')} AS p FROM ({with_se('''SELECT patient_id, id, k AS s1, CAST(k + 10 AS INT) AS n1, CAST(floor(k / 2) AS INT) AS s2, CAST(60 AS INT) AS n2 FROM t''', 's1', 'n1', 's2', 'n2')})"


def _tests(spark, d):
    """Each treatment's k gives two samples to test."""
    e = cohort._events(spark, d).where("event_type = 'purchase'").select("patient_id", F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select("patient_id", "id", two_proportion_p(F.col("k"), F.col("k") + 10, F.floor(F.col("k") / 2), F.lit(60)).alias("p"))


@query("two_proportion_test", TESTS, "p")
def two_proportion_test(spark, d):
    return _tests(spark, d)


ADJUSTED = "least(1.0, min(p * n / i) OVER (PARTITION BY patient_id ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adjusted"


@query("bh_fdr", f"SELECT patient_id, id, p, {ADJUSTED} FROM (SELECT *, count(*) OVER (PARTITION BY patient_id) AS n, row_number() OVER (PARTITION BY patient_id ORDER BY p, id) AS i FROM (SELECT patient_id, id, round(p, 9) AS p FROM ({TESTS})))", "p p_adjusted")
def bh_fdr(spark, d):
    return compare.bh_fdr(_tests(spark, d).withColumn("p", F.round("p", 9)))


def side(name: str, c: str) -> str:
    gri = " + ".join(f"{w} * count(*) FILTER ({c} AND {b})" for w, b in ((3.0, "sgv < 54"), (2.4, "sgv BETWEEN 54 AND 69"), (1.6, "sgv > 250"), (0.8, "sgv BETWEEN 181 AND 250")))
    return f"count(*) FILTER ({c}) AS n_{name}, count(*) FILTER ({c} AND sgv BETWEEN 70 AND 180) AS in_{name}, count(*) FILTER ({c} AND sgv < 54) AS low_{name}, greatest(0, least(100, ({gri}) * 100 / nullif(count(*) FILTER ({c}), 0))) AS gri_{name}"


ATTRIBUTION = f"""SELECT patient_id, id, ts, n_pre, gri_pre, n_post, gri_post, tir_pre, tir_post, tbr54_pre, tbr54_post, tir_post - tir_pre AS delta_tir, tbr54_post - tbr54_pre AS delta_tbr54, gri_post - gri_pre AS delta_gri, p, p_adjusted, CASE WHEN p_adjusted < 0.1 THEN 'likely' WHEN p_adjusted < 0.2 THEN 'possible' ELSE 'none' END AS evidence FROM (
SELECT *, {ADJUSTED} FROM (SELECT *, count(*) OVER (PARTITION BY patient_id) AS n, row_number() OVER (PARTITION BY patient_id ORDER BY p, id) AS i, 100.0 * in_pre / n_pre AS tir_pre, 100.0 * in_post / n_post AS tir_post, 100.0 * low_pre / n_pre AS tbr54_pre, 100.0 * low_post / n_post AS tbr54_post FROM (
SELECT *, {phi_p('in_pre', 'n_pre', 'in_post', 'n_post')} AS p FROM ({with_se(f'''SELECT * FROM (SELECT s.patient_id, s.id, s.ts, {side('pre', 'r.ts < s.ts')}, {side('post', 'r.ts >= s.ts')}
  FROM t s JOIN r ON r.patient_id = s.patient_id AND epoch_us(r.ts) >= epoch_us(s.ts) - 604800000000 AND epoch_us(r.ts) < epoch_us(s.ts) + 604800000000 WHERE s.event_type = 'Profile Switch' GROUP BY 1, 2, 3) WHERE n_pre >= 50 AND n_post >= 50''', 'in_pre', 'n_pre', 'in_post', 'n_post')}))))"""


@query("settings_attribution", ATTRIBUTION, "gri_pre gri_post tir_pre tir_post tbr54_pre tbr54_post delta_tir delta_tbr54 delta_gri p p_adjusted")
def settings_attribution(spark, d):
    switches = cohort.treatments(spark, d).where("event_type = 'Profile Switch'").select("patient_id", "id", "ts")
    return compare.settings_attribution(switches, readings(spark, d))


SNAPSHOTS = "(SELECT o_orderkey AS id, o_orderdate AS captured_at, o_orderpriority AS version, o_orderstatus AS status, o_custkey AS customer FROM orders)"
CHANGES = "(SELECT l_orderkey AS snapshot_id, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS key, l_linestatus AS new_value, l_shipdate AS detected_at FROM lineitem)"


@query("snapshots_latest", f"SELECT id, captured_at, version FROM {SNAPSHOTS} ORDER BY captured_at DESC, id DESC LIMIT 30")
def snapshots_latest(spark, d):
    return settings.latest_snapshots(cohort.snapshots(spark, d)).select("id", "captured_at", "version")


@query("snapshot_status", f"SELECT count(*) AS n, min(captured_at) AS earliest, max(captured_at) AS latest, arg_max(version, (captured_at, id)) AS latest_version, CASE WHEN count(*) = 0 THEN 'no snapshots' ELSE '' END AS note FROM {SNAPSHOTS}")
def snapshot_status(spark, d):
    return settings.snapshot_status(cohort.snapshots(spark, d))


@query(
    "setting_at",
    f"SELECT q.id, q.key, q.ts, s.id AS snapshot_id, s.id IS NOT NULL AND q.key IN ('status', 'customer') AS found, CASE q.key WHEN 'status' THEN s.status WHEN 'customer' THEN CAST(s.customer AS VARCHAR) END AS value FROM (SELECT o_orderkey AS id, ['status', 'customer', 'absent'][1 + CAST(o_orderkey % 3 AS INT)] AS key, o_orderdate + INTERVAL 12 HOUR AS ts FROM orders) q ASOF LEFT JOIN (SELECT captured_at, max(id) AS id, arg_max(status, id) AS status, arg_max(customer, id) AS customer FROM {SNAPSHOTS} GROUP BY 1) s ON s.captured_at <= q.ts",
)
def setting_at(spark, d):
    """Each order asks for a key's value at noon of its day."""
    s = cohort.snapshots(spark, d)
    key = F.element_at(F.array(*map(F.lit, ("status", "customer", "absent"))), (F.col("id") % 3 + 1).cast("int"))
    return settings.setting_at(s.select("id", key.alias("key"), (F.col("captured_at") + F.expr("INTERVAL 12 HOURS")).alias("ts")), s)


@query("setting_history", f"SELECT snapshot_id, line, key, new_value, detected_at, captured_at, version FROM {CHANGES} c JOIN {SNAPSHOTS} s ON s.id = c.snapshot_id WHERE key = 'R'")
def setting_history(spark, d):
    return settings.setting_history(cohort.change_events(spark, d), cohort.snapshots(spark, d), "R")


@query("settings_diff", f"SELECT snapshot_id, line, key, new_value, detected_at, version FROM {CHANGES} c JOIN {SNAPSHOTS} s ON s.id = c.snapshot_id WHERE detected_at >= TIMESTAMP '1995-01-01' AND detected_at < TIMESTAMP '1996-01-01' ORDER BY detected_at, key")
def settings_diff(spark, d):
    return settings.settings_diff(cohort.change_events(spark, d), cohort.snapshots(spark, d), "1995-01-01", "1996-01-01")


@query("changed_keys", f"SELECT count(DISTINCT key) AS n_keys, array_to_string(list(DISTINCT key ORDER BY key)[1:10], ',') AS first_keys FROM {CHANGES}")
def changed_keys(spark, d):
    return settings.changed_keys(cohort.change_events(spark, d))


@query("log_entries", "SELECT event_id AS id, ts, event_type, props AS values_json, k FROM e WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('purchase', 'error') ORDER BY ts, id")
def log_entries(spark, d):
    got = settings.log_entries(cohort.log_entries(spark, d), "2024-01-05", "2024-01-20", ("purchase", "error"))
    return got.withColumn("k", F.from_json("values_json", "k int")["k"])


@query("log_values", "SELECT event_id AS id, ts, event_type, 'k' AS key, CAST(k AS VARCHAR) AS value, 'bigint' AS kind FROM e WHERE k IS NOT NULL")
def log_values(spark, d):
    return settings.log_values(cohort.log_entries(spark, d))
