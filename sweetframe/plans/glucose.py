"""Queries on readings: metrics, variability and profiles."""

from __future__ import annotations

from sweetframe.operators import metrics, profiles, variability
from sweetframe.plans._base import query, readings
from sweetframe.sources import cohort

LOW = "CASE WHEN 1.509 * (pow(ln(sgv), 1.084) - 5.381) < 0 THEN 10 * pow(1.509 * (pow(ln(sgv), 1.084) - 5.381), 2) ELSE 0 END"
HIGH = LOW.replace("< 0 THEN", "> 0 THEN")
CV = "100 * coalesce(stddev_samp(sgv), 0) / avg(sgv)"
share = lambda c: f"100.0 * count(*) FILTER ({c}) / count(*)"
GRI = f"greatest(0, least(100, 3.0 * {share('sgv < 54')} + 2.4 * {share('sgv BETWEEN 54 AND 69')} + 1.6 * {share('sgv > 250')} + 0.8 * {share('sgv BETWEEN 181 AND 250')}))"


def wilson(c: str, sign: str) -> str:
    p, n = f"(count(*) FILTER ({c}) / count(*))", "count(*)"
    x = f"(({p} + 3.8416 / (2 * {n})) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n})"
    return f"100.0 * least(1.0, greatest(0.0, {x}))"


def per_patient(columns: str) -> str:
    return f"SELECT patient_id, {columns} FROM r GROUP BY patient_id"


@query("glycemia_risk_index", per_patient(f"count(*) AS n, {GRI} AS gri, 3.0 * {share('sgv < 54')} + 2.4 * {share('sgv BETWEEN 54 AND 69')} AS hypo_component, 1.6 * {share('sgv > 250')} + 0.8 * {share('sgv BETWEEN 181 AND 250')} AS hyper_component, {share('sgv < 54')} AS pct_lt54, {share('sgv BETWEEN 54 AND 69')} AS pct_54_69, {share('sgv BETWEEN 181 AND 250')} AS pct_181_250, {share('sgv > 250')} AS pct_gt250"), "gri hypo_component hyper_component pct_lt54 pct_54_69 pct_181_250 pct_gt250")
def glycemia_risk_index(spark, d):
    return metrics.glycemia_risk_index(readings(spark, d))


@query("glucose_stats", per_patient(f"count(*) AS n, avg(sgv) AS mean_mgdl, coalesce(stddev_samp(sgv), 0) AS sd_mgdl, {CV} AS cv_percent, 3.31 + 0.02392 * avg(sgv) AS gmi_percent, {share('sgv BETWEEN 70 AND 180')} AS tir_percent, {share('sgv < 70')} AS tbr_lt70_percent, {share('sgv < 54')} AS tbr_lt54_percent, {share('sgv > 180')} AS tar_gt180_percent, {share('sgv > 250')} AS tar_gt250_percent, epoch_us(max(ts)) - epoch_us(min(ts)) >= 336 * 3600000000 AS gmi_reliable"), "mean_mgdl sd_mgdl cv_percent gmi_percent tir_percent tbr_lt70_percent tbr_lt54_percent tar_gt180_percent tar_gt250_percent")
def glucose_stats(spark, d):
    return metrics.glucose_stats(readings(spark, d))


@query("bg_risk_indices", f"SELECT *, CASE WHEN lbgi < 1.1 THEN 'minimal' WHEN lbgi < 2.5 THEN 'low' WHEN lbgi < 5.0 THEN 'moderate' ELSE 'high' END AS lbgi_band, CASE WHEN hbgi < 4.5 THEN 'minimal' WHEN hbgi < 9.0 THEN 'low' WHEN hbgi < 15.0 THEN 'moderate' ELSE 'high' END AS hbgi_band FROM ({per_patient(f'count(*) AS n, avg({LOW}) AS lbgi, avg({HIGH}) AS hbgi')})", "lbgi hbgi")
def bg_risk_indices(spark, d):
    return metrics.bg_risk_indices(readings(spark, d))


@query("adrr", f"SELECT patient_id, avg(x) AS adrr, count(*) AS days FROM (SELECT patient_id, max({LOW}) + max({HIGH}) AS x FROM r GROUP BY patient_id, CAST(ts AS DATE)) GROUP BY patient_id", "adrr")
def adrr(spark, d):
    return metrics.adrr(readings(spark, d))


@query("cv_percent", per_patient(f"{CV} AS cv_percent"), "cv_percent")
def cv_percent(spark, d):
    return metrics.cv_percent(readings(spark, d))


@query("j_index", per_patient("0.001 * pow(avg(sgv) + coalesce(stddev_samp(sgv), 0), 2) AS j_index"), "j_index")
def j_index(spark, d):
    return metrics.j_index(readings(spark, d))


@query("m_value", per_patient("avg(pow(abs(10 * log10(sgv / 120.0)), 3)) AS m_value"), "m_value")
def m_value(spark, d):
    return metrics.m_value(readings(spark, d))


COGI = f"0.5 * least(100, greatest(0, {share('sgv BETWEEN 70 AND 180')})) + 0.35 * least(100, greatest(0, (1 - {share('sgv < 70')} / 15) * 100)) + 0.15 * least(100, greatest(0, (1 - ({CV} - 36) / 72) * 100))"


@query("cogi", per_patient(f"{COGI} AS cogi"), "cogi")
def cogi(spark, d):
    return metrics.cogi(readings(spark, d))


BANDS = {"lt54": "sgv < 54", "54_69": "sgv BETWEEN 54 AND 69", "70_180": "sgv BETWEEN 70 AND 180", "181_250": "sgv BETWEEN 181 AND 250", "gt250": "sgv > 250", "lt70": "sgv < 70", "gt180": "sgv > 180"}


@query("tir_with_ci", per_patient("count(*) AS n, " + ", ".join(f"{share(c)} AS pct_{k}, {wilson(c, '-')} AS ci_lo_{k}, {wilson(c, '+')} AS ci_hi_{k}" for k, c in BANDS.items()) + f", {CV} <= 36 AND {CV} > 0 AS cv_stable"), " ".join(f"{p}_{k}" for k in BANDS for p in ("pct", "ci_lo", "ci_hi")))
def tir_with_ci(spark, d):
    return metrics.tir_with_ci(readings(spark, d))


PERIOD = f"count(*) AS n, avg(sgv) AS mean_mgdl, {share('sgv BETWEEN 70 AND 180')} AS tir_percent, {wilson('sgv BETWEEN 70 AND 180', '-')} AS tir_ci_lo, {wilson('sgv BETWEEN 70 AND 180', '+')} AS tir_ci_hi, {share('sgv < 54')} AS tbr_lt54_percent, {wilson('sgv < 54', '-')} AS tbr_lt54_ci_lo, {wilson('sgv < 54', '+')} AS tbr_lt54_ci_hi, {share('sgv < 70')} AS tbr_percent, {share('sgv > 180')} AS tar_percent, {GRI} AS gri, avg({LOW}) AS lbgi, avg({HIGH}) AS hbgi, {CV} AS cv_percent, 3.31 + 0.02392 * avg(sgv) AS gmi_percent"
PERIOD_DOUBLES = "mean_mgdl tir_percent tir_ci_lo tir_ci_hi tbr_lt54_percent tbr_lt54_ci_lo tbr_lt54_ci_hi tbr_percent tar_percent gri lbgi hbgi cv_percent gmi_percent"


@query("period_metrics", per_patient(PERIOD), PERIOD_DOUBLES)
def period_metrics(spark, d):
    return metrics.period_metrics(readings(spark, d), ("patient_id",))


GAP = "(SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY patient_id ORDER BY ts) AS gap FROM r)"


@query("data_sufficiency", f"SELECT *, CASE WHEN meets_consensus THEN 'sufficient' ELSE CASE WHEN pct_active < 70 THEN 'less than 70 % active' ELSE '' END END AS note FROM (SELECT patient_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days_with_data, coalesce(max(gap), 0) / 3.6e9 AS longest_gap_hours, CAST(288 * 30 AS INT) AS expected, least(100.0, 100.0 * count(*) / (288 * 30)) AS pct_active, least(100.0, 100.0 * count(*) / (288 * 30)) >= 70 AS meets_consensus FROM {GAP} GROUP BY patient_id)", "longest_gap_hours pct_active")
def data_sufficiency(spark, d):
    return metrics.data_sufficiency(readings(spark, d))


@query("longest_gap", f"SELECT patient_id, coalesce(max(gap), 0) / 3.6e9 AS longest_gap_hours FROM {GAP} GROUP BY patient_id", "longest_gap_hours")
def longest_gap(spark, d):
    return metrics.longest_gap(readings(spark, d))


GVP = "SELECT patient_id, coalesce((sum(sqrt(dt * dt + dv * dv)) FILTER (dt > 0) / sum(dt) FILTER (dt > 0) - 1) * 100, 0) AS gvp FROM (SELECT patient_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 6e7 AS dt, sgv - lag(sgv) OVER w AS dv FROM r WINDOW w AS (PARTITION BY patient_id ORDER BY ts, id)) GROUP BY patient_id"


@query("gvp", GVP, "gvp")
def gvp(spark, d):
    return variability.gvp(readings(spark, d))


MAGE = """
SELECT p.patient_id, coalesce(m, 0) AS mage FROM (SELECT DISTINCT patient_id FROM r) p LEFT JOIN (
  SELECT patient_id, avg(swing) FILTER (swing > sd) AS m FROM (
    SELECT patient_id, sd, abs(sgv - lag(sgv) OVER (PARTITION BY patient_id ORDER BY ts, id)) AS swing FROM (
      SELECT *, lag(sgv) OVER w AS b, lead(sgv) OVER w AS a, stddev_samp(sgv) OVER (PARTITION BY patient_id) AS sd FROM r WINDOW w AS (PARTITION BY patient_id ORDER BY ts, id))
    WHERE (sgv > b AND sgv >= a) OR (sgv < b AND sgv <= a)) GROUP BY patient_id) USING (patient_id)"""


@query("mage", MAGE, "mage")
def mage(spark, d):
    return variability.mage(readings(spark, d))


def shifted(minutes: int, value: str, name: str, least: int) -> str:
    return f"""
SELECT n.patient_id, CASE WHEN n >= {least} AND matches >= 10 THEN v ELSE 0 END AS {name}, coalesce(matches, 0) AS matches
FROM (SELECT patient_id, count(*) AS n FROM r GROUP BY patient_id) n LEFT JOIN (
  SELECT patient_id, {value} AS v, count(*) AS matches FROM (
    SELECT a.patient_id, a.sgv AS now, arg_min(b.past, b.minute) AS past
    FROM r a JOIN (SELECT patient_id, epoch_us(ts) // 60000000 AS minute, arg_max(sgv, ts) AS past FROM r GROUP BY 1, 2) b
      ON a.patient_id = b.patient_id AND b.minute BETWEEN epoch_us(a.ts) // 60000000 - {minutes} - 5 AND epoch_us(a.ts) // 60000000 - {minutes} + 5
    GROUP BY a.patient_id, a.id, a.sgv) GROUP BY patient_id) USING (patient_id)"""


MODD = shifted(1440, "avg(abs(now - past))", "modd", 50)


@query("modd", MODD, "modd")
def modd(spark, d):
    return variability.modd(readings(spark, d))


def _conga(hours: int) -> None:
    query(f"conga_{hours}h", shifted(60 * hours, "stddev_samp(now - past)", f"conga_{hours}h", 20), f"conga_{hours}h")(lambda spark, d: variability.conga(readings(spark, d), hours))


for _h in (1, 2, 4):
    _conga(_h)


@query(
    "glucose_variability",
    f"SELECT patient_id, cv_percent, mage, modd, j_index, m_value, gvp, conga_1h, conga_2h, conga_4h, cogi FROM ({per_patient(f'{CV} AS cv_percent, 0.001 * pow(avg(sgv) + coalesce(stddev_samp(sgv), 0), 2) AS j_index, avg(pow(abs(10 * log10(sgv / 120.0)), 3)) AS m_value, {COGI} AS cogi')}) JOIN ({MAGE}) USING (patient_id) JOIN (SELECT patient_id, modd FROM ({MODD})) USING (patient_id) JOIN ({GVP}) USING (patient_id) "
    + " ".join(f"JOIN (SELECT patient_id, conga_{h}h FROM ({shifted(60 * h, 'stddev_samp(now - past)', f'conga_{h}h', 20)})) USING (patient_id)" for h in (1, 2, 4)),
    "cv_percent mage modd j_index m_value gvp conga_1h conga_2h conga_4h cogi",
)
def glucose_variability(spark, d):
    return variability.glucose_variability(readings(spark, d))


PERIODS = "(VALUES ('overnight', 0, 6), ('breakfast', 6, 11), ('lunch', 11, 14), ('afternoon', 14, 17), ('dinner', 17, 21), ('evening', 21, 24)) AS m(period, a, b)"


@query("meal_period_tir", f"SELECT p.patient_id, m.period, count(sgv) AS n, coalesce(avg(sgv), 0) AS mean_mgdl, coalesce(100.0 * count(*) FILTER (sgv BETWEEN 70 AND 180) / nullif(count(sgv), 0), 0) AS tir_percent, coalesce(100.0 * count(*) FILTER (sgv < 70) / nullif(count(sgv), 0), 0) AS tbr_percent, coalesce(100.0 * count(*) FILTER (sgv > 180) / nullif(count(sgv), 0), 0) AS tar_percent FROM (SELECT DISTINCT patient_id FROM r) p CROSS JOIN {PERIODS} LEFT JOIN r ON r.patient_id = p.patient_id AND hour(r.ts) >= m.a AND hour(r.ts) < m.b GROUP BY 1, 2", "mean_mgdl tir_percent tbr_percent tar_percent")
def meal_period_tir(spark, d):
    return profiles.meal_period_tir(readings(spark, d))


AGP = "SELECT p.patient_id, CAST(h AS INT) AS hour, count(sgv) AS n, " + ", ".join(f"CAST(quantile_cont(sgv, {q}) AS DOUBLE) AS {k}" for k, q in profiles.PERCENTILES.items()) + " FROM (SELECT DISTINCT patient_id FROM r) p CROSS JOIN range(24) AS hours(h) LEFT JOIN r ON r.patient_id = p.patient_id AND hour(r.ts) = h GROUP BY 1, 2"


@query("agp_hourly", AGP, "p5 p25 p50 p75 p95")
def agp_hourly(spark, d):
    return profiles.agp_hourly(readings(spark, d))


@query("agp_summary", f"SELECT patient_id, CAST(sum(n) AS BIGINT) AS n, arg_min(hour, (p50, hour)) AS lowest_hour, min(p50) AS lowest_p50, arg_max(hour, (p50, -hour)) AS highest_hour, max(p50) AS highest_p50 FROM ({AGP}) WHERE n > 0 GROUP BY patient_id", "lowest_p50 highest_p50")
def agp_summary(spark, d):
    return profiles.agp_summary(readings(spark, d))


@query("agp_markdown")
def agp_markdown(spark, d):
    return profiles.agp_markdown(readings(spark, d))


@query("hourly_mean", "SELECT patient_id, date_trunc('hour', ts) AS hour, avg(sgv) AS mean_mgdl, count(*) AS n FROM r GROUP BY 1, 2", "mean_mgdl")
def hourly_mean(spark, d):
    return profiles.hourly_mean(readings(spark, d))


@query("daily_tdd", "SELECT patient_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(insulin) AS tdd, count(*) AS n FROM t WHERE insulin > 0 GROUP BY 1, 2", "tdd")
def daily_tdd(spark, d):
    return profiles.daily_tdd(cohort.treatments(spark, d))


@query("daily_profiles", f"SELECT *, CASE WHEN nadir < 54 THEN '<54' WHEN nadir < 70 THEN '<70' ELSE '' END AS flag FROM (SELECT patient_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, avg(sgv) AS mean_mgdl, {share('sgv BETWEEN 70 AND 180')} AS tir_percent, min(sgv) AS nadir FROM r GROUP BY 1, 2)", "mean_mgdl tir_percent")
def daily_profiles(spark, d):
    return profiles.daily_profiles(readings(spark, d))


@query(
    "daily_report",
    f"SELECT g.*, coalesce(n_treatments, 0) AS n_treatments, coalesce(insulin, 0) AS insulin, coalesce(carbs, 0) AS carbs, coalesce(notes, '') AS notes FROM (SELECT patient_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, avg(sgv) AS mean_mgdl, {share('sgv BETWEEN 70 AND 180')} AS tir_percent, {share('sgv < 70')} AS tbr_percent FROM r GROUP BY 1, 2) g LEFT JOIN (SELECT patient_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_treatments, sum(insulin) AS insulin, sum(carbs) AS carbs, string_agg(notes, '; ' ORDER BY ts, id) FILTER (notes <> '' AND event_type <> 'Profile Switch') AS notes FROM t GROUP BY 1, 2) x USING (patient_id, day)",
    "mean_mgdl tir_percent tbr_percent insulin carbs",
)
def daily_report(spark, d):
    return profiles.daily_report(readings(spark, d), cohort.treatments(spark, d))


@query("insulin_carb_summary", "SELECT patient_id, coalesce(sum(insulin), 0) / 30 AS insulin_per_day, coalesce(sum(carbs), 0) / 30 AS carbs_per_day, count(*) FILTER (insulin > 0) / 30 AS boluses_per_day FROM t GROUP BY 1", "insulin_per_day carbs_per_day boluses_per_day")
def insulin_carb_summary(spark, d):
    return profiles.insulin_carb_summary(cohort.treatments(spark, d))


def anchors(where: str) -> str:
    pick = lambda h: f"arg_min(sgv, (abs(minute - {h * 60}), ts)) FILTER (abs(minute - {h * 60}) <= 60)"
    return f"SELECT patient_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {pick(3)} AS at_3, {pick(7)} AS at_7, {pick(7)} - {pick(3)} AS dawn_rise FROM (SELECT *, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute FROM r {where}) GROUP BY 1, 2"


@query("dawn_anchors", anchors(""))
def dawn_anchors(spark, d):
    return profiles.dawn_anchors(readings(spark, d))


@query(
    "overnight_analysis",
    f"SELECT n.*, dawn_rise FROM (SELECT patient_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, arg_min(sgv, ts) AS start_mgdl, arg_max(sgv, ts) AS end_mgdl, arg_max(sgv, ts) - arg_min(sgv, ts) AS drift_mgdl, min(sgv) AS min_mgdl, max(sgv) AS max_mgdl, 5 * count(*) FILTER (sgv < 70) AS below_70_minutes, 5 * count(*) FILTER (sgv < 54) AS below_54_minutes, coalesce(100.0 * count(*) FILTER (step <= 5) / nullif(count(step), 0), 0) AS flat_percent FROM (SELECT *, abs(sgv - lag(sgv) OVER (PARTITION BY patient_id, CAST(ts AS DATE) ORDER BY ts)) AS step FROM r WHERE hour(ts) < 7) GROUP BY 1, 2) n LEFT JOIN ({anchors('WHERE hour(ts) < 7')}) USING (patient_id, day)",
    "flat_percent",
)
def overnight_analysis(spark, d):
    return profiles.overnight_analysis(readings(spark, d))


PATTERNS = f"""
WITH found AS (
  SELECT patient_id, 'overnight_low' AS type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(sgv, ts) AS x FROM r WHERE hour(ts) < 6 AND sgv < 70 GROUP BY 1, 2, 3
  UNION ALL SELECT patient_id, 'dawn_phenomenon', day, dawn_rise FROM ({anchors('')}) WHERE dawn_rise > 30
  UNION ALL SELECT patient_id, 'post_meal_spike', CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(rise, ts) FROM (
    SELECT *, lead(sgv, 6) OVER (PARTITION BY patient_id, CAST(ts AS DATE) ORDER BY ts) - sgv AS rise FROM r) WHERE rise > 50 GROUP BY 1, 2, 3)
SELECT patient_id, type, count(*) AS occurrences, avg(x) AS mean_mgdl, array_to_string(list(day ORDER BY day)[1:5], ',') AS sample_days FROM found GROUP BY 1, 2"""


@query("detect_patterns", PATTERNS, "mean_mgdl")
def detect_patterns(spark, d):
    return profiles.detect_patterns(readings(spark, d))


@query("current_glucose", "SELECT patient_id, ts, sgv, sgv - before AS delta, direction, CAST((epoch_us((SELECT max(ts) FROM r)) - epoch_us(ts)) // 60000000 AS BIGINT) AS minutes_ago FROM (SELECT *, lag(sgv) OVER w AS before, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC) AS n FROM r WINDOW w AS (PARTITION BY patient_id ORDER BY ts)) WHERE n = 1")
def current_glucose(spark, d):
    return profiles.current_glucose(readings(spark, d))
