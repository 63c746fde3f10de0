"""Queries on boluses and meals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweetframe.operators import devices, outcomes
from sweetframe.plans._base import query, readings
from sweetframe.sources import cohort

CORRECTION = "insulin > 0 AND coalesce(carbs, 0) <= 0 AND (event_type LIKE '%Correction%' OR event_type = 'Bolus')"
H = 3_600_000_000


def isolated(same_time: bool) -> str:
    skip = "" if same_time else " AND c.ts <> b.ts"
    return f"SELECT * FROM t b WHERE {CORRECTION} AND NOT EXISTS (SELECT 1 FROM t c WHERE c.carbs > 0 AND c.patient_id = b.patient_id AND abs(epoch_us(c.ts) - epoch_us(b.ts)) <= {H}{skip})"


def with_pre(b: str, tolerance_min: float | None = None) -> str:
    ok = f"epoch_us(b.ts) - epoch_us(r.ts) <= {int(tolerance_min * 60_000_000)}" if tolerance_min else "true"
    return f"SELECT b.*, CASE WHEN {ok} THEN r.sgv END AS pre_bg FROM ({b}) b ASOF LEFT JOIN r ON r.patient_id = b.patient_id AND r.ts <= b.ts"


def with_min(b: str, closed: bool = False) -> str:
    return f"SELECT b.*, (SELECT min(sgv) FROM r WHERE r.patient_id = b.patient_id AND r.ts {'>=' if closed else '>'} b.ts AND epoch_us(r.ts) <= epoch_us(b.ts) + {5 * H}) AS min_bg FROM ({b}) b"


def _t(spark, d):
    return cohort.treatments(spark, d)


def _sens(spark, d):
    return devices.sensitivity(cohort.documents(spark, d))


def _settings(spark, d):
    return cohort.profile_settings(cohort.profiles(cohort.readings(spark, d)))


@query("isolated_corrections", f"SELECT patient_id, id, ts, insulin FROM ({isolated(False)})", "insulin")
def isolated_corrections(spark, d):
    return outcomes.isolated_corrections(_t(spark, d)).select("patient_id", "id", "ts", "insulin")


@query("asof_pre_bg", f"SELECT patient_id, id, ts, pre_bg FROM ({with_pre('SELECT * FROM t WHERE insulin > 0')})")
def asof_pre_bg(spark, d):
    return outcomes.asof_pre_bg(_t(spark, d).where("insulin > 0"), readings(spark, d)).select("patient_id", "id", "ts", "pre_bg")


@query("asof_pre_bg_tol", f"SELECT patient_id, id, ts, pre_bg FROM ({with_pre('SELECT * FROM t WHERE insulin > 0', 15)})")
def asof_pre_bg_tol(spark, d):
    return outcomes.asof_pre_bg(_t(spark, d).where("insulin > 0"), readings(spark, d), 15).select("patient_id", "id", "ts", "pre_bg")


def with_sens(b: str) -> str:
    return f"SELECT b.*, CASE WHEN epoch_us(b.ts) - epoch_us(s.ts) <= 900000000 THEN s.sens_mmol END AS sens_mmol FROM ({b}) b ASOF LEFT JOIN (SELECT * FROM bolus_left WHERE sens_mmol IS NOT NULL) s ON s.patient_id = b.patient_id AND s.ts < b.ts"


@query("asof_sens_strict", f"SELECT patient_id, id, ts, sens_mmol FROM ({with_sens('SELECT * FROM t WHERE insulin > 0')})", "sens_mmol")
def asof_sens_strict(spark, d):
    return outcomes.asof_sens_strict(_t(spark, d).where("insulin > 0"), _sens(spark, d)).select("patient_id", "id", "ts", "sens_mmol")


def with_device(b: str) -> str:
    near = "epoch_us(b.ts) - epoch_us(s.ts) <= 900000000"
    return f"""SELECT b.*, CASE WHEN {near} THEN s.sens_mmol END AS sens_mmol, CASE WHEN {near} AND s.k % 3 > 0 THEN s.v / 8 END AS iob, CASE WHEN {near} AND s.has_suggested THEN s.v10 END AS cob,
      CASE WHEN {near} AND s.has_suggested THEN s.v + 50 END AS eventual_bg FROM ({b}) b ASOF LEFT JOIN bolus_left s ON s.patient_id = b.patient_id AND s.ts <= b.ts"""


@query("asof_devicestatus", f"SELECT patient_id, id, ts, sens_mmol, iob, cob, eventual_bg FROM ({with_device('SELECT patient_id, id, ts FROM t WHERE insulin > 0')})", "sens_mmol iob cob eventual_bg")
def asof_devicestatus(spark, d):
    return outcomes.asof_devicestatus(_t(spark, d).where("insulin > 0").select("patient_id", "id", "ts"), _sens(spark, d))


@query("post_bolus_min", f"SELECT patient_id, id, ts, min_bg FROM ({with_min('SELECT * FROM t WHERE insulin > 0')})")
def post_bolus_min(spark, d):
    return outcomes.post_bolus_min(_t(spark, d).where("insulin > 0"), readings(spark, d)).select("patient_id", "id", "ts", "min_bg")


def samples(same_time: bool) -> str:
    return f"SELECT *, (pre_bg - min_bg) / insulin AS isf FROM ({with_min(with_pre(isolated(same_time)))}) WHERE (pre_bg - min_bg) / insulin > 0 AND (pre_bg - min_bg) / insulin <= 500"


@query("isf_samples", f"SELECT patient_id, id, pre_bg, min_bg, isf FROM ({samples(False)})", "isf")
def isf_samples(spark, d):
    return outcomes.isf_samples(_t(spark, d), readings(spark, d)).select("patient_id", "id", "pre_bg", "min_bg", "isf")


CONFIDENCE = "CASE WHEN n < 3 THEN 'low' WHEN n < 8 THEN 'medium' ELSE 'high' END AS confidence"


@query("isf_check", f"SELECT *, derived_isf_mmol / profile_isf_mmol AS ratio, {CONFIDENCE} FROM (SELECT p.patient_id, count(isf) AS n, avg(isf) AS isf_mgdl, round(avg(isf) / 18.0, 1) AS derived_isf_mmol, 2.8::DOUBLE AS profile_isf_mmol FROM (SELECT DISTINCT patient_id FROM r) p LEFT JOIN ({samples(False)}) s USING (patient_id) GROUP BY 1)", "isf_mgdl derived_isf_mmol profile_isf_mmol ratio")
def isf_check(spark, d):
    return outcomes.isf_check(outcomes.isf_samples(_t(spark, d), readings(spark, d)), _settings(spark, d))


EFFECTIVE = f"SELECT *, round(isf / 18.0, 1) AS realized_mmol, CASE WHEN pre_bg < 100 THEN 'below_target' WHEN pre_bg < 180 THEN 'in_target' ELSE 'above_target' END AS band FROM ({with_sens(samples(True))})"
BAND_SUMS = "count(sens_mmol) AS n, count(isf) - count(sens_mmol) AS unmatched, avg(sens_mmol) AS effective_mmol, avg(realized_mmol) FILTER (sens_mmol IS NOT NULL) AS realized_mmol, avg(realized_mmol) FILTER (sens_mmol IS NOT NULL) / avg(sens_mmol) AS ratio"


@query("effective_isf_bands", f"SELECT p.patient_id, b.band, {BAND_SUMS} FROM (SELECT DISTINCT patient_id FROM r) p CROSS JOIN (VALUES ('below_target'), ('in_target'), ('above_target')) b(band) LEFT JOIN ({EFFECTIVE}) x ON x.patient_id = p.patient_id AND x.band = b.band GROUP BY 1, 2", "effective_mmol realized_mmol ratio")
def effective_isf_bands(spark, d):
    r = readings(spark, d)
    return outcomes.effective_isf_bands(outcomes.effective_isf_samples(_t(spark, d), r, _sens(spark, d)), r)


@query("effective_isf_check", f"SELECT *, {CONFIDENCE}, CASE WHEN ratio IS NULL THEN 'no_data' WHEN ratio > 1.15 THEN 'over_dosing' WHEN ratio < 0.85 THEN 'under_dosing' ELSE 'calibrated' END AS verdict FROM (SELECT p.patient_id, {BAND_SUMS} FROM (SELECT DISTINCT patient_id FROM r) p LEFT JOIN ({EFFECTIVE}) x USING (patient_id) GROUP BY 1)", "effective_mmol realized_mmol ratio")
def effective_isf_check(spark, d):
    r = readings(spark, d)
    return outcomes.effective_isf_check(outcomes.effective_isf_samples(_t(spark, d), r, _sens(spark, d)), r)


PAIRS = "SELECT *, coalesce(insulin, 0) + coalesce((SELECT sum(i.insulin) FROM t i WHERE i.insulin > 0 AND i.patient_id = c.patient_id AND i.ts <> c.ts AND abs(epoch_us(i.ts) - epoch_us(c.ts)) <= 600000000), 0) AS total_insulin FROM t c WHERE carbs > 5"


@query("carb_insulin_pairs", f"SELECT patient_id, id, ts, carbs, total_insulin FROM ({PAIRS}) WHERE total_insulin > 0", "carbs total_insulin")
def carb_insulin_pairs(spark, d):
    return outcomes.carb_insulin_pairs(_t(spark, d)).select("patient_id", "id", "ts", "carbs", "total_insulin")


ALONE = f"SELECT * FROM ({PAIRS}) m WHERE total_insulin > 0 AND NOT EXISTS (SELECT 1 FROM t c WHERE c.carbs > 5 AND c.patient_id = m.patient_id AND c.ts > m.ts AND epoch_us(c.ts) <= epoch_us(m.ts) + {4 * H})"
CR = f"SELECT *, carbs / total_insulin AS cr, CAST(end_bg - pre_bg AS DOUBLE) AS residual FROM (SELECT b.*, (SELECT arg_max(sgv, ts) FROM r WHERE r.patient_id = b.patient_id AND r.ts > b.ts AND epoch_us(r.ts) <= epoch_us(b.ts) + {4 * H}) AS end_bg FROM ({with_pre(ALONE)}) b) WHERE pre_bg IS NOT NULL AND end_bg IS NOT NULL"


@query("carb_ratio_samples", f"SELECT patient_id, id, pre_bg, end_bg, cr, residual FROM ({CR})", "cr residual")
def carb_ratio_samples(spark, d):
    return outcomes.carb_ratio_samples(_t(spark, d), readings(spark, d)).select("patient_id", "id", "pre_bg", "end_bg", "cr", "residual")


@query(
    "carb_ratio_check",
    f"""SELECT *, {CONFIDENCE}, CASE WHEN n = 0 THEN 'no_data' WHEN cr_signal = 0 AND residual_signal = 0 THEN 'stable' WHEN cr_signal = residual_signal THEN CASE WHEN cr_signal > 0 THEN 'too_high' ELSE 'too_low' END
      WHEN cr_signal <> 0 AND residual_signal <> 0 THEN 'signals_disagree' ELSE 'one_signal' END AS verdict FROM (
      SELECT *, CASE WHEN ratio > 1.1 THEN 1 WHEN ratio < 0.9 THEN -1 ELSE 0 END AS cr_signal, CASE WHEN mean_residual >= 20 THEN 1 WHEN mean_residual <= -20 THEN -1 ELSE 0 END AS residual_signal FROM (
      SELECT p.patient_id, count(cr) AS n, avg(cr) AS derived_cr, 10.0::DOUBLE AS profile_cr, avg(cr) / 10.0 AS ratio, avg(residual) AS mean_residual FROM (SELECT DISTINCT patient_id FROM r) p LEFT JOIN ({CR}) USING (patient_id) GROUP BY 1))""",
    "derived_cr profile_cr ratio mean_residual",
)
def carb_ratio_check(spark, d):
    return outcomes.carb_ratio_check(outcomes.carb_ratio_samples(_t(spark, d), readings(spark, d)), _settings(spark, d))


MANUAL = "SELECT * FROM t WHERE insulin >= 0.3 AND event_type IN ('Bolus', 'Correction Bolus') AND upper(coalesce(notes, '')) NOT LIKE '%SMB%'"
EVENTS = f"""SELECT patient_id, id, ts, insulin, pre_bg, min_bg, drop_mgdl, CASE WHEN drop_mgdl > 0 THEN drop_mgdl / insulin END AS realized_isf, sens_mmol * 18.0 AS effective_isf, iob, cob, eventual_bg, meal,
  CASE WHEN pre_bg < 70 THEN 'below_70' WHEN pre_bg < 100 THEN '70_100' WHEN pre_bg < 140 THEN '100_140' WHEN pre_bg < 180 THEN '140_180' WHEN pre_bg < 250 THEN '180_250' WHEN pre_bg >= 250 THEN 'over_250' END AS bg_band,
  CASE WHEN hour(ts) < 6 THEN 'overnight' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_band
FROM (SELECT *, CAST(pre_bg - min_bg AS DOUBLE) AS drop_mgdl, EXISTS (SELECT 1 FROM t c WHERE c.carbs > 0 AND c.patient_id = x.patient_id AND abs(epoch_us(c.ts) - epoch_us(x.ts)) <= {H}) AS meal FROM ({with_device(with_min(with_pre(MANUAL, 15), True))}) x)"""


def _events(spark, d):
    return outcomes.bolus_events(_t(spark, d), readings(spark, d), _sens(spark, d))


@query("bolus_events", EVENTS, "insulin drop_mgdl realized_isf effective_isf iob cob eventual_bg")
def bolus_events(spark, d):
    return _events(spark, d)


def bands(band: str) -> str:
    both = "realized_isf IS NOT NULL AND effective_isf IS NOT NULL"
    return f"SELECT *, coalesce(mean_realized / mean_effective, 0) AS ratio FROM (SELECT patient_id, {band} AS band, count(*) AS n, avg(insulin) AS mean_insulin, avg(pre_bg) AS mean_pre_bg, avg(drop_mgdl) FILTER (drop_mgdl <> 0) AS mean_drop, count(*) FILTER ({both}) AS matched, avg(effective_isf) FILTER ({both}) AS mean_effective, avg(realized_isf) FILTER ({both}) AS mean_realized FROM ({EVENTS}) WHERE {band} IS NOT NULL GROUP BY 1, 2)"


BAND_DOUBLES = "mean_insulin mean_pre_bg mean_drop mean_effective mean_realized ratio"


@query("bolus_by_bg_band", bands("bg_band"), BAND_DOUBLES)
def bolus_by_bg_band(spark, d):
    return outcomes.bolus_bands(_events(spark, d), "bg_band")


@query("bolus_by_time_band", bands("time_band"), BAND_DOUBLES)
def bolus_by_time_band(spark, d):
    return outcomes.bolus_bands(_events(spark, d), "time_band")


def residuals(least: int) -> str:
    pick = lambda a, b: f"CASE WHEN arg_min(n, band = '{b}') FILTER (band IN ('{a}', '{b}')) >= {least} THEN arg_min(ratio, band = '{b}') FILTER (band IN ('{a}', '{b}')) END"
    return f"""SELECT o.*, in_target_ratio, above_target_ratio, CASE WHEN overall_ratio = 0 THEN 'no_data' WHEN overall_ratio BETWEEN 0.85 AND 1.15 THEN 'calibrated'
      WHEN overall_ratio > 1.15 AND above_target_ratio > 1.3 AND in_target_ratio BETWEEN 0.85 AND 1.15 THEN 'over_dosing_above_target' WHEN overall_ratio > 1.15 THEN 'over_dosing' ELSE 'under_dosing' END AS verdict
      FROM (SELECT patient_id, count(*) AS n, count(realized_isf / effective_isf) AS matched, coalesce(avg(realized_isf / effective_isf), 0) AS overall_ratio FROM ({EVENTS}) GROUP BY 1) o
      LEFT JOIN (SELECT patient_id, {pick('100_140', '140_180')} AS in_target_ratio, {pick('180_250', 'over_250')} AS above_target_ratio FROM ({bands('bg_band')}) GROUP BY 1) USING (patient_id)"""


@query("bolus_residuals", residuals(1), "overall_ratio in_target_ratio above_target_ratio")
def bolus_residuals(spark, d):
    return outcomes.bolus_residuals(_events(spark, d))


@query(
    "af_recommendation",
    f"""SELECT patient_id, CAST(100 AS INT) AS current_af, CAST(CASE recommendation WHEN 'hold' THEN 100 WHEN 'dampen_curve' THEN 95 WHEN 'lower_af' THEN 95 WHEN 'raise_af' THEN 100 END AS INT) AS recommended_af, recommendation, overall_ratio, in_target_ratio, above_target_ratio,
      CASE WHEN recommendation = 'insufficient_data' THEN 'low' WHEN recommendation = 'hold' AND matched >= 30 OR recommendation = 'dampen_curve' AND matched >= 40 THEN 'high' ELSE 'medium' END AS confidence, matched
      FROM (SELECT *, CASE WHEN matched < 20 THEN 'insufficient_data' WHEN overall_ratio BETWEEN 0.85 AND 1.15 THEN 'hold' WHEN overall_ratio > 1.15 AND coalesce(above_target_ratio > 1.3 AND in_target_ratio BETWEEN 0.85 AND 1.25, false) THEN 'dampen_curve' WHEN overall_ratio > 1.15 THEN 'lower_af' ELSE 'raise_af' END AS recommendation FROM ({residuals(3)}))""",
    "overall_ratio in_target_ratio above_target_ratio",
)
def af_recommendation(spark, d):
    return outcomes.af_recommendation(_events(spark, d))


def responses(rows: str, keep: str) -> str:
    return f"""SELECT patient_id, id, ts, {keep}, pre_bg, coalesce(peak, pre_bg, 0) AS peak_mgdl, CASE WHEN peak IS NULL THEN 0 ELSE (epoch_us(peak_ts) - epoch_us(ts)) // 60000000 END AS minutes_to_peak,
      CASE WHEN peak IS NULL THEN 0 ELSE peak - coalesce(pre_bg, peak) END AS rise_mgdl, coalesce(end_bg, pre_bg, 0) AS end_mgdl, peak IS NOT NULL AND end_bg BETWEEN 70 AND 180 AS in_range_at_end,
      concat_ws('; ', CASE WHEN peak IS NULL THEN 'no readings after' END, CASE WHEN peak - coalesce(pre_bg, peak) > 80 THEN 'large rise' END, CASE WHEN peak > 250 THEN 'peak above 250' END, CASE WHEN peak IS NOT NULL AND end_bg < 70 THEN 'ended low' END, CASE WHEN peak IS NOT NULL AND pre_bg < 70 THEN 'started low' END) AS notes
    FROM (SELECT m.*, (SELECT max(sgv) FROM r WHERE r.patient_id = m.patient_id AND r.ts > m.ts AND epoch_us(r.ts) <= epoch_us(m.ts) + {4 * H}) AS peak,
      (SELECT arg_min(ts, (-sgv, ts)) FROM r WHERE r.patient_id = m.patient_id AND r.ts > m.ts AND epoch_us(r.ts) <= epoch_us(m.ts) + {4 * H}) AS peak_ts,
      (SELECT arg_max(sgv, ts) FROM r WHERE r.patient_id = m.patient_id AND r.ts > m.ts AND epoch_us(r.ts) <= epoch_us(m.ts) + {4 * H}) AS end_bg
      FROM ({with_pre(rows)}) m)"""


MEAL = "carbs > 0 OR event_type IN ('Carb Correction', 'Meal Bolus', 'Snack Bolus')"


@query("meal_analysis", responses(f"SELECT * FROM t WHERE {MEAL}", "carbs, insulin"), "carbs insulin")
def meal_analysis(spark, d):
    return outcomes.meal_analysis(_t(spark, d), readings(spark, d))


LOOKED_UP = f"""SELECT q.patient_id, q.id, q.ts, n.best.id AS meal_id, n.best.carbs AS carbs, n.best.insulin AS insulin FROM (SELECT * FROM t WHERE event_type = 'Bolus') q LEFT JOIN (
  SELECT b.id, arg_min({{'id': m.id, 'carbs': m.carbs, 'insulin': m.insulin}}, (abs(epoch_us(m.ts) - epoch_us(b.ts)), m.ts, m.id)) AS best FROM t b JOIN (SELECT * FROM t WHERE {MEAL}) m
    ON m.patient_id = b.patient_id AND epoch_us(m.ts) >= epoch_us(b.ts) - {H // 2} AND epoch_us(m.ts) < epoch_us(b.ts) + {H // 2} WHERE b.event_type = 'Bolus' GROUP BY 1) n USING (id)"""


@query("meal_lookup", responses(LOOKED_UP, "meal_id, carbs, insulin"), "carbs insulin")
def meal_lookup(spark, d):
    """The times of plain boluses, each with the meal logged about then."""
    return outcomes.meal_at(_t(spark, d).where("event_type = 'Bolus'"), _t(spark, d), readings(spark, d))


@query(
    "nearest_reading",
    "SELECT q.patient_id, q.id, q.ts, sgv, (epoch_us(rts) - epoch_us(q.ts)) // 60000000 AS minutes_off FROM t q LEFT JOIN (SELECT b.id, arg_min(r.sgv, (abs(epoch_us(r.ts) - epoch_us(b.ts)), r.ts)) AS sgv, arg_min(r.ts, (abs(epoch_us(r.ts) - epoch_us(b.ts)), r.ts)) AS rts FROM t b JOIN r ON r.patient_id = b.patient_id AND epoch_us(r.ts) >= epoch_us(b.ts) - 900000000 AND epoch_us(r.ts) < epoch_us(b.ts) + 900000000 GROUP BY 1) n USING (id)".replace("(epoch_us(rts) - epoch_us(q.ts)) // 60000000", "CAST(floor((epoch_us(rts) - epoch_us(q.ts)) / 60000000) AS BIGINT)"),
)
def nearest_reading(spark, d):
    return outcomes.nearest_reading(_t(spark, d).select("patient_id", "id", "ts"), readings(spark, d))


OBSERVATIONS = f"""
SELECT patient_id, id, minutes, greatest(0, least(1, 1 - (pre_bg - sgv) / CAST(total AS DOUBLE))) AS fraction FROM (
  SELECT *, pre_bg - max(sgv) FILTER (minutes = 300) OVER (PARTITION BY id) AS total, count(*) FILTER (minutes = 30) OVER (PARTITION BY id) AS has_30 FROM (
    SELECT a.patient_id, a.id, o.minutes, any_value(a.pre_bg) AS pre_bg, arg_min(r.sgv, (abs(epoch_us(r.ts) - epoch_us(a.ts) - o.minutes::BIGINT * 60000000), r.ts)) AS sgv
    FROM ({with_pre(f"SELECT * FROM t b WHERE insulin > 0 AND event_type IN ('Correction Bolus', 'Bolus') AND NOT EXISTS (SELECT 1 FROM t c WHERE c.carbs > 0 AND c.patient_id = b.patient_id AND abs(epoch_us(c.ts) - epoch_us(b.ts)) <= {H})", 15)}) a
    CROSS JOIN (VALUES (30), (60), (120), (180), (240), (300)) o(minutes) JOIN r ON r.patient_id = a.patient_id AND abs(epoch_us(r.ts) - epoch_us(a.ts) - o.minutes::BIGINT * 60000000) <= 450000000
    WHERE a.pre_bg IS NOT NULL GROUP BY 1, 2, 3)) WHERE total > 5 AND has_30 > 0"""


@query("iob_observations", OBSERVATIONS, "fraction")
def iob_observations(spark, d):
    return outcomes.iob_observations(_t(spark, d), readings(spark, d))


TAU = "(peak * (1 - peak / (dia * 60)) / (1 - 2 * peak / (dia * 60)))"
CURVE = f"greatest(0, least(1, 1 - (1 / (1 - 2 * {TAU} / (dia * 60) + (1 + 2 * {TAU} / (dia * 60)) * exp(-dia * 60 / {TAU}))) * (1 - 2 * {TAU} / (dia * 60)) * ((minutes * minutes / ({TAU} * dia * 60 * (1 - 2 * {TAU} / (dia * 60))) - minutes / {TAU} - 1) * exp(-minutes / {TAU}) + 1)))"


@query(
    "dia_fit",
    f"""SELECT patient_id, b.dia AS dia_hours, b.peak AS peak_min, b.rmse AS rmse, b.n AS n, b.n >= 30 AS reliable FROM (SELECT patient_id, min({{'rmse': rmse, 'dia': dia, 'peak': peak, 'n': n}}) AS b FROM (
      SELECT patient_id, dia, peak, round(sqrt(avg(pow(CASE WHEN minutes >= dia * 60 THEN 0 ELSE {CURVE} END - fraction, 2))), 9) AS rmse, count(*) AS n FROM ({OBSERVATIONS})
      CROSS JOIN (SELECT 3.0::DOUBLE + 0.5 * i AS dia FROM range(11) g(i)) CROSS JOIN (SELECT 40.0::DOUBLE + 5 * i AS peak FROM range(9) g(i)) WHERE peak < dia * 30 GROUP BY 1, 2, 3) GROUP BY 1)""",
    "dia_hours peak_min rmse",
)
def dia_fit(spark, d):
    return outcomes.dia_fit(outcomes.iob_observations(_t(spark, d), readings(spark, d)))


@query("iob_curve", f'SELECT id, minutes, dia AS dia_hours, peak AS peak_min, CASE WHEN minutes >= dia * 60 THEN 0 ELSE {CURVE} END AS "left" FROM (SELECT event_id AS id, CAST(k * 5 AS INT) AS minutes, 3.0::DOUBLE + k % 6 AS dia, 40.0::DOUBLE + k % 9 * 5 AS peak FROM e WHERE event_type = \'purchase\')'.replace('round("left"', "round(left"), 'dia_hours peak_min "left"')
def iob_curve(spark, d):
    """Each purchase's k gives a time and a pair of parameters."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = cohort._events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("id"), k.alias("k"))
    rows = e.select("id", (F.col("k") * 5).alias("minutes"), (3.0 + F.col("k") % 6).alias("dia_hours"), (40.0 + F.col("k") % 9 * 5).alias("peak_min"))
    return outcomes.iob_curve(rows)
