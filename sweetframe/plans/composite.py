"""Queries on decision tables and reports."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweetframe.operators import devices, episodes, outcomes, profiles, reports
from sweetframe.plans import events
from sweetframe.plans import glucose as g
from sweetframe.plans import outcomes as o
from sweetframe.plans import sources as s
from sweetframe.plans._base import ORACLE_SQL, TABLES, query, readings
from sweetframe.scratch import written
from sweetframe.sources import cohort

CELLS = " UNION ALL ".join(
    f"SELECT patient_id, '{name}' AS population, unnest(['tir', 'tbr54', 'tbr', 'tar', 'tar250', 'cv', 'gmi', 'lbgi', 'hbgi', 'gri']) AS metric, unnest([{g.share(f'''sgv BETWEEN {p['low']} AND {p['high']}''')}, {g.share('sgv < 54')}, {g.share(f'''sgv < {p['low']}''')}, {g.share(f'''sgv > {p['high']}''')}, {g.share('sgv > 250')}, {g.CV}, 3.31 + 0.02392 * avg(sgv), avg({g.LOW}), avg({g.HIGH}), {g.GRI}]) AS value FROM r GROUP BY patient_id"
    for name, p in reports.POPULATIONS.items()
)
TARGETS = ", ".join(f"('{name}', '{m}', {lim}::DOUBLE, {near}::DOUBLE, '{word}', {str(more).lower()})" for name, p in reports.POPULATIONS.items() for m, lim, near, word, more in reports._checks(p) if lim is not None)
AUDIT = f"""SELECT patient_id, population, metric, value, lim AS "limit", good AS in_target, CASE WHEN more THEN CASE WHEN good THEN 'above_target' ELSE 'below_target' END WHEN good THEN 'in_target' ELSE 'above_target' END AS direction,
  CASE WHEN good THEN 'ok' WHEN CASE WHEN more THEN value >= near ELSE value < near END THEN 'borderline' ELSE word END AS severity
FROM (SELECT *, CASE WHEN more THEN value >= lim ELSE value < lim END AS good FROM ({CELLS}) JOIN (VALUES {TARGETS}) x(population, metric, lim, near, word, more) USING (population, metric))"""


@query("target_audit", AUDIT, "value")
def target_audit(spark, d):
    return reports.target_audit(readings(spark, d))


@query("target_audit_summary", f"SELECT *, CASE WHEN failed = 0 THEN 'all targets met' WHEN severe <> '' THEN failed || ' targets unmet, severe: ' || severe ELSE failed || ' targets unmet, none severe' END AS headline FROM (SELECT patient_id, population, count(*) FILTER (in_target) AS passed, count(*) FILTER (NOT in_target) AS failed, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (severity = 'severe'), '') AS severe FROM ({AUDIT}) GROUP BY 1, 2)")
def target_audit_summary(spark, d):
    return reports.target_audit_summary(reports.target_audit(readings(spark, d)))


def inner(name: str) -> str:
    """The registered SQL of another query without its adapter tables."""
    return "SELECT *" + ORACLE_SQL[name].split(TABLES + "\nSELECT *", 1)[1]


#: Zones of the queries by local hour, and their distance from UTC at the tables' dates.
ZONES = {"America/New_York": "- INTERVAL 5 HOUR", "Asia/Kolkata": "+ INTERVAL 330 MINUTE"}


def _by_zone(name: str, f, doubles: str) -> None:
    """Registers a report by local hour for all zones; its SQL is that of the report over readings at local time."""
    local = lambda shift: f"(WITH shifted AS (SELECT * REPLACE (ts {shift} AS ts) FROM r), r AS (SELECT * FROM shifted) {inner(name)})"
    sql = " UNION ALL ".join(f"SELECT '{tz}' AS zone, * FROM {local(shift)}" for tz, shift in ZONES.items())

    def run(spark, d):
        r = written(readings(spark, d).select("patient_id", "id", "ts", "sgv"))
        return reduce(DataFrame.unionByName, [f(r, tz).withColumn("zone", F.lit(tz)) for tz in ZONES])

    query(f"{name}_zones", sql, doubles)(run)


_by_zone("detect_patterns", profiles.detect_patterns, "mean_mgdl")
_by_zone("overnight_analysis", profiles.overnight_analysis, "flat_percent")
_by_zone("meal_period_tir", lambda r, tz: profiles.meal_period_tir(r, tz=tz), "")
_by_zone("agp_hourly", profiles.agp_hourly, "")


class Shared:
    """The tables that the parts of a report share, each read from its source once and written for all parts.

    Readings have the four or five columns that reports use; corrections have glucose before and after and their carbs;
    patients are one row each. What a part gives by patient is written too, so that the report's last join reads small
    tables only and no part runs twice.
    """

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.readings = written(readings(spark, d).select("patient_id", "id", "ts", "sgv", "direction"), "patient_id", "ts")
        self.treatments = written(cohort.treatments(spark, d), "patient_id", "ts")

    @cached_property
    def documents(self):
        columns = ("iob", "cob", "source", "state", "suggested_variable", "suggested_sens", "suggested_cob", "suggested_eventual", "openaps_iob")
        return cohort.documents(self.spark, self.d, columns=columns, state=("eventual_bg", "variable_sens", "carbs_required"))

    @cached_property
    def patients(self):
        return written(self.readings.select("patient_id").distinct())

    @cached_property
    def settings(self):
        return written(cohort.profile_settings(cohort.profiles(self.patients)))

    @cached_property
    def corrections(self):
        kept = outcomes.realized(outcomes.assessed_corrections(self.treatments, self.readings)).where("not carbs_near or not carbs_apart")
        return written(kept.select("patient_id", "id", "ts", "insulin", "pre_bg", "min_bg", "isf", "carbs_near", "carbs_apart"))

    @cached_property
    def effective(self):
        return written(outcomes.effective(self.corrections.where("not carbs_near"), devices.sensitivity(self.documents)))

    @cached_property
    def hourly(self):
        return written(profiles.hourly_mean(self.readings).select("patient_id", F.col("hour").alias("ts"), F.col("mean_mgdl").alias("value")))


def _summary(shared):
    r, t = shared.readings, shared.treatments
    hypo = episodes.hypo_report(written(episodes.hypo_episodes(r, t)), r)
    points = episodes.change_points(episodes.change_point_signal(shared.hourly, 0.25))
    return reports.clinic_summary(r, hypo, profiles.insulin_carb_summary(t), points, t.where("event_type = 'Profile Switch'"))


FINDINGS = {
    "time in range below 70 %": "tir_percent < 70", "time below 70 above 4 %": "tbr_lt70_percent > 4", "time below 54 above 1 %": "tbr_lt54_percent > 1", "time above 250 above 5 %": "tar_gt250_percent > 5",
    "variation above 36 %": "cv_percent > 36", "level 2 hypoglycemia": "level_2 > 0", "sensor active below 70 %": "pct_active < 70",
}


@query(
    "clinic_summary",
    f"""SELECT *, concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{text}' END" for text, c in FINDINGS.items())}) AS findings FROM (
  SELECT b.*, h.episodes, h.level_2, h.nocturnal, h.pct_active, coalesce(i.insulin_per_day, 0) AS insulin_per_day, coalesce(i.carbs_per_day, 0) AS carbs_per_day, coalesce(i.boluses_per_day, 0) AS boluses_per_day, coalesce(c.change_points, 0) AS change_points, coalesce(w.switches, 0) AS switches
  FROM ({g.per_patient(f"count(*) AS n, avg(sgv) AS mean_mgdl, {g.CV} AS cv_percent, 3.31 + 0.02392 * avg(sgv) AS gmi_percent, {g.share('sgv BETWEEN 70 AND 180')} AS tir_percent, {g.share('sgv < 70')} AS tbr_lt70_percent, {g.share('sgv < 54')} AS tbr_lt54_percent, {g.share('sgv > 180')} AS tar_gt180_percent, {g.share('sgv > 250')} AS tar_gt250_percent, {g.share('sgv BETWEEN 70 AND 140')} AS titr_percent, {g.GRI} AS gri")}) b
  LEFT JOIN ({inner('hypo_report')}) h USING (patient_id) LEFT JOIN ({inner('insulin_carb_summary')}) i USING (patient_id)
  LEFT JOIN (SELECT patient_id, count(*) AS change_points FROM ({inner('change_points_bg')}) GROUP BY 1) c USING (patient_id)
  LEFT JOIN (SELECT patient_id, count(*) AS switches FROM t WHERE event_type = 'Profile Switch' GROUP BY 1) w USING (patient_id))""",
    "mean_mgdl cv_percent gmi_percent tir_percent tbr_lt70_percent tbr_lt54_percent tar_gt180_percent tar_gt250_percent titr_percent gri pct_active insulin_per_day carbs_per_day boluses_per_day",
)
def clinic_summary(spark, d):
    return _summary(Shared(spark, d))


@query("clinic_packet")
def clinic_packet(spark, d):
    shared = Shared(spark, d)
    return reports.clinic_packet(written(_summary(shared)), shared.readings)


def _features(spark, d):
    x = Shared(spark, d)
    r, t = x.readings, x.treatments
    cr = outcomes.carb_ratio_check(outcomes.carb_ratio_samples(t, r), x.settings)
    parts = (
        written(profiles.current_glucose(r)), devices.iob_cob_latest(x.documents), devices.algorithm_state(x.documents), written(outcomes.isf_check(x.corrections.where("not carbs_apart"), x.settings)),
        written(outcomes.effective_isf_check(x.effective, x.patients)), written(outcomes.effective_isf_bands(x.effective, x.patients)), written(cr), written(profiles.detect_patterns(r)), episodes.compression_lows(episodes.compression_candidates(r, t)),
    )
    return reports.synthesis_features(r, *parts)


FEATURES = f"""
SELECT b.*, c.sgv, c.minutes_ago, l.iob, l.cob, st.carbs_required, st.eventual_bg, i.ratio AS isf_ratio, e.ratio AS effective_ratio, e.confidence AS effective_confidence, bt.ratio AS in_target_ratio, ba.ratio AS above_target_ratio, coalesce(ba.n, 0) AS above_target_n, cr.n AS cr_n, cr.verdict AS cr_verdict,
  coalesce(p1.occurrences, 0) AS overnight_lows, coalesce(p2.occurrences, 0) AS dawn_rises, coalesce(p3.occurrences, 0) AS spikes, y.yesterday_cv, coalesce(k.compression_lows, 0) AS compression_lows
FROM ({g.per_patient(f"{g.CV} AS cv_percent, {g.share('sgv < 54')} AS tbr_lt54_percent")}) b
LEFT JOIN ({inner('current_glucose')}) c USING (patient_id) LEFT JOIN ({inner('iob_cob_latest')}) l USING (patient_id)
LEFT JOIN (SELECT patient_id, CASE WHEN v > 190 THEN 12.0::DOUBLE END AS carbs_required, v + 50 AS eventual_bg FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, id DESC) AS n FROM ds WHERE has_suggested) WHERE n = 1) st USING (patient_id)
LEFT JOIN ({inner('isf_check')}) i USING (patient_id) LEFT JOIN ({inner('effective_isf_check')}) e USING (patient_id)
LEFT JOIN ({inner('effective_isf_bands')}) bt ON bt.patient_id = b.patient_id AND bt.band = 'in_target' LEFT JOIN ({inner('effective_isf_bands')}) ba ON ba.patient_id = b.patient_id AND ba.band = 'above_target'
LEFT JOIN ({inner('carb_ratio_check')}) cr ON cr.patient_id = b.patient_id
LEFT JOIN ({inner('detect_patterns')}) p1 ON p1.patient_id = b.patient_id AND p1.type = 'overnight_low' LEFT JOIN ({inner('detect_patterns')}) p2 ON p2.patient_id = b.patient_id AND p2.type = 'dawn_phenomenon' LEFT JOIN ({inner('detect_patterns')}) p3 ON p3.patient_id = b.patient_id AND p3.type = 'post_meal_spike'
LEFT JOIN (SELECT patient_id, CASE WHEN count(*) >= 10 THEN {g.CV} END AS yesterday_cv FROM r JOIN (SELECT patient_id, CAST(max(ts) AS DATE) - 1 AS day FROM r GROUP BY 1) q USING (patient_id) WHERE CAST(r.ts AS DATE) = q.day GROUP BY 1) y ON y.patient_id = b.patient_id
LEFT JOIN (SELECT patient_id, count(*) AS compression_lows FROM ({inner('compression_lows')}) GROUP BY 1) k ON k.patient_id = b.patient_id"""


@query("synthesis_features", FEATURES, "cv_percent tbr_lt54_percent iob cob carbs_required eventual_bg isf_ratio effective_ratio in_target_ratio above_target_ratio yesterday_cv")
def synthesis_features(spark, d):
    return _features(spark, d)


@query(
    "synthesis_alerts",
    f"""WITH f AS ({FEATURES})
SELECT patient_id, CAST(0 AS INT) AS rank, 'critical' AS severity, 'carbs_requested' AS category, carbs_required AS value FROM f WHERE carbs_required > 0
UNION ALL SELECT patient_id, 0, 'critical', 'severe_low_cluster', tbr_lt54_percent FROM f WHERE overnight_lows >= 3 AND tbr_lt54_percent > 1
UNION ALL SELECT patient_id, 1, 'warning', 'predicted_low', eventual_bg FROM f WHERE eventual_bg < 70 AND iob > 0""",
    "value",
)
def synthesis_alerts(spark, d):
    return reports.synthesis_alerts(_features(spark, d))


@query(
    "synthesis_insights",
    f"""WITH f AS ({FEATURES})
SELECT patient_id, 'profile_right_controller_strong' AS insight, effective_confidence AS confidence, effective_ratio AS value FROM f WHERE isf_ratio BETWEEN 0.85 AND 1.15 AND effective_ratio > 1.15 AND effective_confidence IN ('medium', 'high')
UNION ALL SELECT patient_id, 'curve_off_at_high_glucose', CASE WHEN above_target_n >= 10 THEN 'high' ELSE 'medium' END, above_target_ratio FROM f WHERE in_target_ratio BETWEEN 0.85 AND 1.15 AND above_target_ratio > 1.3 AND above_target_n >= 5
UNION ALL SELECT patient_id, 'yesterday_varied_more', 'medium', yesterday_cv FROM f WHERE cv_percent > 0 AND yesterday_cv - cv_percent >= 5
UNION ALL SELECT patient_id, 'carb_ratio_not_separable', 'high', cr_n FROM f WHERE cr_n > 0 AND cr_verdict = 'signals_disagree'
UNION ALL SELECT patient_id, 'frequent_spikes', 'high', spikes FROM f WHERE spikes >= 5""",
    "value",
)
def synthesis_insights(spark, d):
    return reports.synthesis_insights(_features(spark, d))


@query(
    "synthesis_questions",
    f"""WITH f AS ({FEATURES})
SELECT patient_id, CAST(0 AS INT) AS place, 'first_lever_for_severe_lows' AS question, tbr_lt54_percent AS value FROM f WHERE overnight_lows >= 3 AND tbr_lt54_percent > 1
UNION ALL SELECT patient_id, 1, 'lower_adjustment_factor', effective_ratio FROM f WHERE isf_ratio BETWEEN 0.85 AND 1.15 AND effective_ratio > 1.15 AND effective_confidence IN ('medium', 'high')
UNION ALL SELECT patient_id, 2, 'dampen_curve_at_high_glucose', above_target_ratio FROM f WHERE in_target_ratio BETWEEN 0.85 AND 1.15 AND above_target_ratio > 1.3 AND above_target_n >= 5
UNION ALL SELECT patient_id, 3, 'bolus_earlier_before_meals', least(spikes, 7) FROM f WHERE spikes >= 5""",
    "value",
)
def synthesis_questions(spark, d):
    return reports.synthesis_questions(_features(spark, d))


_ = (events, o, s)  # their SQL must be registered before this module's
