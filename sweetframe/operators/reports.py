"""Decision tables and reports over the other operators' results: one wide row for each patient, rules as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import high_risk, low_risk, pct
from sweetframe.operators import metrics, profiles

# Consensus targets by population. low, high: the range; then limits in percent.
POPULATIONS = {
    "standard": {"low": 70, "high": 180, "tir_min": 70.0, "tbr_max": 4.0, "tbr54_max": 1.0, "tar_max": 25.0, "tar250_max": 5.0},
    "older_high_risk": {"low": 70, "high": 180, "tir_min": 50.0, "tbr_max": 1.0, "tbr54_max": 1.0, "tar_max": 50.0, "tar250_max": 10.0},
    "pregnancy_t1d": {"low": 63, "high": 140, "tir_min": 70.0, "tbr_max": 4.0, "tbr54_max": 1.0, "tar_max": 25.0, "tar250_max": None},
}


def _checks(p: dict) -> list[tuple[str, float | None, float | None, str, bool]]:
    """(metric, limit, borderline limit, the word beyond that, whether more is better)."""
    plus = lambda x, d: None if x is None else x + d
    return [
        ("tir", p["tir_min"], p["tir_min"] - 10, "over", True),
        ("tbr54", p["tbr54_max"], p["tbr54_max"] + 1, "severe", False),
        ("tbr", p["tbr_max"], p["tbr_max"] + 3, "over", False),
        ("tar", p["tar_max"], p["tar_max"] + 15, "over", False),
        ("tar250", p["tar250_max"], plus(p["tar250_max"], 5), "over", False),
        ("cv", 36.0, 42.0, "over", False),
        ("gmi", 7.0, 8.0, "over", False),
        ("lbgi", 2.5, 5.0, "severe", False),
        ("hbgi", 9.0, 15.0, "severe", False),
        ("gri", 50.0, 70.0, "over", False),
    ]


def target_table(spark) -> DataFrame:
    rows = [(name, p["low"], p["high"], *check) for name, p in POPULATIONS.items() for check in _checks(p) if check[1] is not None]
    return spark.createDataFrame(rows, "population string, low int, high int, metric string, limit double, borderline double, beyond string, more_is_better boolean")


def target_audit(readings: DataFrame, populations: tuple[str, ...] = tuple(POPULATIONS)) -> DataFrame:
    """Each check of each population: value, in target or not, direction, severity. The targets are a table of fixed size."""
    v = F.col("sgv")
    aggregates = []
    for name in populations:
        low, high = POPULATIONS[name]["low"], POPULATIONS[name]["high"]
        aggregates += [pct(v.between(low, high)).alias(f"{name}_tir"), pct(v < low).alias(f"{name}_tbr"), pct(v > high).alias(f"{name}_tar")]
    shared = [pct(v < 54).alias("tbr54"), pct(v > 250).alias("tar250"), F.avg(low_risk(v)).alias("lbgi"), F.avg(high_risk(v)).alias("hbgi")]
    base = readings.groupBy("patient_id").agg(*aggregates, *shared)
    stats = metrics.glucose_stats(readings).select("patient_id", F.col("cv_percent").alias("cv"), F.col("gmi_percent").alias("gmi"))
    wide = base.join(stats, "patient_id").join(metrics.glycemia_risk_index(readings).select("patient_id", "gri"), "patient_id")
    cells = [F.struct(F.lit(p).alias("population"), F.lit(m).alias("metric"), F.col(c).alias("value")) for p in populations for m, c in [*((m, f"{p}_{m}") for m in ("tir", "tbr", "tar")), *((m, m) for m in ("tbr54", "tar250", "lbgi", "hbgi", "cv", "gmi", "gri"))]]
    long = wide.select("patient_id", F.explode(F.array(*cells)).alias("x")).select("patient_id", "x.*")
    checked = long.join(F.broadcast(target_table(readings.sparkSession)), ["population", "metric"])
    more = F.col("more_is_better")
    good = F.when(more, F.col("value") >= F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    near = F.when(more, F.col("value") >= F.col("borderline")).otherwise(F.col("value") < F.col("borderline"))
    severity = F.when(good, "ok").when(near, "borderline").otherwise(F.col("beyond"))
    direction = F.when(more, F.when(good, "above_target").otherwise("below_target")).otherwise(F.when(good, "in_target").otherwise("above_target"))
    return checked.select("patient_id", "population", "metric", "value", "limit", good.alias("in_target"), direction.alias("direction"), severity.alias("severity"))


def target_audit_summary(audit: DataFrame) -> DataFrame:
    severe = F.array_join(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("severity") == "severe", F.col("metric"))))), ",")
    got = audit.groupBy("patient_id", "population").agg(F.sum(F.when(F.col("in_target"), 1).otherwise(0)).alias("passed"), F.sum(F.when(F.col("in_target"), 0).otherwise(1)).alias("failed"), severe.alias("severe"))
    headline = F.when(F.col("failed") == 0, "all targets met").when(F.col("severe") != "", F.concat(F.col("failed"), F.lit(" targets unmet, severe: "), F.col("severe"))).otherwise(F.concat(F.col("failed"), F.lit(" targets unmet, none severe")))
    return got.withColumn("headline", headline)


def clinic_summary(readings: DataFrame, hypo: DataFrame, insulin: DataFrame, change_points: DataFrame, switches: DataFrame) -> DataFrame:
    """Headline metrics of a clinic visit and the findings that they give rise to."""
    count = lambda rows, name: rows.groupBy("patient_id").agg(F.count("*").alias(name))
    stats = metrics.glucose_stats(readings).select("patient_id", "n", "mean_mgdl", "cv_percent", "gmi_percent", "tir_percent", "tbr_lt70_percent", "tbr_lt54_percent", "tar_gt180_percent", "tar_gt250_percent")
    tight = readings.groupBy("patient_id").agg(pct(F.col("sgv").between(70, 140)).alias("titr_percent"))
    out = stats.join(tight, "patient_id").join(metrics.glycemia_risk_index(readings).select("patient_id", "gri"), "patient_id")
    out = out.join(hypo.select("patient_id", "episodes", "level_2", "nocturnal", "pct_active"), "patient_id", "left").join(insulin, "patient_id", "left")
    out = out.join(count(change_points, "change_points"), "patient_id", "left").join(count(switches, "switches"), "patient_id", "left")
    out = out.fillna(0, ["change_points", "switches", "insulin_per_day", "carbs_per_day", "boluses_per_day"])
    rules = {
        "time in range below 70 %": F.col("tir_percent") < 70, "time below 70 above 4 %": F.col("tbr_lt70_percent") > 4, "time below 54 above 1 %": F.col("tbr_lt54_percent") > 1,
        "time above 250 above 5 %": F.col("tar_gt250_percent") > 5, "variation above 36 %": F.col("cv_percent") > 36, "level 2 hypoglycemia": F.col("level_2") > 0, "sensor active below 70 %": F.col("pct_active") < 70,
    }
    return out.withColumn("findings", F.concat_ws("; ", *[F.when(c, text) for text, c in rules.items()]))


def clinic_packet(summary: DataFrame, readings: DataFrame) -> DataFrame:
    """The summary with the hourly profile, days and meal periods as one Markdown text."""
    number = lambda c: F.format_string("%.1f", F.col(c).cast("double"))
    head = F.concat_ws("\n", F.lit("# Report"), F.concat(F.lit("- mean "), number("mean_mgdl"), F.lit(" mg/dL, GMI "), number("gmi_percent"), F.lit(" %, CV "), number("cv_percent"), F.lit(" %")), F.concat(F.lit("- in range "), number("tir_percent"), F.lit(" %, tight "), number("titr_percent"), F.lit(" %, GRI "), number("gri")), F.concat(F.lit("- findings: "), F.when(F.col("findings") == "", "none").otherwise(F.col("findings"))))
    lines = lambda rows, order, line: rows.groupBy("patient_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    days = lines(profiles.daily_profiles(readings), "day", F.concat_ws(" | ", F.col("day").cast("string"), F.col("n").cast("string"), number("mean_mgdl"), number("tir_percent"), F.col("flag"))).withColumnRenamed("text", "days")
    meals = lines(profiles.meal_period_tir(readings), "period", F.concat_ws(" | ", F.col("period"), F.col("n").cast("string"), number("tir_percent"))).withColumnRenamed("text", "meals")
    all_ = summary.join(profiles.agp_markdown(readings), "patient_id").join(days, "patient_id").join(meals, "patient_id")
    return all_.select("patient_id", F.concat_ws("\n\n", head, F.concat(F.lit("## Hours\n"), F.col("markdown")), F.concat(F.lit("## Days\n"), F.col("days")), F.concat(F.lit("## Meals\n"), F.col("meals"))).alias("markdown"))


def synthesis_features(readings: DataFrame, current: DataFrame, iob_cob: DataFrame, algorithm: DataFrame, isf: DataFrame, effective: DataFrame, bands: DataFrame, cr: DataFrame, patterns: DataFrame, compression: DataFrame) -> DataFrame:
    """One wide row for each patient: all that the daily rules read."""
    of_type = lambda kind: F.coalesce(F.max(F.when(F.col("type") == kind, F.col("occurrences"))), F.lit(0)).cast("long")
    counts = patterns.groupBy("patient_id").agg(of_type("overnight_low").alias("overnight_lows"), of_type("dawn_phenomenon").alias("dawn_rises"), of_type("post_meal_spike").alias("spikes"))
    of_band = lambda b, c: F.max(F.when(F.col("band") == b, F.col(c)))
    by_band = bands.groupBy("patient_id").agg(of_band("in_target", "ratio").alias("in_target_ratio"), of_band("above_target", "ratio").alias("above_target_ratio"), of_band("above_target", "n").alias("above_target_n"))
    day = F.to_date("ts")
    days = readings.groupBy("patient_id", day.alias("day")).agg(F.count("*").alias("n"), F.avg("sgv").alias("mean"), F.stddev_samp("sgv").alias("sd"))
    last = F.max("day").over(Window.partitionBy("patient_id"))  # over one row a day
    before = days.withColumn("last", last).where(F.col("day") == F.date_sub("last", 1))
    cv = before.select("patient_id", F.when(F.col("n") >= 10, 100 * F.coalesce("sd", F.lit(0.0)) / F.col("mean")).alias("yesterday_cv"))
    state = algorithm.groupBy("patient_id").agg(F.max(F.struct("ts", "id", "carbs_required", "eventual_bg")).alias("a")).select("patient_id", F.col("a.carbs_required").alias("carbs_required"), F.col("a.eventual_bg").alias("eventual_bg"))
    out = metrics.glucose_stats(readings).select("patient_id", "cv_percent", "tbr_lt54_percent")
    for part in (
        current.select("patient_id", "sgv", "minutes_ago"), iob_cob.select("patient_id", "iob", "cob"), state, isf.select("patient_id", F.col("ratio").alias("isf_ratio")),
        effective.select("patient_id", F.col("ratio").alias("effective_ratio"), F.col("confidence").alias("effective_confidence")), by_band, cr.select("patient_id", F.col("n").alias("cr_n"), F.col("verdict").alias("cr_verdict")),
        counts, cv, compression.groupBy("patient_id").agg(F.count("*").alias("compression_lows")),
    ):
        out = out.join(part, "patient_id", "left")
    return out.fillna(0, ["overnight_lows", "dawn_rises", "spikes", "compression_lows", "cr_n", "above_target_n"])


def _fired(features: DataFrame, rules: list[tuple[Column, list[Column]]], names: tuple[str, ...]) -> DataFrame:
    each = [F.when(condition, F.struct(*[c.alias(n) for n, c in zip(names, shown, strict=True)])) for condition, shown in rules]
    return features.select("patient_id", F.explode(F.array_compact(F.array(*each))).alias("r")).select("patient_id", "r.*")


def synthesis_alerts(features: DataFrame) -> DataFrame:
    """Alerts by severity: requested carbs, a predicted low, a cluster of severe lows."""
    c, lit = F.col, F.lit
    value = lambda x: F.coalesce(x, lit(0.0)).cast("double")
    rules = [
        (c("carbs_required") > 0, [lit(0), lit("critical"), lit("carbs_requested"), value(c("carbs_required"))]),
        ((c("overnight_lows") >= 3) & (c("tbr_lt54_percent") > 1.0), [lit(0), lit("critical"), lit("severe_low_cluster"), value(c("tbr_lt54_percent"))]),
        ((c("eventual_bg") < 70) & (c("iob") > 0), [lit(1), lit("warning"), lit("predicted_low"), value(c("eventual_bg"))]),
    ]
    return _fired(features, rules, ("rank", "severity", "category", "value"))


def synthesis_insights(features: DataFrame) -> DataFrame:
    """What several results say together."""
    c, lit = F.col, F.lit
    sure = lambda condition, yes, no: F.when(condition, yes).otherwise(no)
    rules = [
        (c("isf_ratio").between(0.85, 1.15) & (c("effective_ratio") > 1.15) & c("effective_confidence").isin("medium", "high"), [lit("profile_right_controller_strong"), c("effective_confidence"), c("effective_ratio")]),
        (c("in_target_ratio").between(0.85, 1.15) & (c("above_target_ratio") > 1.30) & (c("above_target_n") >= 5), [lit("curve_off_at_high_glucose"), sure(c("above_target_n") >= 10, "high", "medium"), c("above_target_ratio")]),
        ((c("cv_percent") > 0) & (c("yesterday_cv") - c("cv_percent") >= 5.0), [lit("yesterday_varied_more"), lit("medium"), c("yesterday_cv")]),
        ((c("cr_n") > 0) & (c("cr_verdict") == "signals_disagree"), [lit("carb_ratio_not_separable"), lit("high"), c("cr_n").cast("double")]),
        (c("spikes") >= 5, [lit("frequent_spikes"), lit("high"), c("spikes").cast("double")]),
    ]
    return _fired(features, rules, ("insight", "confidence", "value"))


def synthesis_questions(features: DataFrame, days_examined: int = 7) -> DataFrame:
    """What to ask the care team, in order of place; spikes count once a day examined."""
    c, lit = F.col, F.lit
    rules = [
        ((c("overnight_lows") >= 3) & (c("tbr_lt54_percent") > 1.0), [lit(0), lit("first_lever_for_severe_lows"), c("tbr_lt54_percent")]),
        (c("isf_ratio").between(0.85, 1.15) & (c("effective_ratio") > 1.15) & c("effective_confidence").isin("medium", "high"), [lit(1), lit("lower_adjustment_factor"), c("effective_ratio")]),
        (c("in_target_ratio").between(0.85, 1.15) & (c("above_target_ratio") > 1.30) & (c("above_target_n") >= 5), [lit(2), lit("dampen_curve_at_high_glucose"), c("above_target_ratio")]),
        (c("spikes") >= 5, [lit(3), lit("bolus_earlier_before_meals"), F.least(c("spikes"), lit(days_examined)).cast("double")]),
    ]
    return _fired(features, rules, ("place", "question", "value"))
