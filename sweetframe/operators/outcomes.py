"""Outcomes of boluses and meals: as-of and interval joins of treatments, readings and controller documents.

Times are compared in microseconds. Treatments are unique by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import bg_band, confidence, insulin_left, local, micros, mmol, target_band, time_band
from sweetframe.operators.timejoin import HOUR, MINUTE, asof_join, interval_agg, interval_anti, interval_flag, interval_join, nearest

DIA_GRID = tuple(3.0 + 0.5 * i for i in range(11))
PEAK_GRID = tuple(float(40 + 5 * i) for i in range(9))
OFFSETS_MIN = (30, 60, 120, 180, 240, 300)


def _at() -> Column:
    return micros(F.col("ts"))


def correction_boluses(treatments: DataFrame) -> DataFrame:
    """Insulin without carbs, given as a correction."""
    kind = F.col("event_type").contains("Correction") | (F.col("event_type") == "Bolus")
    return treatments.where((F.col("insulin") > 0) & (F.coalesce("carbs", F.lit(0.0)) <= 0) & kind)


def isolated_corrections(treatments: DataFrame, minutes: int = 60, same_time_counts: bool = False) -> DataFrame:
    """Correction boluses without carbs within ``minutes`` before or after.

    Unless same_time_counts, carbs of the very same time are taken as part of the bolus.
    """
    carbs = treatments.where("carbs > 0").select("patient_id", "ts")
    boluses = correction_boluses(treatments)
    reach = minutes * MINUTE
    if same_time_counts:
        return interval_anti(boluses, carbs, lo=_at() - reach, hi=_at() + reach)
    before = interval_anti(boluses, carbs, lo=_at() - reach, hi=_at(), hi_open=True)
    return interval_anti(before, carbs, lo=_at(), hi=_at() + reach, lo_open=True)


def asof_pre_bg(boluses: DataFrame, readings: DataFrame, tolerance_min: float | None = None) -> DataFrame:
    """boluses with pre_bg, the last reading at or before."""
    return asof_join(boluses, readings, name="pre", columns=["sgv"], tolerance_min=tolerance_min).withColumn("pre_bg", F.col("pre.sgv")).drop("pre")


def post_bolus_min(boluses: DataFrame, readings: DataFrame, dia_hours: float = 5.0, closed: bool = False) -> DataFrame:
    """boluses with min_bg, the least reading after (or from) the bolus up to the action time, at most 5 hours."""
    hi = _at() + int(min(dia_hours, 5.0) * HOUR)
    return interval_agg(boluses, readings, lo=_at(), hi=hi, columns=["sgv"], aggregates={"min_bg": F.min("r_sgv")}, lo_open=not closed)


def asof_sens_strict(boluses: DataFrame, sens: DataFrame, tolerance_min: float = 15) -> DataFrame:
    """boluses with sens_mmol: the last sensitivity strictly before the bolus, rows without one skipped."""
    got = asof_join(boluses, sens.where("sens_mmol is not null"), name="s", columns=["sens_mmol"], tolerance_min=tolerance_min, allow_exact=False)
    return got.withColumn("sens_mmol", F.col("s.sens_mmol")).drop("s")


def asof_devicestatus(boluses: DataFrame, sens: DataFrame, tolerance_min: float = 15) -> DataFrame:
    """boluses with iob, cob, eventual_bg and sens_mmol of the last document at or before; each may be null."""
    columns = ["sens_mmol", "iob", "cob", "eventual_bg"]
    got = asof_join(boluses, sens, name="s", columns=columns, tolerance_min=tolerance_min)
    return got.select("*", *[F.col(f"s.{c}").alias(c) for c in columns]).drop("s")


def realized(boluses: DataFrame) -> DataFrame:
    """Boluses with pre_bg and min_bg that brought glucose down, with isf, mg/dL by unit; only those in (0, 500]."""
    return boluses.withColumn("isf", (F.col("pre_bg") - F.col("min_bg")) / F.col("insulin")).where("isf > 0 and isf <= 500")


def assessed_corrections(treatments: DataFrame, readings: DataFrame, dia_hours: float = 5.0, minutes: int = 60) -> DataFrame:
    """All correction boluses with pre_bg, min_bg, and whether carbs lie within ``minutes``: carbs_near, at whatever time,
    and carbs_apart, not at the bolus's own. What both kinds of isolated corrections are taken from, in one pass."""
    carbs = treatments.where("carbs > 0").select("patient_id", "ts")
    near = {"carbs_near": F.count("r_ts") > 0, "carbs_apart": F.count(F.when(F.col("r_ts") != F.col("__row.ts"), 1)) > 0}
    reach = minutes * MINUTE
    b = interval_agg(correction_boluses(treatments), carbs, lo=_at() - reach, hi=_at() + reach, columns=["ts"], aggregates=near)
    return post_bolus_min(asof_pre_bg(b, readings), readings, dia_hours)


def isf_samples(treatments: DataFrame, readings: DataFrame, dia_hours: float = 5.0) -> DataFrame:
    """Realized sensitivity of each isolated correction."""
    return realized(post_bolus_min(asof_pre_bg(isolated_corrections(treatments), readings), readings, dia_hours))


def isf_check(samples: DataFrame, settings: DataFrame) -> DataFrame:
    """Mean realized sensitivity against the profile's."""
    got = samples.groupBy("patient_id").agg(F.count("*").alias("n"), F.avg("isf").alias("isf_mgdl"))
    got = settings.select("patient_id", "isf_mmol").join(got, "patient_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    derived = mmol(F.col("isf_mgdl"))
    return got.select("patient_id", "n", "isf_mgdl", derived.alias("derived_isf_mmol"), F.col("isf_mmol").alias("profile_isf_mmol"), (derived / F.col("isf_mmol")).alias("ratio"), confidence(F.col("n")).alias("confidence"))


def effective_isf_samples(treatments: DataFrame, readings: DataFrame, sens: DataFrame, dia_hours: float = 5.0) -> DataFrame:
    """Realized and the controller's sensitivity of each isolated correction with a drop; sens_mmol null if unmatched."""
    boluses = isolated_corrections(treatments, same_time_counts=True)
    return effective(realized(post_bolus_min(asof_pre_bg(boluses, readings), readings, dia_hours)), sens)


def effective(realized: DataFrame, sens: DataFrame) -> DataFrame:
    """Realized corrections with the controller's sensitivity just before, and their band."""
    got = asof_sens_strict(realized, sens)
    return got.withColumn("realized_mmol", mmol(F.col("isf"))).withColumn("band", target_band(F.col("pre_bg")))


def _bands(samples: DataFrame, by: list[str]) -> DataFrame:
    has = F.col("sens_mmol").isNotNull()
    got = samples.groupBy(*by).agg(
        F.sum(F.when(has, 1).otherwise(0)).alias("n"), F.sum(F.when(has, 0).otherwise(1)).alias("unmatched"),
        F.avg(F.when(has, F.col("sens_mmol"))).alias("effective_mmol"), F.avg(F.when(has, F.col("realized_mmol"))).alias("realized_mmol"),
    )
    return got.withColumn("ratio", F.col("realized_mmol") / F.col("effective_mmol"))


def effective_isf_bands(samples: DataFrame, patients: DataFrame) -> DataFrame:
    """By band of the glucose before, empty bands included."""
    every = patients.select("patient_id").distinct().withColumn("band", F.explode(F.array(*map(F.lit, ("below_target", "in_target", "above_target")))))
    got = every.join(_bands(samples, ["patient_id", "band"]), ["patient_id", "band"], "left")
    return got.select("patient_id", "band", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "unmatched")], "effective_mmol", "realized_mmol", "ratio")


def effective_isf_check(samples: DataFrame, patients: DataFrame) -> DataFrame:
    """Over all bands, with a verdict: a ratio within 15 % of one is calibrated."""
    got = patients.select("patient_id").distinct().join(_bands(samples, ["patient_id"]), "patient_id", "left")
    got = got.select("patient_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "unmatched")], "effective_mmol", "realized_mmol", "ratio")
    verdict = F.when(F.col("ratio").isNull(), "no_data").when(F.col("ratio") > 1.15, "over_dosing").when(F.col("ratio") < 0.85, "under_dosing").otherwise("calibrated")
    return got.withColumn("confidence", confidence(F.col("n"))).withColumn("verdict", verdict)


def carb_insulin_pairs(treatments: DataFrame, minutes: int = 10, least_carbs: float = 5.0) -> DataFrame:
    """Carb rows with the insulin of their own and of rows within ``minutes`` (not of the very same time)."""
    carbs = treatments.where(F.col("carbs") > least_carbs)
    insulin = treatments.where("insulin > 0").select("patient_id", "ts", "insulin")
    pairs = interval_join(carbs, insulin, lo=_at() - minutes * MINUTE, hi=_at() + minutes * MINUTE, columns=["ts", "insulin"]).where(F.col("r_ts") != F.col("ts"))
    near = pairs.groupBy(F.col("id").alias("__id")).agg(F.sum("r_insulin").alias("near"))
    got = carbs.join(near, F.col("id") == F.col("__id"), "left").drop("__id")
    total = F.coalesce(F.col("insulin"), F.lit(0.0)) + F.coalesce("near", F.lit(0.0))
    return got.withColumn("total_insulin", total).drop("near").where("total_insulin > 0")


def carb_ratio_samples(treatments: DataFrame, readings: DataFrame, hours: int = 4) -> DataFrame:
    """Applied carb ratio and the change of glucose ``hours`` after, of meals without a later one in between."""
    meals = carb_insulin_pairs(treatments)
    later = treatments.where("carbs > 5").select("patient_id", "ts")
    alone = interval_anti(meals, later, lo=_at(), hi=_at() + hours * HOUR, lo_open=True)
    pre = asof_pre_bg(alone, readings).where("pre_bg is not null")
    pairs = interval_join(pre, readings, lo=_at(), hi=_at() + hours * HOUR, columns=["ts", "id", "sgv"], lo_open=True)
    end = pairs.groupBy(F.col("id").alias("__id")).agg(F.max(F.struct("r_ts", "r_id", "r_sgv"))["r_sgv"].alias("end_bg"))
    got = pre.join(end, F.col("id") == F.col("__id")).drop("__id")
    return got.withColumn("cr", F.col("carbs") / F.col("total_insulin")).withColumn("residual", (F.col("end_bg") - F.col("pre_bg")).cast("double"))


def carb_ratio_check(samples: DataFrame, settings: DataFrame) -> DataFrame:
    """Two signals: the applied ratio against the profile's (10 %) and the mean residual (20 mg/dL)."""
    got = samples.groupBy("patient_id").agg(F.count("*").alias("n"), F.avg("cr").alias("derived_cr"), F.avg("residual").alias("mean_residual"))
    got = settings.select("patient_id", F.col("cr").alias("profile_cr")).join(got, "patient_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    got = got.withColumn("ratio", F.col("derived_cr") / F.col("profile_cr"))
    sign = lambda c, lo, hi: F.when(c, hi).otherwise(lo)
    cr = F.when(F.col("ratio") > 1.10, 1).when(F.col("ratio") < 0.90, -1).otherwise(0)
    left = F.when(F.col("mean_residual") >= 20, 1).when(F.col("mean_residual") <= -20, -1).otherwise(0)
    got = got.withColumn("cr_signal", cr).withColumn("residual_signal", left)
    a, b = F.col("cr_signal"), F.col("residual_signal")
    verdict = F.when(F.col("n") == 0, "no_data").when(F.col("ratio").isNull(), "no_profile").when((a == 0) & (b == 0), "stable").when(a == b, sign(a > 0, "too_low", "too_high")).when((a != 0) & (b != 0), "signals_disagree").otherwise("one_signal")
    return got.select("patient_id", "n", "derived_cr", "profile_cr", "ratio", "mean_residual", "cr_signal", "residual_signal", confidence(F.col("n")).alias("confidence"), verdict.alias("verdict"))


def bolus_events(treatments: DataFrame, readings: DataFrame, sens: DataFrame, dia_hours: float = 5.0, tz: str = "UTC") -> DataFrame:
    """Each manual bolus with glucose before, its least after, the controller's state, a meal flag and bands."""
    manual = (F.col("insulin") >= 0.3) & F.col("event_type").isin("Bolus", "Correction Bolus") & ~F.upper(F.coalesce("notes", F.lit(""))).contains("SMB")
    b = treatments.where(manual)
    b = interval_flag(b, treatments.where("carbs > 0").select("patient_id", "ts"), "meal", lo=_at() - HOUR, hi=_at() + HOUR)
    b = asof_pre_bg(b, readings, tolerance_min=15)
    b = post_bolus_min(b, readings, dia_hours, closed=True)
    b = asof_devicestatus(b, sens)
    drop = (F.col("pre_bg") - F.col("min_bg")).cast("double")
    b = b.withColumn("drop_mgdl", drop).withColumn("realized_isf", F.when(F.col("drop_mgdl") > 0, F.col("drop_mgdl") / F.col("insulin")))
    b = b.withColumn("effective_isf", F.col("sens_mmol") * 18.0)
    return b.select(
        "patient_id", "id", "ts", "insulin", "pre_bg", "min_bg", "drop_mgdl", "realized_isf", "effective_isf", "iob", "cob", "eventual_bg", "meal", bg_band(F.col("pre_bg")).alias("bg_band"), time_band(F.hour(local(F.col("ts"), tz))).alias("time_band")
    )


def bolus_bands(events: DataFrame, band: str) -> DataFrame:
    """Means by band; the ratio is one of means over events with both sensitivities."""
    both = F.col("realized_isf").isNotNull() & F.col("effective_isf").isNotNull()
    got = events.where(F.col(band).isNotNull()).groupBy("patient_id", F.col(band).alias("band")).agg(
        F.count("*").alias("n"), F.avg("insulin").alias("mean_insulin"), F.avg("pre_bg").alias("mean_pre_bg"), F.avg(F.when(F.col("drop_mgdl") != 0, F.col("drop_mgdl"))).alias("mean_drop"),
        F.sum(F.when(both, 1).otherwise(0)).alias("matched"), F.avg(F.when(both, F.col("effective_isf"))).alias("mean_effective"), F.avg(F.when(both, F.col("realized_isf"))).alias("mean_realized"),
    )
    return got.withColumn("ratio", F.coalesce(F.col("mean_realized") / F.col("mean_effective"), F.lit(0.0)))


def _first_band(names: tuple[str, ...], least: int) -> Column:
    """The ratio of the first of the named bands that exists; null if that has too few events."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("band"))
    pick = F.min(F.when(F.col("band").isin(*names), F.struct(place.alias("place"), "n", "ratio")))
    return F.when(pick["n"] >= least, pick["ratio"])


def bolus_residuals(events: DataFrame, least: int = 1) -> DataFrame:
    """The mean ratio of realized to effective sensitivity, that of two bands, and a verdict."""
    both = F.col("realized_isf").isNotNull() & F.col("effective_isf").isNotNull()
    all_ = events.groupBy("patient_id").agg(F.count("*").alias("n"), F.sum(F.when(both, 1).otherwise(0)).alias("matched"), F.coalesce(F.avg(F.when(both, F.col("realized_isf") / F.col("effective_isf"))), F.lit(0.0)).alias("overall_ratio"))
    bands = bolus_bands(events, "bg_band").groupBy("patient_id").agg(_first_band(("100_140", "140_180"), least).alias("in_target_ratio"), _first_band(("180_250", "over_250"), least).alias("above_target_ratio"))
    got = all_.join(bands, "patient_id", "left")
    r, curve = F.col("overall_ratio"), (F.col("above_target_ratio") > 1.3) & F.col("in_target_ratio").between(0.85, 1.15)
    verdict = F.when(r == 0, "no_data").when(r.between(0.85, 1.15), "calibrated").when((r > 1.15) & curve, "over_dosing_above_target").when(r > 1.15, "over_dosing").otherwise("under_dosing")
    return got.withColumn("verdict", verdict)


def af_recommendation(events: DataFrame, current_af: int = 100) -> DataFrame:
    """What to discuss about the adjustment factor; from 20 matched boluses on, and with bands of at least 3."""
    got = bolus_residuals(events, least=3)
    n, r, af = F.col("matched"), F.col("overall_ratio"), F.lit(current_af)
    curve = F.coalesce((F.col("above_target_ratio") > 1.3) & F.col("in_target_ratio").between(0.85, 1.25), F.lit(False))
    kind = F.when(n < 20, "insufficient_data").when(r.between(0.85, 1.15), "hold").when((r > 1.15) & curve, "dampen_curve").when(r > 1.15, "lower_af").otherwise("raise_af")
    got = got.withColumn("recommendation", kind)
    k = F.col("recommendation")
    new = F.when(k == "hold", af).when((k == "dampen_curve") & (af <= 25), af).when(k.isin("dampen_curve", "lower_af"), F.greatest(F.lit(20), af - 5)).when(k == "raise_af", F.least(F.lit(100), af + 5))
    sure = F.when(k == "insufficient_data", "low").when((k == "hold") & (n >= 30), "high").when((k == "dampen_curve") & (n >= 40), "high").otherwise("medium")
    return got.select("patient_id", F.lit(current_af).alias("current_af"), new.alias("recommended_af"), "recommendation", "overall_ratio", "in_target_ratio", "above_target_ratio", sure.alias("confidence"), n.alias("matched"))


def meals(treatments: DataFrame) -> DataFrame:
    """Treatments with carbs, or of a kind that stands for a meal."""
    return treatments.where((F.col("carbs") > 0) | F.col("event_type").isin("Carb Correction", "Meal Bolus", "Snack Bolus"))


def meal_analysis(treatments: DataFrame, readings: DataFrame, hours: int = 4, low: int = 70, high: int = 180) -> DataFrame:
    """Each meal: glucose before, peak, time to it, rise, end and notes; without readings after, the value before stands in."""
    return _responses(meals(treatments), readings, ["carbs", "insulin"], hours, low, high)


def meal_at(times: DataFrame, treatments: DataFrame, readings: DataFrame, hours: int = 4, minutes: int = 30, low: int = 70, high: int = 180) -> DataFrame:
    """The response after each of times (patient_id, id, ts), with the meal logged up to ``minutes`` before or less after.

    That is the nearest meal, then the earliest, then the one of least id; null where there is none.
    """
    found = nearest(times.select("patient_id", "id", "ts"), meals(treatments), at=_at(), within=minutes * MINUTE, columns=["id", "carbs", "insulin"], hi_open=True)
    named = found.drop("r_ts").withColumnsRenamed({"r_id": "meal_id", "r_carbs": "carbs", "r_insulin": "insulin"})
    return _responses(named, readings, ["meal_id", "carbs", "insulin"], hours, low, high)


def _responses(rows: DataFrame, readings: DataFrame, keep: list[str], hours: int, low: int, high: int) -> DataFrame:
    pre = asof_pre_bg(rows, readings)
    pairs = interval_join(pre, readings, lo=_at(), hi=_at() + hours * HOUR, columns=["ts", "id", "sgv"], lo_open=True)
    # the first of equal peaks: the largest value, then the least time
    after = pairs.groupBy(F.col("patient_id").alias("__by"), F.col("id").alias("__id")).agg(F.max(F.struct("r_sgv", (-micros(F.col("r_ts"))).alias("back"))).alias("peak"), F.max(F.struct("r_ts", "r_id", "r_sgv"))["r_sgv"].alias("end"))
    got = pre.join(after, (F.col("patient_id") == F.col("__by")) & (F.col("id") == F.col("__id")), "left")
    peak, end = F.coalesce(F.col("peak.r_sgv"), F.col("pre_bg"), F.lit(0)), F.coalesce("end", "pre_bg", F.lit(0))
    got = got.withColumn("peak_mgdl", peak).withColumn("end_mgdl", end).withColumn("rise_mgdl", F.when(F.col("peak").isNull(), 0).otherwise(F.col("peak_mgdl") - F.coalesce("pre_bg", F.col("peak_mgdl"))))
    minutes = F.when(F.col("peak").isNull(), 0).otherwise(F.floor((-F.col("peak.back") - _at()) / MINUTE)).cast("long")
    has = F.col("peak").isNotNull()
    notes = F.array_join(F.array_compact(F.array(F.when(~has, "no readings after"), F.when(has & (F.col("rise_mgdl") > 80), "large rise"), F.when(has & (F.col("peak_mgdl") > 250), "peak above 250"), F.when(has & (F.col("end_mgdl") < low), "ended low"), F.when(has & (F.col("pre_bg") < low), "started low"))), "; ")
    return got.select("patient_id", "id", "ts", *keep, "pre_bg", "peak_mgdl", minutes.alias("minutes_to_peak"), "rise_mgdl", "end_mgdl", (has & F.col("end_mgdl").between(low, high)).alias("in_range_at_end"), notes.alias("notes"))


def nearest_reading(times: DataFrame, readings: DataFrame, minutes: int = 15) -> DataFrame:
    """times (patient_id, id, ts) with the reading nearest to each; the signed difference in whole minutes."""
    got = nearest(times, readings, at=_at(), within=minutes * MINUTE, columns=["sgv"], hi_open=True)
    return got.select(*times.columns, F.col("r_sgv").alias("sgv"), F.floor((micros(F.col("r_ts")) - _at()) / MINUTE).cast("long").alias("minutes_off"))


def iob_observations(treatments: DataFrame, readings: DataFrame) -> DataFrame:
    """The share of a correction's total drop still to come at 30 to 300 minutes; boluses with a drop above 5 only."""
    plain = treatments.where((F.col("insulin") > 0) & F.col("event_type").isin("Correction Bolus", "Bolus"))
    carbs = treatments.where("carbs > 0").select("patient_id", "ts")
    alone = asof_pre_bg(interval_anti(plain, carbs, lo=_at() - HOUR, hi=_at() + HOUR), readings, tolerance_min=15).where("pre_bg is not null")
    probes = alone.select("patient_id", "id", "ts", "pre_bg", F.explode(F.array(*map(F.lit, OFFSETS_MIN))).alias("minutes")).withColumn("probe", F.concat_ws(":", "id", "minutes"))
    got = nearest(probes, readings, at=_at() + F.col("minutes").cast("long") * MINUTE, within=int(7.5 * MINUTE), columns=["sgv"]).where("r_sgv is not null")
    w = Window.partitionBy("id")
    end = F.max(F.when(F.col("minutes") == 300, F.col("r_sgv"))).over(w)
    start = F.max(F.when(F.col("minutes") == 30, 1)).over(w)
    got = got.withColumn("total", F.col("pre_bg") - end).withColumn("has_30", start).where("total > 5 and has_30 = 1")
    left = 1 - (F.col("pre_bg") - F.col("r_sgv")) / F.col("total")
    return got.select("patient_id", "id", "minutes", F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("fraction"))


def dia_fit(observations: DataFrame, dias: tuple[float, ...] = DIA_GRID, peaks: tuple[float, ...] = PEAK_GRID, least: int = 30) -> DataFrame:
    """The action time and peak of least root mean square error on a fixed grid; the least ones on ties.

    Observations of one minute and patient are summed first, so that the grid meets one row for each offset.
    """
    moments = observations.groupBy("patient_id", "minutes").agg(F.count("*").alias("n"), F.sum("fraction").alias("s"), F.sum(F.col("fraction") * F.col("fraction")).alias("q"))
    grid = F.explode(F.array(*[F.struct(F.lit(d).alias("dia"), F.lit(p).alias("peak")) for d in dias for p in peaks if p < d * 30]))
    each = moments.withColumn("g", grid).withColumn("f", insulin_left(F.col("minutes").cast("double"), F.col("g.dia"), F.col("g.peak")))
    sse = F.sum(F.col("q") - 2 * F.col("f") * F.col("s") + F.col("n") * F.col("f") * F.col("f"))
    # rounded before comparing, so that the order of summing can't turn a tie
    fit = each.groupBy("patient_id", "g.dia", "g.peak").agg(F.round(F.sqrt(F.greatest(F.lit(0.0), sse) / F.sum("n")), 9).alias("rmse"), F.sum("n").alias("n"))
    best = fit.groupBy("patient_id").agg(F.min(F.struct("rmse", "dia", "peak", "n")).alias("b"))
    return best.select("patient_id", F.col("b.dia").alias("dia_hours"), F.col("b.peak").alias("peak_min"), "b.rmse", "b.n", (F.col("b.n") >= least).alias("reliable"))


def iob_curve(dias: DataFrame) -> DataFrame:
    """(minutes, dia_hours, peak_min) rows with the share of insulin left."""
    return dias.withColumn("left", insulin_left(F.col("minutes").cast("double"), F.col("dia_hours"), F.col("peak_min")))
