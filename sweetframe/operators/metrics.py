"""Glucose metrics by patient: one pass of conditional aggregates each.

All take valid readings (``valid``) and give one row for each value of ``by``; rounding is left to reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import high_risk, local, low_risk, micros, pct, wilson
from sweetframe.operators import trace


def valid(readings: DataFrame) -> DataFrame:
    """Sensor readings: zeros stand for errors, rows without a time can't be placed."""
    return readings.where("type = 'sgv' and sgv > 0 and ts is not null")


def dedup(readings: DataFrame) -> DataFrame:
    """One row for each patient and id, or time where the id is missing."""
    return readings.withColumn("__key", F.coalesce("id", F.col("ts").cast("string"))).dropDuplicates(["patient_id", "__key"]).drop("__key")


def window_of(readings: DataFrame, days: float, by: str = "patient_id") -> DataFrame:
    """Rows of the last ``days`` before each patient's newest row, that row included."""
    newest = F.max("ts").over(Window.partitionBy(by))
    return readings.withColumn("__new", newest).where(micros(F.col("ts")) >= micros(F.col("__new")) - int(days * 86_400_000_000)).drop("__new")


def _cv() -> Column:
    mean = F.avg("sgv")
    return F.when(mean > 0, 100 * F.coalesce(F.stddev_samp("sgv"), F.lit(0.0)) / mean).otherwise(0.0)


def _sd() -> Column:
    return F.coalesce(F.stddev_samp("sgv"), F.lit(0.0))


def gmi(mean: Column) -> Column:
    return 3.31 + 0.02392 * mean


def _gri() -> dict[str, Column]:
    v = F.col("sgv")
    hypo = 3.0 * pct(v < 54) + 2.4 * pct((v >= 54) & (v < 70))
    hyper = 1.6 * pct(v > 250) + 0.8 * pct((v > 180) & (v <= 250))
    return {"gri": F.greatest(F.lit(0.0), F.least(F.lit(100.0), hypo + hyper)), "hypo_component": hypo, "hyper_component": hyper}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


def glucose_stats(readings: DataFrame, by: tuple[str, ...] = ("patient_id",), low: int = 70, high: int = 180) -> DataFrame:
    v, mean = F.col("sgv"), F.avg("sgv")
    hours = (micros(F.max("ts")) - micros(F.min("ts"))) / 3.6e9
    return readings.groupBy(*by).agg(*_named({
        "n": F.count("*"), "mean_mgdl": mean, "sd_mgdl": _sd(), "cv_percent": _cv(), "gmi_percent": gmi(mean),
        "tir_percent": pct(v.between(low, high)), "tbr_lt70_percent": pct(v < 70), "tbr_lt54_percent": pct(v < 54), "tar_gt180_percent": pct(v > 180), "tar_gt250_percent": pct(v > 250),
        "gmi_reliable": hours >= 336,
    }))


def glycemia_risk_index(readings: DataFrame, by: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    v = F.col("sgv")
    shares = {"pct_lt54": pct(v < 54), "pct_54_69": pct((v >= 54) & (v < 70)), "pct_181_250": pct((v > 180) & (v <= 250)), "pct_gt250": pct(v > 250)}
    return readings.groupBy(*by).agg(F.count("*").alias("n"), *_named(_gri() | shares))


def bg_risk_indices(readings: DataFrame, by: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    v = F.col("sgv")
    risks = readings.groupBy(*by).agg(F.count("*").alias("n"), F.avg(low_risk(v)).alias("lbgi"), F.avg(high_risk(v)).alias("hbgi"))
    low = F.when(F.col("lbgi") < 1.1, "minimal").when(F.col("lbgi") < 2.5, "low").when(F.col("lbgi") < 5.0, "moderate").otherwise("high")
    high = F.when(F.col("hbgi") < 4.5, "minimal").when(F.col("hbgi") < 9.0, "low").when(F.col("hbgi") < 15.0, "moderate").otherwise("high")
    return risks.withColumn("lbgi_band", low).withColumn("hbgi_band", high)


def adrr(readings: DataFrame, tz: str = "UTC") -> DataFrame:
    """Average daily risk range: the day's largest low and high risk, summed, over days."""
    days = readings.groupBy("patient_id", F.to_date(local(F.col("ts"), tz)).alias("day")).agg((F.max(low_risk(F.col("sgv"))) + F.max(high_risk(F.col("sgv")))).alias("range"))
    return days.groupBy("patient_id").agg(F.avg("range").alias("adrr"), F.count("*").alias("days"))


def cv_percent(readings: DataFrame) -> DataFrame:
    return readings.groupBy("patient_id").agg(_cv().alias("cv_percent"))


def j_index(readings: DataFrame) -> DataFrame:
    return readings.groupBy("patient_id").agg((0.001 * F.pow(F.avg("sgv") + _sd(), F.lit(2))).alias("j_index"))


def m_value(readings: DataFrame, target: float = 120.0) -> DataFrame:
    return readings.groupBy("patient_id").agg(F.avg(F.pow(F.abs(10 * F.log10(F.col("sgv") / target)), F.lit(3))).alias("m_value"))


def _cogi(tir: Column, tbr: Column, cv: Column) -> Column:
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return 0.5 * held(tir) + 0.35 * held((1 - tbr / 15) * 100) + 0.15 * held((1 - (cv - 36) / 72) * 100)


def cogi(readings: DataFrame) -> DataFrame:
    v = F.col("sgv")
    return readings.groupBy("patient_id").agg(_cogi(pct(v.between(70, 180)), pct(v < 70), _cv()).alias("cogi"))


def one_pass(readings: DataFrame) -> DataFrame:
    """(patient_id, n, sd, cv_percent, j_index, m_value, cogi): what needs neither order nor earlier values, in one pass."""
    v = F.col("sgv")
    return readings.groupBy("patient_id").agg(*_named({
        "n": F.count("*"), "sd": F.stddev_samp("sgv"), "cv_percent": _cv(), "j_index": 0.001 * F.pow(F.avg("sgv") + _sd(), F.lit(2)),
        "m_value": F.avg(F.pow(F.abs(10 * F.log10(v / 120.0)), F.lit(3))), "cogi": _cogi(pct(v.between(70, 180)), pct(v < 70), _cv()),
    }))


def tir_with_ci(readings: DataFrame) -> DataFrame:
    """Shares of five bands and of all below and above, each with its Wilson interval."""
    v, n = F.col("sgv"), F.count("*")
    bands = {"lt54": v < 54, "54_69": (v >= 54) & (v < 70), "70_180": v.between(70, 180), "181_250": (v > 180) & (v <= 250), "gt250": v > 250, "lt70": v < 70, "gt180": v > 180}
    columns = {}
    for name, condition in bands.items():
        k = F.sum(F.when(condition, 1).otherwise(0))
        lo, hi = wilson(k, n)
        columns |= {f"pct_{name}": pct(condition), f"ci_lo_{name}": lo, f"ci_hi_{name}": hi}
    return readings.groupBy("patient_id").agg(n.alias("n"), *_named(columns), ((_cv() <= 36) & (_cv() > 0)).alias("cv_stable"))


def period_metrics(readings: DataFrame, by: tuple[str, ...]) -> DataFrame:
    v, n = F.col("sgv"), F.count("*")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    tir_lo, tir_hi = wilson(count(v.between(70, 180)), n)
    low_lo, low_hi = wilson(count(v < 54), n)
    return readings.groupBy(*by).agg(*_named({
        "n": n, "mean_mgdl": F.avg("sgv"), "tir_percent": pct(v.between(70, 180)), "tir_ci_lo": tir_lo, "tir_ci_hi": tir_hi, "tbr_lt54_percent": pct(v < 54), "tbr_lt54_ci_lo": low_lo, "tbr_lt54_ci_hi": low_hi,
        "tbr_percent": pct(v < 70), "tar_percent": pct(v > 180), "gri": _gri()["gri"], "lbgi": F.avg(low_risk(v)), "hbgi": F.avg(high_risk(v)), "cv_percent": _cv(), "gmi_percent": gmi(F.avg("sgv")),
    }))


def data_sufficiency(readings: DataFrame, days: int = 30) -> DataFrame:
    """Share of the expected 5-minute readings, the longest gap, and whether they suffice for a report."""
    expected = 288 * max(1, days)
    got = readings.groupBy("patient_id").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days_with_data")).join(longest_gap(readings), "patient_id")
    active = F.least(F.lit(100.0), 100.0 * F.col("n") / expected)
    got = got.withColumn("expected", F.lit(expected)).withColumn("pct_active", active).withColumn("meets_consensus", (F.lit(days) >= 14) & (F.col("pct_active") >= 70))
    note = F.when(F.col("meets_consensus"), "sufficient").otherwise(F.concat_ws("; ", F.when(F.lit(days) < 14, "fewer than 14 days"), F.when(F.col("pct_active") < 70, "less than 70 % active")))
    return got.withColumn("note", note)


def longest_gap(readings: DataFrame) -> DataFrame:
    gap = {"max_gap": micros(F.col("b.ts")) - micros(F.col("a.ts"))}
    return trace.steps(readings, gap, order=("ts",)).select("patient_id", (F.coalesce("max_gap", F.lit(0)) / 3.6e9).alias("longest_gap_hours"))


def sensor_gaps(readings: DataFrame, minutes: int = 15) -> DataFrame:
    """(patient_id, last, next, minutes) of each time without a reading for more than ``minutes``; of the last one next is null.

    The column ``minutes`` has whole minutes.
    """
    near = trace.beside(readings.select("patient_id", "ts", "id"), ["ts"])
    silence = micros(F.col("after.ts")) - micros(F.col("ts"))
    long = F.col("after").isNull() | (silence > minutes * 60_000_000)
    return near.where(long).select("patient_id", F.col("ts").alias("last"), F.col("after.ts").alias("next"), F.floor(silence / 60_000_000).cast("long").alias("minutes"))
