"""Comparisons of periods, and statistics over many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import micros, overlap, two_proportion_p
from sweetframe.operators import metrics
from sweetframe.operators.timejoin import interval_join

DAY = 86_400_000_000


def two_halves(readings: DataFrame, days: int = 14) -> DataFrame:
    """readings with a period: the last ``days`` of each patient are ``b``, those before ``a``; older rows go."""
    newest = F.max(micros(F.col("ts"))).over(Window.partitionBy("patient_id"))
    age = F.floor((newest - micros(F.col("ts"))) / (days * DAY))
    return readings.withColumn("__age", age).where("__age < 2").withColumn("period", F.when(F.col("__age") == 0, "b").otherwise("a")).drop("__age")


def _side_by_side(got: DataFrame, columns: list[str]) -> DataFrame:
    of = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{c}_{p}")
    return got.groupBy("patient_id").agg(*[of(c, p) for c in columns for p in ("a", "b")])


def compare_periods(readings: DataFrame, days: int = 14) -> DataFrame:
    """Means of both periods, their differences, and a sentence of those that matter."""
    got = metrics.glucose_stats(two_halves(readings, days), by=("patient_id", "period"))
    got = _side_by_side(got, ["n", "mean_mgdl", "tir_percent", "gmi_percent"])
    diff = {d: F.col(f"{c}_b") - F.col(f"{c}_a") for d, c in (("delta_mean", "mean_mgdl"), ("delta_tir", "tir_percent"), ("delta_gmi", "gmi_percent"))}
    got = got.withColumns(diff)
    parts = F.concat_ws(", ", F.when(F.col("delta_tir") > 1, "TIR up").when(F.col("delta_tir") < -1, "TIR down"), F.when(F.abs("delta_gmi") >= 0.05, F.when(F.col("delta_gmi") > 0, "GMI up").otherwise("GMI down")), F.when(F.abs("delta_mean") >= 5, F.when(F.col("delta_mean") > 0, "mean up").otherwise("mean down")))
    return got.withColumn("summary", F.when(parts == "", "similar").otherwise(parts))


def time_period_compare(readings: DataFrame, days: int = 14) -> DataFrame:
    """Period metrics side by side; do their intervals overlap?"""
    got = metrics.period_metrics(two_halves(readings, days), ("patient_id", "period"))
    names = [c for c in got.columns if c not in ("patient_id", "period")]
    got = _side_by_side(got, names)
    got = got.withColumns({f"delta_{c}": F.col(f"{c}_b") - F.col(f"{c}_a") for c in ("tir_percent", "tbr_lt54_percent", "gri", "mean_mgdl")})
    both = lambda m: overlap(*[F.col(f"{m}_ci_{e}_{p}") for p in ("a", "b") for e in ("lo", "hi")])
    return got.withColumn("tir_overlap", both("tir")).withColumn("tbr_lt54_overlap", both("tbr_lt54"))


def bh_fdr(rows: DataFrame, p: str = "p", by: tuple[str, ...] = ("patient_id",), tie: str = "id") -> DataFrame:
    """rows with p_adjusted, by the step-up procedure within each group."""
    order = Window.partitionBy(*by).orderBy(F.col(p), tie)
    raw = F.col(p) * F.count("*").over(Window.partitionBy(*by)) / F.row_number().over(order)
    ranked = rows.withColumn("__raw", raw)
    least = F.min("__raw").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), least)).drop("__raw")


def settings_attribution(switches: DataFrame, readings: DataFrame, side_days: int = 7, least: int = 50) -> DataFrame:
    """For each switch, the periods before and after: shares, differences, p of the change of time in range, adjusted."""
    at, reach = micros(F.col("ts")), side_days * DAY
    pairs = interval_join(switches, readings, lo=at - reach, hi=at + reach, columns=["ts", "sgv"], hi_open=True, bucket=DAY)
    before, v = F.col("r_ts") < F.col("ts"), F.col("r_sgv")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    gri = lambda s: F.greatest(F.lit(0.0), F.least(F.lit(100.0), (3.0 * count(s & (v < 54)) + 2.4 * count(s & v.between(54, 69)) + 1.6 * count(s & (v > 250)) + 0.8 * count(s & v.between(181, 250))) * 100 / count(s)))
    columns = {}
    for name, side in (("pre", before), ("post", ~before)):
        columns |= {f"n_{name}": count(side), f"in_{name}": count(side & v.between(70, 180)), f"low_{name}": count(side & (v < 54)), f"gri_{name}": F.when(count(side) > 0, gri(side))}
    got = pairs.groupBy("patient_id", "id", "ts").agg(*[c.alias(k) for k, c in columns.items()]).where((F.col("n_pre") >= least) & (F.col("n_post") >= least))
    share = lambda k, s: 100.0 * F.col(f"{k}_{s}") / F.col(f"n_{s}")
    got = got.withColumns({"tir_pre": share("in", "pre"), "tir_post": share("in", "post"), "tbr54_pre": share("low", "pre"), "tbr54_post": share("low", "post")})
    got = got.withColumns({"delta_tir": F.col("tir_post") - F.col("tir_pre"), "delta_tbr54": F.col("tbr54_post") - F.col("tbr54_pre"), "delta_gri": F.col("gri_post") - F.col("gri_pre")})
    got = bh_fdr(got.withColumn("p", two_proportion_p(F.col("in_pre"), F.col("n_pre"), F.col("in_post"), F.col("n_post"))))
    band = F.when(F.col("p_adjusted") < 0.10, "likely").when(F.col("p_adjusted") < 0.20, "possible").otherwise("none")
    return got.drop("in_pre", "in_post", "low_pre", "low_post").withColumn("evidence", band)
