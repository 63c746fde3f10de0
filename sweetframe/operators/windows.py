"""Windows of whole days: limits of their length, and local midnights as their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fewest and most days that each report takes.
DAYS = {
    "detect_patterns": (1, 30), "isf_check": (1, 30), "carb_ratio_check": (1, 30), "effective_isf_check": (1, 30), "compression_lows": (1, 30), "daily_synthesis": (1, 30),
    "synthesis_patterns": (1, 7), "metrics": (1, 90), "hypo_episodes": (1, 90), "bolus_residuals": (1, 90), "change_points_bg": (7, 90), "dia_fit": (7, 90), "clinic_packet": (7, 90),
    "af_recommendation": (7, 90), "target_audit": (7, 90), "change_points_tdd": (14, 90), "settings_attribution": (14, 90), "attribution_side": (3, 14),
}


def clamped(days: int, report: str = "metrics") -> int:
    """days, within what the report takes."""
    least, most = DAYS[report]
    return max(least, min(days, most))


def zone(tz: Column) -> Column:
    """tz, or UTC where it is null or names no zone."""
    known = F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), tz)).isNotNull()
    return F.when(known, tz).otherwise("UTC")


def midnight(day: Column, tz: Column) -> Column:
    """The instant at which the local day begins, whatever the session's zone."""
    return F.try_to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00 "), zone(tz)))


def zoned(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """rows with the patient's zone as column tz; UTC for patients without one. settings: patient_id, tz."""
    got = rows.join(settings.select("patient_id", F.col("tz").alias("__tz")), "patient_id", "left")
    return got.select(*rows.columns, zone(F.col("__tz")).alias("tz"))


def last_days(rows: DataFrame, settings: DataFrame, days: int, report: str = "metrics") -> DataFrame:
    """Rows of the patient's last local days: that of the newest row and those before it.

    Only the newest time of each patient is aggregated; rows meet their patient's two edges in one join.
    """
    newest = zoned(rows.groupBy("patient_id").agg(F.max("ts").alias("newest")), settings)
    last = F.to_date(F.from_utc_timestamp("newest", F.col("tz")))
    edges = newest.select("patient_id", midnight(F.date_sub(last, clamped(days, report) - 1), F.col("tz")).alias("__from"), midnight(F.date_add(last, 1), F.col("tz")).alias("__to"))
    return rows.join(edges, "patient_id").where((F.col("ts") >= F.col("__from")) & (F.col("ts") < F.col("__to"))).select(*rows.columns)
