"""Profiles over the day and by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import local, micros, pct

#: Meal periods by local hour: [start, end), round midnight where start > end.
MEAL_PERIODS = (("overnight", 0, 6), ("breakfast", 6, 11), ("lunch", 11, 14), ("afternoon", 14, 17), ("dinner", 17, 21), ("evening", 21, 24))
PERCENTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def meal_period_tir(readings: DataFrame, periods=MEAL_PERIODS, tz: str = "UTC") -> DataFrame:
    """Time in range by meal period; periods may overlap and wrap, and those without readings are given with 0 rows."""
    hour = F.hour(local(F.col("ts"), tz))
    inside = lambda a, b: (hour >= a) & (hour < b) if a < b else (hour >= a) | (hour < b)
    own = F.explode(F.array_compact(F.array(*[F.when(inside(a, b), F.lit(name)) for name, a, b in periods])))
    v = F.col("sgv")
    got = readings.select("patient_id", "sgv", own.alias("period")).groupBy("patient_id", "period").agg(F.count("*").alias("n"), F.avg("sgv").alias("mean_mgdl"), pct(v.between(70, 180)).alias("tir_percent"), pct(v < 70).alias("tbr_percent"), pct(v > 180).alias("tar_percent"))
    every = readings.select("patient_id").distinct().withColumn("period", F.explode(F.array(*[F.lit(p[0]) for p in periods])))
    filled = every.join(got, ["patient_id", "period"], "left")
    return filled.select("patient_id", "period", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_mgdl", "tir_percent", "tbr_percent", "tar_percent")])


def agp_hourly(readings: DataFrame, tz: str = "UTC", approx: bool = False) -> DataFrame:
    """Percentiles by local hour, interpolated; all 24 hours. approx trades exactness for bounded memory."""
    cuts = list(PERCENTILES.values())
    of = F.percentile_approx("sgv", cuts, 10_000) if approx else F.percentile("sgv", F.array(*map(F.lit, cuts)))
    got = readings.groupBy("patient_id", F.hour(local(F.col("ts"), tz)).alias("hour")).agg(F.count("*").alias("n"), of.alias("p"))
    every = readings.select("patient_id").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    filled = every.join(got, ["patient_id", "hour"], "left")
    return filled.select("patient_id", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[F.try_element_at("p", F.lit(i + 1)).cast("double").alias(name) for i, name in enumerate(PERCENTILES)])


def agp_summary(readings: DataFrame, tz: str = "UTC") -> DataFrame:
    """Hours of the lowest and highest median; the first one on ties."""
    h = agp_hourly(readings, tz).where("n > 0")
    low, high = F.min(F.struct("p50", "hour")), F.max(F.struct("p50", -F.col("hour")))
    got = h.groupBy("patient_id").agg(low.alias("low"), high.alias("high"), F.sum("n").alias("n"))
    return got.select("patient_id", "n", F.col("low.hour").alias("lowest_hour"), F.col("low.p50").alias("lowest_p50"), (-F.col("high.col2")).alias("highest_hour"), F.col("high.p50").alias("highest_p50"))


def agp_markdown(readings: DataFrame, tz: str = "UTC") -> DataFrame:
    """A table with a bar for each hour: 40 places of 10 mg/dL, ``=`` from the 25th to the 75th percentile, ``*`` at the median."""
    place = lambda c: F.least(F.lit(39), F.greatest(F.lit(0), F.floor(F.col(c) / 10).cast("int")))
    from_, to, mid = place("p25"), place("p75"), place("p50")
    bar = F.concat(F.repeat(F.lit(" "), from_), F.repeat(F.lit("="), to - from_ + 1), F.repeat(F.lit(" "), 39 - to))
    bar = F.overlay(bar, F.lit("*"), mid + 1)
    number = lambda c: F.format_string("%4.0f", F.col(c))
    line = F.when(F.col("n") > 0, F.concat_ws(" | ", F.format_string("%02d", "hour"), F.format_string("%5d", "n"), *map(number, PERCENTILES), bar)).otherwise(F.format_string("%02d | no data", "hour"))
    lines = agp_hourly(readings, tz).groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct("hour", line.alias("line")))).alias("lines"), F.sum("n").alias("n"))
    head = F.lit("hour | n | p5 | p25 | p50 | p75 | p95 | profile")
    return lines.select("patient_id", F.concat_ws("\n", F.array(head), F.transform("lines", lambda x: x["line"])).alias("markdown"))


def hourly_mean(readings: DataFrame) -> DataFrame:
    return readings.groupBy("patient_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("sgv").alias("mean_mgdl"), F.count("*").alias("n"))


def daily_tdd(treatments: DataFrame) -> DataFrame:
    """Total insulin by day."""
    return treatments.where("insulin > 0").groupBy("patient_id", F.to_date("ts").alias("day")).agg(F.sum("insulin").alias("tdd"), F.count("*").alias("n"))


def daily_profiles(readings: DataFrame, tz: str | Column = "UTC") -> DataFrame:
    got = readings.groupBy("patient_id", F.to_date(local(F.col("ts"), tz)).alias("day")).agg(F.count("*").alias("n"), F.avg("sgv").alias("mean_mgdl"), pct(F.col("sgv").between(70, 180)).alias("tir_percent"), F.min("sgv").alias("nadir"))
    return got.withColumn("flag", F.when(F.col("nadir") < 54, "<54").when(F.col("nadir") < 70, "<70").otherwise(""))


def daily_report(readings: DataFrame, treatments: DataFrame, tz: str = "UTC") -> DataFrame:
    """Glucose and treatments by local day; notes in order of time."""
    day = lambda: F.to_date(local(F.col("ts"), tz)).alias("day")
    v = F.col("sgv")
    glucose = readings.groupBy("patient_id", day()).agg(F.count("*").alias("n"), F.avg("sgv").alias("mean_mgdl"), pct(v.between(70, 180)).alias("tir_percent"), pct(v < 70).alias("tbr_percent"))
    noted = (F.coalesce("notes", F.lit("")) != "") & ~F.coalesce("event_type", F.lit("")).isin("Profile Switch", "Temporary Override", "Temp Basal")
    notes = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(noted, F.struct("ts", "id", "notes")))), lambda x: x["notes"]), "; ")
    given = treatments.groupBy("patient_id", day()).agg(F.count("*").alias("n_treatments"), F.coalesce(F.sum("insulin"), F.lit(0.0)).alias("insulin"), F.coalesce(F.sum("carbs"), F.lit(0.0)).alias("carbs"), notes.alias("notes"))
    both = glucose.join(given, ["patient_id", "day"], "left")
    return both.select("patient_id", "day", "n", "mean_mgdl", "tir_percent", "tbr_percent", F.coalesce("n_treatments", F.lit(0)).cast("long").alias("n_treatments"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("insulin", "carbs")], F.coalesce("notes", F.lit("")).alias("notes"))


def insulin_carb_summary(treatments: DataFrame, days: int = 30) -> DataFrame:
    """Daily means over the window."""
    return treatments.groupBy("patient_id").agg(
        (F.coalesce(F.sum(F.when(F.col("insulin") > 0, F.col("insulin"))), F.lit(0.0)) / days).alias("insulin_per_day"),
        (F.coalesce(F.sum(F.when(F.col("carbs") > 0, F.col("carbs"))), F.lit(0.0)) / days).alias("carbs_per_day"),
        (F.sum(F.when(F.col("insulin") > 0, 1).otherwise(0)) / days).alias("boluses_per_day"),
    )


def overnight_analysis(readings: DataFrame, tz: str = "UTC") -> DataFrame:
    """Local 00:00 to 07:00 of each day: ends, drift, extremes, minutes below, dawn rise and share of flat steps."""
    at = local(F.col("ts"), tz)
    night = readings.withColumn("day", F.to_date(at)).withColumn("minute", F.hour(at) * 60 + F.minute(at)).where("minute < 420")
    w = Window.partitionBy("patient_id", "day").orderBy("ts", "id")
    night = night.withColumn("step", F.abs(F.col("sgv") - F.lag("sgv").over(w)))
    first, last = F.min(F.struct("ts", "id", "sgv"))["sgv"], F.max(F.struct("ts", "id", "sgv"))["sgv"]
    got = night.groupBy("patient_id", "day").agg(
        F.count("*").alias("n"), first.alias("start_mgdl"), last.alias("end_mgdl"), (last - first).alias("drift_mgdl"), F.min("sgv").alias("min_mgdl"), F.max("sgv").alias("max_mgdl"),
        (5 * F.sum(F.when(F.col("sgv") < 70, 1).otherwise(0))).alias("below_70_minutes"), (5 * F.sum(F.when(F.col("sgv") < 54, 1).otherwise(0))).alias("below_54_minutes"),
        F.coalesce(100.0 * F.sum(F.when(F.col("step") <= 5, 1).when(F.col("step") > 5, 0)) / F.count("step"), F.lit(0.0)).alias("flat_percent"),
    )
    return got.join(dawn_anchors(readings.where(F.hour(at) < 7), tz).select("patient_id", "day", "dawn_rise"), ["patient_id", "day"], "left")


def dawn_anchors(readings: DataFrame, tz: str = "UTC") -> DataFrame:
    """The readings nearest to 03:00 and 07:00 of each local day, within an hour; the earlier one on ties."""
    at = local(F.col("ts"), tz)
    rows = readings.withColumn("day", F.to_date(at)).withColumn("minute", F.hour(at) * 60 + F.minute(at))

    def anchor(hour: int):
        off = F.abs(F.col("minute") - 60 * hour)
        return F.min(F.when(off <= 60, F.struct(off.alias("off"), "ts", "id", "sgv")))["sgv"]

    got = rows.groupBy("patient_id", "day").agg(anchor(3).alias("at_3"), anchor(7).alias("at_7"))
    return got.withColumn("dawn_rise", F.col("at_7") - F.col("at_3"))


def detect_patterns(readings: DataFrame, tz: str = "UTC", dawn_rise: int = 30, spike: int = 50) -> DataFrame:
    """Overnight lows, dawn rises and rapid rises, at most one of each a day: counts, means and the first five days."""
    at = local(F.col("ts"), tz)
    rows = readings.withColumn("day", F.to_date(at)).withColumn("hour", F.hour(at))
    lows = rows.where("hour < 6 and sgv < 70").groupBy("patient_id", "day").agg(F.min(F.struct("ts", "id", "sgv"))["sgv"].alias("value")).withColumn("type", F.lit("overnight_low"))
    dawn = dawn_anchors(readings, tz).where(F.col("dawn_rise") > dawn_rise).select("patient_id", "day", F.col("dawn_rise").alias("value"), F.lit("dawn_phenomenon").alias("type"))
    w = Window.partitionBy("patient_id", "day").orderBy("ts", "id")
    rise = rows.withColumn("rise", F.lead("sgv", 6).over(w) - F.col("sgv")).where(F.col("rise") > spike)
    spikes = rise.groupBy("patient_id", "day").agg(F.min(F.struct("ts", "id", "rise"))["rise"].alias("value")).withColumn("type", F.lit("post_meal_spike"))
    every = lows.unionByName(dawn).unionByName(spikes)
    got = every.groupBy("patient_id", "type").agg(F.count("*").alias("occurrences"), F.avg("value").alias("mean_mgdl"), F.sort_array(F.collect_list("day")).alias("days"))
    return got.select("patient_id", "type", "occurrences", "mean_mgdl", F.array_join(F.transform(F.slice("days", 1, 5), lambda d: d.cast("string")), ",").alias("sample_days"))


def current_glucose(readings: DataFrame) -> DataFrame:
    """Each patient's newest reading, the change since the one before, and its age at the newest time of the table."""
    w = Window.partitionBy("patient_id").orderBy("ts", "id")
    newest = readings.agg(F.max("ts").alias("as_of"))
    last = readings.withColumn("delta", F.col("sgv") - F.lag("sgv").over(w)).groupBy("patient_id").agg(F.max(F.struct("ts", "id", "sgv", "delta", "direction")).alias("m"))
    aged = last.join(F.broadcast(newest))  # one row
    return aged.select("patient_id", "m.ts", "m.sgv", "m.delta", "m.direction", F.greatest(F.lit(0), F.floor((micros(F.col("as_of")) - micros(F.col("m.ts"))) / 60_000_000)).cast("long").alias("minutes_ago"))
