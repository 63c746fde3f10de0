"""Queries on local time, profile documents of all shapes and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweetframe.functions import scalars
from sweetframe.operators import profiles, windows
from sweetframe.plans._base import query, readings
from sweetframe.plans.glucose import share
from sweetframe.sources import cohort

#: Readings with the zone that settings name, and the local time in the zone that counts.
ZONED = """(SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE zone AS clock FROM (
  SELECT *, CASE patient_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Kolkata' ELSE 'UTC' END AS zone FROM r))"""


def _zones(rows):
    """A zone for each patient; every third one's is no zone."""
    k = F.col("patient_id") % 3
    return rows.select("patient_id").distinct().withColumn("tz", F.when(k == 0, "America/New_York").when(k == 1, "Asia/Kolkata").otherwise("Not/AZone"))


@query(
    "local_midnights",
    f"""SELECT patient_id, CAST(day AS VARCHAR) AS day, (CAST(day AS TIMESTAMP) AT TIME ZONE zone) AT TIME ZONE 'UTC' AS starts, (CAST(day + 1 AS TIMESTAMP) AT TIME ZONE zone) AT TIME ZONE 'UTC' AS ends, n
      FROM (SELECT patient_id, zone, CAST(clock AS DATE) AS day, count(*) AS n FROM {ZONED} GROUP BY ALL)""",
)
def local_midnights(spark, d):
    """Each local day with readings, and the instants at which it begins and ends."""
    r = readings(spark, d)
    days = windows.zoned(r, _zones(r)).groupBy("patient_id", "tz", F.to_date(scalars.local(F.col("ts"), F.col("tz"))).alias("day")).agg(F.count("*").alias("n"))
    edge = lambda day: windows.midnight(day, F.col("tz"))
    return days.select("patient_id", "day", edge(F.col("day")).alias("starts"), edge(F.date_add("day", 1)).alias("ends"), "n")


@query(
    "daily_profiles_local",
    f"""SELECT patient_id, CAST(day AS VARCHAR) AS day, count(*) AS n, avg(sgv) AS mean_mgdl, {share('sgv BETWEEN 70 AND 180')} AS tir_percent, min(sgv) AS nadir, CASE WHEN min(sgv) < 54 THEN '<54' WHEN min(sgv) < 70 THEN '<70' ELSE '' END AS flag
      FROM (SELECT *, CAST(clock AS DATE) AS day, max(CAST(clock AS DATE)) OVER (PARTITION BY patient_id) AS last FROM {ZONED}) WHERE day > last - 7 GROUP BY patient_id, day""",
    "mean_mgdl tir_percent",
)
def daily_profiles_local(spark, d):
    """The last seven local days of each patient."""
    r = readings(spark, d)
    zones = _zones(r)
    return profiles.daily_profiles(windows.zoned(windows.last_days(r, zones, 7), zones), F.col("tz"))


#: What the profile documents of customers hold, by the key modulo 6.
PROFILES = """(SELECT c_custkey AS patient_id, c_custkey % 6 AS k, 40 + c_custkey % 50 AS sens, 5 + c_custkey % 9 AS cr FROM customer)"""


@query(
    "profile_settings_mixed",
    f"""SELECT patient_id, CASE WHEN k IN (0, 1, 4) THEN 4.0::DOUBLE ELSE 5.0 END AS dia_hours, CASE k WHEN 0 THEN sens / 10.0 WHEN 1 THEN round(sens / 18.0, 1) END AS isf_mmol, CASE WHEN k IN (0, 1) THEN cr::DOUBLE END AS cr,
      CASE k WHEN 1 THEN 'mg/dL' ELSE 'mmol/L' END AS units, CASE k WHEN 1 THEN 'America/New_York' WHEN 4 THEN 'Not/AZone' ELSE 'UTC' END AS tz FROM {PROFILES}""",
    "dia_hours isf_mmol cr",
)
def profile_settings_mixed(spark, d):
    """Profile documents in either unit, with zeros, without the named profile, without entries and without any profile."""
    return cohort.profile_settings(cohort.profile_documents(spark, d))


@query(
    "profile_schedules_mixed",
    f"""SELECT patient_id, schedule, start, value FROM (
      SELECT patient_id, k, 'sens' AS schedule, '00:00' AS start, CASE k WHEN 0 THEN sens / 10.0 WHEN 3 THEN 0 ELSE sens END::DOUBLE AS value FROM {PROFILES}
      UNION ALL SELECT patient_id, k, 'carbratio', '00:00', CASE k WHEN 3 THEN 0 ELSE cr END FROM {PROFILES}
      UNION ALL SELECT patient_id, k, 'basal', u.start, u.value FROM {PROFILES} CROSS JOIN (VALUES ('00:00', 0.8::DOUBLE), ('06:30', 1.1)) u(start, value)) WHERE k < 4""",
    "value",
)
def profile_schedules_mixed(spark, d):
    """Their schedules; where the named profile is absent, those of the first one."""
    return cohort.profile_schedules(cohort.profile_documents(spark, d))


@query("readings_stamped", "SELECT patient_id, id, CAST(round_even(round(sgv / 18.0, 1) * 18.0, 0) AS INT) AS mgdl_again, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, epoch_us(ts) // 1000 AS unix_ms FROM r")
def readings_stamped(spark, d):
    """Values to mmol/L and back, and times as text and milliseconds."""
    r = readings(spark, d)
    return r.select("patient_id", "id", scalars.mgdl(scalars.mmol(F.col("sgv"))).alias("mgdl_again"), scalars.iso_z(F.col("ts")).alias("iso"), F.unix_millis("ts").alias("unix_ms"))
