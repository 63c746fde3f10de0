import datetime as dt

import pytest
from pyspark.sql import functions as F

from sweetframe.operators import outcomes, reports, settings, windows
from sweetframe.sources import cohort

NOON = dt.datetime(2024, 3, 10, 12)


def test_clamps():
    assert [windows.clamped(n) for n in (-3, 0, 1, 14, 90, 91)] == [1, 1, 1, 14, 90, 90]
    assert [windows.clamped(n, "change_points_tdd") for n in (1, 14, 365)] == [14, 14, 90]
    assert windows.clamped(30, "synthesis_patterns") == 7
    with pytest.raises(KeyError):
        windows.clamped(7, "no such report")


def test_midnight(spark):
    rows = [("2024-03-10", "America/New_York"), ("2024-03-11", "America/New_York"), ("2024-01-05", "Asia/Kolkata"), ("2024-01-05", "Not/AZone"), ("2024-01-05", None), ("2024-01-05", ""), (None, "UTC")]
    got = spark.createDataFrame(rows, "day string, tz string").select(windows.midnight(F.col("day").cast("date"), F.col("tz")).cast("string").alias("at")).collect()
    # New York turns its clocks on the 10th, so that day has 23 hours
    assert [r["at"] for r in got] == ["2024-03-10 05:00:00", "2024-03-11 04:00:00", "2024-01-04 18:30:00", "2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-01-05 00:00:00", None]


def test_last_days(spark):
    rows = [(p, i, NOON + dt.timedelta(hours=h)) for p in (1, 2) for i, h in enumerate((-40, -8, -6, 10, 15))]
    r = spark.createDataFrame(rows, "patient_id long, id long, ts timestamp")
    zones = spark.createDataFrame([(1, "America/New_York")], "patient_id long, tz string")
    # the newest row is 03:00 UTC of the 11th: still the 10th in New York, which began at 05:00 UTC
    got = {(x["patient_id"], x["id"]) for x in windows.last_days(r, zones, 0).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 4)}
    assert windows.last_days(r, zones, 2).count() == 4 + 4
    assert windows.last_days(r.limit(0), zones, 2).count() == 0


def test_meal_at(spark):
    at = lambda m: NOON + dt.timedelta(minutes=m)
    meals = [(1, 7, at(-30), "Meal Bolus", 4.0, 40.0), (1, 8, at(20), "Carb Correction", None, 12.0), (1, 9, at(5), "Bolus", 1.0, None), (2, 7, at(30), "Meal Bolus", 4.0, 40.0)]
    treatments = spark.createDataFrame(meals, "patient_id long, id long, ts timestamp, event_type string, insulin double, carbs double")
    readings = spark.createDataFrame([(1, str(m), at(m), v) for m, v in ((-5, 100), (30, 190), (60, 270), (120, 150), (300, 60))], "patient_id long, id string, ts timestamp, sgv int")
    times = spark.createDataFrame([(1, 0, at(0)), (2, 0, at(0))], "patient_id long, id long, ts timestamp")
    one, two = outcomes.meal_at(times, treatments, readings).orderBy("patient_id").collect()
    # the nearer meal; a lone bolus is none
    assert (one["meal_id"], one["carbs"], one["insulin"]) == (8, 12.0, None)
    assert (one["pre_bg"], one["peak_mgdl"], one["minutes_to_peak"], one["end_mgdl"]) == (100, 270, 60, 150)
    # 30 minutes later lies outside; ids of other patients aren't mixed up
    assert two["meal_id"] is None and two["notes"] == "no readings after"
    (early,) = outcomes.meal_at(times.where("patient_id = 1"), treatments.where("id = 7"), readings).collect()
    assert early["meal_id"] == 7


def test_questions(spark):
    names = "patient_id long, overnight_lows long, tbr_lt54_percent double, isf_ratio double, effective_ratio double, effective_confidence string, in_target_ratio double, above_target_ratio double, above_target_n long, spikes long"
    rows = [(1, 3, 2.5, 1.0, 1.4, "high", 1.0, 1.5, 5, 9), (2, 2, 2.5, 1.0, 1.4, "low", 1.0, 1.5, 4, 4), (3, 0, None, None, None, None, None, None, 0, 0)]
    got = reports.synthesis_questions(spark.createDataFrame(rows, names)).orderBy("place").collect()
    assert [(r["patient_id"], r["place"], r["value"]) for r in got] == [(1, 0, 2.5), (1, 1, 1.4), (1, 2, 1.5), (1, 3, 7.0)]


def test_absent_stores(spark, tmp_path):
    absent = cohort.read_store(spark, str(tmp_path / "none"), cohort.SNAPSHOTS)
    (status,) = settings.snapshot_status(absent).collect()
    assert (status["n"], status["latest"], status["note"]) == (0, None, "no snapshots")
    log = cohort.read_store(spark, str(tmp_path / "none"), cohort.LOG)
    assert settings.log_entries(log, "2024-01-01", kinds=("view",)).collect() == []
    written = spark.createDataFrame([(1, NOON, "3", "{}")], cohort.SNAPSHOTS)
    written.write.parquet(str(tmp_path / "some"))
    assert settings.snapshot_status(cohort.read_store(spark, str(tmp_path / "some"), cohort.SNAPSHOTS)).first()["note"] == ""
    with pytest.raises(Exception, match="(?i)pars"):
        cohort.read_store(spark, str(tmp_path / "none"), "not a schema at all,")
