import datetime as dt

import pytest
from pyspark.sql import functions as F

from sweetframe.functions.scalars import micros
from sweetframe.operators import timejoin as tj

T0 = dt.datetime(2024, 1, 1, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (1, "b", at(30)), (2, "c", at(10)), (1, "d", at(-5))], "patient_id long, id string, ts timestamp")
    right = spark.createDataFrame([(1, "x", at(0), 100), (1, "y", at(10), 110), (1, "z", at(10), 120), (1, "w", at(14), None), (2, "v", at(11), 70)], "patient_id long, id string, ts timestamp, sgv int")
    return left, right


def values(df):
    return {r["id"]: (r["m"]["sgv"] if r["m"] else "none") for r in df.collect()}


def test_asof_bounds(sides):
    left, right = sides
    assert values(tj.asof_join(left, right, name="m", columns=["sgv"])) == {"a": 120, "b": None, "c": "none", "d": "none"}
    assert values(tj.asof_join(left, right, name="m", columns=["sgv"], allow_exact=False)) == {"a": 100, "b": None, "c": "none", "d": "none"}
    assert values(tj.asof_join(left, right.where("sgv is not null"), name="m", columns=["sgv"], tolerance_min=20)) == {"a": 120, "b": 120, "c": "none", "d": "none"}
    assert values(tj.asof_join(left, right.where("sgv is not null"), name="m", columns=["sgv"], tolerance_min=19)) == {"a": 120, "b": "none", "c": "none", "d": "none"}


def test_interval_bounds_and_plan(sides):
    left, right = sides
    lo, hi = micros(F.col("ts")) - 10 * tj.MINUTE, micros(F.col("ts")) + 4 * tj.MINUTE
    pairs = lambda **k: sorted((r["id"], r["r_id"]) for r in tj.interval_join(left, right, lo=lo, hi=hi, columns=["id"], **k).collect())
    assert pairs() == [("a", "w"), ("a", "x"), ("a", "y"), ("a", "z"), ("c", "v")]
    assert pairs(lo_open=True) == [("a", "w"), ("a", "y"), ("a", "z"), ("c", "v")]
    assert pairs(hi_open=True) == [("a", "x"), ("a", "y"), ("a", "z"), ("c", "v")]
    assert pairs(bucket=tj.MINUTE) == pairs()
    plan = tj.interval_join(left, right, lo=lo, hi=hi, columns=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [r["id"] for r in tj.interval_anti(left, right, lo=lo, hi=hi).orderBy("id").collect()] == ["b", "d"]
    assert {r["id"]: r["f"] for r in tj.interval_flag(left, right, "f", lo=lo, hi=hi).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_nearest_takes_the_earlier_on_ties(spark):
    left = spark.createDataFrame([(1, "a", at(10))], "patient_id long, id string, ts timestamp")
    right = spark.createDataFrame([(1, at(12), 1), (1, at(8), 2), (1, at(30), 3)], "patient_id long, ts timestamp, sgv int")
    got = tj.nearest(left, right, at=micros(F.col("ts")), within=5 * tj.MINUTE, columns=["sgv"]).first()
    assert got["r_sgv"] == 2
    assert tj.nearest(left, right.limit(0), at=micros(F.col("ts")), within=tj.MINUTE, columns=["sgv"]).first()["r_sgv"] is None


def test_ids_of_two_patients_and_null_times_are_kept_apart(spark):
    left = spark.createDataFrame([("p", "a", 100), ("q", "a", 100), ("q", "z", None)], "patient_id string, id string, s long").select("patient_id", "id", F.timestamp_seconds("s").alias("ts"))
    right = spark.createDataFrame([("p", 130, 7.0), ("p", 160, 5.0)], "patient_id string, s long, sgv double").select("patient_id", F.timestamp_seconds("s").alias("ts"), "sgv")
    lo, hi = micros(F.col("ts")), micros(F.col("ts")) + tj.MINUTE
    flags = {(r["patient_id"], r["id"]): r["f"] for r in tj.interval_flag(left, right, "f", lo=lo, hi=hi).collect()}
    assert flags == {("p", "a"): True, ("q", "a"): False, ("q", "z"): False}
    assert {(r["patient_id"], r["id"]) for r in tj.interval_anti(left, right, lo=lo, hi=hi).collect()} == {("q", "a"), ("q", "z")}
    least = tj.interval_agg(left, right, lo=lo, hi=hi, columns=["sgv"], aggregates={"m": F.min("r_sgv")}).collect()
    assert {(r["patient_id"], r["id"]): r["m"] for r in least} == {("p", "a"): 5.0, ("q", "a"): None, ("q", "z"): None}
    near = {(r["patient_id"], r["id"]): r["r_sgv"] for r in tj.nearest(left, right, at=lo, within=tj.MINUTE, columns=["sgv"]).collect()}
    assert near == {("p", "a"): 7.0, ("q", "a"): None, ("q", "z"): None}


def test_a_stack_of_interval_joins_reads_its_left_side_once(spark):
    from sweetframe.plans import QUERIES

    plan = QUERIES["isf_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6
