"""Effective sensitivity, carb ratio and change points at the reports' own thresholds, on small made-up traces."""

import datetime as dt
import json
import math

import pytest

from sweetframe.operators import devices, episodes, outcomes

T0 = dt.datetime(2024, 2, 6, 8)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def readings(spark, values, step=5, start=0):
    return spark.createDataFrame([(1, f"r{i:05d}", at(start + step * i), v) for i, v in enumerate(values)], "patient_id long, id string, ts timestamp, sgv int")


def treatments(spark, *rows):
    """rows: minute, type, insulin, carbs."""
    data = [(1, i, at(m), kind, insulin, carbs, None) for i, (m, kind, insulin, carbs) in enumerate(rows)]
    return spark.createDataFrame(data, "patient_id long, id long, ts timestamp, event_type string, insulin double, carbs double, notes string")


def controller(spark, *rows):
    """rows: minute, what was decided."""
    data = [(1, i, json.dumps({"openaps": {"suggested": decided}}), at(m)) for i, (m, decided) in enumerate(rows)]
    return devices.sensitivity(devices.typed(spark.createDataFrame(data, "patient_id long, id long, doc string, ts timestamp")))


def fall(spark, before, least):
    return readings(spark, [before] * 7 + [least] * 70)


def checked(spark, boluses, trace, sens):
    samples = outcomes.effective_isf_samples(boluses, trace, sens)
    patients = trace.select("patient_id").distinct()
    return outcomes.effective_isf_check(samples, patients).first(), {r["band"]: r for r in outcomes.effective_isf_bands(samples, patients).collect()}


@pytest.mark.parametrize(
    "decided, minute, want",
    [
        ({"variable_sens": 36, "sens": 9}, 25, 2.0), ({"sens": 2.2}, 25, 2.2), ({"variable_sens": 0, "sens": 2.2}, 25, 2.2), ({"variable_sens": "36"}, 25, None),
        ({"variable_sens": 36}, 15, 2.0), ({"variable_sens": 36}, 14.9, None), ({"variable_sens": 36}, 30, None), ({"variable_sens": -5}, 25, None),
    ],
)
def test_the_controllers_sensitivity_lies_strictly_before_and_within_a_quarter_of_an_hour(spark, decided, minute, want):
    check, _ = checked(spark, treatments(spark, (30, "Correction Bolus", 2.0, None)), fall(spark, 190, 118), controller(spark, (minute, decided)))
    assert check["effective_mmol"] == want and (check["n"], check["unmatched"]) == ((1, 0) if want else (0, 1))
    if want:
        assert check["realized_mmol"] == 2.0 and check["ratio"] == pytest.approx(2.0 / want)


def test_documents_without_a_sensitivity_are_passed_over(spark):
    sens = controller(spark, (20, {"variable_sens": 45}), (24, {"COB": 3}), (28, {"variable_sens": None}))
    check, _ = checked(spark, treatments(spark, (30, "Bolus", 1.0, None)), fall(spark, 150, 100), sens)
    assert check["effective_mmol"] == 2.5


@pytest.mark.parametrize("sens, verdict", [(40, "over_dosing"), (54, "calibrated"), (70, "under_dosing")])
def test_verdict_of_the_ratio(spark, sens, verdict):
    check, _ = checked(spark, treatments(spark, (30, "Bolus", 1.0, None)), fall(spark, 160, 106), controller(spark, (25, {"variable_sens": sens})))
    assert check["verdict"] == verdict and check["confidence"] == "low"


def test_bands_by_glucose_before_with_empty_ones(spark):
    trace = readings(spark, [90] * 7 + [70] * 90 + [150] * 9 + [80] * 90 + [250] * 9 + [100] * 90)
    boluses = treatments(spark, (30, "Bolus", 1.0, None), (97 * 5 + 40, "Bolus", 1.0, None))
    sens = controller(spark, (25, {"variable_sens": 36}), (97 * 5 + 35, {"variable_sens": 36}))
    _, bands = checked(spark, boluses, trace, sens)
    assert {b: r["n"] for b, r in bands.items()} == {"below_target": 1, "in_target": 1, "above_target": 0}
    assert bands["below_target"]["realized_mmol"] == 1.1 and bands["in_target"]["realized_mmol"] == 3.9 and bands["above_target"]["ratio"] is None


def test_no_drop_carbs_near_and_no_data(spark):
    sens = controller(spark, (25, {"variable_sens": 36}))
    rising, _ = checked(spark, treatments(spark, (30, "Bolus", 1.0, None)), readings(spark, [100] * 7 + [140] * 70), sens)
    assert (rising["n"], rising["verdict"]) == (0, "no_data")
    with_carbs, _ = checked(spark, treatments(spark, (30, "Bolus", 1.0, None), (85, "Carb Correction", None, 12.0)), fall(spark, 190, 118), sens)
    assert with_carbs["n"] == with_carbs["unmatched"] == 0


@pytest.mark.parametrize("end, carbs, verdict", [(100, 60.0, "stable"), (140, 60.0, "one_signal"), (140, 72.0, "too_high"), (60, 48.0, "too_low"), (60, 72.0, "signals_disagree")])
def test_carb_ratio_of_two_signals(spark, end, carbs, verdict):
    trace = readings(spark, [100] * 30 + [end] * 60)
    meals = treatments(spark, (10, "Meal Bolus", 6.0, carbs))
    settings = spark.createDataFrame([(1, 10.0)], "patient_id long, cr double")
    got = outcomes.carb_ratio_check(outcomes.carb_ratio_samples(meals, trace), settings).first()
    assert (got["n"], got["derived_cr"], got["mean_residual"], got["verdict"]) == (1, carbs / 6, end - 100, verdict)


def test_change_points_at_the_reports_own_thresholds(spark):
    """Hourly glucose at 4 and daily doses at 3 standard deviations: a fall and a rise of one stretch each stand out."""
    n, w = 360, 30
    wave = lambda i: 0.01 * math.sin(i)
    swing = [100 + wave(i) - (50 if 150 <= i < 180 else 0) + (50 if 180 <= i < 210 else 0) for i in range(n)]
    pulse = [40 + wave(i) + (20 if 200 <= i < 230 else 0) for i in range(n)]
    calm = [100 + 20 * math.sin(i / 9) for i in range(n)]

    def points(values, sigma):
        series = spark.createDataFrame([(1, at(60 * i), float(v)) for i, v in enumerate(values)], "patient_id long, ts timestamp, value double")
        return [(r["place"], r["direction"], round(r["shift"])) for r in episodes.change_points(episodes.change_point_signal(series, sigma)).orderBy("place").collect()]

    assert n // 12 == w
    assert points(swing, 4.0) == [(180, "up", 100)] and points(calm, 4.0) == []
    assert points(pulse, 3.0) == [(200, "up", 20), (230, "down", -20)] and points(pulse, 4.0) == []
