"""Small traces with known answers."""

import datetime as dt

import pytest

from sweetframe.operators import compare, episodes, metrics, outcomes, profiles, variability

T0 = dt.datetime(2024, 1, 1, 12)


@pytest.fixture
def trace(spark):
    def make(values, start=T0, step=5, at=None):
        times = at or [step * i for i in range(len(values))]
        rows = [(1, f"{i:05d}", start + dt.timedelta(minutes=m), v, "sgv") for i, (m, v) in enumerate(zip(times, values))]
        return metrics.valid(spark.createDataFrame(rows, "patient_id long, id string, ts timestamp, sgv int, type string").repartition(3))

    return make


@pytest.fixture
def given(spark):
    def make(*rows):
        full = [(1, i, T0 + dt.timedelta(minutes=m), kind, insulin, carbs, None, None) for i, (m, kind, insulin, carbs) in enumerate(rows)]
        return spark.createDataFrame(full, "patient_id long, id long, ts timestamp, event_type string, insulin double, carbs double, notes string, entered_by string")

    return make


def episodes_of(readings, treatments):
    return [r.asDict() for r in episodes.hypo_episodes(readings, treatments).orderBy("start").collect()]


def test_hypo_episodes(trace, given):
    none = given()
    got = episodes_of(trace([68, 65, 62, 66, 120], at=[0, 5, 10, 15, 25]), none)
    assert [(e["minutes"], e["nadir"], e["level"], e["rescue"]) for e in got] == [(15, 62, 1, False)]
    assert episodes_of(trace([65, 66, 120]), none) == []
    assert [e["level"] for e in episodes_of(trace([66, 58, 50, 60, 110], at=[0, 5, 10, 15, 30]), none)] == [2]
    assert len(episodes_of(trace([66, 64, 75, 63, 62, 68]), none)) == 1
    night = trace([66, 62, 64, 65], start=dt.datetime(2024, 1, 1, 3))
    assert episodes_of(night, none)[0]["nocturnal"]
    assert episodes_of(trace([66, 60, 58, 64, 120], at=[0, 5, 10, 15, 30]), given((10, "Carb Correction", None, 15.0)))[0]["rescue"]
    assert episodes_of(trace([0, 120]), none) == []


def test_compression_lows(trace, given):
    lows = lambda values, treatments: episodes.compression_lows(episodes.compression_candidates(trace(values), treatments)).collect()
    got = lows([105, 100, 50, 100, 105], given())
    assert [r["nadir"] for r in got] == [50]
    assert lows([105, 100, 50, 100, 105], given((12, "Carb Correction", None, 15.0))) == []
    assert len(lows([105, 100, 50, 100, 105], given((-60, "Carb Correction", None, 15.0)))) == 1
    assert lows([110 - 4 * i for i in range(8)] + [78 + 3 * i for i in range(10)], given()) == []


def test_change_points(spark):
    rows = [(1, T0 + dt.timedelta(hours=i), 100.0 if i < 100 else 130.0) for i in range(200)]
    series = spark.createDataFrame(rows, "patient_id long, ts timestamp, value double")
    got = episodes.change_points(episodes.change_point_signal(series, 1.5)).collect()
    assert len(got) >= 1 and got[0]["direction"] == "up" and 80 <= got[0]["place"] <= 120
    assert episodes.change_points(episodes.change_point_signal(series.limit(20), 1.5)).count() == 0


def plain_change_points(values, sigma):
    n = len(values)
    w = max(10, n // 12)
    mean = sum(values) / n
    sd = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5
    shift = {i: sum(values[i : i + w]) / w - sum(values[i - w : i]) / w for i in range(w, n - w)}
    found, i = [], w
    while i < n - w:
        if abs(shift[i]) > sigma * sd:
            best = max(range(i, min(i + w, n - w)), key=lambda j: abs(shift[j]))
            found.append(best)
            i = best + w
        else:
            i += 1
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_change_points_equal_a_plain_scan(spark, seed):
    import random

    rng = random.Random(seed)
    level, values = 120.0, []
    for _ in range(240):
        if rng.random() < 0.03:
            level = rng.uniform(80, 200)
        values.append(float(round(level + rng.gauss(0, 12))))
    series = spark.createDataFrame([(1, T0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "patient_id long, ts timestamp, value double")
    got = episodes.change_points(episodes.change_point_signal(series, 0.4)).orderBy("place").collect()
    assert [r["place"] for r in got] == plain_change_points(values, 0.4)


def test_variability(trace):
    assert 90 < variability.mage(trace([80, 180] * 4)).first()["mage"] < 110
    assert variability.mage(trace([100])).first()["mage"] == 0
    assert variability.gvp(trace([100] * 5)).first()["gvp"] == 0
    assert variability.modd(trace([100] * 10)).first()["modd"] == 0
    two_days = trace([100 + (i % 7) for i in range(288)] + [110 + (i % 7) for i in range(288)])
    assert variability.modd(two_days).first()["matches"] > 200


def test_profiles(trace):
    hourly = trace([100 + 5 * h for h in range(24) for _ in range(5)], start=dt.datetime(2024, 1, 1), at=[60 * h + 5 * k for h in range(24) for k in range(5)])
    rows = profiles.agp_hourly(hourly).orderBy("hour").collect()
    assert len(rows) == 24 and rows[0]["p50"] == 100 and rows[23]["p50"] == 215
    means = profiles.hourly_mean(trace([100, 110, 200], at=[10, 20, 65])).orderBy("hour").collect()
    assert [r["mean_mgdl"] for r in means] == [105, 200]
    wrap = profiles.meal_period_tir(trace([100] * 6, start=dt.datetime(2024, 1, 1), at=[60 * h for h in (2, 5, 8, 15, 22, 23)]), periods=(("overnight", 22, 6), ("day", 6, 22), ("none", 12, 13)))
    assert {r["period"]: r["n"] for r in wrap.collect()} == {"overnight": 4, "day": 2, "none": 0}
    assert "no data" in profiles.agp_markdown(trace([100])).first()["markdown"]


def test_isolated_corrections_and_ratio(trace, given):
    readings = trace([140] * 3 + [90] * 60)
    assert outcomes.isf_samples(given((10, "Correction Bolus", 1.0, None), (40, "Carb Correction", None, 15.0)), readings).count() == 0
    assert outcomes.isf_samples(given((10, "Correction Bolus", 1.0, None)), readings).first()["isf"] == 50
    long = trace([100] * 200)
    meals = given((0, "Meal Bolus", 6.0, 60.0), (480, "Meal Bolus", 4.0, 40.0))
    assert [r["cr"] for r in outcomes.carb_ratio_samples(meals, long).collect()] == [10.0, 10.0]
    split = given((0, "Carb Correction", None, 50.0), (0.5, "Bolus", 5.0, None))
    assert [r["cr"] for r in outcomes.carb_ratio_samples(split, long).collect()] == [10.0]
    assert outcomes.carb_ratio_samples(given((0, "Meal Bolus", 6.0, 60.0), (120, "Meal Bolus", 4.0, 40.0)), long).count() == 1


def test_bh_adjusted_is_never_below_raw(spark):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.5])], "patient_id long, id long, p double")
    got = {r["p"]: r["p_adjusted"] for r in compare.bh_fdr(rows).collect()}
    assert all(b >= a for a, b in got.items()) and abs(got[0.005] - 0.025) < 1e-12 and abs(got[0.04] - 0.05) < 1e-12


def test_bands_sum_to_one_hundred_and_order_does_not_matter(trace):
    values = [45, 60, 100, 150, 190, 300, 70, 180, 54]
    a, b = (metrics.tir_with_ci(trace(v)).first().asDict() for v in (values, values[::-1]))
    assert a == b and abs(sum(a[f"pct_{k}"] for k in ("lt54", "54_69", "70_180", "181_250", "gt250")) - 100) < 1e-9


def test_empty_readings(trace, given):
    empty = trace([])
    for f in (metrics.glucose_stats, metrics.glycemia_risk_index, metrics.tir_with_ci, variability.glucose_variability, profiles.agp_hourly, profiles.detect_patterns):
        assert f(empty).count() == 0
    assert episodes_of(empty, given()) == []
