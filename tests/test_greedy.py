"""Pointer doubling, its two users, ranges of time and shared stages, against plain loops."""

import bisect
import random
import re
from datetime import datetime, timedelta

import pytest

from sweetframe.operators import episodes, greedy, settings
from sweetframe.plans import QUERIES

START = datetime(2024, 1, 1)


def test_chains_of_any_length_are_followed(spark):
    rows, want = [], set()
    for patient, n, step in ((1, 200, 1), (2, 37, 3), (3, 1, 1)):
        rows += [(patient, i, i + step if i + step < n else None, i == 0) for i in range(n)]
        want |= {(patient, i) for i in range(0, n, step)}
    pointers = spark.createDataFrame(rows, "patient_id long, place long, next long, first boolean")
    assert {tuple(r) for r in greedy.chosen(pointers).collect()} == want
    assert greedy.chosen(pointers.where("false")).collect() == []


def test_compression_lows_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(episodes, "_BLOCK", 16)
    rnd = random.Random(2)
    rows = []
    for patient in (1, 2, 3):
        for first in sorted(rnd.sample(range(1, 400), 150 if patient < 3 else 1)):
            rows.append((patient, first, first + rnd.randint(2, 6), f"{patient}-{first}"))
    want, free = set(), {}
    for patient, first, recovery, id_ in rows:
        if first >= free.get(patient, 0):
            want.add(id_)
            free[patient] = recovery + 1
    got = episodes.compression_lows(spark.createDataFrame(rows, "patient_id long, first int, recovery int, id string"))
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_change_points_equal_a_loop(spark):
    rnd = random.Random(6)
    rows = []
    for patient, w, share in ((1, 10, 0.9), (2, 13, 0.3), (3, 25, 0.05), (4, 10, 0.6)):
        for i in range(10, 400):
            if rnd.random() < share:
                rows.append((patient, i, w, START + timedelta(hours=i), float(rnd.randint(-6, 6) or 1)))
    want = []
    for patient in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == patient]
        at = 0
        while at < len(own):
            reach = [r for r in own[at:] if r[1] < own[at][1] + own[at][2]]
            best = min(reach, key=lambda r: (-abs(r[4]), r[1]))
            want.append((patient, best[1], best[4]))
            at = bisect.bisect_left([r[1] for r in own], best[1] + best[2])
    got = episodes.change_points(spark.createDataFrame(rows, "patient_id long, i long, w long, ts timestamp, shift double"))
    assert sorted((r["patient_id"], r["place"], r["shift"]) for r in got.collect()) == sorted(want)


def test_no_list_of_a_patients_candidates(spark):
    signal = spark.createDataFrame([], "patient_id long, i long, w long, ts timestamp, shift double")
    candidates = spark.createDataFrame([], "patient_id long, first int, recovery int, id string")
    for df in (episodes.change_points(signal), episodes.compression_lows(candidates)):
        assert df.collect() == [] and "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_settings_are_found_by_ranges_of_time(spark, parts):
    rnd = random.Random(parts)
    crowded = [START + timedelta(seconds=rnd.randint(0, 500)) for _ in range(900)]  # most in one moment of a long history
    times = crowded + [START + timedelta(days=rnd.randint(-4000, 4000)) for _ in range(60)]
    docs = [(i, t, f'{{"a": {i}, "b": null}}') for i, t in enumerate(times)]
    asks = [(i, rnd.choice(["a", "b", "z"]), t + timedelta(seconds=rnd.choice([0, 1, -1]))) for i, t in enumerate(rnd.sample(times, 200))] + [(999, "a", None), (1000, "a", START - timedelta(days=9999))]
    snapshots = spark.createDataFrame(docs, "id long, captured_at timestamp, full_json string")
    requests = spark.createDataFrame(asks, "id long, key string, ts timestamp")
    order = sorted((t, i) for i, t, _ in docs)
    for r in settings.setting_at(requests, snapshots, parts).collect():
        n = bisect.bisect_right(order, (r["ts"], float("inf"))) if r["ts"] else 0
        want = order[n - 1][1] if n else None
        assert (r["snapshot_id"], r["found"], r["value"]) == (want, want is not None and r["key"] in "ab", str(want) if want is not None and r["key"] == "a" else None)
    ranges = settings._ranges(snapshots.withColumnRenamed("captured_at", "ts"), "ts", 10)
    sizes = [sum(a <= t.timestamp() * 1e6 < b for t in times) for a, b in zip(ranges, ranges[1:], strict=False)]
    assert max(sizes) < 3 * len(times) / 10


def test_synthesis_reads_shared_tables(spark):
    df = QUERIES["synthesis_features"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan", plan)) <= 12
    assert "events.parquet" not in plan
