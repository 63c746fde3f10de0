"""The store by day and the trigram index."""

import datetime as dt
import os
import re

import pytest

from sweetframe.operators import scans, textindex
from sweetframe.sources import store

SCHEMA = "patient_id long, id string, ts timestamp, sgv int"
T0 = dt.datetime(2024, 5, 1, 12)


def files(path):
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def rows(spark, n, **change):
    data = [(i % 3, f"r{i}", T0 + dt.timedelta(hours=7 * i), 100 + i) for i in range(n)] + [(1, "no time", None, 5)]
    data = [tuple(change.get(r[1], r)) for r in data]
    return spark.createDataFrame(data, SCHEMA)


def stored(spark, path):
    return sorted(map(str, store.read(spark, path, SCHEMA).drop("day").collect()))


def test_loads_are_idempotent_and_write_changed_days_only(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read(spark, path, SCHEMA).count() == 0
    assert store.upsert(rows(spark, 40), path) > 10
    before = files(path)
    assert store.upsert(rows(spark, 40), path) == 0 and files(path) == before
    moved = {"r7": (1, "r7", T0 + dt.timedelta(days=40), 1), "r20": (2, "r20", T0 + dt.timedelta(hours=140), 999)}
    assert store.upsert(rows(spark, 40, **moved), path) == 3  # the old and the new day of one row, the day of the other
    assert stored(spark, path) == sorted(map(str, rows(spark, 40, **moved).collect()))
    kept = {f for f in before if f in files(path)}
    assert len(kept) >= len(before) - 2
    assert store.upsert(rows(spark, 3).union(rows(spark, 3)), path) == 0  # rows of one key in one load
    new = spark.createDataFrame([(5, "n", T0, 1), (5, "n", T0, 2)], SCHEMA)
    assert store.upsert(new, path) == 1 and len(stored(spark, path)) == 42  # of rows of one key the last one
    assert [r["sgv"] for r in store.read(spark, path, SCHEMA).where("id = 'n'").collect()] == [2]


def test_a_day_whose_last_row_moves_away_is_empty(spark, tmp_path):
    path = str(tmp_path / "store")
    one = lambda day: spark.createDataFrame([(1, "a", T0 + dt.timedelta(days=day), 7), (1, "b", T0, 8)], SCHEMA)
    store.upsert(one(3), path)
    store.upsert(one(9), path)
    assert stored(spark, path) == sorted(map(str, one(9).collect()))


def test_reads_prune_days(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(rows(spark, 60), path)
    all_ = store.read(spark, path, SCHEMA)
    some = store.between(all_, "2024-05-03 06:00:00", "2024-05-05 06:00:00")
    assert sorted(r["id"] for r in some.collect()) == sorted(f"r{i}" for i in range(60) if dt.datetime(2024, 5, 3, 6) <= T0 + dt.timedelta(hours=7 * i) < dt.datetime(2024, 5, 5, 6))
    assert re.search(r"PartitionFilters: \[[^\]]*day", some._jdf.queryExecution().executedPlan().toString())
    edges = spark.createDataFrame([(0, dt.datetime(2024, 5, 2), dt.datetime(2024, 5, 4)), (2, dt.datetime(2024, 5, 9, 3), dt.datetime(2024, 5, 9, 20))], "patient_id long, lo timestamp, hi timestamp")
    own = store.of_edges(all_, edges.where("patient_id < 5"))
    want = {f"r{i}" for i in range(60) for p, lo, hi in edges.collect() if i % 3 == p and lo <= T0 + dt.timedelta(hours=7 * i) < hi}
    assert {r["id"] for r in own.collect()} == want and want
    assert "dynamicpruning" in own._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def notes(spark):
    data = [(i, ["felt LOW after lunch", "auto SMB", None, "", "ab", "Ünder the müsli", "lowlow"][i % 7], "Bolus" if i % 2 else "Carb Correction", f"user{i}") for i in range(300)]
    return spark.createDataFrame(data, "id long, notes string, event_type string, entered_by string").repartition(4)


@pytest.mark.parametrize("words", ["low", "LOW", "felt low after", "smb", "b", "ab", "zzz", "müsli", "r the m", "user29", "tion", "boluslow", "", "carb c"])
def test_index_finds_what_the_scan_finds(notes, words):
    postings = textindex.build(notes)
    key = lambda df: sorted(r["id"] for r in df.collect())
    assert key(textindex.search(notes, postings, words)) == key(scans.search(notes, words))


def test_a_search_fetches_the_rarest_trigrams_rows_only(notes):
    postings = textindex.build(notes)
    plan = textindex.search(notes, postings, "user299")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(gram,(r29|299|er2)", plan)
    assert postings.where("gram = '299'").count() == 1
