import random

import pytest

from sweetframe.operators import episodes, metrics, outcomes
from sweetframe.sources import cohort
from sweetframe.streaming import glucose

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Readings in files of some hours, rows within a file in random order, some sent twice."""
    folder = tmp_path_factory.mktemp("feed")
    rows = cohort.readings(spark, D).orderBy("ts").collect()
    schema = cohort.readings(spark, D).schema
    rng = random.Random(1)
    for i in range(0, len(rows), 100):
        part = rows[i : i + 100] + rng.sample(rows[i : i + 100], min(5, len(rows[i : i + 100])))
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    last = rows[-1].asDict()
    far = {**last, "ts": last["ts"].replace(year=last["ts"].year + 1), "id": "end", "sgv": 100}
    for n in (1, 2):  # carry the watermark past all rows
        spark.createDataFrame([tuple({**far, "id": f"end{n}"}[f.name] for f in schema)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_windowed_tir_equals_batch(spark, feed):
    got = drained(spark, glucose.windowed_tir(glucose.valid_stream(feed)), "tir")
    want = glucose.windowed_tir(metrics.valid(cohort.readings(spark, D)))
    key = lambda df: sorted((r["patient_id"], r["start"], r["n"], round(r["tir_percent"], 6)) for r in df.collect() if r["start"].year == 2024)
    assert key(got) == key(want)


def test_hypo_episodes_equal_batch(spark, feed):
    got = drained(spark, glucose.hypo_episodes(glucose.valid_stream(feed)), "hypo")
    want = episodes.hypo_episodes(metrics.valid(cohort.readings(spark, D)), cohort.treatments(spark, D))
    key = lambda df: sorted((r["patient_id"], r["minutes"], r["nadir"], r["level"]) for r in df.collect())
    assert key(got) == key(want)


@pytest.fixture(scope="module")
def treatment_feed(spark, tmp_path_factory):
    """Treatments in files of some hours, in random order within a file, and rows that carry the watermark on."""
    folder = tmp_path_factory.mktemp("treatments")
    frame = cohort.treatments(spark, D).where("ts is not null")
    rows, schema = frame.orderBy("ts").collect(), frame.schema
    rng = random.Random(2)
    for i in range(0, len(rows), 60):
        part = rows[i : i + 60]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    for n in (1, 2):  # carry the watermarks of boluses and of carbs past all rows
        far = {**rows[-1].asDict(), "ts": rows[-1]["ts"].replace(year=rows[-1]["ts"].year + n), "insulin": 1.0, "event_type": "Correction Bolus"}
        both = [{**far, "id": -n, "carbs": None}, {**far, "id": -n - 10, "carbs": 5.0}]
        spark.createDataFrame([tuple(x[f.name] for f in schema) for x in both], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_isolated_corrections_of_two_streams_equal_batch(spark, treatment_feed):
    got = drained(spark, glucose.isolated_corrections(treatment_feed), "isolated")
    want = outcomes.isolated_corrections(cohort.treatments(spark, D))
    key = lambda df: sorted((r["patient_id"], r["id"], r["ts"], r["insulin"]) for r in df.collect() if r["id"] >= 0)
    assert key(got) == key(want) and key(want)


def test_least_glucose_after_boluses_of_two_streams_equals_batch(spark, treatment_feed, feed):
    plain = lambda t: t.where("insulin > 0")
    got = drained(spark, glucose.post_bolus_min(plain(treatment_feed), glucose.valid_stream(feed)), "least")
    want = outcomes.post_bolus_min(plain(cohort.treatments(spark, D)), metrics.valid(cohort.readings(spark, D)))
    key = lambda df: sorted((r["patient_id"], r["id"], r["ts"], r["min_bg"]) for r in df.collect() if r["id"] >= 0)
    assert key(got) == key(want) and key(want)


def test_silent_sensors_equal_batch_gaps_one_row_each(spark, feed):
    got = [(r["patient_id"], r["last"]) for r in drained(spark, glucose.silent_sensors(glucose.valid_stream(feed)), "silent").collect() if r["last"].year == 2024]
    want = [(r["patient_id"], r["last"]) for r in metrics.sensor_gaps(metrics.valid(cohort.readings(spark, D))).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
