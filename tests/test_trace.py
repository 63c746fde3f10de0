"""Scans of two levels against plain windows, with one patient that has nine tenths of the rows."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import micros
from sweetframe.operators import episodes, metrics, timejoin, trace, variability

HOUR = 3_600_000_000
START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = []
    for patient, n in ((1, 1800), (2, 150), (3, 40), (4, 1)):
        at, v = 0, 120
        for i in range(n):
            at += rnd.choice([5, 5, 5, 5, 6, 0, 90, 60 * 24 * 9 if i % 97 == 0 else 5])
            v = min(300, max(45, v + rnd.randint(-25, 24)))
            rows.append((patient, f"{patient}-{i:05d}", START + timedelta(minutes=at), v, "sgv"))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "patient_id long, id string, ts timestamp, sgv int, type string").repartition(4).cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("width", [HOUR, 30 * HOUR, trace.WEEK])
def test_rows_beside_counts_and_last_values_equal_plain_windows(skewed, width):
    w = Window.partitionBy("patient_id").orderBy("ts", "id")
    row = F.struct("sgv", "id")
    same(trace.beside(skewed, ["sgv", "id"], width=width), skewed.withColumns({"before": F.lag(row).over(w), "after": F.lead(row).over(w)}))
    low = F.when(F.col("sgv") < 60, F.col("id"))
    same(trace.last_so_far(skewed, low, "last_low", width=width), skewed.withColumn("last_low", F.last(low, ignorenulls=True).over(w)))
    n = F.when(F.col("sgv") < 60, 1).otherwise(0)
    same(trace.numbered(skewed, {"lows": n}, width=width), skewed.withColumns({"place": F.row_number().over(w), "lows": F.sum(n).over(w)}))
    gap = {"max_gap": micros(F.col("b.ts")) - micros(F.col("a.ts")), "sum_rise": F.greatest(F.col("b.sgv") - F.col("a.sgv"), F.lit(0))}
    lagged = skewed.withColumns({"gap": micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w), "rise": F.greatest(F.col("sgv") - F.lag("sgv").over(w), F.lit(0))})
    plain = lagged.groupBy("patient_id").agg(F.max("gap").alias("max_gap"), F.coalesce(F.sum("rise"), F.lit(0)).alias("sum_rise"))
    same(trace.steps(skewed, gap, columns=("ts", "sgv"), width=width), plain)


@pytest.mark.parametrize("tolerance, exact", [(None, True), (None, False), (15, True), (15, False), (600, True)])
def test_asof_joins_over_chunks_equal_a_plain_window(skewed, tolerance, exact):
    left = skewed.sample(0.2, seed=3).select("patient_id", "id", (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ts"))
    right = skewed.where("sgv % 7 = 0")
    joined = lambda width: timejoin.asof_join(left, right, name="m", columns=["sgv", "id"], tolerance_min=tolerance, allow_exact=exact, width=width)
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.patient_id") == F.col("r.patient_id")) & ((F.col("r.ts") <= F.col("l.ts")) if exact else (F.col("r.ts") < F.col("l.ts"))))
    best = pairs.groupBy(F.col("l.id").alias("id")).agg(F.max(F.struct(F.col("r.ts").alias("ts"), F.col("r.id").alias("tie"), F.col("r.sgv").alias("sgv"))).alias("b"))
    near = F.lit(True) if tolerance is None else micros(F.col("ts")) - micros(F.col("b.ts")) <= tolerance * 60_000_000
    want = left.join(best, "id", "left").select("patient_id", "id", "ts", F.when(near, F.when(F.col("b").isNotNull(), F.struct(F.col("b.ts").alias("ts"), F.col("b.sgv").alias("sgv"), F.col("b.tie").alias("id")))).alias("m"))
    for width in (HOUR, trace.WEEK):
        same(joined(width), want)


def test_left_rows_without_a_time_stay_unmatched(spark, skewed):
    left = spark.createDataFrame([(1, "x", None), (1, "y", START + timedelta(days=1))], "patient_id long, id string, ts timestamp")
    for tolerance in (None, 15):
        got = {r["id"]: r["m"] for r in timejoin.asof_join(left, skewed, name="m", columns=["sgv"], tolerance_min=tolerance).collect()}
        assert set(got) == {"x", "y"} and got["x"] is None


def test_no_window_over_rows_is_partitioned_by_patient_alone(skewed):
    """Windows by patient alone see a row a chunk: the fewer rows of an aggregate by patient and chunk."""
    for df in (trace.beside(skewed, ["sgv"]), trace.numbered(skewed), variability.gvp(skewed), metrics.longest_gap(skewed), timejoin.asof_join(skewed, skewed, name="m", columns=["sgv"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if re.match(r"\W*Window ", line)]
        assert windows
        for line in windows:
            by = re.findall(r"\[(?:[^\[\]]*)\]", line)[-2]
            over_chunks = "__chunk" in re.findall(r"\[(?:[^\[\]]*)\]", line)[-1]
            assert "__chunk" in by or over_chunks, line
    biggest = lambda width: skewed.groupBy("patient_id", trace.chunk(F.col("ts"), width)).count().agg(F.max("count")).first()[0]
    assert biggest(trace.WEEK) < skewed.count() / 2 and biggest(30 * HOUR) < skewed.count() / 5


def test_metrics_and_episodes_of_a_skewed_cohort_equal_those_of_plain_windows(spark, skewed):
    w = Window.partitionBy("patient_id").orderBy("ts", "id")
    low = skewed.withColumn("low", F.col("sgv") < 70).withColumn("risen", F.sum(F.when(F.col("low"), 0).otherwise(1)).over(w)).where("low").withColumn("at", micros(F.col("ts")))
    new = (F.lag("risen").over(w) != F.col("risen")) & (F.col("at") - F.lag("at").over(w) >= 15 * 60_000_000)
    runs = low.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(w)).groupBy("patient_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    want = runs.where((micros(F.col("end")) - micros(F.col("start"))) >= 15 * 60_000_000).select("patient_id", "start", "end", "n")
    carbs = spark.createDataFrame([], "patient_id long, ts timestamp, carbs double")
    got = episodes.hypo_episodes(skewed, carbs).select("patient_id", "start", "end", "n")
    assert got.count() > 20
    same(got, want)
    turn = skewed.select("patient_id", "ts", "id", "sgv", F.lag("sgv").over(w).alias("a"), F.lead("sgv").over(w).alias("b"))
    same(variability.turning_points(skewed), turn.where("(sgv > a and sgv >= b) or (sgv < a and sgv <= b)"))


def test_shifted_metrics_of_one_probe_table_equal_single_ones(skewed):
    all_ = {r["patient_id"]: r for r in variability.glucose_variability(skewed).collect()}
    for name, one in (("modd", variability.modd(skewed)), ("conga_1h", variability.conga(skewed, 1)), ("conga_4h", variability.conga(skewed, 4)), ("mage", variability.mage(skewed)), ("gvp", variability.gvp(skewed)), ("cogi", metrics.cogi(skewed)), ("m_value", metrics.m_value(skewed))):
        for r in one.collect():
            assert r[name] == pytest.approx(all_[r["patient_id"]][name], abs=1e-9), name


def test_equal_left_rows_of_an_interval_aggregate_stay_apart(spark):
    at = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, at, {"k": 1})] * 2, "patient_id long, ts timestamp, m map<string, int>")
    right = spark.createDataFrame([(1, at, 5), (1, at, 6)], "patient_id long, ts timestamp, v int")
    got = timejoin.interval_agg(left, right, lo=micros(F.col("ts")), hi=micros(F.col("ts")), columns=["v"], aggregates={"s": F.sum("r_v")}).collect()
    assert [(r["m"], r["s"]) for r in got] == [({"k": 1}, 11)] * 2


def test_shifted_equals_brute_force_and_enters_no_probe_by_offset(spark):
    import random
    from datetime import datetime, timedelta, timezone

    from sweetframe.operators import variability

    rnd, start = random.Random(3), datetime(2024, 1, 3, tzinfo=timezone.utc)
    rows = [(rnd.randint(1, 2), f"i{k}", start + timedelta(seconds=rnd.choice([rnd.randint(0, 1_300_000), rnd.randint(80_000, 90_000), 600_000])), rnd.randint(40, 300)) for k in range(2_000)]
    rows += [(1, "i5", start, 77), (1, None, start, 70), (2, "early", datetime(1969, 12, 31, 23, tzinfo=timezone.utc), 90), (2, "eve", datetime(1970, 1, 1, 0, 2, tzinfo=timezone.utc), 95)]
    minute = lambda t: int(t.timestamp() // 60)
    last = {}
    for p, i, t, v in rows:
        last[p, minute(t)] = max(last.get((p, minute(t)), (t, "", -1)), (t, i or "", v))
    for lags in (variability.LAGS, {"near": 2}):
        want = {}
        for p, i, t, v in rows:
            for name, m in lags.items():
                hit = next(((o, last[p, minute(t) - m + o][2], v) for o in range(-5, 6) if (p, minute(t) - m + o) in last), None)
                if hit:
                    want[p, i, name] = min(want.get((p, i, name), hit), hit)
        found = variability.shifted(spark.createDataFrame(rows, "patient_id long, id string, ts timestamp, sgv int").repartition(5), lags)
        assert sorted(map(tuple, found.collect())) == sorted((p, name, past, now) for (p, _, name), (_, past, now) in want.items())
        assert found._jdf.queryExecution().optimizedPlan().toString().count("offset") <= 4 * len(lags) + 4  # 11 of each lag before
