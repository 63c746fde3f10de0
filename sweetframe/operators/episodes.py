"""Episodes and events in the trace: hypoglycemia, compression lows and change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import iso_z, local, micros
from sweetframe.operators import greedy, trace
from sweetframe.operators.timejoin import MINUTE, interval_anti, interval_flag
from sweetframe.scratch import written


def hypo_episodes(readings: DataFrame, treatments: DataFrame, tz: str = "UTC", merge_min: int = 15, least_min: int = 15) -> DataFrame:
    """Runs of readings below 70 that last at least 15 whole minutes from the first low to the last.

    Runs merge where less than 15 minutes lie between their lows; a gap without any reading doesn't end a run. A low begins
    a run if the reading before it isn't low and the low before it is long past; the runs' first lows are carried forward.
    """
    near = trace.beside(readings.select("patient_id", "ts", "id", "sgv"), ["sgv"])
    lows = near.where("sgv < 70").select("patient_id", "ts", "id", "sgv", (F.col("before.sgv") < 70).alias("goes_on"))
    after_low = trace.beside(lows, ["ts"])
    begins = F.col("before").isNull() | (~F.col("goes_on") & (micros(F.col("ts")) - micros(F.col("before.ts")) >= merge_min * MINUTE))
    marked = after_low.withColumn("begins", F.coalesce(begins, F.lit(False)))
    runs = trace.last_so_far(marked, F.when(F.col("begins"), F.struct("ts", "id")), "run")
    nadir = F.min(F.struct("sgv", "ts", "id"))
    got = runs.groupBy("patient_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), nadir.alias("low"), F.count("*").alias("n"))
    minutes = F.floor((micros(F.col("end")) - micros(F.col("start"))) / MINUTE).cast("long")
    got = got.withColumn("minutes", minutes).where(F.col("minutes") >= least_min)
    flat = got.select("patient_id", F.col("start").alias("ts"), "end", "minutes", F.col("low.sgv").alias("nadir"), F.col("low.ts").alias("nadir_ts"), "n", F.concat_ws(":", "patient_id", "run.id").alias("id"))
    flat = flat.withColumn("level", F.when(F.col("nadir") < 54, 2).otherwise(1)).withColumn("nocturnal", F.hour(local(F.col("nadir_ts"), tz)) < 6)
    carbs = treatments.where("carbs > 0").select("patient_id", "ts")
    flat = interval_flag(flat, carbs, "rescue", lo=micros(F.col("ts")) - 15 * MINUTE, hi=micros(F.col("end")) + 15 * MINUTE)
    return flat.select("patient_id", F.col("ts").alias("start"), "end", "minutes", "nadir", "nadir_ts", "n", "level", "nocturnal", "rescue")


def hypo_report(episodes: DataFrame, readings: DataFrame, days: int = 30) -> DataFrame:
    """Counts, rates and durations; patients without episodes included."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    patients = readings.groupBy("patient_id").agg(F.count("*").alias("readings"))
    got = patients.join(episodes, "patient_id", "left").groupBy("patient_id", "readings").agg(
        F.count("start").alias("episodes"), count(F.col("level") == 1).alias("level_1"), count(F.col("level") == 2).alias("level_2"), count(F.col("nocturnal")).alias("nocturnal"), count(F.col("rescue")).alias("with_rescue"),
        F.coalesce(F.avg("minutes"), F.lit(0.0)).alias("mean_minutes"), F.coalesce(F.sum("minutes"), F.lit(0)).alias("total_minutes"),
    )
    active = F.least(F.lit(100.0), 100.0 * F.col("readings") / (288 * max(1, days)))
    return got.withColumn("per_week", F.col("episodes") / max(1, days) * 7).withColumn("pct_active", active).withColumn("undercounted", F.col("pct_active") < 70)


_BLOCK = 4_096  # places of a trace that are looked at together
_SPAN = 6  # places that a candidate looks ahead, so that it recovers at most so many after its first


def _blocks(rows: DataFrame, place: str, before: int, after: int) -> DataFrame:
    """rows by ``__block`` of places, each block with so many places of its neighbours; ``__own`` where a row is of the block itself."""
    block = F.floor(F.col(place) / _BLOCK)
    near = F.array_distinct(F.array(block, F.floor((F.col(place) + before) / _BLOCK), F.floor((F.col(place) - after) / _BLOCK)))
    return rows.withColumn("__block", F.explode(near)).withColumn("__own", F.col("__block") == block)


def compression_candidates(readings: DataFrame, treatments: DataFrame) -> DataFrame:
    """Sharp falls below 70 that recover as sharply within half an hour, without carbs near the nadir.

    (patient_id, first, recovery, id, ts, nadir_ts, nadir, fall, rise); first and recovery are places in the trace. Readings
    are looked at in blocks of places, which have the few places after them too.
    """
    placed = trace.numbered(readings.select("patient_id", "id", "ts", "sgv")).withColumn("place", F.col("place").cast("int"))
    w = Window.partitionBy("patient_id", "__block").orderBy("place")
    row = F.struct(F.col("sgv").alias("v"), micros(F.col("ts")).alias("at"))
    ahead = F.array(*[F.lead(F.struct(F.col("v"), F.col("at"), F.lit(k).alias("k")), k).over(w) for k in range(1, _SPAN + 1)])
    rows = _blocks(placed, "place", 0, _SPAN).select("patient_id", "id", "ts", "place", "__block", "__own", row.alias("r")).select("patient_id", "id", "ts", "place", "__block", "__own", "r.v", "r.at")
    rows = rows.withColumn("ahead", ahead).where("__own")
    low = F.array_min(F.transform(F.array_compact(F.slice("ahead", 1, 3)), lambda x: F.struct(x["v"], x["k"], x["at"])))
    rows = rows.withColumn("low", low).where("low is not null").withColumn("fall", F.col("v") - F.col("low.v"))
    minutes = lambda a, b: (a - b) / MINUTE
    down = minutes(F.col("low.at"), F.col("at"))
    rows = rows.where((F.col("fall") >= 30) & (F.col("low.v") < 70) & (down > 0) & (F.col("fall") >= 2 * down))
    after = F.filter(F.array_compact(F.slice("ahead", F.col("low.k") + 1, 3)), lambda x: x["v"].isNotNull())
    high = F.array_max(F.transform(after, lambda x: F.struct(x["v"], (-x["k"]).alias("back"), x["at"])))
    rows = rows.withColumn("high", high).where("high is not null").withColumn("rise", F.col("high.v") - F.col("low.v"))
    up = minutes(F.col("high.at"), F.col("low.at"))
    rows = rows.where((F.col("rise") >= 30) & (up > 0) & (F.col("rise") >= 2 * up) & (minutes(F.col("high.at"), F.col("at")) <= 30))
    found = rows.select("patient_id", "place", (F.col("place") - F.col("high.back")).alias("recovery"), "id", "ts", F.timestamp_micros("low.at").alias("nadir_ts"), F.col("low.v").alias("nadir"), "fall", "rise")
    at = micros(F.col("nadir_ts"))
    return interval_anti(found, treatments.where("carbs > 10").select("patient_id", "ts"), lo=at - 15 * MINUTE, hi=at + 15 * MINUTE).withColumnRenamed("place", "first")


def compression_lows(candidates: DataFrame) -> DataFrame:
    """Of overlapping candidates the earliest: the next one starts after its recovery.

    Candidates that no earlier one overlaps are chosen anyway; each points to the first one after its recovery. Both lie
    within a few places, as a candidate recovers at most six places after its first.
    """
    candidates = written(candidates)
    w = Window.partitionBy("patient_id", "__block").orderBy("first")
    near = _blocks(candidates.select("patient_id", "first", "recovery"), "first", _SPAN, 2 * _SPAN)
    reached = F.max("recovery").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = near.withColumn("free", F.coalesce(reached < F.col("first"), F.lit(True)))
    ahead = F.array_compact(F.array(*[F.lead(F.struct("first", "free"), k).over(w) for k in range(1, _SPAN + 2)]))
    later = F.get(F.filter(ahead, lambda x: x["first"] > F.col("recovery")), F.lit(0))
    pointers = marked.withColumn("later", later).where("__own").select("patient_id", "first", F.when(~F.col("later.free"), F.col("later.first")).alias("next"), "free")
    kept = greedy.chosen(pointers.select("patient_id", F.col("first").alias("place"), "next", F.col("free").alias("first")))
    return candidates.join(kept.withColumnRenamed("place", "first"), ["patient_id", "first"], "left_semi").select(candidates.columns)


def change_point_signal(series: DataFrame, sigma: float, value: str = "value", least: int = 30) -> DataFrame:
    """The mean shift at each place of a series (patient_id, ts, value): mean of the W values from there on, less that of
    the W before; W is a twelfth of the series, at least 10. Only places whose shift exceeds sigma standard deviations.
    """
    values = series.select("patient_id", "ts", F.col(value).alias("v"))
    whole = values.groupBy("patient_id").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd")).where(F.col("n") >= least)
    rows = trace.numbered(values, {"sum": F.col("v")}, order=("ts",)).join(whole, "patient_id")
    rows = rows.select("patient_id", "ts", (F.col("place") - 1).alias("i"), "n", "sd", F.greatest(F.lit(10), F.floor(F.col("n") / 12)).cast("long").alias("w"), (F.col("sum") - F.col("v")).alias("sum"))
    rows = written(rows)
    # the sum of all before place i, at i - W, i and i + W
    def at(place: Column, name: str) -> DataFrame:
        return rows.select("patient_id", place.alias("i"), F.col("sum").alias(name))

    both = rows.join(at(F.col("i") + F.col("w"), "s_back"), ["patient_id", "i"]).join(at(F.col("i") - F.col("w"), "s_ahead"), ["patient_id", "i"])
    shift = (F.col("s_ahead") - 2 * F.col("sum") + F.col("s_back")) / F.col("w")
    got = both.where(F.col("i") < F.col("n") - F.col("w")).withColumn("shift", F.round(shift, 9))
    return got.where(F.abs("shift") > sigma * F.col("sd")).select("patient_id", "ts", "i", "w", "n", "shift", "sd")


def change_points(signal: DataFrame) -> DataFrame:
    """The largest shift of each stretch of W places over the threshold; the search goes on W places after it.

    Each place's best is the best of what its block of W places has from there on, and of what the next block has before the
    stretch ends. It points to the first place W after that best. A place with none in the W before it starts a stretch in any case.
    """
    s = written(signal.select("patient_id", "i", "w", "ts", "shift"))
    block = lambda place: F.floor(place / F.col("w"))
    rank = F.struct(F.abs("shift").alias("size"), (-F.col("i")).alias("back"))
    rows = s.select("patient_id", "i", "w", block(F.col("i")).alias("block"), rank.alias("rank"), (F.col("i") - F.lag("i").over(Window.partitionBy("patient_id", block(F.col("i"))).orderBy("i"))).alias("gap"))
    by = Window.partitionBy("patient_id", "block")
    upto, onward = by.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow), by.orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # the best of the own block from each place on, and of the next block before i + W
    own = rows.withColumn("own", F.max("rank").over(by.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.col("i") + F.col("w") - 1
    known = rows.select("patient_id", "block", F.col("i").alias("at"), F.lit(0).alias("asks"), "rank", F.lit(None).cast("long").alias("i"))
    asked = rows.where(block(last) > F.col("block")).select("patient_id", block(last).alias("block"), last.alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("struct<size: double, back: bigint>").alias("rank"), "i")
    ahead = known.unionByName(asked).withColumn("ahead", F.max("rank").over(upto)).where("asks = 1").select("patient_id", "i", "ahead")
    best = own.join(ahead, ["patient_id", "i"], "left").select("patient_id", "i", "w", "block", "gap", (-F.greatest("own", F.coalesce("ahead", "own"))["back"]).alias("best"))
    best = written(best)

    # whether a place starts a stretch, and the first place from best + W on, within this block or the next
    ends = best.groupBy("patient_id", "block").agg(F.min("i").alias("head"), F.max("i").alias("tail"))
    tails = ends.select("patient_id", (F.col("block") + 1).alias("block"), F.col("tail").alias("last_tail"))
    heads = ends.select("patient_id", (F.col("block") - 1).alias("block"), F.col("head").alias("next_head"))
    before = F.coalesce("gap", F.col("i") - F.col("last_tail"))
    starts = best.join(tails, ["patient_id", "block"], "left").select("patient_id", "i", "w", "block", "best", F.coalesce(before >= F.col("w"), F.lit(True)).alias("first"))
    target = F.col("best") + F.col("w")
    known = best.select("patient_id", "block", F.col("i").alias("at"), F.lit(0).alias("asks"), F.col("i").alias("found"), F.lit(None).cast("long").alias("i"))
    asked = best.select("patient_id", block(target).alias("block"), target.alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("found"), "i")
    inside = known.unionByName(asked).withColumn("found", F.min("found").over(onward)).where("asks = 1")
    found = inside.join(heads, ["patient_id", "block"], "left").select("patient_id", "i", F.coalesce("found", "next_head").alias("next"))
    pointers = starts.join(found, ["patient_id", "i"]).select("patient_id", F.col("i").alias("place"), "next", "first", "best")
    pointers = written(pointers)
    kept = greedy.chosen(pointers).join(pointers, ["patient_id", "place"]).select("patient_id", F.col("best").alias("i"))
    got = kept.distinct().join(s, ["patient_id", "i"])
    return got.select("patient_id", F.col("i").alias("place"), "ts", "shift", F.when(F.col("shift") > 0, "up").otherwise("down").alias("direction"))


def with_switches(points: DataFrame, switches: DataFrame) -> DataFrame:
    """points with the patient's profile switches: their number, the newest one's time and, as text, all times in order."""
    times = F.array_join(F.transform(F.sort_array(F.collect_list("ts")), iso_z), ",")
    listed = switches.groupBy("patient_id").agg(F.count("*").alias("switches"), F.max("ts").alias("last_switch"), times.alias("switch_times"))
    return points.join(listed, "patient_id", "left").withColumn("switches", F.coalesce("switches", F.lit(0)).cast("long"))
