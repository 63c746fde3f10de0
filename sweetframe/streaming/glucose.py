"""Structured Streaming variants: deduplicated readings, windowed time in range, hypoglycemia episodes, interval joins of
treatments and readings, and alerts for silent sensors.

Late rows beyond the watermark are dropped; apart from them the results equal those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sweetframe.operators import outcomes

WATERMARK = "30 minutes"
EPISODE = "patient_id long, start timestamp, end timestamp, minutes long, nadir int, level int"


def valid_stream(readings: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Valid readings, each id once within the watermark."""
    return readings.where("type = 'sgv' and sgv > 0").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["patient_id", "id"])


def windowed_tir(readings: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Time in range by patient and tumbling or sliding window."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    v = F.col("sgv")
    share = lambda c: (100.0 * F.sum(F.when(c, 1).otherwise(0)) / F.count(F.lit(1)))
    got = readings.groupBy(window.alias("w"), "patient_id").agg(F.count(F.lit(1)).alias("n"), F.avg("sgv").alias("mean_mgdl"), share(v.between(70, 180)).alias("tir_percent"), share(v < 70).alias("tbr_percent"))
    return got.select("patient_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_mgdl", "tir_percent", "tbr_percent")


def hypo_episodes(readings: DataFrame, merge_min: int = 15, least_min: int = 15) -> DataFrame:
    """Episodes as their runs close: when a later low begins a new run, or the watermark passes the run by a day.

    State by patient: the open run (first low, last low, nadir), whether glucose has risen since, and rows that the
    watermark hasn't passed yet, so that rows within it may come in any order.
    """
    merge, least, quiet = merge_min * 60_000, least_min * 60_000, 86_400_000

    def closed(key: int, run: tuple[int, int, int]) -> dict | None:
        first, last, nadir = run
        if last - first < least:
            return None
        return {"patient_id": key, "start": pd.Timestamp(first, unit="ms"), "end": pd.Timestamp(last, unit="ms"), "minutes": (last - first) // 60_000, "nadir": nadir, "level": 2 if nadir < 54 else 1}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, nadir, risen, ts, sgv = state.get if state.exists else (-1, -1, 0, False, [], [])
        rows = list(zip(ts, sgv, strict=True))
        for pdf in batches:
            rows += zip((pdf["ts"].astype("datetime64[us]").astype("int64") // 1_000).tolist(), pdf["sgv"].tolist(), strict=True)
        passed, out = state.getCurrentWatermarkMs(), []
        for at, value in sorted(r for r in rows if r[0] <= passed):
            if value >= 70:
                risen = True
            elif first < 0:
                first, last, nadir, risen = at, at, value, False
            elif risen and at - last >= merge:
                out.append(closed(key[0], (first, last, nadir)))
                first, last, nadir, risen = at, at, value, False
            else:
                last, nadir, risen = at, min(nadir, value), False
        if first >= 0 and risen and passed - last >= quiet:
            out.append(closed(key[0], (first, last, nadir)))
            first = -1
        waiting = [r for r in rows if r[0] > passed]
        state.update((first, last, nadir, risen, [r[0] for r in waiting], [r[1] for r in waiting]))
        if waiting or first >= 0:
            state.setTimeoutTimestamp(max(passed + 1, waiting[0][0] if waiting else last + quiet))
        found = [x for x in out if x]
        if found:
            yield pd.DataFrame(found)

    return readings.groupBy("patient_id").applyInPandasWithState(
        step, EPISODE, "first long, last long, nadir int, risen boolean, ts array<long>, sgv array<int>", "append", GroupStateTimeout.EventTimeTimeout
    )


def isolated_corrections(treatments: DataFrame, minutes: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """Correction boluses without carbs within ``minutes`` before or after, carbs of the very same time aside.

    An outer stream-stream join on patient and time: a bolus without carbs comes out once the watermark has passed its
    interval. Both sides are the one stream of treatments, (patient_id, id, ts, event_type, insulin, carbs).
    """
    boluses = outcomes.correction_boluses(treatments).select("patient_id", "id", "ts", "insulin").withWatermark("ts", watermark)
    carbs = treatments.where("carbs > 0").select(F.col("patient_id").alias("by"), F.col("ts").alias("at")).withWatermark("at", watermark)
    reach = F.expr(f"INTERVAL {minutes} MINUTES")
    near = (F.col("patient_id") == F.col("by")) & (F.col("at") >= F.col("ts") - reach) & (F.col("at") <= F.col("ts") + reach) & (F.col("at") != F.col("ts"))
    return boluses.join(carbs, near, "left_outer").where("at is null").select("patient_id", "id", "ts", "insulin")


def post_bolus_min(boluses: DataFrame, readings: DataFrame, hours: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """(patient_id, id, ts, min_bg): the least reading after each bolus up to some hours; null where there is none.

    An interval join of two streams under watermarks, left outer, then an aggregate by bolus, whose time is the event time
    of both: a bolus comes out once the watermark has passed its interval. readings have a watermark, as of ``valid_stream``.
    """
    left = boluses.select("patient_id", "id", "ts").withWatermark("ts", watermark)
    right = readings.select(F.col("patient_id").alias("by"), F.col("ts").alias("at"), "sgv")
    after = (F.col("patient_id") == F.col("by")) & (F.col("at") > F.col("ts")) & (F.col("at") <= F.col("ts") + F.expr(f"INTERVAL {hours} HOURS"))
    pairs = left.join(right, after, "left_outer")
    # the window is the bolus's own microsecond, so that its groups are one bolus each
    got = pairs.groupBy(F.window("ts", "1 microsecond").alias("w"), "patient_id", "id").agg(F.min("ts").alias("ts"), F.min("sgv").alias("min_bg"))
    return got.select("patient_id", "id", "ts", "min_bg")


GAP = "patient_id long, last timestamp, alerted_at timestamp"


def silent_sensors(readings: DataFrame, minutes: int = 15) -> DataFrame:
    """(patient_id, last, alerted_at) an alert for each gap: no reading for more than ``minutes`` after ``last``.

    A timer in the patient's state fires when the watermark passes ``last`` by so many minutes, also without a new row of
    the patient; one row a gap. State: the last reading, whether its silence was told, and the readings that the watermark
    hasn't passed yet.
    """
    quiet = minutes * 60_000_000  # times are in microseconds, the watermark and timers in milliseconds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, ts = state.get if state.exists else (-1, False, [])
        rows = list(ts)
        for pdf in batches:
            rows += (pdf["ts"].astype("datetime64[us]").astype("int64")).tolist()
        passed, out = state.getCurrentWatermarkMs() * 1_000, []
        for at in sorted(r for r in rows if r <= passed):
            if last >= 0 and at - last > quiet and not told:
                out.append(last)
            last, told = max(last, at), False
        waiting = [r for r in rows if r > passed]
        if last >= 0 and passed - last > quiet and not told:
            out.append(last)
            told = True
        state.update((last, told, waiting))
        if waiting or last >= 0 and not told:
            due = [min(waiting)] if waiting else []
            at = min(due + ([last + quiet + 1] if last >= 0 and not told else []))
            state.setTimeoutTimestamp(max(passed, at) // 1_000 + 1)
        if out:
            at = pd.to_datetime(pd.Series(out), unit="us")
            yield pd.DataFrame({"patient_id": key[0], "last": at, "alerted_at": at + pd.Timedelta(microseconds=quiet)})

    return readings.groupBy("patient_id").applyInPandasWithState(step, GAP, "last long, told boolean, ts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
