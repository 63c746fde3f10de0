"""Variability metrics that need the order of readings or their value a day or some hours before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import micros
from sweetframe.operators import metrics, trace
from sweetframe.scratch import written


_STEP = {  # a: the reading before, b: the reading; steps of no time don't count
    "sum_length": lambda dt, dv: F.when(dt > 0, F.sqrt(dt * dt + dv * dv)),
    "sum_time": lambda dt, dv: F.when(dt > 0, dt),
}


def gvp(readings: DataFrame) -> DataFrame:
    """Glycemic variability percentage: how much longer the trace is than a flat one."""
    dt, dv = (micros(F.col("b.ts")) - micros(F.col("a.ts"))) / 6e7, F.col("b.sgv") - F.col("a.sgv")
    sums = trace.steps(readings, {k: f(dt, dv) for k, f in _STEP.items()}, columns=("ts", "sgv"))
    return sums.select("patient_id", F.coalesce((F.col("sum_length") / F.nullif("sum_time", F.lit(0.0)) - 1) * 100, F.lit(0.0)).alias("gvp"))


def turning_points(readings: DataFrame) -> DataFrame:
    """(patient_id, ts, id, sgv) where the trace turns; of a level top or bottom the first reading."""
    near = trace.beside(readings.select("patient_id", "ts", "id", "sgv"), ["sgv"])
    v, before, after = F.col("sgv"), F.col("before.sgv"), F.col("after.sgv")
    return near.where(((v > before) & (v >= after)) | ((v < before) & (v <= after))).select("patient_id", "ts", "id", "sgv")


def mage(readings: DataFrame, threshold_sd: float = 1.0) -> DataFrame:
    """Mean amplitude of the excursions between turning points that exceed the standard deviation."""
    sd = readings.groupBy("patient_id").agg(F.stddev_samp("sgv").alias("sd"))
    return _mage(turning_points(readings), sd, threshold_sd)


def _mage(turns: DataFrame, sd: DataFrame, threshold_sd: float = 1.0) -> DataFrame:
    """turns: turning points; sd: (patient_id, sd) of all patients."""
    swings = trace.beside(turns, ["sgv"]).select("patient_id", F.abs(F.col("sgv") - F.col("before.sgv")).alias("swing"))
    mean = swings.join(sd, "patient_id").groupBy("patient_id").agg(F.avg(F.when(F.col("swing") > threshold_sd * F.col("sd"), F.col("swing"))).alias("m"))
    return sd.join(mean, "patient_id", "left").select("patient_id", F.coalesce("m", F.lit(0.0)).alias("mage"))


#: Minutes back that the shifted metrics compare with, by name.
LAGS = {"modd": 24 * 60, "conga_1h": 60, "conga_2h": 120, "conga_4h": 240}


def shifted(readings: DataFrame, lags: dict[str, int] = LAGS, slack: int = 5) -> DataFrame:
    """(patient_id, lag, now, past): each reading's value and that of some minutes before, the first hit from -slack to +slack.

    The last readings of the minutes are few rows, cut into weeks of a patient; those that later minutes look back to are
    copied into the week after. One window for each lag finds the first hit there, and each reading meets its minute once.
    """
    own = readings.where("ts is not null").select("patient_id", "id", "ts", F.col("sgv").alias("now"), F.floor(micros(F.col("ts")) / 60_000_000).alias("minute"))
    by_minute = own.groupBy("patient_id", "minute").agg(F.max(F.struct("ts", "id", "now")).alias("last")).select("patient_id", "minute", F.col("last.now").alias("past"))
    back, ahead = max(lags.values()) + slack, slack - min(lags.values())
    width = max(trace.WEEK // 60_000_000, back, ahead)
    at = F.floor(F.col("minute") / width)
    places = F.array(at, F.when(F.col("minute") + back >= (at + 1) * width, at + 1), F.when(F.col("minute") - ahead < at * width, at - 1))
    near = Window.partitionBy("patient_id", "chunk").orderBy("minute")
    placed = by_minute.select("patient_id", "minute", "past", at.alias("at"), F.explode(F.array_compact(places)).alias("chunk"))
    hits = placed.select("patient_id", "minute", "at", "chunk", *[F.first(F.struct("minute", "past")).over(near.rangeBetween(-m - slack, slack - m)).alias(name) for name, m in lags.items()]).where("chunk = at")
    met = own.join(hits.select("patient_id", "minute", *lags), ["patient_id", "minute"])
    first = lambda name: F.min(F.when(F.col(name).isNotNull(), F.struct((F.col(f"{name}.minute") - F.col("minute")).alias("offset"), F.col(f"{name}.past").alias("past"), F.col("now")))).alias(name)
    found = met.groupBy("patient_id", "id").agg(*[first(name) for name in lags])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("lag"), F.col(name).alias("m")) for name in lags]))
    return found.select("patient_id", each.alias("x")).where("x.m is not null").select("patient_id", "x.lag", "x.m.past", "x.m.now")


def _gated(counted: DataFrame, pairs: DataFrame, names: list[str], least_matches: int = 10) -> DataFrame:
    """The shifted metrics and their numbers of matches, 0 where there are too few. counted: (patient_id, n)."""
    d = F.col("now") - F.col("past")
    of = lambda name, x: F.when(F.col("lag") == name, x)
    value = {n: F.avg(of(n, F.abs(d))) if n == "modd" else F.stddev_samp(of(n, d)) for n in names}
    got = pairs.groupBy("patient_id").agg(*[v.alias(n) for n, v in value.items()], *[F.count(of(n, d)).alias(f"matches_{n}") for n in names])
    enough = {n: (F.col("n") >= (50 if n == "modd" else 20)) & (F.col(f"matches_{n}") >= least_matches) for n in names}
    out = counted.select("patient_id", "n").join(got, "patient_id", "left")
    return out.select("patient_id", *[F.when(enough[n], F.col(n)).otherwise(0.0).alias(n) for n in names], *[F.coalesce(f"matches_{n}", F.lit(0)).cast("long").alias(f"matches_{n}") for n in names])


def _one(readings: DataFrame, name: str, minutes: int) -> DataFrame:
    counted = readings.groupBy("patient_id").agg(F.count("*").alias("n"))
    return _gated(counted, shifted(readings, {name: minutes}), [name]).withColumnRenamed(f"matches_{name}", "matches")


def modd(readings: DataFrame) -> DataFrame:
    """Mean absolute difference to the reading of a day before."""
    return _one(readings, "modd", 24 * 60)


def conga(readings: DataFrame, hours: int) -> DataFrame:
    """Standard deviation of the differences to the reading of some hours before."""
    return _one(readings, f"conga_{hours}h", hours * 60)


def glucose_variability(readings: DataFrame) -> DataFrame:
    """All variability metrics in one row for each patient.

    The readings' four columns are written once and read by the one-row aggregates, the turning points, the steps and the
    minutes.
    """
    r = written(readings.select("patient_id", "ts", "id", "sgv"))
    sums = written(metrics.one_pass(r))
    out = sums.select("patient_id", "cv_percent", "j_index", "m_value", "cogi")
    for part in (_mage(turning_points(r), sums.select("patient_id", "sd")), gvp(r), _gated(sums, shifted(r), list(LAGS))):
        out = out.join(part, "patient_id")
    return out.select("patient_id", "cv_percent", "mage", "modd", "j_index", "m_value", "gvp", "conga_1h", "conga_2h", "conga_4h", "cogi")
