"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mmol(mgdl: Column) -> Column:
    return F.round(mgdl / 18.0, 1)


def mgdl(mmol: Column) -> Column:
    return F.bround(mmol * 18.0).cast("int")


def pct(condition: Column) -> Column:
    """Aggregate: the share of rows that meet the condition, in percent."""
    return 100.0 * F.sum(F.when(condition, 1).otherwise(0)) / F.count(F.lit(1))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, in percent, within [0, 100]; 0 for no rows."""
    p, zz = successes / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)
    inside = lambda x: F.when(n > 0, 100.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(0.0)
    return inside(centre - half), inside(centre + half)


def risk(bg: Column) -> Column:
    """The symmetrised glucose scale; negative for low values."""
    return 1.509 * (F.pow(F.log(bg), F.lit(1.084)) - 5.381)


def low_risk(bg: Column) -> Column:
    f = risk(bg)
    return F.when(f < 0, 10.0 * f * f).otherwise(0.0)


def high_risk(bg: Column) -> Column:
    f = risk(bg)
    return F.when(f > 0, 10.0 * f * f).otherwise(0.0)


def band(value: Column, cuts: list[tuple[float, str]], last: str) -> Column:
    """The name of the first cut that value lies below."""
    out = F.when(value < cuts[0][0], cuts[0][1])
    for cut, name in cuts[1:]:
        out = out.when(value < cut, name)
    return F.when(value.isNotNull(), out.otherwise(last))


def bg_band(bg: Column) -> Column:
    return band(bg, [(70, "below_70"), (100, "70_100"), (140, "100_140"), (180, "140_180"), (250, "180_250")], "over_250")


def target_band(bg: Column) -> Column:
    return band(bg, [(100, "below_target"), (180, "in_target")], "above_target")


def time_band(hour: Column) -> Column:
    return band(hour, [(6, "overnight"), (12, "morning"), (18, "afternoon")], "evening")


def confidence(n: Column) -> Column:
    return F.when(n < 3, "low").when(n < 8, "medium").otherwise("high")


def local(ts: Column, tz: str | Column = "UTC") -> Column:
    """The local time; tz is a zone or a column of zones."""
    return ts if isinstance(tz, str) and tz == "UTC" else F.from_utc_timestamp(ts, tz)


def iso_z(ts: Column) -> Column:
    """The time as text, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def insulin_left(minutes: Column, dia_hours: Column, peak: Column) -> Column:
    """The share of a bolus still active, on the exponential activity curve."""
    td = dia_hours * 60.0
    tp = F.when(F.abs(1 - 2 * peak / td) < 1e-9, peak * 0.99).otherwise(peak)
    tau = tp * (1 - tp / td) / (1 - 2 * tp / td)
    a = 2 * tau / td
    s = 1 / (1 - a + (1 + a) * F.exp(-td / tau))
    left = 1 - s * (1 - a) * ((minutes * minutes / (tau * td * (1 - a)) - minutes / tau - 1) * F.exp(-minutes / tau) + 1)
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))
    return F.when(minutes < 0, 1.0).when(minutes >= td, 0.0).when(tau <= 0, 1.0).otherwise(held)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function for z >= 0, by a polynomial in 1 / (1 + 0.2316419 z)."""
    t = 1 / (1 + 0.2316419 * z)
    # The coefficients of the approximation.
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.31938153):
        poly = t * (F.lit(c) + poly)
    return 1 - F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly


def two_proportion_p(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """Two-sided p-value of the pooled z-test; 1 for empty or constant samples."""
    pool = (s1 + s2) / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    z = F.abs(s1 / n1 - s2 / n2) / se
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - normal_cdf(z))))
    return F.when((n1 == 0) | (n2 == 0), 1.0).when(se == 0, 1.0).otherwise(p)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return ~((hi1 < lo2) | (hi2 < lo1))
