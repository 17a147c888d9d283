"""Column functions of the interval analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Kyiv"
DAY_MINUTES, WINDOW_MINUTES, RECOVERY_MINUTES = 1440, 540, 480


def local_time(ts: Column, zone: str = ZONE) -> Column:
    """Wall clock of a UTC instant that is held without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def micros_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def overlap_minutes(s: Column, e: Column, ws: Column, we: Column) -> Column:
    """Minutes of [s, e) inside [ws, we); 0 where either is empty or inverted."""
    inside = F.greatest(F.lit(0), micros_between(F.greatest(s, ws), F.least(e, we))) / 6e7
    return F.when((e <= s) | (we <= ws), 0.0).otherwise(inside)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x held between lo and hi; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, null where either is null, d is 0, or the result isn't finite."""
    q = F.try_divide(n.cast("double"), d.cast("double"))
    return F.when(F.isnan(q) | (F.abs(q) == float("inf")), None).otherwise(q)


def category(x: Column) -> Column:
    return F.when(x < 0.33, "low").when(x < 0.66, "medium").when(x.isNotNull(), "high").otherwise("low")


def volatility_label(std: Column) -> Column:
    x = finite_or_zero(std)
    return F.when(x < 60, "low").when(x < 180, "medium").otherwise("high")


def trend_label(early: Column, late: Column, early_index: Column, late_index: Column) -> Column:
    d, i = finite_or_zero(late) - finite_or_zero(early), finite_or_zero(late_index) - finite_or_zero(early_index)
    still = (F.abs(d) < 30) & (F.abs(i) < 0.03)
    return F.when(still, "stable").when((d >= 30) & (i >= 0.03), "worsening").when((d <= -30) & (i <= -0.03), "improving").otherwise("mixed")


def shift_label(n: Column) -> Column:
    return F.when(n <= 0, "no clear statistical shift").when(n >= 2, "repeated statistical shifts").otherwise("possible statistical shift")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def is_night(hour: Column) -> Column:
    return (hour >= 22) | (hour < 7)


def is_work(hour: Column, weekday: Column) -> Column:
    return (weekday < 5) & (hour >= 9) & (hour < 18)
