"""Composite indices, daily inequality and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import category, clip, finite_or_zero


def minmax(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with each column scaled over the whole table (new name -> column): one aggregate, joined as a single row."""
    x = {new: finite_or_zero(F.col(c).cast("double")) for new, c in columns.items()}
    ends = df.agg(*[f(v).alias(f"_{n}_{new}") for new, v in x.items() for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {new: F.when(F.col(f"_hi_{new}") == F.col(f"_lo_{new}"), 0.0).otherwise((v - F.col(f"_lo_{new}")) / (F.col(f"_hi_{new}") - F.col(f"_lo_{new}"))) for new, v in x.items()}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).drop(*ends.columns)


def indices(days: DataFrame) -> DataFrame:
    episodes = "merged_alert_episode_count" if "merged_alert_episode_count" in days.columns else "alert_count"
    free = F.coalesce("longest_alert_free_window_minutes", F.lit(1440.0))
    rows = days.withColumns({"_max": F.coalesce("max_alert_duration", F.lit(0.0)), "_strain": 1 - free / 1440})
    rows = minmax(rows, {"_m": "alert_minutes_total", "_e": episodes, "_d": "_max", "_r": "_strain"})
    burden = clip(0.5 * F.col("_m") + 0.2 * F.col("_e") + 0.2 * F.col("_d") + 0.1 * F.col("_r"), 0.0, 1.0)
    rows = rows.withColumns({
        "alert_burden_index": burden, "sleep_disruption_index": clip(F.col("alert_minutes_night") / 540, 0.0, 1.0), "workday_disruption_index": clip(F.col("alert_minutes_workday") / 540, 0.0, 1.0),
        "alert_free_window_share": clip(F.col("longest_alert_free_window_minutes") / 1440, 0.0, 1.0), "low_recovery_day": F.col("longest_alert_free_window_minutes") < 480,
    }).drop("_max", "_strain", "_m", "_e", "_d", "_r")
    return rows.withColumns({f"{a}_category": category(F.col(f"{b}_index")) for a, b in (("alert_burden", "alert_burden"), ("sleep_disruption", "sleep_disruption"), ("workday_disruption", "workday_disruption"))})


def _gini(x: str, place: str) -> Column:
    """Of a group's values x, not negative, and their places in order, from 1."""
    n, total = F.count(F.lit(1)), F.sum(x)
    g = (2 * F.sum(F.col(place) * F.col(x)) - (n + 1) * total) / (n * total)
    return F.when((total == 0) | (F.min(x) == F.max(x)), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), g)))


def _ratio(x: str, place: str, n: str) -> Column:
    """Mean of the top fifth over the mean of the bottom fifth (at least one row each); null over zero, 1 for zero over zero."""
    k = F.greatest(F.lit(1), F.ceil(F.col(n) / 5))
    top, bottom = F.avg(F.when(F.col(place) > F.col(n) - k, F.col(x))), F.avg(F.when(F.col(place) <= k, F.col(x)))
    return F.when((bottom == 0) & (top > 0), None).when(bottom == 0, 1.0).otherwise(F.try_divide(top, bottom))


def _ranked(df: DataFrame, by: str, values: dict[str, Column]) -> DataFrame:
    """by, each value, its place in the order of its group, and the group's size: one shuffle, however many values."""
    w = Window.partitionBy(by)
    rows = df.select(by, *[v.alias(name) for name, v in values.items()])
    return rows.withColumns({f"{name}_place": F.row_number().over(w.orderBy(name)) for name in values} | {"n": F.count(F.lit(1)).over(w)})


def gini_of(df: DataFrame, value: str, by: str, name: str) -> DataFrame:
    x = F.greatest(F.lit(0.0), finite_or_zero(F.col(value)))
    return _ranked(df, by, {"x": x}).groupBy(by).agg(_gini("x", "x_place").alias(name))


def top_bottom(df: DataFrame, value: str, by: str, name: str) -> DataFrame:
    return _ranked(df, by, {"x": finite_or_zero(F.col(value))}).groupBy(by).agg(_ratio("x", "x_place", "n").alias(name))


def daily_inequality(days: DataFrame) -> DataFrame:
    """Gini indices of minutes and burden, and top over bottom of minutes, by date. The places of the minutes serve both: negative
    ones are zero for the index, which leaves their order as it is."""
    minutes, index = finite_or_zero(F.col("alert_minutes_total")), F.greatest(F.lit(0.0), finite_or_zero(F.col("alert_burden_index")))
    rows = _ranked(days, "date", {"x": minutes, "b": index}).withColumn("m", F.greatest(F.lit(0.0), F.col("x")))
    return rows.groupBy("date").agg(_gini("m", "x_place").alias("gini_alert_minutes_total"), _gini("b", "b_place").alias("gini_alert_burden_index"), _ratio("x", "x_place", "n").alias("top_bottom_alert_minutes_ratio"))


def region_day_metrics(days: DataFrame) -> DataFrame:
    rows = indices(days)
    return rows.join(daily_inequality(rows), "date", "left").select(*rows.columns, "gini_alert_minutes_total", "gini_alert_burden_index", "top_bottom_alert_minutes_ratio")


def region_summary(rows: DataFrame) -> DataFrame:
    c, f = F.col, F
    out = rows.groupBy("region_id", "region_name").agg(
        f.min("date").alias("date_start"), f.max("date").alias("date_end"), f.count(f.lit(1)).alias("days_count"),
        f.sum("alert_minutes_total").alias("total_alert_minutes"), f.avg("alert_minutes_total").alias("mean_daily_alert_minutes"), f.median("alert_minutes_total").alias("median_daily_alert_minutes"), f.max("alert_minutes_total").alias("max_daily_alert_minutes"),
        f.sum("alert_count").alias("total_alert_count"), f.avg("alert_count").alias("mean_daily_alert_count"), f.sum("alert_minutes_night").alias("total_night_alert_minutes"),
        f.avg("sleep_disruption_index").alias("mean_sleep_disruption_index"), f.count_if(c("sleep_disruption_category") == "high").alias("high_sleep_disruption_days"),
        f.sum("alert_minutes_workday").alias("total_workday_alert_minutes"), f.avg("workday_disruption_index").alias("mean_workday_disruption_index"), f.count_if(c("workday_disruption_category") == "high").alias("high_workday_disruption_days"),
        f.avg("alert_burden_index").alias("mean_alert_burden_index"), f.count_if(c("alert_burden_category") == "high").alias("high_alert_burden_days"), f.avg("longest_alert_free_window_minutes").alias("mean_longest_alert_free_window_minutes"),
        f.count_if("low_recovery_day").alias("low_recovery_days"), f.count_if(c("alert_minutes_total") > 0).alias("days_with_any_alert"),
    )
    return out.withColumn("share_days_with_any_alert", c("days_with_any_alert") / c("days_count"))


def national_summary(national: DataFrame, rows: DataFrame) -> DataFrame:
    daily = rows.groupBy("date").agg(F.max("gini_alert_minutes_total").alias("g"), F.max("gini_alert_burden_index").alias("gb"), F.max("top_bottom_alert_minutes_ratio").alias("r"))
    return national.join(daily, "date", "left").agg(
        F.min("date").alias("date_start"), F.max("date").alias("date_end"), F.count(F.lit(1)).alias("days_count"), F.sum("total_alert_minutes_all_regions").alias("total_alert_minutes_all_regions"),
        F.avg("total_alert_minutes_all_regions").alias("mean_daily_total_alert_minutes_all_regions"), F.max("total_alert_minutes_all_regions").alias("max_daily_total_alert_minutes_all_regions"),
        F.avg("regions_with_alerts_count").alias("mean_regions_with_alerts_count"), F.max("regions_with_alerts_count").alias("max_regions_with_alerts_count"), F.avg("national_alert_burden_index").alias("mean_national_alert_burden_index"),
        F.max("max_regions_simultaneously_alerted").alias("max_regions_simultaneously_alerted_observed"), F.avg("g").alias("mean_gini_alert_minutes_total"), F.avg("gb").alias("mean_gini_alert_burden_index"),
    )
