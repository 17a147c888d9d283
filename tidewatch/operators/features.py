"""Dense region x hour, region x day and national day tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_night, is_work
from . import intervals as I


def spans(records: DataFrame) -> DataFrame:
    """The first start and the last instant of each region: a row for each region, from one pass."""
    last = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("e"))
    return records.groupBy("region").agg(F.min("s").alias("first_start"), F.max(last).alias("last_instant"))


def observed_range(regions: DataFrame) -> DataFrame:
    """First and last date of the rows of spans()."""
    return regions.agg(F.to_date(F.min("first_start")).alias("first_date"), F.to_date(F.max("last_instant")).alias("last_date"))


def region_ids(regions: DataFrame) -> DataFrame:
    """Regions are few; they are numbered by name."""
    return regions.select("region").distinct().withColumn("region_id", F.row_number().over(Window.orderBy("region")).cast("bigint"))


def region_hour(merged: DataFrame, regions: DataFrame) -> DataFrame:
    """Every region and hour of the observed days. merged: merged_by_day(); regions: spans()."""
    minutes = I.minutes_by_hour(merged)
    day = F.explode(F.sequence("first_date", "last_date"))
    hours = observed_range(regions).filter("first_date IS NOT NULL").select(day.alias("date")).select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    hours = hours.select("date", F.timestamp_add("HOUR", F.col("h"), F.col("date").cast("timestamp_ntz")).alias("datetime_hour"), F.col("h").cast("bigint").alias("hour"))
    grid = hours.crossJoin(F.broadcast(region_ids(regions)))  # regions x hours is the result's own size
    full = grid.join(minutes, ["region", "datetime_hour"], "left")
    active = F.least(F.lit(60.0), F.greatest(F.lit(0.0), F.coalesce("minutes", F.lit(0.0))))
    weekday = F.weekday("date").cast("bigint")
    return full.select(
        "region_id", F.col("region").alias("region_name"), "datetime_hour", "date", active.alias("alert_minutes_in_hour"), (active > 0).alias("is_alert_active"), "hour",
        weekday.alias("weekday"), F.month("date").cast("bigint").alias("month"), is_night(F.col("hour")).alias("is_night"), is_work(F.col("hour"), weekday).alias("is_work_hour"),
    )


#: columns of a day with any record, and their types
ACTIVE = {
    "region_name": "string", "date": "date", "raw_alert_record_count": "long", "merged_alert_episode_count": "long", "alert_minutes_total": "double",
    "alert_minutes_night": "double", "alert_minutes_workday": "double", "max_alert_duration": "double", "median_alert_duration": "double",
    "longest_alert_free_window_minutes": "double", "first_alert_time": "timestamp_ntz", "last_alert_time": "timestamp_ntz",
}


def _totals(hours: DataFrame, *keys: str) -> DataFrame:
    """Minutes of each day: all, at night, in working hours."""
    m = F.col("alert_minutes_in_hour")
    total = lambda which, most, name: F.least(F.lit(most), F.sum(F.when(which, m).otherwise(0.0))).alias(name)
    return hours.groupBy(*keys).agg(total(F.lit(True), 1440.0, "alert_minutes_total"), total(F.col("is_night"), 540.0, "alert_minutes_night"), total(F.col("is_work_hour"), 540.0, "alert_minutes_workday"))


def _described(base: DataFrame, stats: DataFrame, gaps: DataFrame) -> DataFrame:
    named = lambda df: df.withColumnRenamed("region", "region_name")
    return base.join(named(stats), ["region_name", "date"], "left").join(named(gaps), ["region_name", "date"], "left")


def _completed(rows: DataFrame) -> DataFrame:
    """The published columns; days without records have no minutes and are free throughout."""
    c, zero = F.col, lambda name, x: F.coalesce(name, F.lit(x)).alias(name)
    raw, minutes = F.coalesce("raw_alert_record_count", F.lit(0)), {n: F.coalesce(n, F.lit(0.0)) for n in ("alert_minutes_total", "alert_minutes_night", "alert_minutes_workday")}
    return rows.select(
        "region_id", "region_name", "date", raw.alias("alert_count"), raw.alias("raw_alert_record_count"), zero("merged_alert_episode_count", 0),
        *[v.alias(n) for n, v in minutes.items()], "max_alert_duration", "median_alert_duration",
        zero("longest_alert_free_window_minutes", 1440.0), (minutes["alert_minutes_total"] / 1440).alias("share_day_under_alert"),
        (minutes["alert_minutes_night"] > 0).alias("sleep_window_interrupted"), (minutes["alert_minutes_workday"] > 0).alias("workday_interrupted"), c("first_alert_time"), c("last_alert_time"),
    )


def region_day(records: DataFrame, merged: DataFrame, hours: DataFrame) -> DataFrame:
    return _completed(_described(_totals(hours, "region_id", "region_name", "date"), I.daily_stats(records), I.day_gaps(merged)))


def active_days(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """The features of each region and day with any record, from that day's rows alone. parts: by_day(); merged: merged_by_day()."""
    hour = F.hour("datetime_hour")
    minutes = F.least(F.lit(60.0), F.greatest(F.lit(0.0), F.col("minutes")))
    hours = I.minutes_by_hour(merged).withColumns({"date": F.to_date("datetime_hour"), "alert_minutes_in_hour": minutes, "is_night": is_night(hour), "is_work_hour": is_work(hour, F.weekday("datetime_hour"))})
    return _described(_totals(hours.withColumnRenamed("region", "region_name"), "region_name", "date"), I.part_stats(parts), I.day_gaps(merged))


def dense_days(active: DataFrame) -> DataFrame:
    """region_day() from the rows of active_days(): every region and day from the first to the last that has any."""
    ends = active.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a IS NOT NULL")
    ids = region_ids(active.select(F.col("region_name").alias("region"))).withColumnRenamed("region", "region_name")
    grid = ends.select(F.explode(F.sequence("a", "b")).alias("date")).crossJoin(F.broadcast(ids))  # the result's own size
    return _completed(grid.join(active, ["region_name", "date"], "left"))


def national_day(hours: DataFrame, days: DataFrame) -> DataFrame:
    base = days.groupBy("date").agg(F.count_if(F.col("alert_minutes_total") > 0).alias("regions_with_alerts_count"), F.sum("alert_minutes_total").alias("total_alert_minutes_all_regions"))
    most = hours.groupBy("date", "datetime_hour").agg(F.count_if("is_alert_active").alias("n")).groupBy("date").agg(F.max("n").alias("max_regions_simultaneously_alerted"))
    top = base.agg(F.max("total_alert_minutes_all_regions").alias("top"))
    share = F.when(F.col("top") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("total_alert_minutes_all_regions") / F.col("top")))).otherwise(0.0)
    return base.join(most, "date", "left").crossJoin(F.broadcast(top)).withColumn("national_alert_burden_index", share).drop("top")
