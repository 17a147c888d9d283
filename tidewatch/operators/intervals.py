"""Interval algebra on local wall-clock time: [s, e) of each region, held as timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import local_time, micros_between, overlap_minutes
from ..sources.files import require_columns, written
from .selection import exact_median


def local_records(alerts: DataFrame) -> DataFrame:
    """region, s, e, duration_minutes. The end is the local start plus the elapsed time, so that a change of the clocks
    inside an interval doesn't stretch it. Rows without both ends, or that end before they start, go."""
    require_columns(alerts, {"region", "started_at_utc", "finished_at_utc"}, "alerts")
    ok = alerts.filter(F.col("started_at_utc").isNotNull() & (F.col("finished_at_utc") > F.col("started_at_utc")))
    elapsed = micros_between(F.col("started_at_utc"), F.col("finished_at_utc"))
    minutes = F.coalesce(F.col("duration_minutes"), elapsed / 6e7) if "duration_minutes" in alerts.columns else elapsed / 6e7
    start = local_time(F.col("started_at_utc"))
    rows = ok.select("region", start.alias("s"), minutes.alias("duration_minutes"))
    return rows.withColumn("e", F.timestamp_add("MICROSECOND", F.round(F.col("duration_minutes") * 6e7).cast("bigint"), F.col("s")))


def by_day(intervals: DataFrame) -> DataFrame:
    """One row for each local day that an interval touches, with the part inside it (cs, ce)."""
    last = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("e"))
    rows = intervals.filter("e > s").withColumn("date", F.explode(F.sequence(F.to_date("s"), F.to_date(last))))
    day = F.col("date").cast("timestamp_ntz")
    return rows.withColumns({"cs": F.greatest("s", day), "ce": F.least(F.col("e"), F.timestamp_add("DAY", F.lit(1), day))})


def islands(rows: DataFrame, keys: list[str], s: str, e: str) -> DataFrame:
    """Unions of overlapping or touching intervals of each key."""
    order = Window.partitionBy(*keys).orderBy(s, e)
    before = F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, s, e, F.when(before.isNull() | (F.col(s) > before), 1).otherwise(0).alias("new"))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("island")


def merged_by_day(records: DataFrame) -> DataFrame:
    """region, date, cs, ce: merged intervals clipped to days. Cutting at midnight first gives the same union, and lets a
    region with most of the rows spread over its days."""
    return islands(by_day(records), ["region", "date"], "cs", "ce")


def stitched(days: DataFrame) -> DataFrame:
    """region, s, e: merged intervals, from the parts of days that merged_by_day() gives. A part that touches neither end of its day
    is whole already. The others, two at most for each region and day however many records there are, are stitched across midnight:
    only they are seen region by region."""
    day = F.col("date").cast("timestamp_ntz")
    parts = days.select("region", F.col("cs").alias("s"), F.col("ce").alias("e"), ((F.col("cs") == day) | (F.col("ce") == F.timestamp_add("DAY", F.lit(1), day))).alias("edge"))
    return parts.filter("NOT edge").select("region", "s", "e").union(islands(parts.filter("edge"), ["region"], "s", "e"))


def merged(records: DataFrame) -> DataFrame:
    """region, s, e: merged intervals. Days are merged first, and written, since both ways of stitched() read them."""
    return stitched(written(merged_by_day(records), "merged"))


def minutes_by_hour(days: DataFrame) -> DataFrame:
    """region, datetime_hour, minutes of merged day parts."""
    last = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("ce"))
    hour = F.date_trunc("HOUR", "cs").cast("timestamp_ntz")
    rows = days.withColumn("datetime_hour", F.explode(F.sequence(hour, last, F.expr("INTERVAL 1 HOUR"))))
    after = F.timestamp_add("HOUR", F.lit(1), F.col("datetime_hour"))
    return rows.groupBy("region", "datetime_hour").agg(F.sum(overlap_minutes(F.col("cs"), F.col("ce"), F.col("datetime_hour"), after)).alias("minutes"))


#: a region's day with more records than this gets its median by selection
HOT = 1_000_000


def daily_stats(records: DataFrame, hot: int = HOT) -> DataFrame:
    """Of raw records by region and day: count, largest and median of the whole duration, first start and last end inside."""
    return part_stats(by_day(records), hot)


def part_stats(parts: DataFrame, hot: int = HOT) -> DataFrame:
    """daily_stats() of rows that by_day() made. The median of a group is a hash map of its values, so groups over `hot` rows are
    taken out and their medians selected in rounds."""
    keys = ["region", "date"]
    plain = [
        F.count(F.lit(1)).alias("raw_alert_record_count"), F.max("duration_minutes").alias("max_alert_duration"),
        F.min("cs").alias("first_alert_time"), F.max("ce").alias("last_alert_time"),
    ]
    median = F.median("duration_minutes").alias("median_alert_duration")
    large = parts.groupBy(*keys).count().filter(F.col("count") > hot).select(*keys)
    if large.isEmpty():
        return parts.groupBy(*keys).agg(*plain, median)
    large = written(large, "large")
    small = parts.join(large, keys, "left_anti").groupBy(*keys).agg(*plain, median)
    rest = parts.join(large, keys, "left_semi")
    return small.unionByName(rest.groupBy(*keys).agg(*plain).join(exact_median(rest, keys, "duration_minutes", hot).withColumnRenamed("median", "median_alert_duration"), keys))


def day_gaps(days: DataFrame) -> DataFrame:
    """Episodes and the longest gap (its edges included) of each region and day that has any."""
    day = F.col("date").cast("timestamp_ntz")
    before = F.coalesce(F.lag("ce").over(Window.partitionBy("region", "date").orderBy("cs")), day)
    gaps = days.withColumn("gap", micros_between(before, F.col("cs")))
    rest = micros_between(F.max("ce"), F.timestamp_add("DAY", F.lit(1), F.max(day)))
    return gaps.groupBy("region", "date").agg(F.count(F.lit(1)).alias("merged_alert_episode_count"), (F.greatest(F.max("gap"), rest) / 6e7).alias("longest_alert_free_window_minutes"))
