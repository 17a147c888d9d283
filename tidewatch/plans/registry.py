"""Registered queries over the given tables, and their SQL.

The tables hold no alerts, so intervals are derived from events (25 regions by user, value in minutes), and long daily
series from orders by region of the customer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, intervals, metrics, quality, timeseries
from ..operators.selection import exact_median
from ..sources import cleaning
from ..sources.daytables import DayTables
from ..sources.files import shared_folder, written
from ..sources.snapshots import read_snapshot
from ..streaming.merge import closed_intervals, file_stream, follow
from . import dashboard
from .oracles import ORACLES  # noqa: F401

FLAGSHIP = "minutes_by_region_day"


def alerts(spark: SparkSession, sf: str, faulty: bool = False) -> DataFrame:
    return alerts_of(spark.read.parquet(f"{sf}/events.parquet"), faulty)


def alerts_of(events: DataFrame, faulty: bool = False) -> DataFrame:
    """Intervals of events. faulty: with those that cleaning takes out, made from the smallest values: no end under 5, no length
    under 10."""
    value = F.when(F.col("value") < 10, 0.0).otherwise(F.col("value")) if faulty else F.col("value")
    seconds = F.round(value * 60).cast("bigint")
    start = F.date_trunc("SECOND", "ts").cast("timestamp_ntz")
    region = F.concat(F.lit("R"), F.lpad((F.col("user_id") % 25).cast("string"), 2, "0"))
    rows = events.select(F.col("event_id").alias("alert_id"), region.alias("region"), start.alias("started_at_utc"), seconds.alias("duration_seconds"), "event_type", "value")
    end = F.timestamp_add("SECOND", F.col("duration_seconds"), F.col("started_at_utc"))
    if faulty:
        return rows.withColumn("finished_at_utc", F.when(F.col("value") >= 5, end)).drop("value")
    return rows.filter("duration_seconds > 0").withColumn("finished_at_utc", end).drop("value")


def records(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.local_records(alerts(spark, sf))


class Tables:
    """The tables that the queries of one run share. What several of them read is written once, at the size of the result: the
    merged parts of days, and the table of days, so that events are read three times at most (merged parts, daily
    statistics, first and last instants)."""

    def __init__(self, spark: SparkSession, sf: str):
        self.records = records(spark, sf)

    @cached_property
    def merged(self) -> DataFrame:
        return written(intervals.merged_by_day(self.records), "merged")

    @cached_property
    def hours(self) -> DataFrame:
        return features.region_hour(self.merged, written(features.spans(self.records), "spans"))

    @cached_property
    def days(self) -> DataFrame:
        return written(features.region_day(self.records, self.merged, self.hours), "days", "date")

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics.region_day_metrics(written(metrics.indices(self.days), "indices"))

    @cached_property
    def national(self) -> DataFrame:
        return features.national_day(self.hours, self.days)

    @cached_property
    def regions(self) -> DataFrame:
        return metrics.region_summary(self.metrics)

    @cached_property
    def country(self) -> DataFrame:
        return metrics.national_summary(self.national, self.metrics)


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, sf: str) -> DayTables:
    """The day tables after a stream of the events' files has been followed to its end."""
    tables = DayTables(spark, scratch(spark, "streamed"))
    follow(alerts_of(file_stream(spark, f"{sf}/events.parquet")), tables, scratch(spark, "stream-checkpoint")).awaitTermination()
    return tables


#: what comes after this instant arrives as an update
UPDATE = "2024-01-28 00:00:00"


def updated(spark: SparkSession, sf: str) -> DayTables:
    """The day tables after a first batch, and one of the last days, of which only touched days were rebuilt."""
    tables, rows, late = DayTables(spark, scratch(spark, "updated")), alerts(spark, sf), F.col("started_at_utc") >= F.lit(UPDATE).cast("timestamp_ntz")
    tables.add(rows.filter(~late), "first")
    tables.add(rows.filter(late), "update")
    return tables


def closed(spark: SparkSession, sf: str) -> DataFrame:
    """Merged intervals that a stream tells as closed, six hours behind the latest start."""
    out, rows = scratch(spark, "closed"), intervals.local_records(alerts_of(file_stream(spark, f"{sf}/events.parquet")))
    told = closed_intervals(rows, "6 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream-checkpoint"))
    told.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("region", "s", "e", "n_records")


def published(spark: SparkSession, sf: str, checks: bool = False) -> DataFrame:
    """The daily metrics as readers find them after a publish whose checks were measured by the write; or those checks."""
    path = scratch(spark, "published")
    found = quality.publish_measured(Tables(spark, sf).metrics, path, quality.METRIC_RANGES, quality.CATEGORIES)
    return spark.createDataFrame(list(found.items()), "metric string, passed boolean") if checks else read_snapshot(spark, path)


def region_medians(spark: SparkSession, sf: str) -> DataFrame:
    return exact_median(records(spark, sf), ["region"], "duration_minutes", small=64)


def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """r_name, date, count: orders of each region and day, a row for each; written, since the calendar and the series read it."""
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return written(rows.groupBy("r_name", F.to_date("o_orderdate").alias("date")).count(), "daily")


def series(spark: SparkSession, sf: str) -> DataFrame:
    """The daily series of each region, with the place of each row in it."""
    daily = daily_counts(spark, sf)
    ends = daily.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    regions = spark.read.parquet(f"{sf}/region.parquet").select("r_name")
    grid = ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("date")).crossJoin(F.broadcast(regions))
    minutes = F.least(F.lit(1440.0), 120.0 * F.coalesce("count", F.lit(0)))
    full = grid.join(daily, ["r_name", "date"], "left").select(F.col("r_name").alias("region_name"), "date", minutes.alias("alert_minutes_total"))
    return timeseries.placed(full.withColumn("alert_burden_index", F.col("alert_minutes_total") / 1440))


def rolling(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.rolling(series(spark, sf)).drop("pos", "n")


def region_series(spark: SparkSession, sf: str, region: str) -> DataFrame:
    """A region's rows of a year, from the published table: it is laid out by region and year, and only that folder is read."""
    table = written(dashboard.laid_out(rolling(spark, sf)), "rolling", "region_name", "year")
    return dashboard.filter_series(table, region, LONG_FROM, LONG_TO)


def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = alerts(spark, sf).select("region", "event_type", "started_at_utc", "finished_at_utc")
    part = lambda df, source: df.select(F.lit(source).alias("source_file"), F.lit(source).alias("source"), F.lit(source).alias("source_scope"), "region", F.col("region").alias("oblast"), *[F.lit(None).cast("string").alias(c) for c in ("raion", "hromada")], F.col("event_type").alias("alert_level"), "started_at_utc", "finished_at_utc", F.lit(None).cast("boolean").alias("volunteer_naive"))
    off = part(rows.filter("event_type <> 'view' AND started_at_utc >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"), "official")
    return cleaning.combine(off, part(rows.filter("event_type = 'view'"), "volunteer"))


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, shares of a day to nine: in whole seconds those may end in a five at the seventh."""
    return df.select(*[F.round(c, 9 if c in ("share_day_under_alert", "alert_free_window_share") else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _clean(spark, sf):
    numbered = cleaning.number(clean_rows(spark, sf))
    return numbered.select("alert_id", "source", "region", "alert_level", "started_at_utc", "finished_at_utc", "started_date_utc", "duration_seconds", F.round("duration_minutes", 6).alias("duration_minutes"), "duration_quality")


def _by_day(spark, sf):
    parts = intervals.minutes_by_hour(intervals.merged_by_day(records(spark, sf)))
    return parts.groupBy(F.col("region").alias("region_name"), F.to_date("datetime_hour").alias("date")).agg(F.round(F.sum("minutes"), 6).alias("alert_minutes"))


def _of(make: Callable[[Tables], DataFrame], *order: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the shared tables, rounded, and in the order that the published table has."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = _rounded(make(Tables(spark, sf)))
        return out.orderBy(*order) if order else out

    return query


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.summary(series(spark, sf))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.profile(alerts(spark, sf, faulty=True))


def _series_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = series(spark, sf)
    return quality.series_checks(timeseries.rolling(rows), timeseries.summary(rows), rows)


CHOSEN, FROM, TO = ["R01", "R07"], "2024-01-05", "2024-01-20"
LONG_FROM, LONG_TO = "1995-01-01", "1995-12-31"

QUERIES = {
    "minutes_by_region_day": _by_day,
    "merged_intervals": lambda s, d: intervals.merged(records(s, d)),
    "observed_range": lambda s, d: features.observed_range(features.spans(records(s, d))),
    "region_hour_features": _of(lambda t: t.hours, "region_name", "datetime_hour"),
    "daily_alert_stats": lambda s, d: _rounded(intervals.daily_stats(records(s, d))),
    "longest_free_window": lambda s, d: _rounded(intervals.day_gaps(intervals.merged_by_day(records(s, d)))),
    "region_day_features": _of(lambda t: t.days, "region_name", "date"),
    "national_day_features": _of(lambda t: t.national, "date"),
    "region_day_metrics": _of(lambda t: t.metrics, "region_name", "date"),
    "daily_inequality": _of(lambda t: metrics.daily_inequality(written(metrics.indices(t.days), "indices")), "date"),
    "region_summary": _of(lambda t: t.regions, "region_name"),
    "national_summary": _of(lambda t: t.country),
    "clean_intervals": _clean,
    "clean_summary": lambda s, d: cleaning.summarize(clean_rows(s, d)),
    "rolling_series": lambda s, d: _rounded(rolling(s, d)).orderBy("region_name", "date"),
    "rolling_parameter": lambda s, d: _rounded(timeseries.add_rolling(series(s, d), "alert_minutes_total", 5).drop("pos", "n")),
    "period_comparison": lambda s, d: _rounded(timeseries.periods(series(s, d))),
    "change_points": lambda s, d: timeseries.change_points(series(s, d)),
    "timeseries_summary": lambda s, d: _rounded(_summary(s, d)).orderBy("region"),
    "timeseries_summary_row": lambda s, d: _rounded(dashboard.summary_row(_summary(s, d), "ASIA")),
    "timeseries_region": lambda s, d: _rounded(region_series(s, d, "ASIA")),
    "stability_metric_series": lambda s, d: _rounded(dashboard.metric_series(region_series(s, d, "EUROPE"), "ABI")),
    "stability_cards": lambda s, d: dashboard.stability_cards(_summary(s, d), "ASIA"),
    "stability_ranking": lambda s, d: dashboard.stability_ranking(_summary(s, d), "volatility"),
    "recent_increase_ranking": lambda s, d: dashboard.stability_ranking(_summary(s, d), "recent increase"),
    "example_regions": lambda s, d: _rounded(dashboard.example_regions(_summary(s, d), "volatility_label", ["medium", "high"])),
    "shift_dates": lambda s, d: dashboard.shift_dates(timeseries.change_points(series(s, d))),
    "series_checks": _series_checks,
    "filter_region_day": _of(lambda t: dashboard.filter_region_day(t.days, CHOSEN, FROM, TO).select("region_name", "date", "alert_minutes_total")),
    "ranking_top10": _of(lambda t: dashboard.top(t.regions, "mean_alert_burden_index").select("region_name", "mean_alert_burden_index")),
    "overview_cards": _of(lambda t: dashboard.overview(t.metrics)),
    "chosen_cards": _of(lambda t: dashboard.cards(dashboard.filter_region_day(t.metrics, CHOSEN, FROM, TO), t.country)),
    "sidebar_choices": _of(lambda t: dashboard.choices(t.days)),
    "region_list": _of(lambda t: dashboard.regions(t.days)),
    "chosen_rolling": _of(lambda t: timeseries.add_rolling(dashboard.filter_region_day(t.days, CHOSEN, FROM, TO).select("region_name", "date", "alert_minutes_total"), "alert_minutes_total")),
    "disruption_series": _of(lambda t: dashboard.disruption_series(t.metrics, CHOSEN, FROM, TO)),
    "inequality_series": _of(lambda t: dashboard.inequality_series(t.metrics, FROM, TO), "date"),
    "category_counts": lambda s, d: quality.value_counts(Tables(s, d).metrics, "alert_burden_category"),
    "feature_ranges": _of(lambda t: quality.feature_checks(t.hours, t.days, t.national)),
    "metric_ranges": _of(lambda t: quality.range_checks(t.metrics, quality.METRIC_RANGES)),
    "metric_checks": _of(lambda t: quality.metric_checks(t.metrics)),
    "profile_alerts": _profile,
    "streamed_intervals": lambda s, d: streamed(s, d).merged_intervals(),
    "streamed_metrics": lambda s, d: _rounded(metrics.region_day_metrics(written(metrics.indices(streamed(s, d).region_days()), "indices"))),
    "updated_days": lambda s, d: _rounded(updated(s, d).region_days()),
    "closed_intervals": closed,
    "region_medians": lambda s, d: _rounded(region_medians(s, d)),
    "measured_checks": lambda s, d: published(s, d, checks=True),
    "published_metrics": lambda s, d: _rounded(published(s, d)),
}
