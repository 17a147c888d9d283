"""The filters, rankings and series that a dashboard asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import has_columns

#: fixed values: what rankings are ordered by, public wording, and the columns of each daily metric (daily, means, deviations)
RANKINGS = {"latest burden": "latest_30d_alert_minutes_mean", "volatility": "std_alert_minutes", "recent increase": "latest_vs_previous_30d_delta"}
TREND = {
    "worsening": "historically increased", "stable": "historically stable", "mixed": "mixed historical pattern", "improving": "historically decreased",
}
SHIFT = {
    "no clear shift": "no clear statistical shift", "possible shift": "possible statistical shift", "strong shift": "repeated statistical shifts",
    "no clear statistical shift": "no clear statistical shift", "possible statistical shift": "possible statistical shift",
    "repeated statistical shifts": "repeated statistical shifts",
}
METRICS = {
    "Alert minutes": ["alert_minutes_total", "alert_minutes_14d_mean", "alert_minutes_30d_mean", "alert_minutes_14d_std", "alert_minutes_30d_std"],
    "ABI": ["alert_burden_index", "abi_14d_mean", "abi_30d_mean", "abi_14d_std", "abi_30d_std"],
    "SDI": ["sleep_disruption_index", None, None, None, None],
    "WDI": ["workday_disruption_index", None, None, None, None],
}


def _worded(label: Column, words: dict[str, str], other: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.when(label.isNotNull(), F.coalesce(known[label], F.lit(other)))


def public_trend(label: Column) -> Column:
    return F.coalesce(_worded(label, TREND, "mixed historical pattern"), F.lit("not available"))


def public_shift(label: Column) -> Column:
    return F.coalesce(_worded(label, SHIFT, "possible statistical shift"), F.lit("not available"))


def hours_text(minutes: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(minutes / 60, 0), F.lit(" h")), F.lit("n/a"))


def hours_per_day(minutes: Column, signed: bool = False) -> Column:
    sign = F.when(minutes > 0, "+").otherwise("") if signed else F.lit("")
    return F.coalesce(F.concat(sign, F.format_number(minutes / 60, 1), F.lit(" h/day")), F.lit("n/a"))


def decimal_text(x: Column, digits: int = 3) -> Column:
    return F.coalesce(F.format_number(x, digits), F.lit("n/a"))


def choices(days: DataFrame, preferred: str = "Kyiv City") -> DataFrame:
    """What a sidebar offers: all regions in order, the bounds of the dates, and the region to begin with."""
    names = F.array_sort(F.collect_set("region_name"))  # regions are few
    one = days.agg(names.alias("names"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    begin = F.when(F.array_contains("names", preferred), preferred).otherwise(F.try_element_at("names", F.lit(1)))
    return one.select(F.array_join("names", ";").alias("regions"), "first_date", "last_date", begin.alias("default_region"))


def regions(days: DataFrame) -> DataFrame:
    return days.select("region_name").distinct().orderBy("region_name")


def laid_out(df: DataFrame) -> DataFrame:
    """df with the year that its table is laid out by, beside the region: see filter_region_day()."""
    return df.withColumn("year", F.year("date"))


def filter_region_day(df: DataFrame, regions: list[str], start: str, end: str) -> DataFrame:
    """Rows of some regions and a range of dates. Both columns may be what the table is laid out by; where that is the year, a filter
    on it is added, so that only the folders asked for are read."""
    if not has_columns(df, {"region_name", "date"}):
        return df.limit(0)
    rows = df.filter(F.col("region_name").isin(*regions) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.filter(F.col("year").between(int(start[:4]), int(end[:4]))).drop("year") if "year" in df.columns else rows


def top(df: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The n rows with the largest metric, nulls first; names decide ties."""
    return df.orderBy(F.desc_nulls_first(metric), "region_name").limit(n)


def overview(days: DataFrame) -> DataFrame:
    return days.agg(F.count_distinct("region_name").alias("n_regions"), F.avg("alert_burden_index").alias("mean_abi"), F.avg("sleep_disruption_index").alias("mean_sdi"), F.avg("workday_disruption_index").alias("mean_wdi"), F.sum("alert_minutes_total").alias("total_minutes"))


def inequality_series(rows: DataFrame, start: str, end: str) -> DataFrame:
    inside = rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.groupBy("date").agg(F.max("gini_alert_minutes_total").alias("gini_minutes"), F.max("gini_alert_burden_index").alias("gini_burden"))


def filter_series(df: DataFrame, region: str, start: str, end: str) -> DataFrame:
    """One region's rows of a range of dates, in order."""
    return filter_region_day(df, [region], start, end).orderBy("date")


def summary_row(summary: DataFrame, region: str) -> DataFrame:
    return summary.filter(F.col("region") == region).limit(1)


def cards(days: DataFrame, national: DataFrame) -> DataFrame:
    """The figures at the top, as they are shown: of the chosen days, and of the country."""
    one = overview(days).crossJoin(F.broadcast(national.select("max_regions_simultaneously_alerted_observed")))
    shown = {c: decimal_text(F.col(c)) for c in ("mean_abi", "mean_sdi", "mean_wdi")} | {"total_hours": hours_text(F.col("total_minutes"))}
    return one.withColumns(shown).drop("total_minutes")


def disruption_series(days: DataFrame, chosen: list[str], start: str, end: str) -> DataFrame:
    rows = filter_region_day(days, chosen, start, end)
    return rows.select("region_name", "date", "sleep_disruption_index", "workday_disruption_index").orderBy("region_name", "date")


def metric_series(rows: DataFrame, label: str) -> DataFrame:
    """date, daily, rolling_14, rolling_30, volatility_14, volatility_30 of a metric; null where it has no such column."""
    names = ["daily", "rolling_14", "rolling_30", "volatility_14", "volatility_30"]
    columns = [(F.col(c) if c in rows.columns else F.lit(None).cast("double")).alias(n) for c, n in zip(METRICS[label], names)]
    return rows.select("region_name", "date", *columns)


def stability_cards(summary: DataFrame, region: str) -> DataFrame:
    """A region's stability section: hours a day lately and before, the change, and its labels in public words."""
    c = F.col
    return summary_row(summary, region).select(
        "region", hours_per_day(c("latest_30d_alert_minutes_mean")).alias("latest"), hours_per_day(c("previous_30d_alert_minutes_mean")).alias("previous"),
        hours_per_day(c("latest_vs_previous_30d_delta"), True).alias("change"), "volatility_label", public_trend(c("trend_label")).alias("trend"),
        public_shift(c("regime_shift_label")).alias("shift"), "n_change_points",
    )


def stability_ranking(summary: DataFrame, mode: str, n: int = 10) -> DataFrame:
    """The n first regions; where a label is null its public wording is null too."""
    c = F.col
    return summary.orderBy(F.desc_nulls_first(RANKINGS[mode]), "region").limit(n).select(
        "region", F.bround(c("latest_30d_alert_minutes_mean") / 60, 1).alias("latest_hours"), F.bround(c("latest_vs_previous_30d_delta") / 60, 1).alias("delta_hours"),
        "volatility_label", _worded(c("trend_label"), TREND, "mixed historical pattern").alias("public_trend_label"),
        _worded(c("regime_shift_label"), SHIFT, "possible statistical shift").alias("public_shift_label"), "n_change_points",
    )


def example_regions(summary: DataFrame, column: str, labels: list[str], n: int = 10) -> DataFrame:
    """The n most volatile regions with one of these labels, means deciding ties."""
    rows = summary.filter(F.col(column).isin(*labels)).select("region", column, "mean_alert_minutes", "std_alert_minutes")
    return rows.orderBy(F.desc_nulls_first("std_alert_minutes"), F.desc_nulls_first("mean_alert_minutes"), "region").limit(n)


def shift_dates(summary: DataFrame) -> DataFrame:
    return summary.select("region", F.explode(F.filter(F.split("change_point_dates", ";"), lambda x: x != "")).alias("shift_date"))
