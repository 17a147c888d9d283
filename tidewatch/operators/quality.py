"""Range checks, label checks and profiles, each one aggregate over the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import has_columns
from ..sources.snapshots import publish_snapshot

#: fixed values: bounds of the published columns, and labels that they may have
HOUR_RANGES = {"alert_minutes_in_hour": (0.0, 60.0)}
FEATURE_RANGES = {
    "alert_minutes_total": (0.0, 1440.0), "alert_minutes_night": (0.0, 540.0), "alert_minutes_workday": (0.0, 540.0),
    "longest_alert_free_window_minutes": (0.0, 1440.0), "share_day_under_alert": (0.0, 1.0),
}
NATIONAL_RANGES = {"national_alert_burden_index": (0.0, 1.0)}
INDICES = [
    "alert_burden_index", "sleep_disruption_index", "workday_disruption_index", "alert_free_window_share", "gini_alert_minutes_total", "gini_alert_burden_index",
]
METRIC_RANGES = {c: (0.0, 1.0) for c in INDICES}
LEVELS = {"low", "medium", "high"}
CATEGORIES = {c: LEVELS for c in ("alert_burden_category", "sleep_disruption_category", "workday_disruption_category")}
SUMMARY_LABELS = {
    "volatility_label": LEVELS, "trend_label": {"worsening", "stable", "improving", "mixed"},
    "regime_shift_label": {"no clear statistical shift", "possible statistical shift", "repeated statistical shifts"},
}
#: fixed values: columns of a daily series with its rolling figures, and of the summary of regions
SERIES_COLUMNS = [
    "region_name", "date", "alert_minutes_total", "alert_burden_index", "alert_minutes_7d_mean", "alert_minutes_14d_mean", "alert_minutes_30d_mean",
    "abi_7d_mean", "abi_14d_mean", "abi_30d_mean", "alert_minutes_14d_std", "alert_minutes_30d_std", "abi_14d_std", "abi_30d_std",
]
SUMMARY_COLUMNS = ["region", "n_days", "mean_alert_minutes", "std_alert_minutes", *SUMMARY_LABELS, "n_change_points", "change_point_dates"]


def range_checks(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """metric, min, max, lower, upper, passed; an empty or all-null column passes."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in ranges for n, f in (("lo", F.min), ("hi", F.max))])
    rows = [F.struct(F.lit(c).alias("metric"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"), F.lit(a).alias("lower"), F.lit(b).alias("upper"), F.coalesce((F.col(f"lo_{c}") >= a) & (F.col(f"hi_{c}") <= b), F.lit(True)).alias("passed")) for c, (a, b) in ranges.items()]
    return ends.select(F.inline(F.array(*rows)))


def is_infinite(df: DataFrame) -> Column:
    """Whether a row has an infinite number in any column."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return reduce(lambda a, b: a | b, [F.coalesce(F.abs(c) == float("inf"), F.lit(False)) for c in floats], F.lit(False))


def has_infinite(df: DataFrame) -> bool:
    return bool(df.agg(F.max(is_infinite(df)).alias("x")).first()["x"])


def label_checks(df: DataFrame, allowed: dict[str, set[str]]) -> DataFrame:
    """metric, passed for each column of labels, and for infinite numbers: one pass. A missing column doesn't pass, a null does."""
    odd = [F.count_if(~F.col(c).isin(*values)).alias(c) if c in df.columns else F.lit(1).alias(c) for c, values in allowed.items()]
    one = df.agg(*odd, F.count_if(is_infinite(df)).alias("no_infinite_values"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), (F.col(c) == 0).alias("passed")) for c in one.columns])))


def labels_are_valid(df: DataFrame, column: str, allowed: set[str]) -> bool:
    return all(r["passed"] for r in label_checks(df.select(column) if column in df.columns else df, {column: allowed}).collect())


def feature_checks(hours: DataFrame, days: DataFrame, national: DataFrame) -> DataFrame:
    parts = ((hours, HOUR_RANGES), (days, FEATURE_RANGES), (national, NATIONAL_RANGES))
    return reduce(DataFrame.union, [range_checks(df, ranges) for df, ranges in parts])


def metric_checks(rows: DataFrame) -> DataFrame:
    """metric, passed: ranges, categories and infinite numbers of the daily metrics."""
    return range_checks(rows, METRIC_RANGES).select("metric", "passed").union(label_checks(rows, CATEGORIES))


def series_checks(series: DataFrame, summary: DataFrame, source: DataFrame) -> DataFrame:
    """metric, passed: columns of both tables, as many rows as the source, infinite numbers and labels."""
    counts = series.agg(F.count(F.lit(1)).alias("n")).crossJoin(source.agg(F.count(F.lit(1)).alias("m")))
    fixed = {"series_columns": has_columns(series, set(SERIES_COLUMNS)), "summary_columns": has_columns(summary, set(SUMMARY_COLUMNS))}
    there = [F.struct(F.lit(k).alias("metric"), F.lit(v).alias("passed")) for k, v in fixed.items()]
    first = counts.select(F.inline(F.array(*there, F.struct(F.lit("row_count").alias("metric"), (F.col("n") == F.col("m")).alias("passed")))))
    named = lambda df, what: df.withColumn("metric", F.when(F.col("metric") == "no_infinite_values", f"{what}_infinite").otherwise(F.col("metric")))
    return first.union(named(label_checks(series, {}), "series")).union(named(label_checks(summary, SUMMARY_LABELS), "summary"))


class Measured:
    """Checks of a table that are measured while it is written: watch() is the table to write, checks() what was found, after the
    write. The table is computed once, and not read for its checks. ranges, labels: as in range_checks() and label_checks(). A
    missing column doesn't pass; an empty or all-null one does."""

    def __init__(self, ranges: dict[str, tuple[float, float]], labels: dict[str, set[str]]):
        self.ranges, self.labels, self.seen = ranges, labels, Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        self.missing = {c for c in (*self.ranges, *self.labels) if c not in df.columns}
        ends = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in self.ranges if c in df.columns for n, f in (("lo", F.min), ("hi", F.max))]
        odd = [F.count_if(~F.col(c).isin(*values)).alias(f"odd_{c}") for c, values in self.labels.items() if c in df.columns]
        return df.observe(self.seen, *ends, *odd, F.count_if(is_infinite(df)).alias("infinite"), F.count(F.lit(1)).alias("rows"))

    def checks(self) -> dict[str, bool]:
        got = self.seen.get
        inside = {c: c not in self.missing and all(x is None or a <= x <= b for x in (got[f"lo_{c}"], got[f"hi_{c}"])) for c, (a, b) in self.ranges.items()}
        return inside | {c: c not in self.missing and not got[f"odd_{c}"] for c in self.labels} | {"no_infinite_values": not got["infinite"]}

    def gate(self) -> None:
        failed = [c for c, passed in self.checks().items() if not passed]
        if failed:
            raise ValueError(f"validation failed: {', '.join(failed)}")


def publish_measured(df: DataFrame, path: str, ranges: dict[str, tuple[float, float]], labels: dict[str, set[str]], *partition_by: str) -> dict[str, bool]:
    """Publishes df if its checks pass, which are measured while it is written; else the version before stays and ValueError is raised."""
    measured = Measured(ranges, labels)
    publish_snapshot(measured.watch(df), path, *partition_by, verdict=measured.gate)
    return measured.checks()


def has_zone(df: DataFrame, column: str) -> bool:
    """Whether a column holds instants, not times without a zone."""
    return isinstance(df.schema[column].dataType, T.TimestampType)


def gate(checks: DataFrame) -> None:
    """Raises before anything is written, if a check failed."""
    failed = [r["metric"] for r in checks.filter("NOT passed").collect()]
    if failed:
        raise ValueError(f"validation failed: {', '.join(failed)}")


def publish_checked(df: DataFrame, path: str, checks: DataFrame) -> None:
    """Publishes df as the next version, if checks of other tables passed."""
    gate(checks)
    publish_snapshot(df, path)


def profile(alerts: DataFrame) -> DataFrame:
    c = F.col
    return alerts.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("region").alias("n_regions"), F.min("started_at_utc").alias("coverage_start"), F.max("finished_at_utc").alias("coverage_end"),
        F.count_if(c("finished_at_utc").isNull()).alias("missing_ends"), F.count_if(c("duration_seconds") <= 0).alias("non_positive_durations"), (F.count("alert_id") - F.count_distinct("alert_id")).alias("duplicate_ids"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
