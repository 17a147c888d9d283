"""Tables of an interval store that are laid out by day, and of which only touched days are rebuilt."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, intervals

SCHEMAS = {
    "parts": "region string, duration_minutes double, cs timestamp_ntz, ce timestamp_ntz, date date, batch string",
    "merged": "region string, cs timestamp_ntz, ce timestamp_ntz, date date",
    "days": ", ".join(f"{c} {t}" for c, t in features.ACTIVE.items()),
}


class DayTables:
    """Three tables in a folder, each laid out by date: parts (the records of each batch, cut into days), merged (their unions) and days
    (features of each region and day with any record).

    add() takes a batch of records, old or new days alike: it writes the batch's parts, finds the days that they touch, and
    rebuilds these days' merged parts and features from all parts of those days, by dynamic overwrite of partitions. Nothing
    else is read or written. A batch that is added again under its name overwrites itself, so a stream may replay it; a
    rebuild that fails is completed by the replay. One writer at a time. Numbers of regions and what depends on all days
    (dense grids, scaled indices) aren't stored: they are worked out when read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _write(self, df: DataFrame, table: str, *by: str) -> None:
        """Hot days are written by several tasks, and small ones by one."""
        df.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{table}")

    def read(self, table: str) -> DataFrame:
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}").select(*names)

    def add(self, alerts: DataFrame, batch: str | int) -> list[datetime.date]:
        """The days that were touched, after they are rebuilt. alerts: region, started_at_utc, finished_at_utc."""
        parts = intervals.by_day(intervals.local_records(alerts)).select("region", "duration_minutes", "cs", "ce", "date", F.lit(str(batch)).alias("batch"))
        self._write(parts, "parts", "date", "batch")
        mine = self.read("parts").filter(F.col("batch") == str(batch))
        touched = sorted(r["date"] for r in mine.select("date").distinct().collect())  # days of a calendar
        if touched:
            self.rebuild(touched)
        return touched

    def rebuild(self, dates: list[datetime.date]) -> None:
        at = F.col("date").isin(dates)
        parts = self.read("parts").filter(at)
        self._write(intervals.islands(parts, ["region", "date"], "cs", "ce").select("region", "cs", "ce", "date"), "merged", "date")
        self._write(features.active_days(parts, self.read("merged").filter(at)).select(*features.ACTIVE), "days", "date")

    def merged_intervals(self) -> DataFrame:
        return intervals.stitched(self.read("merged"))

    def region_days(self) -> DataFrame:
        return features.dense_days(self.read("days"))
