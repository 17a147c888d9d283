import hashlib
from datetime import date, timedelta
from datetime import datetime as D

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars
from tidewatch.operators import features, intervals, metrics, quality, timeseries
from tidewatch.operators.selection import exact_median
from tidewatch.plans import dashboard
from tidewatch.sources import cleaning, files, snapshots


def alerts(spark, rows):
    df = spark.createDataFrame(rows, "region string, s timestamp_ntz, f timestamp_ntz")
    return df.select("region", F.col("s").alias("started_at_utc"), F.col("f").alias("finished_at_utc"))


def test_overlap(spark):
    rows = [(D(2022, 1, 1, 10, 15), D(2022, 1, 1, 10, 45), 30.0), (D(2022, 1, 1, 8), D(2022, 1, 1, 9), 0.0), (D(2022, 1, 1, 9, 30), D(2022, 1, 1, 10, 30), 30.0), (D(2022, 1, 1, 12), D(2022, 1, 1, 11), 0.0)]
    df = spark.createDataFrame(rows, "s timestamp_ntz, e timestamp_ntz, want double")
    a, b = F.lit("2022-01-01 10:00:00").cast("timestamp_ntz"), F.lit("2022-01-01 11:00:00").cast("timestamp_ntz")
    assert df.filter(scalars.overlap_minutes(F.col("s"), F.col("e"), a, b) != F.col("want")).count() == 0


def test_bounds(spark):
    """Two overlapping intervals over midnight, and a region with a working day; Kyiv is two hours ahead."""
    a = alerts(spark, [("K", D(2022, 1, 2, 22), D(2022, 1, 3, 21)), ("K", D(2022, 1, 3, 20), D(2022, 1, 3, 23)), ("L", D(2022, 1, 3, 7), D(2022, 1, 3, 16)), ("L", D(2022, 1, 3, 7), D(2022, 1, 3, 7))])
    rec = intervals.local_records(a)
    merged, regions = intervals.merged_by_day(rec), features.spans(rec)
    hours = features.region_hour(merged, regions)
    assert hours.count() == 96
    rows = {(r["region_name"], r["date"].day): r for r in features.region_day(rec, merged, hours).collect()}
    k = rows["K", 3]
    assert [k[c] for c in ("alert_minutes_total", "alert_minutes_night", "alert_minutes_workday", "raw_alert_record_count", "merged_alert_episode_count", "max_alert_duration", "longest_alert_free_window_minutes")] == [1440, 540, 540, 2, 1, 1380, 0]
    assert k["last_alert_time"] == D(2022, 1, 4) and rows["K", 4]["alert_minutes_total"] == 60 and rows["L", 3]["longest_alert_free_window_minutes"] == 540
    assert rows["L", 4]["max_alert_duration"] is None and rows["L", 4]["longest_alert_free_window_minutes"] == 1440
    nat = {r["date"].day: r for r in features.national_day(hours, features.region_day(rec, merged, hours)).collect()}
    assert nat[3]["max_regions_simultaneously_alerted"] == 2 and nat[4]["national_alert_burden_index"] == pytest.approx(60 / 1980)


def test_clock_change(spark):
    """The clocks go forward at 03:00; an interval of two hours stays two hours."""
    rec = intervals.local_records(alerts(spark, [("K", D(2022, 3, 26, 23, 30), D(2022, 3, 27, 1, 30))]))
    got = {r["datetime_hour"].hour: r["minutes"] for r in intervals.minutes_by_hour(intervals.merged_by_day(rec)).collect()}
    assert got == {1: 30, 2: 60, 3: 30}


def test_touching_intervals_merge(spark):
    rec = intervals.local_records(alerts(spark, [("K", D(2022, 1, 1, 1), D(2022, 1, 1, 2)), ("K", D(2022, 1, 1, 2), D(2022, 1, 1, 23)), ("K", D(2022, 1, 2, 1), D(2022, 1, 2, 2))]))
    assert intervals.merged(rec).count() == 2


def test_stitching(spark):
    """Only parts that touch midnight are seen region by region; runs over days, gaps at midnight and whole days."""
    rows = [("K", D(2022, 1, 1, 20), D(2022, 1, 4, 1)), ("K", D(2022, 1, 4, 21), D(2022, 1, 4, 22)), ("K", D(2022, 1, 4, 20), D(2022, 1, 4, 21, 30)), ("L", D(2022, 1, 1, 21), D(2022, 1, 1, 22)), ("L", D(2022, 1, 1, 23), D(2022, 1, 2, 22))]
    rec = spark.createDataFrame(rows, "region string, s timestamp_ntz, e timestamp_ntz")
    want = [("K", D(2022, 1, 1, 20), D(2022, 1, 4, 1)), ("K", D(2022, 1, 4, 20), D(2022, 1, 4, 22)), ("L", D(2022, 1, 1, 21), D(2022, 1, 1, 22)), ("L", D(2022, 1, 1, 23), D(2022, 1, 2, 22))]
    assert sorted(map(tuple, intervals.merged(rec).collect())) == want
    seen = intervals.islands(intervals.by_day(rec), ["region"], "cs", "ce")
    assert sorted(map(tuple, seen.collect())) == want


def test_median_by_selection(spark):
    """Groups whose values are spread, tied, skewed by powers, or few, against the plain median; a hot region and day."""
    draw = np.random.default_rng(11)
    groups = {"spread": draw.normal(size=3001), "tied": np.r_[np.full(1500, 2.0), draw.random(500), [1.0]], "powers": 2.0 ** draw.integers(-900, 900, 2000), "even": np.arange(2000.0), "two": np.r_[np.zeros(1000), np.ones(1000)], "few": draw.random(9), "most": np.r_[np.full(1990, 5.0), np.arange(5.0)]}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "x", small=100).collect()}
    assert got == {k: np.median(v) for k, v in groups.items()}
    recs = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("region"), F.lit("2022-01-01 10:00:00").cast("timestamp_ntz").alias("s"), (F.col("id") * 7919 % 997 / 7).alias("duration_minutes"), F.lit("2022-01-01 11:00:00").cast("timestamp_ntz").alias("e"))
    plain, hot = (sorted(intervals.daily_stats(recs, n).select("region", "date", "raw_alert_record_count", "max_alert_duration", "first_alert_time", "last_alert_time", "median_alert_duration").collect()) for n in (10**6, 1500))
    assert plain == hot and len(hot) == 2


def test_empty(spark):
    rec = intervals.local_records(alerts(spark, []))
    merged, regions = intervals.merged_by_day(rec), features.spans(rec)
    hours = features.region_hour(merged, regions)
    assert hours.count() == 0 and metrics.region_day_metrics(features.region_day(rec, merged, hours)).count() == 0


def test_inequality(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (1, 3.0), (2, 0.0), (2, 0.0), (3, 0.0), (3, 0.0), (3, 10.0)], "date int, v double")
    got = {r["date"]: r["g"] for r in metrics.gini_of(df, "v", "date", "g").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: pytest.approx(2 / 3)}
    got = {r["date"]: r["t"] for r in metrics.top_bottom(df, "v", "date", "t").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None}


def test_labels_and_division(spark):
    row = spark.range(1).select(scalars.safe_divide(F.lit(10), F.lit(0)).alias("a"), scalars.safe_divide(F.lit(10), F.lit(2)).alias("b"), *[scalars.category(F.lit(x)).alias(f"c{i}") for i, x in enumerate((0.0, 0.33, 0.66))]).first()
    assert tuple(row) == (None, 5.0, "low", "medium", "high")


def split_points(values: np.ndarray, count: int, least: int, step: int = 5) -> list[int]:
    """Binary segmentation by squared error: the split with the largest gain, again and again, on a grid of `step`."""
    total, squares = np.r_[0, np.cumsum(values)], np.r_[0, np.cumsum(values**2)]
    cost = lambda a, b: squares[b] - squares[a] - (total[b] - total[a]) ** 2 / (b - a)
    edges = [0, len(values)]
    for _ in range(count):
        best = None
        for a, b in zip(edges, edges[1:]):
            points = np.array([p for p in range(a, b) if p % step == 0 and p - a >= least and b - p >= least], int)
            if len(points):
                gain = cost(a, b) - cost(a, points) - cost(points, b)
                k = len(gain) - 1 - int(np.argmax(gain[::-1]))
                if best is None or gain[k] > best[0]:
                    best = (gain[k], int(points[k]))
        if best is None:
            return []
        edges = sorted([*edges, best[1]])
    return edges[1:-1]


def change_dates(values: np.ndarray, dates: list, most: int = 3) -> list:
    """First days of new regimes: splits whose neighbouring means differ by 60 minutes and half a deviation at least."""
    n = len(values)
    if n != len(dates) or n < 18 or values.max() == 0 or values.std() < 1e-9:
        return []
    least = max(3, min(30, n // 6))
    points = split_points(values, min(most, max(1, n // least - 1)), least)
    edges = [0, *points, n]
    limit = max(60.0, 0.5 * values.std(ddof=1))
    return [dates[p] for a, p, b in zip(edges, points, edges[2:]) if abs(values[p:b].mean() - values[a:p].mean()) >= limit]


def test_change_points(spark):
    """Native rounds against a search by arrays, with blocks that cut the series."""
    draw = np.random.default_rng(5)
    series = {"up": np.r_[np.zeros(45), np.full(45, 300.0)], "even": np.tile([100.0, 105.0], 45), "zero": np.zeros(90), "short": np.r_[np.zeros(8), np.full(8, 900.0)], "flat": np.full(50, 7.0), "tie": np.r_[np.zeros(30), np.full(30, 600.0), np.zeros(30)]}
    series |= {f"r{i}": np.concatenate([np.full(draw.integers(5, 90), draw.integers(0, 12) * 120.0) + draw.integers(0, 3, 1) * 60 for _ in range(draw.integers(1, 7))]) for i in range(25)}
    days = lambda v: [date(2022, 1, 1) + timedelta(days=i) for i in range(len(v))]
    rows = [(r, d, float(x)) for r, v in series.items() for d, x in zip(days(v), v)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(str(r), d, float(x)) for r, d, x in rows], "region_name string, date date, alert_minutes_total double")
    for block in (4096, 7):
        got = {r["region"]: (r["n_change_points"], r["change_point_dates"]) for r in timeseries.change_points(df, block=block).collect()}
        want = {r: change_dates(v, [str(d) for d in days(v)]) for r, v in series.items()}
        assert got == {r: (len(w), ";".join(w)) for r, w in want.items()}
    assert got["up"] == (1, "2022-02-15") and got["even"] == (0, "")
    assert timeseries.change_points(df.limit(0)).count() == 0


def test_rolling_over_blocks(spark):
    """A region's series in many blocks gives the rows that one window over the region gives, and fills several tasks."""
    rows = spark.range(2000).select(F.when(F.col("id") % 20 == 0, "L").otherwise("K").alias("region_name"), F.col("id").alias("date"), (F.col("id") * 37 % 101).cast("double").alias("alert_minutes_total"), (F.col("id") % 7 / 7).alias("alert_burden_index"))
    whole = Window.partitionBy("region_name").orderBy("date")
    want = rows.select("region_name", "date", *[F.round(F.avg("alert_minutes_total").over(whole.rowsBetween(1 - n, 0)), 9).alias(f"alert_minutes_{n}d_mean") for n in (7, 14, 30)], F.round(F.coalesce(F.stddev_samp("alert_burden_index").over(whole.rowsBetween(-29, 0)), F.lit(0.0)), 9).alias("abi_30d_std"))
    got = timeseries.rolling(rows.repartition(5), block=50)
    rounded = got.select("region_name", "date", *[F.round(c, 9).alias(c) for c in want.columns[2:]])
    assert sorted(rounded.collect()) == sorted(want.collect()) and set(got.columns) >= set(rows.columns)
    assert "pos" not in got.columns and len(got.groupBy(F.floor(F.col("date") / 50)).count().collect()) == 40
    with pytest.raises(ValueError, match="need blocks"):
        timeseries.rolling(rows, block=20)


def test_rolling_keeps_regions_apart(spark):
    df = spark.createDataFrame([("K", 2, 20.0, 0.2), ("K", 1, 10.0, 0.1), ("K", 3, 30.0, 0.3), ("L", 1, 100.0, 0.9)], "region_name string, date int, alert_minutes_total double, alert_burden_index double")
    rows = timeseries.rolling(df).orderBy("region_name", "date").collect()
    assert [r["alert_minutes_7d_mean"] for r in rows] == [10, 15, 20, 100] and rows[0]["abi_14d_std"] == 0


def test_clean_intervals(spark, tmp_path):
    (tmp_path / cleaning.OFFICIAL_FILE).write_text("oblast,raion,hromada,level,started_at,finished_at,source\n" + "Kyivska oblast,,,oblast,2022-03-15 01:00:00+00:00,2022-03-15 02:00:00+00:00,official\n" * 2 + "Lvivska oblast,,,oblast,2022-03-15 03:00:00+00:00,2022-03-15 03:00:00+00:00,official\n")
    (tmp_path / cleaning.VOLUNTEER_FILE).write_text("region,started_at,finished_at,naive\n Kyiv City ,2022-03-01 01:00:00+00:00,2022-03-01 01:30:00+00:00,False\nKyiv City,2022-03-16 01:00:00+00:00,2022-03-16 01:30:00+00:00,False\n")
    rows = cleaning.build_clean_intervals(spark, tmp_path).orderBy("alert_id").collect()
    assert [(r["alert_id"], r["source"], r["region"], r["duration_minutes"]) for r in rows] == [(1, "volunteer", "Kyiv City", 30.0), (2, "official", "Kyivska oblast", 60.0)]
    with pytest.raises(FileNotFoundError, match="Missing required raw file"):
        cleaning.build_clean_intervals(spark, tmp_path / "none")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("region,alerts\nKyiv,3\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.csv").write_text("x\n1\n")
    (tmp_path / "c.txt").write_text("no")
    assert [r["path"].rsplit("/", 1)[1] for r in files.raw_files(spark, str(tmp_path)).collect()] == ["a.csv"]
    assert files.inspect_dataset(spark, tmp_path).first()["rows"] == 1
    with pytest.raises(ValueError, match="Unsupported file type"):
        files.load_any_file(spark, tmp_path / "c.txt")


def test_files_are_published_and_found(spark, tmp_path):
    df = spark.createDataFrame([("Kyiv", 3)], "region string, alerts long")
    at = str(tmp_path / "table")
    files.publish(df, at)
    files.publish(df.union(df), at)
    assert spark.read.parquet(at).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["table"]
    assert files.load_tables(spark, str(tmp_path), ["none"], []) is None
    files.publish(df, f"{at}.parquet")
    got = files.load_tables(spark, str(tmp_path), ["table"], ["none"])
    assert got["none"] is None and got["table"].count() == 1
    (tmp_path / "a.csv").write_text("x\n1\n")
    kept = files.build_manifest(spark, str(tmp_path), ["a.csv", "b.csv"], {"archive": "old", "files": {}})
    assert kept == {"archive": "old", "files": {"a.csv": {"exists": True, "size_bytes": 4}, "b.csv": {"exists": False, "size_bytes": None}}}
    files.write_manifest(spark, f"{tmp_path}/m.json", kept)
    assert files.read_manifest(spark, f"{tmp_path}/m.json") == kept and files.read_manifest(spark, f"{tmp_path}/none.json") == {}
    assert files.missing_files(spark, str(tmp_path), ["a.csv", "b.csv"]) == ["b.csv"]
    files.write_inventory(files.inspect_dataset(spark, str(tmp_path)), f"{tmp_path}/inventory")
    assert spark.read.option("header", True).csv(f"{tmp_path}/inventory").filter("path like '%a.csv'").first()["rows"] == "1"
    digest = files.file_digests(spark, f"{tmp_path}/a.csv").first()["sha256"]
    assert digest == hashlib.sha256(b"x\n1\n").hexdigest()


def test_checks(spark, tmp_path):
    inf = float("inf")
    df = spark.createDataFrame([(0.5, "low"), (None, None), (1.5, "odd")], "x double, label string")
    checks = quality.range_checks(df, {"x": (0.0, 1.0)})
    assert [r["passed"] for r in checks.collect()] == [False]
    with pytest.raises(ValueError, match="validation failed: x"):
        quality.publish_checked(df, f"{tmp_path}/t", checks)
    assert not (tmp_path / "t").exists()
    good = df.filter("x < 1")
    quality.publish_checked(good, f"{tmp_path}/t", quality.range_checks(good, {"x": (0.0, 1.0)}))
    assert snapshots.read_snapshot(spark, f"{tmp_path}/t").count() == 1
    assert not quality.labels_are_valid(df, "label", {"low"}) and quality.labels_are_valid(df, "label", {"low", "odd"}) and not quality.labels_are_valid(df, "none", {"low"})
    assert not quality.has_infinite(df) and quality.has_infinite(spark.createDataFrame([(-inf,)], "x double")) and not quality.has_infinite(df.select("label"))
    times = spark.range(1).select(F.current_timestamp().alias("a"), F.current_timestamp().cast("timestamp_ntz").alias("b"))
    assert quality.has_zone(times, "a") and not quality.has_zone(times, "b")
    with pytest.raises(ValueError, match="Missing required columns in alerts: finished_at_utc"):
        intervals.local_records(spark.createDataFrame([], "region string, started_at_utc timestamp_ntz"))


def test_public_words(spark):
    rows = spark.createDataFrame([(None, None, None), ("worsening", "strong shift", 90.0), ("odd", "odd", -30.0), ("stable", "possible shift", 120000.0)], "trend string, shift string, m double")
    c = F.col
    got = rows.select(dashboard.public_trend(c("trend")), dashboard.public_shift(c("shift")), dashboard.hours_text(c("m")), dashboard.hours_per_day(c("m"), True), dashboard.decimal_text(c("m")))
    assert [tuple(r) for r in got.collect()] == [
        ("not available", "not available", "n/a", "n/a", "n/a"), ("historically increased", "repeated statistical shifts", "2 h", "+1.5 h/day", "90.000"),
        ("mixed historical pattern", "possible statistical shift", "-0 h", "-0.5 h/day", "-30.000"), ("historically stable", "possible statistical shift", "2,000 h", "+2,000.0 h/day", "120,000.000"),
    ]
