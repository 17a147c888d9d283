"""Published versions, day tables, streams, layouts, the inventory and the scratch folder."""

import json
import os
import subprocess
import sys
from datetime import date
from datetime import datetime as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features, intervals, quality
from tidewatch.plans import dashboard, registry
from tidewatch.sources import files, snapshots
from tidewatch.sources.daytables import DayTables
from tidewatch.streaming.merge import closed_intervals, file_stream, follow

SF = "/root/testdata/sf0.001"
ROUNDED = lambda df: sorted(map(str, registry._rounded(df.select(*sorted(df.columns))).collect()))


def test_readers_find_a_version_between_all_steps(spark, tmp_path):
    at, table = str(tmp_path / "t"), lambda n: spark.range(n)
    with pytest.raises(FileNotFoundError, match="Missing required table"):
        snapshots.read_snapshot(spark, at)
    snapshots.publish_snapshot(table(1), at)
    opened = snapshots.read_snapshot(spark, at)
    seen = {step: snapshots.read_snapshot(spark, at).count() for step in snapshots.steps(table(2), at)}
    assert seen == {"written": 1, "pointer written": 1, "published": 2, "pruned": 2}
    assert opened.count() == 1  # a reader that resolved the version before can still read it
    for n in (3, 4):
        snapshots.publish_snapshot(table(n), at)
    assert snapshots.read_snapshot(spark, at).count() == 4 and len(list(tmp_path.glob("t/v-*"))) == 2


def test_a_publish_that_fails_leaves_the_version_before(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.publish_snapshot(spark.range(1), at)
    slow = snapshots.steps(spark.range(5), at)
    next(slow)
    snapshots.publish_snapshot(spark.range(2), at)  # another writer takes the number
    with pytest.raises(FileExistsError):
        list(slow)
    with pytest.raises(Exception, match="(?i)divi"):
        snapshots.publish_snapshot(spark.range(3).select(F.lit(1) / (F.col("id") - 1)), at)
    assert snapshots.read_snapshot(spark, at).count() == 2 and len(list(tmp_path.glob("t/v-*"))) == 2


def test_checks_are_measured_by_the_write(spark, tmp_path):
    at, bounds, labels = str(tmp_path / "t"), {"x": (0.0, 1.0)}, {"label": {"low"}}
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    good = spark.createDataFrame([(0.5, "low"), (None, None)], "x double, label string").mapInArrow(count, "x double, label string")
    assert quality.publish_measured(good, at, bounds, labels) == {"x": True, "label": True, "no_infinite_values": True}
    assert counted.value == 2  # each row was computed once
    for bad, what in (((1.5, "low"), "x"), ((0.1, "odd"), "label"), ((float("inf"), "low"), "x, no_infinite_values")):
        with pytest.raises(ValueError, match=f"validation failed: {what}"):
            quality.publish_measured(spark.createDataFrame([bad], "x double, label string"), at, bounds, labels)
    with pytest.raises(ValueError, match="validation failed: label"):
        quality.publish_measured(spark.createDataFrame([(0.5,)], "x double"), at, bounds, labels)
    assert snapshots.read_snapshot(spark, at).count() == 2 and len(list(tmp_path.glob("t/v-*"))) == 1
    assert quality.publish_measured(good.limit(0), at, bounds, labels)["x"]


def rebuilt(alerts):
    """The same tables by a full rebuild."""
    rec = intervals.local_records(alerts)
    merged = intervals.merged_by_day(rec)
    return intervals.merged(rec), features.region_day(rec, merged, features.region_hour(merged, features.spans(rec)))


def same(tables, alerts):
    merged, days = rebuilt(alerts)
    assert ROUNDED(tables.merged_intervals()) == ROUNDED(merged)
    assert ROUNDED(tables.region_days()) == ROUNDED(days)


def test_only_touched_days_are_rebuilt(spark, tmp_path):
    rows = registry.alerts(spark, SF)
    day = F.to_date("started_at_utc")
    late = day.isin(date(2024, 1, 9), date(2024, 1, 20)) & (F.col("alert_id") % 3 == 0)
    tables = DayTables(spark, str(tmp_path))
    tables.add(rows.filter(~late), "a")
    files_of = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for t in ("merged", "days") for p in (tmp_path / t).rglob("*.parquet")}
    before = files_of()
    touched = tables.add(rows.filter(late), "b")
    after = files_of()
    changed = {p.parts[1] for p in {*before, *after} if before.get(p) != after.get(p)}
    assert changed == {f"date={d}" for d in touched} and 2 <= len(touched) <= 4  # an interval may go on into the next day
    same(tables, rows)
    tables.add(rows.filter(late), "b")
    same(tables, rows)
    assert tables.add(rows.limit(0), "c") == []
    plan = tables.read("days").filter(F.col("date") == date(2024, 1, 9))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def write_events(spark, folder, part, name):
    part.coalesce(1).write.parquet(f"{folder}/.{name}")
    os.makedirs(f"{folder}/events", exist_ok=True)
    next(Path(f"{folder}/.{name}").glob("*.parquet")).rename(f"{folder}/events/{name}.parquet")


class Failing(DayTables):
    """Fails once, after the batch's parts are written and before days are rebuilt."""

    fail = True

    def rebuild(self, dates):
        if self.fail and self.read("parts").select("batch").distinct().count() == 2:
            raise RuntimeError("lost")
        super().rebuild(dates)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Files in several batches, a batch that fails half way, a restart, and records of old days that come last."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    late = F.col("event_id") % 5 == 0
    for k in range(3):
        write_events(spark, tmp_path, events.filter(~late & (F.col("event_id") % 3 == k)), f"{k}")
    tables, checkpoint = Failing(spark, str(tmp_path / "tables")), str(tmp_path / "checkpoint")
    run = lambda: follow(registry.alerts_of(file_stream(spark, f"{tmp_path}/events", 1)), tables, checkpoint).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    tables.fail = False
    run()
    same(tables, registry.alerts_of(events.filter(~late)))
    write_events(spark, tmp_path, events.filter(late), "late")
    run()
    same(tables, registry.alerts_of(events))


def test_closed_intervals_and_late_records(spark, tmp_path):
    shape = "region string, s timestamp_ntz, e timestamp_ntz"
    at = lambda h, m=0: D(2024, 1, 1, h, m)
    batches = [
        [("K", at(1), at(2)), ("K", at(2), at(3)), ("K", at(4), at(5)), ("L", at(1), at(9)), ("L", at(4), at(4))],
        [("K", at(4, 30), at(6)), ("K", at(10), at(11)), ("L", at(8), at(9, 30))],
        [("K", at(1, 30), at(2, 30)), ("K", at(20), at(21))],  # the first comes too late
        [("L", at(22), at(23))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = closed_intervals(file_stream(spark, f"{tmp_path}/in"), "1 hour")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema("region string, s timestamp_ntz, e timestamp_ntz, n_records long").parquet(f"{tmp_path}/out").collect())
    assert got == [("K", at(1), at(3), 2), ("K", at(4), at(6), 2), ("K", at(10), at(11), 1), ("K", at(20), at(21), 1), ("L", at(1), at(9, 30), 2)]


def test_folders_that_are_read_grow_with_the_range(spark):
    table = files.written(dashboard.laid_out(registry.rolling(spark, SF)), "rolling", "region_name", "year")
    read = lambda a, b, *names: dashboard.filter_region_day(table, list(names), a, b).select(F.col("_metadata.file_path").alias("f")).distinct().count()
    one, two = read("1995-01-01", "1995-12-31", "ASIA"), read("1995-06-01", "1996-02-01", "ASIA")
    assert one == 1 and two == 2 and read("1995-01-01", "1995-12-31", "ASIA", "EUROPE") == 2
    plan = registry.region_series(spark, SF, "ASIA")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region_name" in plan or "PartitionFilters: [(region_name" in plan
    days = registry.Tables(spark, SF).days
    plan = dashboard.filter_region_day(days, ["R01"], "2024-01-05", "2024-01-06")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(region_name)" in plan


def test_inventory_of_many_files(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i:02d}.csv").write_text("région,alerts\n" + "Kyiv,3\n" * i)
    (tmp_path / "g.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "h.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    (tmp_path / "i.json").write_text("{broken")
    (tmp_path / "j.csv").write_text('a,b\n1,"two\nlines"\n1,2,3\n')
    (tmp_path / "k.parquet").write_bytes(b"no")
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.sparkContext.setJobGroup("inventory", "inventory")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.inspect_dataset(spark, str(tmp_path)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("inventory"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 12 and len(rows) == 46
    assert [rows[f"f{i:02d}.csv"]["rows"] for i in range(40)] == list(range(40)) and json.loads(rows["f03.csv"]["columns"]) == ["région", "alerts"]
    assert "région" in rows["f03.csv"]["columns"] and json.loads(rows["f03.csv"]["dtypes"]) == ["string", "bigint"]
    assert rows["g.jsonl"]["rows"] == 2 and rows["h.json"]["column_count"] == 2
    assert all(rows[n]["load_error"] and rows[n]["rows"] is None for n in ("i.json", "j.csv", "k.parquet"))
    assert next(r for n, r in rows.items() if n.startswith("part-"))["rows"] == 7
    large = {r["path"].rsplit("/", 1)[1]: r for r in files.inspect_dataset(spark, str(tmp_path), whole=20).collect()}
    assert large["f03.csv"]["rows"] == 3 and large["k.parquet"]["load_error"] and set(large) == set(rows)
    assert files.inspect_dataset(spark, str(tmp_path / "none")).count() == 0


def test_all_kinds_of_files_are_loaded(spark, tmp_path):
    want = [("Kyiv", 3), ("Lviv", 4)]
    (tmp_path / "a.csv").write_text("region,alerts\nKyiv,3\nLviv,4\n")
    (tmp_path / "a.json").write_text('[{"region": "Kyiv", "alerts": 3},\n {"region": "Lviv", "alerts": 4}]')
    (tmp_path / "a.jsonl").write_text('{"region": "Kyiv", "alerts": 3}\n{"region": "Lviv", "alerts": 4}\n')
    spark.createDataFrame(want, "region string, alerts long").coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    for ending in ("csv", "json", "jsonl", "parquet"):
        assert sorted(tuple(r) for r in files.load_any_file(spark, str(tmp_path / f"a.{ending}")).select("region", "alerts").collect()) == want


def test_inputs_of_later_stages(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Missing required feature input: .*Build the features first"):
        files.stage_input(spark, "metrics", str(tmp_path / "none"), set())
    spark.range(2).write.parquet(str(tmp_path / "t"))
    assert files.stage_input(spark, "metrics", str(tmp_path / "t"), {"id"}).count() == 2
    with pytest.raises(ValueError, match="Missing required columns in clean alerts input: a, b"):
        files.stage_input(spark, "features", str(tmp_path / "t"), {"b", "a", "id"})
    assert files.has_columns(spark.range(1), {"id"}) and files.missing_columns(spark.range(1), {"id", "x"}) == ["x"]
    assert files.display_path("/a/b/c.csv", "/a") == "b/c.csv" and files.display_path("/ab/c.csv", "/a") == "/ab/c.csv"


SCRIPT = """
import sys, os
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from tidewatch.plans import registry
from tidewatch.sources.files import shared_folder
assert registry.QUERIES["region_day_features"](spark, "/root/testdata/sf0.001").count() > 0
print("FOLDER", shared_folder(spark), os.path.isdir(shared_folder(spark)))
spark.stop()
"""


def test_scratch_without_a_checkpoint_folder(tmp_path):
    """Where the cluster names no folder, a temporary one serves; it is gone when the application has ended."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parent.parent)}
    got = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert got.returncode == 0, got.stderr[-2000:]
    _, folder, there = next(x for x in got.stdout.splitlines() if x.startswith("FOLDER")).split()
    assert there == "True" and not os.path.exists(folder)
