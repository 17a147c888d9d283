"""Rolling statistics, period comparison, labels and change points of daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_zero, shift_label, trend_label, volatility_label
from ..sources.files import has_columns, written

#: rows of one region's series that a task takes at once
BLOCK = 4096


def placed(df: DataFrame, key: str = "region_name", order: str = "date") -> DataFrame:
    """df with pos, a row's place in its region's series (from 0), and n, the length of that series. Rows are sorted by range and
    written, so that a long series fills several tasks; a place is the one in its partition plus the counts of those before."""
    if {"pos", "n"} <= set(df.columns):
        return df
    rows = df.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    rows = written(rows, "placed")
    parts = Window.partitionBy("_key")  # a row for each partition that has rows of the region
    sizes = rows.groupBy(F.col(key).alias("_key"), F.col("_p").alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_i").alias("_first"))
    sizes = sizes.withColumns({"_before": F.sum("_c").over(parts.orderBy("_part")) - F.col("_c"), "n": F.sum("_c").over(parts)})
    rows = rows.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_part")))
    return rows.select(*df.columns, (F.col("_i") - F.col("_first") + F.col("_before")).alias("pos"), "n")


def trailing(df: DataFrame, columns: dict[str, tuple], key: str = "region_name", order: str = "date", block: int = BLOCK) -> DataFrame:
    """df with columns over the rows before: name -> (aggregate, rows). A series is cut into blocks; each also gets the last rows of
    the one before as a lead-in, so that a window never goes beyond its block and a long series fills several tasks."""
    rows, reach = placed(df, key, order), max(n for _, n in columns.values()) - 1
    if reach > block:
        raise ValueError(f"windows of {reach + 1} rows need blocks of {reach} rows at least")
    own = F.floor(F.col("pos") / block)
    copies = F.when(F.col("pos") % block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_block", F.explode(copies))
    at = Window.partitionBy(key, "_block").orderBy("pos")
    return rows.withColumns({name: f(at.rowsBetween(1 - n, 0)) for name, (f, n) in columns.items()}).filter(F.col("_block") == own).drop("_block")


def rolling(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Trailing means over 7, 14 and 30 rows, sample deviations over 14 and 30 (0 for a single row), of each region."""
    mean, std = (lambda v: lambda w: F.avg(v).over(w)), (lambda v: lambda w: F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0)))
    out: dict[str, tuple] = {}
    for name, value in (("alert_minutes", "alert_minutes_total"), ("abi", "alert_burden_index")):
        out |= {f"{name}_{n}d_mean": (mean(value), n) for n in (7, 14, 30)}
        out |= {f"{name}_{n}d_std": (std(value), n) for n in (14, 30)}
    rows = trailing(df, out, block=block)
    return rows.select(*[c for c in df.columns if c not in out], *out)


def add_rolling(df: DataFrame, metric: str, window: int = 14, block: int = BLOCK) -> DataFrame:
    if not has_columns(df, {"region_name", "date", metric}):
        return df
    name = f"{metric}_rolling"
    rows = trailing(df, {name: (lambda w: F.avg(metric).over(w), window)}, block=max(block, window))
    return rows.select(*[c for c in df.columns if c != name], name)


def prefix_sums(rows: DataFrame, value: Column, key: str = "region_name", block: int = BLOCK) -> DataFrame:
    """Rows of placed() with t, the sum of the value over the region's rows up to and with this one, block by block."""
    rows = rows.withColumns({"_v": value, "_block": F.floor(F.col("pos") / block)})
    sums = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(F.sum("_v").alias("_s"))
    sums = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy("_key").orderBy("_b")) - F.col("_s"))  # a row for each block
    inside = F.sum("_v").over(Window.partitionBy(key, "_block").orderBy("pos"))
    rows = rows.withColumn("_inside", inside).join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    return rows.withColumn("t", F.col("_inside") + F.col("_before")).drop("_v", "_block", "_key", "_b", "_s", "_before", "_inside")


def change_points(df: DataFrame, most: int = 3, step: int = 5, block: int = BLOCK) -> DataFrame:
    """region, n_change_points, change_point_dates (joined by semicolons): first days of new regimes.

    Binary segmentation by squared error, of all regions side by side: in each round the split with the largest gain, on a grid of
    `step` rows, divides one segment of a region; earlier segments and later points win ties. Costs come from prefix sums, so a
    round is one join of the grid's points with the few segments and one maximum. Neighbouring segments count as different if
    their means differ by 60 minutes and half a deviation at least. A region gets none if its series is short, constant or
    zero, or if a round finds no split."""
    at, c = "region_name", F.col
    rows = placed(df, at)
    rows = rows.select(at, "date", "pos", "n", finite_or_zero(F.col("alert_minutes_total").cast("double")).alias("v"))
    points = written(prefix_sums(rows, c("v"), at, block).select(at, "date", (c("pos") + 1).alias("p"), "t", "v"), "points")
    of = points.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"), F.stddev_pop("v").alias("pop"), F.stddev_samp("v").alias("sd"), F.max_by("t", "p").alias("total"))
    of = written(of, "series")  # a row for each region
    least = F.greatest(F.lit(3), F.least(F.lit(30), F.floor(c("n") / 6)))
    fit = of.filter("n >= 18 AND top <> 0 AND pop >= 1e-9").select(at, "n", "sd", "total", least.alias("least"))
    fit = fit.withColumn("rounds", F.least(F.lit(most), F.greatest(F.lit(1), F.floor(c("n") / c("least")) - 1)))
    segments = fit.select(at, "sd", "least", "rounds", F.lit(0).cast("long").alias("a"), F.lit(0.0).alias("ta"), c("n").alias("b"), c("total").alias("tb"))
    grid = points.filter(c("p") % step == 0).select(c(at).alias("r"), "p", "t")
    square = lambda x, k: x * x / k
    for k in range(most):
        inside = grid.join(segments, c("r").eqNullSafe(c(at)) & (c("p") - c("a") >= c("least")) & (c("b") - c("p") >= c("least")) & (c("rounds") > k))
        gain = square(c("t") - c("ta"), c("p") - c("a")) + square(c("tb") - c("t"), c("b") - c("p")) - square(c("tb") - c("ta"), c("b") - c("a"))
        split = inside.groupBy("r").agg(F.max(F.struct(gain.alias("gain"), (-c("a")).alias("minus"), c("p"), c("t"))).alias("x")).select("r", (-c("x.minus")).alias("split"), "x.p", "x.t")
        shape = ["a", "ta", "b", "tb"]
        both = F.when(c("split").isNull(), F.array(F.struct(*shape))).otherwise(F.array(F.struct("a", "ta", c("p").alias("b"), c("t").alias("tb")), F.struct(c("p").alias("a"), c("t").alias("ta"), "b", "tb")))
        segments = segments.join(split, c(at).eqNullSafe(c("r")) & (c("a") == c("split")), "left").select(at, "sd", "least", "rounds", F.explode(both).alias("e")).select(at, "sd", "least", "rounds", "e.*")
        segments = written(segments, "segments")  # most + 1 rows for each region
    few = Window.partitionBy(at)
    mean = (c("tb") - c("ta")) / (c("b") - c("a"))
    shifts = segments.withColumns({"mean": mean, "found": F.count(F.lit(1)).over(few)}).withColumn("before", F.lag("mean").over(few.orderBy("a")))
    shifts = shifts.filter((c("found") == c("rounds") + 1) & (F.abs(c("mean") - c("before")) >= F.greatest(F.lit(60.0), 0.5 * c("sd")))).select(c(at).alias("r"), (c("a") + 1).alias("first"))
    dated = points.join(shifts, c(at).eqNullSafe(c("r")) & (c("p") == c("first"))).groupBy("r").agg(F.array_sort(F.collect_list(c("date").cast("string"))).alias("dates"))
    out = of.join(dated, c(at).eqNullSafe(c("r")), "left")
    return out.select(c(at).alias("region"), F.coalesce(F.size("dates"), F.lit(0)).cast("long").alias("n_change_points"), F.coalesce(F.array_join("dates", ";"), F.lit("")).alias("change_point_dates"))


def periods(df: DataFrame) -> DataFrame:
    """Per region: mean, deviation, means of thirds, of the last 30 rows and the 30 before, ratio and delta."""
    rows = placed(df).select("region_name", (F.col("pos") + 1).alias("i"), "n", finite_or_zero(F.col("alert_minutes_total")).alias("m"), finite_or_zero(F.col("alert_burden_index")).alias("b"))
    a = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    b = F.greatest(a + 1, F.floor(2 * F.col("n") / 3))
    few, i, n = F.col("n") < 3, F.col("i"), F.col("n")
    parts = {"early": few | (i <= a), "middle": few | ((i > a) & (i <= b)), "late": few | (i > b)}
    means = [F.avg(F.when(p, F.col(c))).alias(f"{name}_mean_{label}") for c, label in (("m", "alert_minutes"), ("b", "abi")) for name, p in parts.items()]
    back = n - i
    last, prev = F.avg(F.when(back < 30, F.col("m"))), F.avg(F.when((back >= 30) & (back < 60), F.col("m")))
    out = rows.groupBy("region_name").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("m").alias("mean_alert_minutes"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std_alert_minutes"),
        *means, last.alias("latest_30d_alert_minutes_mean"), F.coalesce(prev, last).alias("previous_30d_alert_minutes_mean"),
    )
    early, late = F.col("early_mean_alert_minutes"), F.col("late_mean_alert_minutes")
    ratio = F.when((early == 0) & (late == 0), 1.0).when(early == 0, None).otherwise(F.try_divide(late, early))
    return out.withColumns({
        "late_vs_early_alert_minutes_ratio": ratio, "late_vs_early_abi_delta": F.col("late_mean_abi") - F.col("early_mean_abi"), "latest_vs_previous_30d_delta": F.col("latest_30d_alert_minutes_mean") - F.col("previous_30d_alert_minutes_mean"),
        "volatility_label": volatility_label(F.col("std_alert_minutes")), "trend_label": trend_label(early, late, F.col("early_mean_abi"), F.col("late_mean_abi")),
    }).withColumnRenamed("region_name", "region")


def summary(df: DataFrame) -> DataFrame:
    df = placed(df)
    return periods(df).join(change_points(df), "region", "left").withColumn("regime_shift_label", shift_label(F.col("n_change_points")))
