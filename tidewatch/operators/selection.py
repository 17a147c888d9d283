"""Exact order statistics of groups of any size, by selection in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import forget, written

#: values that split a group in a round, and the accuracy of the sketch that finds them
SPLITS, ACCURACY = 64, 2000
#: groups that are sent to every task at most; beyond, they are joined by key and Spark splits skewed ones
BROADCAST = 10_000


def _beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST else few, keys)


def exact_median(rows: DataFrame, keys: list[str], value: str, small: int = 1 << 16) -> DataFrame:
    """keys and median (the mean of the two middle values of an even number) of each group with a value that isn't null.

    Groups of up to `small` values take Spark's own median. Of a larger one, each middle rank is a target. A round sketches the
    values that may hold a target and takes SPLITS quantiles; counts how many values equal a quantile or lie between two, each
    task summing first; and goes on with the values of the one bucket that holds the rank. A bucket of equal values ends the
    search, so ties don't stop it, and any other holds about 1/SPLITS of the values, whatever their distribution: rounds grow
    with the logarithm of the largest group, and no task holds a group."""
    spark = rows.sparkSession
    rows = rows.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    sizes = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small), "sizes")
    cold = rows.join(sizes, keys, "left_anti").groupBy(*keys).agg(F.median("v").alias("median"))
    middle = F.explode(F.when(F.col("n") % 2 == 1, F.array(F.floor(F.col("n") / 2))).otherwise(F.array(F.floor(F.col("n") / 2) - 1, F.floor(F.col("n") / 2)))).alias("k")
    targets = sizes.select(*keys, middle).withColumn("t", F.col("k"))
    if targets.isEmpty():
        return cold
    own, found = [*keys, "t"], []
    rows = _beside(rows, targets, keys)
    while True:
        points = [i / SPLITS for i in range(SPLITS + 1)]
        splits = written(rows.groupBy(*own).agg(F.array_distinct(F.percentile_approx("v", points, F.lit(ACCURACY))).alias("splits")), "splits")
        below = F.size(F.filter("splits", lambda s: s < F.col("v")))
        rows = _beside(rows, splits, own).withColumn("bucket", 2 * below + F.array_contains("splits", F.col("v")).cast("int")).drop("splits")
        sums = rows.groupBy(*own, "bucket").agg(F.count(F.lit(1)).alias("c"), F.max("k").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy(*own).orderBy("bucket")) - F.col("c")  # two rows for each split at most
        at = written(sums.withColumn("before", before).filter("before <= k AND k < before + c").withColumn("k", F.col("k") - F.col("before")), "buckets")
        found.append(at.filter("lo = hi").select(*own, F.col("lo").alias("v")))
        rest = _beside(rows.drop("k"), at.filter("lo < hi").select(*own, "bucket", "k", "c"), [*own, "bucket"]).drop("bucket")
        rest = written(rest, "candidates")
        few = rest.filter(F.col("c") <= small)
        place = F.row_number().over(Window.partitionBy(*own).orderBy("v")) - 1
        found.append(few.withColumn("place", place).filter("place = k").select(*own, "v"))
        rows = rest.filter(F.col("c") > small).drop("c")
        forget(spark, splits)
        if rows.isEmpty():
            break
    hot = found[0]
    for more in found[1:]:
        hot = hot.union(more)
    return cold.union(hot.groupBy(*keys).agg(F.avg("v").alias("median")))
