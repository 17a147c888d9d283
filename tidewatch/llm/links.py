"""Connected components of a table of links, by star contraction (after Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stash


def _toward_least(both: DataFrame) -> DataFrame:
    """Links (u, v) with m, the least of u and all its v."""
    return both.join(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")


def _round(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself; then so are its smaller ones and
    it. Links are (a, b) with a > b. The second step works where the first one's shuffle put its rows."""
    large = _toward_least(links.union(links.select("b", "a")).toDF("u", "v")).filter("v > u")
    small = _toward_least(large.select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct())
    return small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node and component (its least node) for every node that a link (a, b) of longs touches. Self links are ignored; an
    empty table gives an empty one. Rounds grow with the logarithm of the longest path; each is written out."""
    now = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    for _ in range(rounds):
        seen = Observation()
        now = stash(_round(now).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
        was, mark = mark, (seen.get["n"], seen.get["sum"])
        if mark == was:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")
