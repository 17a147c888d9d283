"""Published tables: each version in a folder of its own, and numbered pointers of which the last names the version to read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .files import store

POINTERS = "_pointers"


def _pointers(spark: SparkSession, path: str) -> dict[int, str]:
    """Versions by number."""
    fs, at = store(spark, f"{path}/{POINTERS}")
    if not fs.exists(at):
        return {}
    out = {}
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.isdigit():
            stream = fs.open(status.getPath())
            try:
                out[int(name)] = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return out


def resolve(spark: SparkSession, path: str) -> str | None:
    """The folder of the version to read now; None where nothing was published."""
    known = _pointers(spark, path)
    return f"{path}/{known[max(known)]}" if known else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    folder = resolve(spark, path)
    if not folder:
        raise FileNotFoundError(f"Missing required table: {path}. Publish it first.")
    return spark.read.parquet(folder)


def steps(df: DataFrame, path: str, *partition_by: str, keep: int = 2, verdict: Callable[[], None] | None = None) -> Iterator[str]:
    """Publishes df, and tells after each step what was done. Readers find the version before or this one at every moment: the
    version is complete before its pointer is written, and the pointer comes in by one rename to a number that nobody has yet. A
    writer that finds the number taken raises, and its version goes. verdict: called when the version is written; what it
    raises keeps the version from being published. The last `keep` versions stay for readers that have resolved them."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    fs, folder = store(spark, f"{path}/{version}")
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    aside = at(f"{POINTERS}/.{version}")
    try:
        number = max(_pointers(spark, path), default=0) + 1
        df.write.partitionBy(*partition_by).parquet(folder.toString())
        if verdict:
            verdict()
        yield "written"
        out = fs.create(aside, True)
        out.write(bytearray(version.encode()))
        out.close()
        yield "pointer written"
        to = at(f"{POINTERS}/{number:012d}")
        if fs.exists(to) or not fs.rename(aside, to):
            raise FileExistsError(f"{path} was published by another writer")
    except BaseException:
        fs.delete(folder, True)
        fs.delete(aside, False)
        raise
    yield "published"
    known = _pointers(spark, path)
    for n in sorted(known)[:-keep]:
        fs.delete(at(f"{POINTERS}/{n:012d}"), False)
        fs.delete(at(known[n]), True)
    yield "pruned"


def publish_snapshot(df: DataFrame, path: str, *partition_by: str, keep: int = 2, verdict: Callable[[], None] | None = None) -> None:
    for _ in steps(df, path, *partition_by, keep=keep, verdict=verdict):
        pass
