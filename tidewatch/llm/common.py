"""Helpers that several operators share: reading tables, the shared scratch folder, sizes."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder, store


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, and no others: extra columns never reach an operator."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: removes a query's shuffle files when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: rows of one Arrow batch on the way to Python
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: paths that stash() has written in each open scratch() of a thread, the innermost last
_open = threading.local()


def stash(df: DataFrame, label: str = "t", batch_rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage. The shuffle files of the write go with it: what
    follows reads the written table alone, so they would only fill the executors' disks. batch_rows: rows that are sent to
    Python at once, for steps whose texts would make large batches."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    ours = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name in ours:
            spark.conf.set(name, before[name])
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that stash() writes inside are removed at the end, so that a query's disk is what its steps still read. It gives
    keep(df, label), a stash() that outlives it: what leaves the block must read kept tables and those from before alone."""
    scopes = _open.__dict__.setdefault("scopes", [])
    own: list[str] = []
    scopes.append(own)

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = stash(df, label)
        path = own.pop()
        if len(scopes) > 1:
            scopes[-2].append(path)
        return out

    try:
        yield keep
    finally:
        scopes.pop()
        for path in own:
            fs, at = store(spark, path)
            fs.delete(at, True)


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart, and that column's name: what is decided about a row is decided about it alone,
    whatever its doc_id. A row that was read from Parquet is told by its file and its place there, hashed to 64 bits (of n
    rows about n * n / 2**65 pairs are taken for one); other tables are written out with their rows numbered, because a row
    that is computed again may get another number."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    try:
        placed = docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(row))
        placed.schema  # noqa: B018  tells whether the columns are there
        return placed, row
    except AnalysisException:  # no such columns: not read from Parquet
        return stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def bits_for(n: float, least: int = 6, most: int = 22) -> int:
    """The smallest b with 2**b >= n, within limits; 64 buckets at least keep a small input's cores busy."""
    return min(most, max(least, (max(1, int(n)) - 1).bit_length()))


def by_bucket(rows: DataFrame, bits: int, most: int = 8192):
    """rows grouped by bucket, with two tasks a bucket (so that few tasks get several) up to `most` or the session's number."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, min(2 << bits, most)), "bucket").groupBy("bucket")


#: bits of one bitmap that bitmap_construct_agg makes
BITMAP = 32768


def slot_table(slots: DataFrame, bits: int) -> np.ndarray:
    """A mask of 2**bits slots, set where the one column of slots (0 to 2**bits - 1) has them. Spark builds the bitmaps; what
    reaches the driver is 2**bits / 8 bytes at most, whatever the input. Made to skip rows early: a slot may be set by
    another value too, so whoever reads it must still join on the value."""
    slot = F.col(slots.columns[0])
    found = slots.groupBy(F.floor(slot / BITMAP).cast("int").alias("block")).agg(F.bitmap_construct_agg((slot % BITMAP).cast("long")).alias("map"))
    out = np.zeros((max(1, (1 << bits) // BITMAP), BITMAP), bool)
    for row in found.toLocalIterator():
        out[row["block"]] = np.unpackbits(np.frombuffer(row["map"], np.uint8), bitorder="little")
    return out.reshape(-1)[: 1 << bits]


def id_slot(column: str, bits: int):
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
