"""Exact dedup: a tree that merges sorted runs of digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stash, table, with_row

#: rows of one digest are spread over so many leaves, and so many children meet at a node
LEAVES, FAN_IN = 256, 16


def merge_tree(rows: DataFrame, key: list[str], id_col: str, largest: bool = False, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """rows with keep_id and group_size of their key, by DataFrame operations only.

    Each leaf reduces its rows to a run with one entry per key: its kept identifier, and how many rows it stands for. Then
    the leaves exchange runs as in a binomial tree, with `fan_in` in place of two: in round r the leaves whose numbers agree
    but for the last r digits (to the base fan_in) send their runs to the one that ends in zeros. There the runs meet sorted
    by key and identifier, one pass merges them, and the first entry of each key stays, with the sum of the sizes. The last
    round leaves one entry for each key. Results then go down the same tree, so that no task ever holds more than a leaf's
    share, or `fan_in` entries, of a key: a key with a third of all rows needs no special treatment. Keys may be null (nulls
    are equal); a null identifier is kept only where a key has no other. rows must be cheap to read several times (see
    stash()).
    """
    pick = F.max if largest else F.min
    rows = rows.withColumn("_node", F.pmod(F.xxhash64(id_col), F.lit(leaves)).cast("int"))
    runs = [rows.groupBy("_node", *key).agg(pick(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))]
    steps = [1]
    while steps[-1] < leaves:
        steps.append(min(steps[-1] * fan_in, leaves))
        runs.append(_merged(_sent(runs[-1], steps[-1]), key, largest))
    known = runs.pop()
    for step, run in zip(steps[:0:-1] + [1], [*runs[::-1], rows]):
        kept = [c for c in run.columns if c not in ("keep_id", "group_size")]
        result = known.select(F.col("_node").alias("_from"), *[F.col(k).alias(f"_k{j}") for j, k in enumerate(key)], F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(key)])
        joined = run.withColumn("_to", _receiver(step)).join(result, (F.col("_to") == F.col("_from")) & same)
        known = joined.select(*kept, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"))
    return known.drop("_node")


def _receiver(step: int) -> Column:
    """The leaf that gets a leaf's run in the round whose receivers lie `step` apart."""
    return (F.col("_node") - F.col("_node") % step).cast("int")


def _sent(run: DataFrame, step: int) -> DataFrame:
    return run.withColumn("_node", _receiver(step))


def _merged(runs: DataFrame, key: list[str], largest: bool) -> DataFrame:
    """One run of those that met: sorted by node, key and identifier, the first entry of each key with the sum of the sizes."""
    entry = Window.partitionBy("_node", *key)
    order = F.col("keep_id").desc_nulls_last() if largest else F.col("keep_id").asc_nulls_last()
    sized = runs.withColumns({"_first": F.row_number().over(entry.orderBy(order)), "group_size": F.sum("group_size").over(entry)})
    return sized.filter("_first = 1").drop("_first")


def digest_columns(text: str, normalise: Column | None = None) -> list[Column]:
    """The SHA-256 of a text (null: empty), and what verifies it: XXH64 and the length, which don't follow from it."""
    whole = F.coalesce(F.col(text) if normalise is None else normalise, F.lit(""))
    return [F.sha2(whole.cast("binary"), 256).alias("text_sha256"), F.xxhash64(whole).alias("check_hash"), F.octet_length(whole).alias("n_bytes")]


def digests(docs: DataFrame, text: str = "text", normalise: Column | None = None) -> DataFrame:
    return docs.select("doc_id", *digest_columns(text, normalise))


def exact_duplicates(docs: DataFrame, keep: str = "smallest", text: str = "text", leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so all null and empty texts form one group. A digest alone does
    not decide: equality is verified by a second hash and the length, which are part of the key. Rows that repeat a
    doc_id with the same text count twice in group_size and are all kept; a null doc_id stays only where its text has no
    other. An empty table gives an empty result; other columns are ignored.
    """
    found = merge_tree(stash(digests(docs, text), "digests"), ["text_sha256", "check_hash", "n_bytes"], "doc_id", keep == "largest", leaves, fan_in)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows with their own columns, one of each group of equal texts (null: empty): that with the smallest (or largest)
    doc_id, null ones last. Each row is a document of its own, so of rows that repeat a doc_id and a text one stays."""
    rows, row = with_row(docs)
    rank = F.struct(F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull(), "doc_id", row)
    prints = rows.select(row, rank.alias("_rank"), *digest_columns("text"))
    with scratch(docs.sparkSession) as keeping:
        found = merge_tree(stash(prints, "digests"), ["text_sha256", "check_hash", "n_bytes"], "_rank", keep == "largest")
        gone = keeping(found.filter("_rank <> keep_id").select(row), "gone")
    return rows.join(gone, row, "left_anti").drop(row)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), keep="largest")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
