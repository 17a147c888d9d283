"""Hard negatives: exact integer scores from products of residues, then windows of scores around each positive."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table, with_row

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: rows (and anchors) of one cell, and anchors that are scored at once
BLOCK, TILE = 8192, 128
#: residues are below this, so that 64 products of two symmetric residues add up exactly in float32
LARGEST = 1024
NONE = np.iinfo(np.int64).min


def moduli(bound: int) -> list[int]:
    """The largest primes below LARGEST whose product tells all scores of -bound to bound apart."""
    primes = [p for p in range(3, LARGEST, 2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2))][::-1]
    product, count = 1, 0
    while product <= 2 * bound:
        product *= primes[count]
        count += 1
    return primes[:count]


def symmetric(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, between -(p - 1) / 2 and (p - 1) / 2."""
    return (x + p // 2) % p - p // 2


class Residues:
    """The rows of an integer matrix modulo each of several primes, as float32."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [symmetric(matrix, p).astype(np.float32) for p in primes]

    def scores(self, which: slice | np.ndarray, other: Residues, those: slice) -> np.ndarray:
        """Inner products of some rows with those of another matrix: a float32 product for each prime, over as many columns at
        once as stay exact, and mixed-radix reconstruction with symmetric digits (which needs no comparison for the sign)."""
        total, unit = None, 1
        for p, a, b in zip(self.primes, self.parts, other.parts):
            a, b, step = a[which], b[those], (1 << 24) // (p // 2) ** 2
            r = np.zeros((len(a), len(b)), np.int64)
            for k in range(0, a.shape[1], step):
                r += (a[:, k : k + step] @ b[:, k : k + step].T).astype(np.int64)
            if total is None:
                total = symmetric(r, p)
            else:
                total += symmetric((r - total) % p * pow(unit, -1, p), p) * np.int64(unit)
            unit *= p
        return total


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest entries, in falling order, ties by column; NONE marks what doesn't count."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        i, j = np.nonzero((scores >= least) & (scores > NONE))
    else:
        i, j = np.nonzero(scores > NONE)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    kept = np.arange(len(i)) - first < k
    return i[kept], j[kept]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of integers; one that is shorter than the others is filled up with zeros."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * out).astype(np.int64)


def _by_id(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("label", "ascending"), ("vec_id", "ascending")])  # null ids come last


class Cell:
    """One block of anchors against one block of rows, both sorted by label and id."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, width: int, primes: list[int]):
        self.anchors, self.rows = _by_id(anchors), _by_id(rows)
        self.a, self.r = (Residues(_matrix(t["embedding"], width), primes) for t in (self.anchors, self.rows))
        self.labels, self.of = (t["label"].to_numpy() for t in (self.anchors, self.rows))
        self.keys, self.others = (t["row"].to_numpy() for t in (self.anchors, self.rows))

    def positives(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of the best rows of each anchor's own label, other than itself."""
        found = []
        for label in np.unique(self.labels):
            lo, hi = np.searchsorted(self.of, [label, label], "left")[0], np.searchsorted(self.of, label, "right")
            mine = np.flatnonzero(self.labels == label)
            for at in range(0, len(mine) if hi > lo else 0, TILE):
                which = mine[at : at + TILE]
                scores = self.a.scores(which, self.r, slice(lo, hi))
                scores[self.keys[which][:, None] == self.others[lo:hi]] = NONE
                i, j = best(scores, count)
                found.append((which[i], j + lo, scores[i, j]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def negatives(self, wanted: list[list[dict]], count: int, low: int, high: int):
        """Anchor, place of the positive, row and score of the best rows of other labels in the window of each positive."""
        found, deep = [], max(map(len, wanted), default=0)
        places, least, most = (np.zeros((len(wanted), deep), np.int64) for _ in range(3))
        least[:], most[:] = 1, 0
        for n, some in enumerate(wanted):
            for k, x in enumerate(some):
                places[n, k], least[n, k], most[n, k] = x["place"], -(-low * x["positive_score"] // 100), high * x["positive_score"] // 100
        ids = self.rows["vec_id"].combine_chunks()
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        for at in range(0, len(wanted), TILE):
            which = slice(at, at + TILE)
            scores = self.a.scores(which, self.r, slice(None))
            scores[self.labels[which][:, None] == self.of] = NONE
            scores = scores[:, order]
            for k in range(deep):
                inside = (scores >= least[which, k][:, None]) & (scores <= most[which, k][:, None])
                i, j = best(np.where(inside, scores, NONE), count)
                found.append((i + at, places[which, k][i], order[j], scores[i, j]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def clean(vectors: DataFrame, shift: int = 7) -> DataFrame:
    """row, vec_id, label, embedding of the rows that take part: none with a null label, a null vector or a component that is null
    or not finite. Where vec_id is divisible by `shift`, the label first becomes (label + 1) % 10."""
    rows, row = with_row(vectors.select("vec_id", "label", "embedding"))
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    moved = F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col(row).alias("row"), "vec_id", moved.alias("label"), x.alias("embedding"))


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95, shift: int = 7, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(256 * x); scores are exact inner products. Anchors are the rows whose vec_id is divisible by `every`: they
    and all rows are dealt into blocks by a hash of the row, and each pair of blocks is a cell that is scored on its own, so no
    label, copy or vector fills a task, and what a task holds doesn't grow. A cell sends on the best few of each anchor, which
    are ranked again by Spark. Rows are sent once for each block of anchors, twice: the work is the product of rows and anchors.

    Repeated rows are rows of their own, as candidates and as anchors. A null vec_id makes no anchor and comes last among ties. A
    shorter vector counts as filled up with zeros. Ids of rows are 64-bit hashes of file and place. An empty table, or one
    without anchors, gives no rows; other columns are ignored. Vectors whose scores might not fit a long raise an
    ArithmeticError, as overflows in Spark's own arithmetic do.
    """
    rows = clean(vectors, shift)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    count, queries, longest, width = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    bound = (SCALE * longest + math.sqrt(width)) ** 2 * (1 + 1e-9) + 1
    if not bound < 2**62:
        raise ArithmeticError(f"scores up to {bound:.3g} might not fit a long")
    primes = moduli(int(bound))
    spread = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-count // 1024))
    across, down = max(1, spread, -(-count // block)), max(1, -(-queries // block))

    def cells(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        every_other, df = F.explode(F.sequence(F.lit(0), F.lit(others - 1))), df.toDF(*df.columns)  # columns of its own
        return df.select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias(own)).select("*", every_other.alias(other)).groupBy("across", "down")

    def near(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        cell = Cell(queries, block, width, primes)
        i, j, scores = cell.positives(positives)
        return pa.table({"row": pa.array(cell.keys[i], pa.int64()), "anchor_id": cell.anchors["vec_id"].take(pa.array(i)), "positive_id": cell.rows["vec_id"].take(pa.array(j)), "positive_score": pa.array(scores, pa.int64())})

    def hard(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        cell = Cell(queries, block, width, primes)
        i, place, j, scores = cell.negatives(cell.anchors["wanted"].to_pylist(), negatives, low, high)
        return pa.table({"row": pa.array(cell.keys[i], pa.int64()), "place": pa.array(place, pa.int32()), "negative_id": cell.rows["vec_id"].take(pa.array(j)), "negative_score": pa.array(scores, pa.int64())})

    all_rows = cells(rows, "across", across, "down", down)
    found = cells(anchors, "down", down, "across", across).cogroup(all_rows).applyInArrow(near, "row long, anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id")))
    chosen = stash(found.withColumn("place", place).filter(F.col("place") <= positives), "positives")

    wanted = chosen.filter("positive_score >= 0").groupBy("row").agg(F.collect_list(F.struct("place", "positive_score")).alias("wanted"))  # few for each anchor
    found = cells(anchors.join(wanted, "row"), "down", down, "across", across).cogroup(all_rows).applyInArrow(hard, "row long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return chosen.join(ranked, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP11_SQL = """
WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k, a.vec_id AS anchor_id, b.k AS o, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.k <> b.k),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id NULLS LAST) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.id NULLS LAST) AS rank
  FROM p JOIN s ON s.k = p.k AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
