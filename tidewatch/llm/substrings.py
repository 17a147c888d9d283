"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark; repeated windows become maximal removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_for, by_bucket, table, text_bytes
from .hashing import U, Words, chunks, pack, unpack

#: bytes of text for each bucket of hashes; hashes that a task holds before it sends them
WINDOW, BUCKET_BYTES, HELD = 13, 4_000_000, 1_000_000
ENTRY = "bucket int, doc_id long, docs binary, counts binary, hashes binary"
REPLY = "doc_id long, hash long"
_ENTRY = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
_REPLY = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64())])


def first_owner(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hash, owner); where a hash begins in that order; each row's smallest owner of its hash; how many rows have it."""
    order = np.lexsort((owners, hashes))
    h, o = hashes[order], owners[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(h)])
    return order, first, np.repeat(o[first], size), np.repeat(size, size)


def runs(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal owners begins, with the end appended."""
    if not len(owners):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    at = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    return at, np.r_[at, len(owners)]


def by_owner(owners: np.ndarray, hashes: np.ndarray) -> list[tuple[int, bytes]]:
    """(owner, its distinct hashes)"""
    order = np.lexsort((hashes, owners))
    o, h = owners[order], hashes[order]
    if len(o):
        new = np.r_[True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])]
        o, h = o[new], h[new]
    at, ends = runs(o)
    return [(int(o[a]), h[a:b].tobytes()) for a, b in zip(at.tolist(), ends[1:].tolist())]


def known_ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id of each row and whether it has one."""
    col = rows.column("doc_id")
    return np.asarray(col.fill_null(0)), np.asarray(col.is_valid())


def entries(hashes: np.ndarray, owners: np.ndarray, bits: int, width: int = 7) -> list[tuple]:
    """One row per bucket: which documents own how many of its hashes, and `width` bytes of each hash below the bucket's own."""
    order = np.lexsort((owners, hashes >> U(64 - bits)))
    h, o = hashes[order], owners[order]
    bucket = (h >> U(64 - bits)).astype(np.int64)
    at, ends = runs(bucket)
    out = []
    for a, b in zip(at.tolist(), ends[1:].tolist()):
        own = o[a:b]
        d, stops = runs(own)
        out.append((int(bucket[a]), None, np.diff(own[d], prepend=0).tobytes(), np.diff(stops).astype("<u4").tobytes(), pack((h[a:b] << U(bits)) >> U(64 - 8 * width), width)))
    return out


def read_entries(bucket: int, bits: int, docs: list, counts: list, hashes: list, width: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and owners that entries() wrote, of all rows of a bucket."""
    owners = [np.repeat(np.cumsum(np.frombuffer(d, np.int64)), np.frombuffer(c, "<u4")) for d, c in zip(docs, counts)]
    low = unpack(b"".join(hashes), width)
    h = ((low << U(64 - 8 * width)) >> U(bits)) | (U(bucket) << U(64 - bits))
    return h, np.concatenate(owners) if owners else np.zeros(0, np.int64)


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def truncated(hashes: np.ndarray, bits: int, width: int = 7) -> np.ndarray:
    """Only the bits that entries() keeps."""
    lost = max(0, 64 - 8 * width - bits)
    return (hashes >> U(lost)) << U(lost)


def repeated_windows(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """doc_id and hash of those of its windows that also start in a document with a smaller doc_id, a row each at every size.

    A task counts its own hashes first, HELD at a time: one that several of its documents share is settled there for all but
    the smallest, and is sent once, with that document. A bucket of hashes therefore gets few entries of even the
    commonest window, and the number of buckets grows with the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            h, own = map(np.concatenate, zip(*held))
            held.clear()
            order, first, least, _ = first_owner(h, own)
            h, own = h[order], own[order]
            again = own > least
            out = entries(h[first], own[first], bits)
            out += [(doc % (1 << bits), doc, None, None, b) for doc, b in by_owner(own[again], h[again])]
            if out:
                yield arrow_rows(out, _ENTRY)

        for rows, raw, offsets in chunks(batches):
            ids, known = known_ids(rows)
            words = Words(raw, offsets)
            at, h = words.windows(window)
            has = known[words.doc[at]]
            held.append((truncated(h[has], bits), ids[words.doc[at[has]]]))
            if sum(len(x) for x, _ in held) >= HELD:
                yield from send()
        if held:
            yield from send()

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        settled, rest = group.filter(group.column("doc_id").is_valid()), group.filter(group.column("doc_id").is_null())
        h, own = read_entries(key[0].as_py(), bits, *(rest.column(c).to_pylist() for c in ("docs", "counts", "hashes")))
        order, _, least, _ = first_owner(h, own)
        h, own = h[order], own[order]
        again = (own > least) & np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])][: len(h)]
        early = settled.column("hashes").to_pylist()
        docs_of = np.repeat(settled.column("doc_id").to_numpy().astype(np.int64), np.array([len(x) // 8 for x in early], np.int64))
        rows = np.r_[docs_of, own[again]], np.r_[np.frombuffer(b"".join(early), np.int64), h[again].view(np.int64)]
        return pa.table([pa.array(x, pa.int64()) for x in rows], _REPLY)

    return by_bucket(docs.mapInArrow(count, ENTRY), bits).applyInArrow(settle, REPLY)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 [, n_spans, kept_text].

    A word goes when a window of `window` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Equal doc_ids are not smaller than each other. A null or empty text has no words and an empty
    kept text; documents shorter than a window lose nothing; a row with a null doc_id is returned as it is and takes no
    part. An empty table gives an empty result; other columns are ignored. Windows are compared by 64-bit hashes (63 to
    60 bits on small inputs), so of n windows about n*n / 2**64 pairs are taken for equal wrongly.
    """
    docs = docs.select("doc_id", "text")
    bits = bits_for(text_bytes(docs) / BUCKET_BYTES)
    found = repeated_windows(docs, window, bits).groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in chunks(batches):
            lists = [x.values.to_numpy().view(np.uint64) if x.is_valid else () for x in rows.column("hashes")]
            n_words, n_removed, n_spans, digest, texts = [], [], [], [], []
            words = Words(raw, offsets) if any(map(len, lists)) else None
            flagged = np.zeros(0, np.int64)
            if words:
                at, h = words.windows(window)
                h = truncated(h, bits)
                bounds = np.searchsorted(words.doc[at], np.arange(len(lists) + 1))
                change = np.zeros(len(words.start) + window + 1, np.int32)
                for i, found_in in enumerate(lists):
                    if len(found_in):
                        lo, hi = bounds[i], bounds[i + 1]
                        hit = at[lo:hi][np.isin(h[lo:hi], found_in)]
                        change[hit] += 1
                        change[hit + window] -= 1
                flagged = np.cumsum(change)[: len(words.start)] > 0
            data = raw.tobytes()
            for i in range(len(lists)):
                own = data[offsets[i] : offsets[i + 1]].split()
                n_words.append(len(own))
                if len(lists[i]):
                    gone = flagged[words.first_word[i] : words.first_word[i + 1]]
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                    own = list(compress(own, (~gone).tolist()))
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                kept = b" ".join(own)
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            out = {"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "n_spans": pa.array(n_spans, pa.int64())}
            if with_text:
                out["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long" + ", kept_text string" * with_text
    return docs.join(found, "doc_id", "left").mapInArrow(apply, shape)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("n_spans")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS s FROM g),
f AS (SELECT s, min(doc_id) AS first_id FROM k GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM k JOIN f USING (s) WHERE doc_id > first_id),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
j AS (SELECT a.doc_id, a.p, a.word, r.p IS NOT NULL AS gone FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.p = r.p),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
             string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM j GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""
