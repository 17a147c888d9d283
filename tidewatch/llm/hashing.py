"""Vectorised tokenising and rolling hashes over Arrow text, used inside Spark tasks.

Texts arrive as one byte buffer for many documents. Words and windows are hashed for the whole buffer at once with prefix
sums of a Rabin-Karp polynomial modulo 2**64, so the cost is a few array passes and no Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE, WINDOW_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: bytes of text that are hashed at once; a longer document is a chunk of its own
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word (the finaliser of splitmix64); one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair of ends."""
    n = len(values)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in pieces of about `limit` bytes: the rows, their texts' bytes on end, and where each text begins."""
    for batch in batches:
        col = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        n = len(col)
        if not n:
            continue
        _, offsets, data = col.buffers()
        at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


class Words:
    """The words of a chunk: start and end byte, ordinal of the document, 64-bit hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, table: np.ndarray | None = None):
        n = len(raw)
        inside = ~separator[raw]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins = inside & first[:-1]
        begins[1:] |= inside[1:] & ~inside[:-1]
        ends = inside & first[1:]
        ends[:-1] |= inside[:-1] & ~inside[1:]
        if n:
            ends[-1] |= inside[-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bytes = table[raw] if table is not None else raw
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = span_hashes(self.bytes.astype(U) + U(1), self.start, self.end, BASE)
        #: words of document i are first_word[i] : first_word[i + 1]
        self.first_word = np.searchsorted(self.start, offsets)

    def windows(self, k: int, tokens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of k words that lies in one document."""
        values = self.hash if tokens is None else tokens
        n = len(values) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, span_hashes(values, at, at + k, WINDOW_BASE)


def pack(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(b: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(b) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return wide.reshape(-1).view("<u8")


def squeeze(*arrays: np.ndarray) -> bytes:
    """The arrays in one compressed piece, byte planes apart, so that small numbers cost little."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, shape: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays that squeeze() took, by type and length."""
    sizes = [np.dtype(kind).itemsize * n for kind, n in shape]
    raw, at, out = np.frombuffer(pa.decompress(data, decompressed_size=sum(sizes), codec="zstd", asbytes=True), np.uint8), 0, []
    for (kind, n), size in zip(shape, sizes):
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(-1, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += size
    return out
