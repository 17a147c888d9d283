"""Packing: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

WINDOW, END_ID = 1024, 0
#: a group has about so many tokens or pieces, whichever fills it first
GROUP_TOKENS, GROUP_PIECES = 1 << 24, 100_000
#: fixed value: the special string of the vocabulary, and its id
SPECIAL = {"<|endoftext|>": 50256}
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str | None = None):
    """The byte-level BPE of the public tokenizer files, by its ranks: it gives the ids of byte_bpe_50k.json (tested) in a
    fifth of the time. The special string becomes its id, as it does there."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[vocabulary]


def cut(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Every document's ids and an end id, cut into full windows and one shorter rest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or "", allowed_special="all", disallowed_special=()).astype("<u4"), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=PIECES)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE)


class OpenWindows:
    """Windows by remaining capacity, with a segment tree of how many there are of each: the tightest one that still
    takes a piece is found in log2(window) steps."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remaining capacity and number of the tightest open window with room for length."""
        node = length + self.size
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (0 if self.count[2 * node] else 1)
        room = node - self.size
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. Pieces go in by falling length, ties in the order given."""
    tree, made = OpenWindows(window), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length) if length < window else None
        if found is None:
            found = window, made
            made += 1
        room, sequence[i] = found
        offset[i] = window - room
        if room > length:
            tree.add(room - length, int(sequence[i]))
    return sequence, offset


def pack(docs: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces are written out and dealt, by their place in the written table, into groups of about `group_tokens` tokens or
    `group_pieces` pieces, each of which is packed on its own: no group grows with the input, equal rows are dealt like others,
    and a task that runs again finds the same group. A sequence is never longer than `window` and has no gaps; only its end is
    padding. A null or empty text is the end id alone. A repeated row is packed as often as it occurs; rows with a null doc_id
    are packed too, with a null doc_id. An empty table gives no pieces; other columns are ignored.
    """
    bits = 40
    rows = stash(cut(docs, window, vocabulary), "pieces")
    tokens, count = rows.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-tokens // group_tokens), -(-count // group_pieces))
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)

    def fill(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        sequence, offset = best_fit_decreasing(pieces["length"].to_numpy(), window)
        placed = pieces.select(PIECES).append_column("sequence_id", pa.array((key[0].as_py() << bits) + sequence))
        return placed.append_column("offset", pa.array(offset))

    grouped = rows.select(*PIECES, F.pmod(F.xxhash64(part, "_metadata.row_index"), F.lit(groups)).alias("_group"))
    return grouped.groupBy("_group").applyInArrow(fill, PACKED)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
