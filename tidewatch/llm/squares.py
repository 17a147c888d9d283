"""Packing by sums of squares (after Csirik, Johnson et al., 2006): each piece goes where the squared counts of open sequences per
residual gap become smallest."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

WINDOW, END_ID = 4096, 1
#: a group has about so many tokens or pieces, whichever fills it first
GROUP_TOKENS, GROUP_PIECES = 1 << 24, 200_000
#: words whose ids a worker remembers, and the longest that it does
REMEMBERED, LONGEST = 300_000, 64
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PACKED = f"{PIECE}, sequence_id long, offset long"
FIRST, _NEVER = 40, np.iinfo(np.int64).max


#: a word of Latin-1 letters with ASCII signs behind it (no apostrophe, which may begin a piece of its own): the commonest stretch
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")
#: fixed values: the characters that byte-level vocabularies write bytes as
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class Words(dict):
    """The bytes of the ids (little-endian, 32 bits) of a stretch of text without spaces or line ends. The tokenizer's pieces never
    reach across a space, so a text's ids are those of its stretches, one after the other; each is encoded once. A plain word is
    also looked up in small letters and without the signs behind it, which the tokenizer splits off, and encoded by the
    tokenizer's model alone, as it has nothing to normalise."""

    def __init__(self, vocabulary: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain and (small := plain[1].lower()) != word:
            ids = self[small] + (self[plain[2]] if plain[2] else b"")
        else:
            found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(ALPHABET))] if plain else self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = np.array(found, "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


_words: dict[str | None, Words] = {}


def words(vocabulary: str | None = None) -> Words:
    if vocabulary not in _words:
        _words[vocabulary] = Words(vocabulary)
    return _words[vocabulary]


def cut(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Every document's ids and an end id; only what is longer than the window is cut, into full windows and a rest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(known.ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), window)):
                    part = ids[start : start + window]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(PIECES, zip(*rows))], names=PIECES)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE)


def sum_of_squares(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. Pieces go in by falling length, ties in the order given; of equally good places the
    tightest gap is taken, and a new sequence only where it is better than every gap. Full sequences count nothing."""
    opened = np.zeros(window + 1, np.int64)  # open sequences by residual gap; none is counted at gap 0
    at: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        change = np.where(opened[size:] > 0, 2 * (opened[: window - size + 1] - opened[size:]) + 2, _NEVER)
        if opened[size]:
            change[0] = 1 - 2 * opened[size]
        rest, fresh = int(change.argmin()), 2 * opened[window - size] + 1 if size < window else 0
        if change[rest] < fresh:
            gap = rest + size
            opened[gap] -= 1
            number = at[gap].pop()
        else:
            gap, number, rest = window, made, window - size
            made += 1
        sequence[i], offset[i] = number, window - gap
        if rest:
            opened[rest] += 1
            at[rest].append(number)
    return sequence, offset


def pack(docs: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are written out and dealt, by their place in the written table, into groups of about `group_tokens` tokens or
    `group_pieces` pieces, each of which is packed on its own: no group grows with the input, equal rows are dealt like others,
    and a task that runs again finds the same group. Each group ends with a few sequences that aren't full. A null or empty text
    is the end id alone; a document is cut only if it is longer than `window`. A repeated row is packed as often as it occurs,
    with a null doc_id too. An empty table gives no pieces; other columns are ignored. Strings of special tokens in a text become
    their special ids, as the tokenizer does by default.
    """
    rows = stash(cut(docs, window, vocabulary), "pieces", batch_rows=1000)
    tokens, count = rows.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-tokens // group_tokens), -(-count // group_pieces))
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)

    def fill(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        sequence, offset = sum_of_squares(pieces["length"].to_numpy(), window)
        placed = pieces.select(PIECES).append_column("sequence_id", pa.array((key[0].as_py() << FIRST) + sequence))
        return placed.append_column("offset", pa.array(offset))

    grouped = rows.select(*PIECES, F.pmod(F.xxhash64(part, "_metadata.row_index"), F.lit(groups)).alias("_group"))
    return grouped.groupBy("_group").applyInArrow(fill, PACKED)


def op13_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
