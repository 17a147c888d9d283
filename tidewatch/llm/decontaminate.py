"""Benchmark decontamination: windows of template tokens, hash-joined, with a check that slots are filled consistently."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_for, slot_table, stash, table, with_row
from .hashing import BASE, LOWER, WINDOW_BASE, U, Words, chunks, mix, span_hashes

#: SLACK: words more or less between two windows of a chain
WINDOW, COVERAGE, IN_TOKENS, SLACK, BROADCAST_ROWS = 8, 0.5, 0.7, 4, 200_000
#: bits of the mask of windows that may be an item's: about eight slots for each, within these bounds
SLOT_BITS, MOST_SLOT_BITS = 22, 28
#: fixed values: units of measure that become a placeholder when a number stands before them
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces ton tons ml cl l litre litres liter liters "
    "gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros pound pounds cent cents usd eur gbp degree degrees c f k mph kmh w kw v a hz khz mhz ghz kb mb gb tb"
).split()

LETTERS = np.ones(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?:;\n"]] = True
DIGIT, UPPER = np.zeros(256, bool), np.zeros(256, bool)
DIGIT[48:58], UPPER[65:91] = True, True


def one_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw.astype(U) + U(1), np.array([0]), np.array([len(raw)]), BASE)[0])


UNIT_HASHES = np.sort(np.array([one_hash(u) for u in UNITS], U))
NUMBER, QUANTITY, NAME = (U(one_hash(x)) for x in ("<number>", "<quantity>", "<name>"))
#: fixed values: first bytes and bounds of the second one of capitals beyond A-Z: Latin, Greek, Cyrillic
CAPITALS = [(0xC3, 0x80, 0x9E), (0xCE, 0x86, 0xA9), (0xD0, 0x80, 0xAF)]


class Template:
    """The tokens of a chunk with placeholders. Words are runs of letters and digits, A-Z lower-cased. A number is one token with
    its separators (1,200 or 3.5); with a unit behind it, apart or not (5 kg, 5kg), it is a quantity, one token too. A
    name is a word with a capital and small letters that doesn't begin a sentence, or that does and is a name elsewhere in the
    same text; names side by side are one token."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        w = self.words = Words(raw, offsets, separator=LETTERS, table=LOWER)
        n = len(w.start)
        if not n:
            self.first = self.doc = self.first_token = np.zeros(len(offsets), np.int64)[:0]
            self.first_token = np.zeros(len(offsets), np.int64)
            self.tokens = self.filled = np.zeros(0, U)
            self.slot = np.zeros(0, bool)
            return
        count = lambda mask, a, b: (c := np.r_[0, np.cumsum(mask[raw])])[b] - c[a]
        digits = count(DIGIT, w.start, w.end)
        number = digits > 0
        follows = np.r_[False, w.doc[1:] == w.doc[:-1]]
        gap = np.r_[0, w.end[:-1]]
        between = np.where(follows, w.start - gap, 0)
        opens = ~follows | (count(STOPS, np.minimum(gap, w.start), w.start) > 0)
        second = raw[np.minimum(w.start + 1, w.end - 1)]
        capital = UPPER[raw[w.start]]
        for byte, least, most in CAPITALS:
            capital |= (raw[w.start] == byte) & (second >= least) & (second <= most)
        title = capital & (count(UPPER, w.start + 1, w.end) == 0) & (w.end - w.start > 1) & ~number
        known = mix(w.hash ^ w.doc.astype(U))
        name = title & (~opens | np.isin(known, known[title & ~opens]))
        # 5kg: letters after the last digit that are a unit
        last_digit = np.maximum.accumulate(np.where(DIGIT[raw], np.arange(len(raw)), -1))[w.end - 1]
        tail = number & (last_digit < w.end - 1)
        with_unit = np.zeros(n, bool)
        k = np.flatnonzero(tail)
        with_unit[k] = np.isin(span_hashes(w.bytes.astype(U) + U(1), last_digit[k] + 1, w.end[k], BASE), UNIT_HASHES)
        after_number = np.r_[False, number[:-1]] & follows
        unit = after_number & ~number & (between <= 1) & np.isin(w.hash, UNIT_HASHES) & ~np.r_[False, with_unit[:-1]]
        point = (raw[np.maximum(w.start - 1, 0)] == ord(",")) | (raw[np.maximum(w.start - 1, 0)] == ord("."))
        goes_on = after_number & number & (between == 1) & point
        goes_on |= name & np.r_[False, name[:-1]] & follows & ~opens & (between == 1)
        first = np.flatnonzero(~(goes_on | unit))
        end = np.r_[first[1:], n]
        c = np.r_[0, np.cumsum(unit | with_unit)]
        quantity = number[first] & (c[end] > c[first])
        self.first, self.doc = first, w.doc[first]
        self.first_token = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.slot = number[first] | name[first]
        # what fills a slot: a name's words, and a number without its unit
        value, k = w.hash.copy(), np.flatnonzero(with_unit)
        value[k] = span_hashes(w.bytes.astype(U) + U(1), w.start[k], last_digit[k] + 1, BASE)
        self.filled = span_hashes(value, first, end - unit[end - 1], WINDOW_BASE)
        self.tokens = np.where(quantity, QUANTITY, np.where(number[first], NUMBER, np.where(name[first], NAME, w.hash[first])))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first token and hash of every run of k tokens that lies in one document."""
        n = len(self.tokens) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, self.hashes(at, k)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """Of the runs of k tokens at these places. A run of placeholders alone, as in a list of numbers, fits every other one, so it is
        told by what fills it."""
        c = np.r_[0, np.cumsum(self.slot)]
        bare = c[at + k] - c[at] == k
        out = span_hashes(self.tokens, at, at + k, WINDOW_BASE)
        out[bare] = mix(span_hashes(self.filled, at[bare], at[bare] + k, WINDOW_BASE))
        return out


ITEM = "template long, n_tokens long, item_id long, size int, hashes array<long>, slots array<int>, filled array<long>"


def item_templates(benchmark: DataFrame, window: int) -> DataFrame:
    """template (a hash of all tokens), item_id, size and hashes of its windows, its slots and what fills them. An item with fewer
    tokens than a window is one window: its whole sequence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in chunks(batches):
            t, out = Template(raw, offsets), []
            for i, item in enumerate(rows.column("item_id").to_pylist()):
                lo, hi = int(t.first_token[i]), int(t.first_token[i + 1])
                k = min(window, hi - lo)
                if item is None or not k:
                    continue
                at = np.arange(lo, hi - k + 1)
                whole = span_hashes(t.tokens, np.array([lo]), np.array([hi]), WINDOW_BASE)[0]
                slots = np.flatnonzero(t.slot[lo:hi])
                own = t.hashes(at, k).view(np.int64)
                hashes = own.tolist()
                # items of one template and the same bare windows are one template
                whole = mix(whole ^ np.bitwise_xor.reduce(mix(own.view(U)))).view(np.int64)
                out.append((int(whole), hi - lo, item, k, hashes, slots.tolist(), t.filled[lo + slots].view(np.int64).tolist()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["template", "n_tokens", "item_id", "size", "hashes", "slots", "filled"])

    return benchmark.select("item_id", "text").mapInArrow(cut, ITEM)


def document_windows(docs: DataFrame, row: str, sizes: list[int], marks: np.ndarray, bits: int) -> DataFrame:
    """hash, row, doc_id, doc_pos, filled (hashes of its tokens' words) of each window whose slot is marked."""
    marked = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(marked.value).astype(bool)
        for rows, raw, offsets in chunks(batches):
            t = Template(raw, offsets)
            ids, keys = rows.column("doc_id"), rows.column("row")
            for k in sizes:
                at, h = t.windows(k)
                hit = mask[(h >> U(64 - bits)).astype(np.int64)]
                at, h = at[hit], h[hit]
                if len(at):
                    doc = t.doc[at]
                    filled = t.filled[at[:, None] + np.arange(k)].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(filled.reshape(-1)))
                    columns = [pa.array(h.view(np.int64)), keys.take(pa.array(doc)), ids.take(pa.array(doc)), pa.array(at - t.first_token[doc]), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["hash", "row", "doc_id", "doc_pos", "filled"])

    return docs.select(F.col(row).alias("row"), "doc_id", "text").mapInArrow(find, "hash long, row long, doc_id long, doc_pos long, filled array<long>")


class _Diagonal:
    """Hits whose two places differ by one number, in order, and the longest chain that ends at one of them or before."""

    def __init__(self):
        self.places, self.best = [], []

    def add(self, place: int, length: int, hit: int) -> None:
        self.places.append(place)
        self.best.append(max((length, -hit), self.best[-1]) if self.best else (length, -hit))

    def before(self, place: int) -> tuple[int, int]:
        k = bisect_left(self.places, place)
        return self.best[k - 1] if k else (0, 0)


def chains(hits: list[tuple[int, int]], slack: int = SLACK) -> list[list[int]]:
    """Of hits (place in the document, place in the item) in order: the longest chains, each ending where no longer one goes on. Both
    places grow along a chain, and from one hit to the next by numbers that differ by `slack` at most, so that a few words
    more or less don't break it. What may come before a hit lies on one of the diagonals beside its own, each of which knows its
    longest chain up to a place: a hit costs some searches, however many there are."""
    best, before, goes_on = [1] * len(hits), [-1] * len(hits), [False] * len(hits)
    diagonals: dict[int, _Diagonal] = {}
    for x, (d, i) in enumerate(hits):
        near = (diagonals[c].before(min(d, i + c)) for c in range(d - i - slack, d - i + slack + 1) if c in diagonals)
        length, hit = max(near, default=(0, 0))
        if length:
            best[x], before[x] = length + 1, -hit
            goes_on[-hit] = True
        diagonals.setdefault(d - i, _Diagonal()).add(d, best[x], x)
    out = []
    for x in sorted((x for x in range(len(hits)) if not goes_on[x]), key=lambda x: (-best[x], x)):
        chain = []
        while x >= 0:
            chain.append(x)
            x = before[x]
        out.append(chain[::-1])
    return out


MATCH = "doc_id long, template long, n_matched long, doc_pos long, slots array<int>, now array<long>"


def chained(hits: DataFrame, coverage: float, in_tokens: float) -> DataFrame:
    """For each row and template the chains of windows that cover enough of it, with what the document has at each place."""

    def join(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_pos", "item_pos", "filled"))), key=lambda r: r[:2])
        rows = [r for r, last in zip(rows, [None, *rows]) if last is None or r[:2] != last[:2]]
        n_item, size, out = group.column("n_item")[0].as_py(), group.column("size")[0].as_py(), []
        for chain in chains([r[:2] for r in rows]):
            covered = len({rows[x][1] + step for x in chain for step in range(size)})
            if len(chain) < coverage * n_item and covered < in_tokens * (n_item + size - 1):
                continue
            now: dict[int, int] = {}
            for x in chain:
                for step, word in enumerate(rows[x][2]):
                    now.setdefault(rows[x][1] + step, word)
            out.append((group.column("doc_id")[0].as_py(), key[1].as_py(), len(chain), rows[chain[0]][0], list(now), list(now.values())))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["doc_id", "template", "n_matched", "doc_pos", "slots", "now"]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return hits.groupBy("row", "template").applyInArrow(join, MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, in_tokens: float = IN_TOKENS) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, n_matched, n_item, coverage, reparameterised.

    A document contains an item when a chain of its windows has at least `coverage` of the item's template windows in order, or
    these windows have at least `in_tokens` of its tokens (a changed word breaks all windows around it), and fills the slots consistently: equal values of the item became equal values, different ones different.
    reparameterised says that some slot was filled anew. Items of one template are one template until its windows are found,
    so a benchmark of many items made from one template joins each window once. Null and empty texts and rows with a null id
    match nothing. An item shorter than a window matches as its whole sequence. Rows that repeat a doc_id are searched each by itself, and the
    longest match of them is told. A passage in a third of all documents
    makes no large group: groups are one document and one template. An empty table on either side gives an empty result;
    other columns are ignored.
    """
    items = stash(item_templates(benchmark, window).distinct(), "items")
    windows = items.dropDuplicates(["template", "n_tokens"]).select("template", "size", F.size("hashes").cast("long").alias("n_item"), F.posexplode("hashes").alias("item_pos", "hash"))
    windows = stash(windows.withColumn("item_pos", F.col("item_pos").cast("long")), "windows")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # `window` of them at most
    count = windows.count()
    bits, small = bits_for(8 * count, SLOT_BITS, MOST_SLOT_BITS), count <= BROADCAST_ROWS
    marks = slot_table(windows.select(F.shiftrightunsigned("hash", 64 - bits)), bits)
    rows, row = with_row(docs.select("doc_id", "text"))
    found = document_windows(rows.filter("doc_id IS NOT NULL"), row, sizes, marks, bits)
    hits = found.join(F.broadcast(windows) if small else windows, "hash").filter(F.size("filled") == F.col("size"))
    matched = chained(hits.select("row", "doc_id", "template", "n_item", "size", "doc_pos", "item_pos", "filled"), coverage, in_tokens)
    of_item = items.select("template", "item_id", F.size("hashes").cast("long").alias("n_item"), F.col("slots").alias("places"), "filled")
    both = matched.join(of_item, "template")
    here = F.filter(F.arrays_zip("places", "filled"), lambda x: F.array_contains("slots", x["places"]))
    pairs = F.transform(here, lambda x: F.struct(x["filled"].alias("was"), F.element_at("now", F.array_position("slots", x["places"]).cast("int")).alias("now")))
    both = both.withColumn("pairs", F.array_distinct(pairs))
    n = F.size("pairs")
    fair = (F.size(F.array_distinct(F.transform("pairs", lambda p: p["was"]))) == n) & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["now"]))) == n)
    anew = F.exists("pairs", lambda p: p["was"] != p["now"])
    good = both.filter(fair).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_matched", "n_item", anew.alias("reparameterised")), F.struct("n_matched", -F.col("doc_pos"))).alias("b"))
    return good.select("doc_id", "item_id", "b.n_matched", "b.n_item", (F.col("b.n_matched") / F.col("b.n_item")).alias("coverage"), "b.reparameterised")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows with their own columns that contain no benchmark item, each row by its own text, whatever its doc_id."""
    rows, row = with_row(docs)
    found = contaminated(rows.select(F.col(row).alias("doc_id"), "text"), benchmark)
    return rows.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
