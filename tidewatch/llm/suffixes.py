"""Suffix-array dedup: two-stage suffix sorting of the regions that documents may share, then adjacent common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_for, by_bucket, id_slot, slot_table, stash, table, text_bytes
from .hashing import BASE, U, chunks, mix, powers, span_hashes, squeeze, unsqueeze
from .substrings import _ENTRY, ENTRY, arrow_rows, by_owner, entries, first_owner, known_ids, read_entries, runs, truncated

LENGTH, GRAM, BUCKET_BYTES, HOT, HOT_BITS, ID_BITS = 50, 24, 4_000_000, 256, 20, 24
#: bytes of segments that are sorted at once: sorting takes some 200 bytes of memory for each
SORT_BYTES = 400_000
#: texts that are sent to Python at once; anchors and bytes of segments that a task holds before it sends them
BATCH_ROWS, HELD_ANCHORS, HELD_BYTES = 1000, 1_000_000, 8_000_000
#: bytes of an anchor's hash below its bucket that are sent; two anchors taken for one cost work only
ANCHOR_BYTES = 5
#: rows with a doc_id are settled: runs of `lengths` repeated starts. In the others `packed` has n segments with `size` bytes
SEGMENT = "bucket int, doc_id long, starts binary, lengths binary, n int, size int, packed binary"
_SEGMENT = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("starts", pa.binary()), ("lengths", pa.binary()), ("n", pa.int32()), ("size", pa.int32()), ("packed", pa.binary())])
REPEAT = "doc_id long, starts binary, counts binary"
_REPEAT = pa.schema([("doc_id", pa.int64()), ("starts", pa.binary()), ("counts", pa.binary())])


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = 56) -> np.ndarray:
    """Positions of text (bytes) in the order of the suffixes that begin there, compared by `depth` bytes at least.

    wanted: a mask of positions; where a wanted suffix is larger than its successor, the successor must be wanted too.
    First stage: suffixes smaller than their successor are sorted directly. Second stage: one scan over the buckets of
    first bytes induces all the others, each from its successor's place.
    """
    text, wanted = np.r_[text, np.uint8(0)], np.r_[wanted, True]  # the end counts as a zero byte, smaller than what follows
    smaller = smaller_than_next(text)
    small = np.flatnonzero(wanted & smaller)
    if len(small):
        small = direct_order(eight_bytes(np.r_[text, np.zeros(depth + 8, np.uint8)]), small, depth)
    larger = wanted & ~smaller
    n_larger, n_small = np.bincount(text[larger], minlength=256), np.bincount(text[small], minlength=256)
    begin = np.concatenate([[0], np.cumsum(n_larger + n_small)])
    order = np.full(begin[-1], -1, np.int64)
    first_small = begin[:-1] + n_larger
    order[np.repeat(first_small - np.concatenate([[0], np.cumsum(n_small)[:-1]]), n_small) + np.arange(len(small))] = small
    head = begin[:-1].copy()

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[larger[before]]
        if len(before):
            c = text[before]
            by = np.argsort(c, kind="stable")
            before, c = before[by], c[by]
            at, ends = runs(c)
            for a, b in zip(at.tolist(), ends[1:].tolist()):
                to = int(c[a])
                order[head[to] : head[to] + b - a] = before[a:b]
                head[to] += b - a

    for c in np.flatnonzero(n_larger + n_small).tolist():
        done = begin[c]
        while done < head[c]:
            done, block = head[c], order[done : head[c]]
            induce(block)
        induce(order[first_small[c] : begin[c + 1]])
    return order[order < len(text) - 1]


def direct_order(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places `at` in the order of the `depth` bytes that follow: by the first eight, then the next eight where those tie."""
    order = at[np.argsort(words[at], kind="stable")]
    first = words[order]
    new = np.r_[True, first[1:] != first[:-1]]
    for j in range(8, depth, 8):
        tied = np.flatnonzero(~new | np.r_[~new[1:], False])
        if not len(tied):
            break
        group, places = np.cumsum(new)[tied], order[tied]
        by = np.lexsort((words[places + j], group))
        order[tied] = places[by]
        w = words[places[by] + j]
        new[tied[1:]] |= w[1:] != w[:-1]
    return order


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than its successor; the last one counts as smaller."""
    n = len(text)
    after = np.r_[text[1:], np.uint8(255)]
    differs = text != after
    differs[-1:] = True
    last = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
    out = (text < after)[np.minimum.accumulate(last[::-1])[::-1]]
    out[-1:] = True
    return out


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as a big-endian number."""
    wide = np.zeros(len(text) - 7, U)
    for j in range(8):
        wide = (wide << U(8)) | text[j : len(text) - 7 + j]
    return wide


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to `most`."""
    words = eight_bytes(np.r_[text, np.zeros(most + 16, np.uint8)])
    total, equal = np.zeros(len(order), np.int64), np.ones(len(order), bool)
    equal[:1] = False
    for j in range(0, most, 8):
        at = np.flatnonzero(equal)
        differ = words[order[at] + j] ^ words[order[at - 1] + j]
        same = np.full(len(at), 8)
        for b in range(7, -1, -1):
            same[differ >= U(1 << (8 * (7 - b)))] = b
        total[at] += same
        equal[at] = differ == 0
    return np.minimum(total, most)


def repeats_before(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each segment (of eight bytes at least) has the bytes of the segment before it. words: eight_bytes() of the text."""
    same = np.zeros(len(start), bool)
    same[1:] = size[1:] == size[:-1]
    for j in range(0, int(size.max(initial=0)), 8):
        k = np.flatnonzero(same)
        if not len(k):
            break
        step = np.minimum(j, size[k] - 8)
        same[k] = words[start[k] + step] == words[start[k - 1] + step]
    return same


class Anchors:
    """For every string of `length` bytes inside one document, the position of its smallest `gram`-byte hash. Equal
    strings have it at the same place, so they are found together; runs of strings with one anchor are kept as one."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.at = self.doc = empty
        self.hash = np.zeros(0, U)
        n = len(raw) - length + 1
        if n <= 0:
            return
        grams = len(raw) - gram + 1
        up, down = powers(BASE, len(raw) + 1)
        total = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=total[1:])
        h = mix((total[gram:] - total[:grams]) * down[:grams])
        bits = U(max(24, len(raw).bit_length()))
        key = ((h >> bits) << bits) | np.arange(grams, dtype=U)
        width, least = 1, key
        while 2 * width <= length - gram + 1:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        rest = length - gram + 1 - width
        if rest:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        at = (least & U((1 << int(bits)) - 1)).astype(np.int64)
        starts = np.zeros(len(raw) + 1, np.int32)
        whole = np.flatnonzero(np.diff(offsets) >= length)
        starts[offsets[whole]] += 1
        starts[offsets[whole + 1] - length + 1] -= 1
        valid = np.cumsum(starts)[:n] > 0
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        begins[offsets[whole]] = True
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | begins[1:]
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends)
        self.at = at[self.first]
        self.hash = mix(h[self.at])  # the smallest hashes lie close to zero; mixed again they fill all buckets alike
        self.doc = np.searchsorted(offsets, self.first, "right") - 1


def tags(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What a document is told of its shared anchors: 32 bits of each, below the bucket's. An anchor that is taken for a shared
    one has its strings sorted in vain, no more."""
    return ((hashes << U(bits)) >> U(32)).astype("<u4")


def shared_anchors(docs: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """doc_id and the tags of the anchors it has in common with another document (doc_id null: the hashes of anchors that
    very many tasks have)."""
    reply = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary())])

    def shares(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """Hashes and owners in order, where each hash begins, how many rows have it, and the tags of each owner that shares."""
        order, first, least, size = first_owner(h, own)
        h, own = h[order], own[order]
        most = np.repeat(own[np.r_[first[1:], len(own)] - 1], np.diff(np.r_[first, len(own)])) if len(own) else own
        return h, own, first, size, by_owner(own[most > least], tags(h[most > least], bits))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            h, own, first, _, found = shares(*map(np.concatenate, zip(*held)))
            held.clear()
            out = entries(h[first], own[first], bits, ANCHOR_BYTES)
            out += [(doc % (1 << bits), doc, None, None, b) for doc, b in found]
            if out:
                yield arrow_rows(out, _ENTRY)

        for rows, raw, offsets in chunks(batches):
            ids, known = known_ids(rows)
            anchors = Anchors(raw, offsets, length, gram)
            has = known[anchors.doc]
            held.append((truncated(anchors.hash[has], bits, ANCHOR_BYTES), ids[anchors.doc[has]]))
            if sum(len(h) for h, _ in held) >= HELD_ANCHORS:
                yield from send()
        if held:
            yield from send()

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        settled, rest = group.filter(group.column("doc_id").is_valid()), group.filter(group.column("doc_id").is_null())
        h, own = read_entries(key[0].as_py(), bits, *(rest.column(c).to_pylist() for c in ("docs", "counts", "hashes")), ANCHOR_BYTES)
        h, own, _, size, found = shares(h, own)
        hot = np.unique(h[size >= HOT])
        if len(hot):
            found.append((None, hot.tobytes()))
        late = pa.Table.from_batches([arrow_rows(found, reply)] if found else [], reply)
        return pa.concat_tables([settled.select(["doc_id", "hashes"]).cast(reply), late])

    return by_bucket(docs.mapInArrow(find, ENTRY), bits).applyInArrow(settle, "doc_id long, hashes binary")


def hot_slots(found: DataFrame) -> np.ndarray:
    """A table of 2**HOT_BITS slots with the hash prefixes of hot anchors; its size is fixed, and a slot that is set in
    vain only means that an anchor is treated as hot."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("hashes").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b, U) >> U(64 - HOT_BITS)).astype(np.int64))], ["slot"])

    out = np.zeros(1 << HOT_BITS, bool)
    for row in found.filter("doc_id IS NULL").mapInArrow(slots, "slot long").distinct().toLocalIterator():
        out[row["slot"]] = True
    return out


def segments(docs: DataFrame, length: int, gram: int, bits: int, hot: np.ndarray) -> DataFrame:
    """The strings around shared anchors, by bucket; rows with a doc_id are settled: starts there are repeats."""
    marks = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        waiting = 0
        for rows, raw, offsets in chunks(batches):
            ids, _ = known_ids(rows)
            lists = rows.column("hashes").to_pylist()
            wanted = np.unique(np.frombuffer(b"".join(b for x in lists if x for b in x), "<u4"))
            anchors = Anchors(raw, offsets, length, gram)
            mine = np.isin(tags(anchors.hash, bits), wanted)
            first, last, h, doc = anchors.first[mine], anchors.last[mine], anchors.hash[mine], anchors.doc[mine]
            very = marks.value[(h >> U(64 - HOT_BITS)).astype(np.int64)]
            if very.any():  # strings at hot anchors go one by one, dealt by their own hash
                n = np.where(very, last - first + 1, 1)
                k = np.repeat(np.arange(len(n)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first, last, h, doc, very = first[k] + step, np.where(very[k], first[k] + step, last[k]), h[k], doc[k], very[k]
            size, own = last + length - first, ids[doc]
            content = span_hashes(raw.astype(U) + U(1), first, first + size, BASE)
            order = np.lexsort((own, content))
            first, size, own, doc = first[order], size[order], own[order], doc[order]
            route, inside = np.where(very, content, h)[order], first - offsets[doc]
            # equal segments of the chunk, told by their bytes: what is not of the first document is a repeat
            new = np.flatnonzero(~repeats_before(eight_bytes(raw), first, size)) if len(raw) >= 8 else np.zeros(0, np.int64)
            again = own > np.repeat(own[new], np.diff(np.r_[new, len(own)]))
            o = np.argsort(own[again], kind="stable")
            who, s, c = own[again][o], inside[again][o], (size - length + 1)[again][o]
            at, ends = runs(who)
            out = [(int(who[a]) % (1 << bits), int(who[a]), s[a:b].astype("<i4").tobytes(), c[a:b].astype("<i4").tobytes(), None, None, None) for a, b in zip(at.tolist(), ends[1:].tolist())]
            if out:
                yield arrow_rows(out, _SEGMENT)
            bucket, part = (route >> U(64 - bits)).astype(np.int64), ((route >> U(64 - bits - 8)) & U(255)).astype(np.uint8)
            new = np.flatnonzero(~again)
            new = new[np.lexsort((inside[new], own[new], bucket[new]))]
            at, ends = runs(bucket[new])
            for a, b in zip(at.tolist(), ends[1:].tolist()):
                k = new[a:b]
                take = np.repeat(first[k] - np.cumsum(size[k]) + size[k], size[k]) + np.arange(size[k].sum())
                held.setdefault(int(bucket[k[0]]), []).append((own[k], inside[k].astype("<i4"), size[k].astype("<i4"), part[k], raw[take]))
            waiting += int(size[new].sum())
            if waiting >= HELD_BYTES:
                yield packed(held)
                held, waiting = {}, 0
        if held:
            yield packed(held)

    return docs.mapInArrow(emit, SEGMENT)


def packed(held: dict[int, list[tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
    """A row for each bucket with its segments: owners, starts, sizes, parts and bytes."""
    out = []
    for bucket, lots in held.items():
        own, start, size, part, data = map(np.concatenate, zip(*lots))
        out.append((bucket, None, None, None, len(own), len(data), squeeze(np.diff(own, prepend=0), start, size, part, data)))
    return arrow_rows(out, _SEGMENT)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Owners, starts, sizes, parts and bytes of all rows that packed() made of a bucket."""
    columns = zip(*(rows.column(c).to_pylist() for c in ("n", "size", "packed")))
    lots = [unsqueeze(b, [("<i8", n), ("<i4", n), ("<i4", n), ("u1", n), ("u1", size)]) for n, size, b in columns]
    own = np.concatenate([np.cumsum(x[0]) for x in lots])
    return own, *(np.concatenate([x[i] for x in lots]).astype(kind) for i, kind in ((1, np.int64), (2, np.int64), (3, np.uint8), (4, np.uint8)))


def repeated_starts(own: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """owner and place of each string of `length` bytes in these segments that a smaller owner has too. Segments of the same
    bytes are sorted once, for the smallest owner: a larger one repeats all its strings, the same one repeats what the
    first does."""
    begin = np.cumsum(size) - size
    order = np.lexsort((own, span_hashes(data.astype(U) + U(1), begin, begin + size, BASE)))
    new = ~repeats_before(eight_bytes(data), begin[order], size[order])
    first = order[new]
    like = np.empty(len(order), np.int64)
    like[order] = np.cumsum(new) - 1
    take = np.repeat(begin[first] - np.cumsum(size[first]) + size[first], size[first]) + np.arange(size[first].sum())
    segment, place = sorted_repeats(own[first], size[first], data[take], length)
    larger, fellow = own > own[first][like], own == own[first][like]
    # of segments like the first and of its owner: the first one's repeats
    n_found = np.bincount(segment, minlength=len(first))
    segment, place = segment[o := np.argsort(segment, kind="stable")], place[o]
    k = np.flatnonzero(fellow)
    n, base = n_found[like[k]], (np.cumsum(n_found) - n_found)[like[k]]
    at = np.repeat(base - np.cumsum(n) + n, n) + np.arange(n.sum())
    who, where = np.repeat(own[k], n), np.repeat(start[k], n) + place[at]
    k = np.flatnonzero(larger)
    n = size[k] - length + 1
    return np.r_[who, np.repeat(own[k], n)], np.r_[where, np.repeat(start[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def sorted_repeats(own: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and place in it of each string of `length` bytes that a segment of a smaller owner has too."""
    begin = np.cumsum(size + 1) - size - 1  # each segment is followed by a zero byte
    text = np.zeros(int((size + 1).sum()), np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    n = size - length + 1
    candidate = np.zeros(len(text), bool)
    candidate[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())] = True
    # a suffix that is larger than its successor is induced from it, so successors are wanted up to a smaller one
    here = np.arange(len(text), dtype=np.int32)
    smaller = smaller_than_next(text)
    stop = np.minimum.accumulate(np.where(smaller, here, np.int32(len(text)))[::-1])[::-1]
    reach = np.zeros(len(text) + 1, np.int32)
    final = begin + n - 1
    reach[final] += 1
    np.add.at(reach, np.minimum(stop[final], len(text) - 1) + 1, -1)
    wanted = candidate | (np.cumsum(reach)[:-1] > 0)
    order = suffix_order(text, wanted, -(-length // 8) * 8)
    order = order[candidate[order]]
    shared = common_prefixes(text, order, length) >= length
    segment = np.searchsorted(begin, order, "right") - 1
    who = own[segment]
    new = np.flatnonzero(~shared)
    least = np.repeat(np.minimum.reduceat(who, new), np.diff(np.r_[new, len(who)]))
    again = who > least
    return segment[again], (order - begin[segment])[again]


def sort_bucket(length: int):
    """The task of one bucket: sort the suffixes of its segments, and return the starts that a smaller document has too.
    Strings of different parts of a bucket have different anchors, so parts are sorted a few at a time."""

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        settled, rest = group.filter(group.column("doc_id").is_valid()), group.filter(group.column("doc_id").is_null())
        done = settled.select(["doc_id", "starts", "lengths"]).rename_columns(["doc_id", "starts", "counts"]).cast(_REPEAT)
        if not len(rest):
            return done
        own, start, size, part, data = unpacked(rest)
        at = np.cumsum(size) - size
        order = np.argsort(part, kind="stable")
        total = np.bincount(part, weights=size, minlength=256)
        lots = np.floor(np.cumsum(total) / SORT_BYTES)[part[order]]
        out = []
        for k in np.split(order, np.flatnonzero(np.diff(lots)) + 1):
            take = np.repeat(at[k] - np.cumsum(size[k]) + size[k], size[k]) + np.arange(size[k].sum())
            out.append(repeated_starts(own[k], start[k], size[k], data[take], length))
        who, where = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
        by = np.lexsort((where, who))
        who, where = who[by], where[by]
        if not len(who):
            return done
        fresh = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)])
        counts = np.diff(np.r_[fresh, len(who)])
        w, s = who[fresh], where[fresh]
        at, ends = runs(w)
        found = [(int(w[a]), s[a:b].astype("<i4").tobytes(), counts[a:b].astype("<i4").tobytes()) for a, b in zip(at.tolist(), ends[1:].tolist())]
        return pa.concat_tables([done, pa.Table.from_batches([arrow_rows(found, _REPEAT)], _REPEAT)])

    return settle


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept_bytes].

    A byte goes when it is covered by a string of `length` bytes that also starts in a document with a smaller doc_id;
    strings are judged on the input and do not cross documents. Equal doc_ids are not smaller than each other; a repeated
    doc_id must repeat its text, as starts are told by doc_id. A null text
    counts as empty; texts shorter than `length` lose nothing; a row with a null doc_id is returned as it is and takes no
    part. An empty table gives an empty result; other columns are ignored.

    Sorting every suffix would move the whole corpus many times over. So the corpus is first narrowed down without loss:
    each string of `length` bytes is filed under its anchor, the smallest hash of its `gram`-byte substrings, and only
    strings whose anchor occurs in two documents go on. Those are dealt into buckets by anchor, and in each bucket the
    suffixes are sorted in two stages; strings that share `length` bytes with a neighbour are decided there, exactly.
    Buckets grow in number with the input; equal segments of a chunk, told by their bytes, are settled before the shuffle, and
    strings at an anchor that very many tasks have are dealt by their own hash.
    """
    if not 8 <= gram <= length:
        raise ValueError("needs 8 <= gram <= length")
    docs = docs.select("doc_id", "text")
    bits = bits_for(text_bytes(docs) / BUCKET_BYTES)
    found = stash(shared_anchors(docs, length, gram, bits), "anchors", BATCH_ROWS)
    hot = hot_slots(found)
    mine = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes"))
    marks = docs.sparkSession.sparkContext.broadcast(np.packbits(slot_table(mine.select(id_slot("doc_id", ID_BITS)), ID_BITS)))

    def skim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(marks.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(mask[np.asarray(batch.column("slot"))])).select(["doc_id", "text"])

    # texts without shared anchors stay where they are; the join decides exactly
    some = docs.filter("doc_id IS NOT NULL").withColumn("slot", id_slot("doc_id", ID_BITS)).mapInArrow(skim, "doc_id long, text string")
    repeats = by_bucket(segments(some.join(mine, "doc_id"), length, gram, bits, hot), bits).applyInArrow(sort_bucket(length), REPEAT)
    repeats = stash(repeats, "repeats", BATCH_ROWS).groupBy("doc_id").agg(F.collect_list(F.struct("starts", "counts")).alias("repeats"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in chunks(batches):
            data = raw.tobytes()
            lists = rows.column("repeats").to_pylist()
            n_removed, n_spans, digest, texts = [], [], [], []
            for i, lots in enumerate(lists):
                own = data[offsets[i] : offsets[i + 1]]
                removed = spans = 0
                if lots:
                    s = np.concatenate([np.frombuffer(x["starts"], "<i4") for x in lots]).astype(np.int64)
                    e = np.minimum(s + np.concatenate([np.frombuffer(x["counts"], "<i4") for x in lots]) - 1 + length, len(own))
                    ok = s < len(own)
                    change = np.bincount(s[ok], minlength=len(own) + 1) - np.bincount(e[ok], minlength=len(own) + 1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed, spans = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
                    own = np.frombuffer(own, np.uint8)[~gone].tobytes()
                n_removed.append(removed)
                n_spans.append(spans)
                digest.append(hashlib.sha256(own).hexdigest())
                texts.append(own if with_text else None)
            out = {"doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                out["kept_bytes"] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return docs.join(repeats, "doc_id", "left").mapInArrow(apply, shape)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100),
k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM g),
f AS (SELECT s, min(doc_id) AS first_id FROM k GROUP BY s),
r AS (SELECT doc_id, p FROM k JOIN f USING (s) WHERE doc_id > first_id),
o AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 AS before FROM r),
b AS (SELECT doc_id, p, sum(CASE WHEN before >= p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM o),
s AS (SELECT doc_id, span, min(p) AS lo, max(p) + 50 AS hi FROM b GROUP BY doc_id, span),
t AS (SELECT doc_id, span, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY span), 0) AS keep_from FROM s),
u AS (SELECT t.doc_id, string_agg(substr(d.h, 2 * keep_from + 1, 2 * (lo - keep_from)), '' ORDER BY span) AS head, max(hi) AS hi,
             count(*) AS n_spans, sum(hi - lo) AS n_removed FROM t JOIN d ON t.doc_id = d.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head || substr(d.h, 2 * hi + 1), d.h))) AS kept_sha256
FROM d LEFT JOIN u ON d.doc_id = u.doc_id
"""
