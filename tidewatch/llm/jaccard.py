"""N-gram Jaccard join: a grouped prefix join over sets of word shingles, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_slot, scratch, slot_table, stash, table, with_row
from .hashing import LOWER, WINDOW_BASE, U, Words, chunks, mix, span_hashes
from .links import components

WORDS, PERCENT = 5, 80
#: shingle frequencies are kept in so many slots, whatever the input
COUNT_BITS, COUNT_BLOCK = 18, 1024
#: slots of the table that lets a scan skip documents that no candidate pair has
ID_BITS = 24
#: a set's shingles are counted in so many parts of the hash range; where one count is odd and another even, two sets differ
PART_BITS = 10
#: rows of one key are reduced in so many leaves before they meet; members of a shingle that one task compares with the rest
LEAVES, SALT_ROWS = 256, 64
#: so many shingles of a prefix before one tell whether two members have met at an earlier one
BEFORE = 8
#: so many members of a shingle's largest component meet its odd ones first where those are more than SALT_ROWS, so many of them
#: for each odd member go on, and that so many times at most
HUBS, NEAREST, HUB_TURNS = 4, 4, 2
#: rows of texts or sets that Python gets at once
BATCH_ROWS = 1000
SET = "doc_id long, n_shingles long, sum_digest long, xor_digest long, prefix_digest long, sketch binary, parts array<long>, prefix array<long>"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased; fewer words are one shingle."""
    words = Words(raw, offsets, table=LOWER)
    at, h = words.windows(k)
    bounds = np.searchsorted(words.doc[at], np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        a, b = words.first_word[i], words.first_word[i + 1]
        if 0 < b - a < k:
            out.append(span_hashes(words.hash, np.array([a]), np.array([b]), WINDOW_BASE))
        else:
            out.append(np.unique(h[bounds[i] : bounds[i + 1]]))
    return out


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle of each slot, over all documents; a slot is a prefix of the shingle's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for _, raw, offsets in chunks(batches):
            h = np.concatenate(shingle_sets(raw, offsets, k))
            total += np.bincount((h >> U(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            blocks = total.reshape(-1, COUNT_BLOCK)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "counts": pa.array([b.astype("<u4").tobytes() for b in blocks], pa.binary())})

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(COUNT_BLOCK, np.int64)
        for b in group.column("counts").to_pylist():
            total += np.frombuffer(b, "<u4" if len(b) == 4 * COUNT_BLOCK else "<i8")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << COUNT_BITS, np.int64).reshape(-1, COUNT_BLOCK)
    with scratch(docs.sparkSession):
        by_task = stash(docs.select("text").mapInArrow(count, "block int, counts binary"), "counts", BATCH_ROWS)
        for row in by_task.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
            out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest set that can reach the similarity with a set of n."""
    return -(-n * percent // 100)


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Each document's set size, digests, and prefix: its rarest shingles, so many that two similar sets share one."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, k))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counts.value
        for rows, raw, offsets in chunks(batches):
            size, sums, xors, heads, prefix, maps, parts = [], [], [], [], [], [], []
            for h in shingle_sets(raw, offsets, k):
                n = len(h)
                head = h[np.lexsort((h, common[(h >> U(64 - COUNT_BITS)).astype(np.int64)]))[: n - least_overlap(n, percent) + 1]] if n else h
                other = mix(h ^ U(0x5851F42D4C957F2D))
                size.append(n)
                sums.append(np.add.reduce(other) if n else U(0))
                xors.append(np.bitwise_xor.reduce(mix(other)) if n else U(0))
                heads.append(np.add.reduce(mix(head ^ U(0x14057B7EF767814F))) if n else U(0))
                prefix.append(head.view(np.int64))
                maps.append(sketch(h))
                odd = np.bincount((h >> U(64 - PART_BITS)).astype(np.int64), minlength=1 << PART_BITS) & 1
                parts.append(np.packbits(odd.astype(bool)).view(np.int64))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in prefix])], pa.int32()), pa.array(flat, pa.int64()))
            shares = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) << (PART_BITS - 6), pa.int32()), pa.array(np.concatenate(parts)))
            longs = [pa.array(np.array(x, U).view(np.int64)) for x in (sums, xors, heads)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size, pa.int64()), *longs, pa.array(maps, pa.binary()), shares, lists], names=["doc_id", "n_shingles", "sum_digest", "xor_digest", "prefix_digest", "sketch", "parts", "prefix"])

    return docs.mapInArrow(cut, SET)


def sketch(h: np.ndarray) -> bytes:
    """A bitmap of about one bit per shingle. Each bit that only one of two bitmaps has stands for at least one shingle that
    only one of the sets has, so bitmaps bound the similarity from above."""
    bits = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    out = np.zeros(bits, bool)
    out[(h & U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles with these bitmaps can reach the similarity; never wrongly False."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size)) for v in (x, y))
    apart = int(np.bitwise_count(x ^ y).sum())
    # sets that differ in `apart` shingles have (n + m - apart) / (n + m + apart) at most
    return 100 * (n + m - apart) >= percent * (n + m + apart)


def least_by_leaf(rows: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """leaf, the key, the leaf's least id_col and the key's (`least`). Leaves are dealt by id_col, so at most LEAVES rows of a key
    meet in the second step, however many rows have it, and whoever joins by leaf and key spreads a hot key too."""
    leaves = rows.withColumn("leaf", leaf(id_col)).groupBy("leaf", *key).agg(F.min(id_col).alias(id_col))
    return leaves.withColumn("least", F.min(id_col).over(Window.partitionBy(*key)))


def leaf(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(LEAVES)).cast("int")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sizes and bitmaps allow a link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")))
            good = [may_link(*row, percent) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = sets.select("doc_id", "n_shingles", "sketch")
    left = pairs.join(own.toDF("a", "na", "sa"), "a")
    both = left.join(own.toDF("b", "nb", "sb"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of documents whose whole sets reach the similarity; repeated doc_ids may repeat them."""
    pairs = stash(possible(pairs, sets, percent).distinct(), "pairs", BATCH_ROWS)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(slot_table(ids.select(id_slot("doc_id", ID_BITS)), ID_BITS)))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(wanted.value).astype(bool)
        some = (b.filter(pa.array(marks[np.asarray(b.column("slot"))])) for b in batches)
        for rows, raw, offsets in chunks(some):
            yield pa.RecordBatch.from_pydict({"id": rows.column("doc_id"), "hashes": pa.array([h.tobytes() for h in shingle_sets(raw, offsets, k)], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    whole = docs.filter("doc_id IS NOT NULL").withColumn("slot", id_slot("doc_id", ID_BITS)).mapInArrow(hashes, "id long, hashes binary")
    known = stash(whole.join(ids, whole["id"] == ids["doc_id"], "left_semi"), "sets", BATCH_ROWS)
    left = pairs.join(known.withColumnsRenamed({"id": "a", "hashes": "left"}), "a")
    both = left.join(known.withColumnsRenamed({"id": "b", "hashes": "right"}), "b").select("a", "b", "left", "right")
    return stash(both.mapInArrow(compare, "a long, b long"), "linked", BATCH_ROWS)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, itself included).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of `words`-word shingles. A null or
    empty text has an empty set and links with nothing. Rows that repeat a doc_id are returned as often, and are one document:
    what any of its texts links with is in its component. A row with a null doc_id links with nothing and has a null component. An empty table gives an empty result; other columns are ignored.

    Documents with one set are one member; members with one prefix and size are one group (both found by leaf and then by key,
    so thousands of copies cost no pairs). Groups that share a prefix shingle are candidates: first each group with the
    first of its size class at each shingle, and each member with its group's first. What these verified links join is one
    component. Then, wherever a prefix shingle still holds several components, every pair across components whose sizes
    and places of the shingle allow a link is verified too, once; a group of three members or more keeps its rarest shingle for that even where no other
    group has it, as two of them may link with each other and not with its first. Where many members of a shingle are outside its
    largest component, they meet a few of that component before, which most of them join. Bitmaps rule out most pairs before whole sets are sent. A pair inside a
    component needs no test, as it can't change the result; no other pair is left out. Sets are compared whole, by 64-bit hashes of their shingles.
    """
    docs = docs.select("doc_id", "text")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("a <> b")
    if several.isEmpty():
        return _near_by_id(docs, words, percent)
    rows, row = with_row(docs)
    one = rows.filter("doc_id IS NOT NULL").select(F.col(row).alias("row"), "doc_id", "text")
    near = stash(_near_by_id(one.select(F.col("row").alias("doc_id"), "text"), words, percent).withColumnsRenamed({"doc_id": "row"}), "near")
    named = stash(near.join(one.select("row", "doc_id"), "row"), "named")
    first = named.groupBy("doc_id").agg(F.min("component_id").alias("a"))
    joined = components(named.join(first, "doc_id").select("a", F.col("component_id").alias("b")).filter("a <> b").distinct())
    root = F.coalesce("component", "component_id")
    rooted = stash(named.join(joined, named["component_id"] == joined["node"], "left").select("doc_id", "n_shingles", root.alias("root")), "rooted")
    # by leaf and then by root, so that a component with a third of all rows is a few rows where it meets
    least = least_by_leaf(rooted.select("root", "doc_id"), ["root"], "doc_id").select("leaf", "root", "least")
    found = rooted.withColumn("leaf", leaf("doc_id")).join(least, ["leaf", "root"]).select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return found.union(_near_by_id(docs.filter("doc_id IS NULL"), words, percent))


def _near_by_id(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates() where rows that repeat a doc_id repeat its text."""
    spark = docs.sparkSession
    sets = stash(prefixes(docs, words, percent), "prefixes", BATCH_ROWS)
    some = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").drop("prefix", "sketch", "parts")
    same = ["n_shingles", "sum_digest", "xor_digest", "prefix_digest"]  # the prefix follows from the set
    member = stash(least_by_leaf(some, same, "doc_id"), "members")
    member_of = member.filter("doc_id = least").select(F.col("least").alias("member"), "n_shingles", "prefix_digest")
    alike = ["n_shingles", "prefix_digest"]
    top = least_by_leaf(member_of, alike, "member").select("leaf", *alike, F.col("least").alias("grp"))
    group = stash(member_of.withColumn("leaf", leaf("member")).join(top, ["leaf", *alike]).select("member", "n_shingles", "grp"), "groups")

    with scratch(spark) as keep:
        leaders = group.filter("member = grp").select(F.col("grp").alias("doc_id"))
        postings = sets.select("doc_id", "n_shingles", "prefix").join(leaders, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        several = group.groupBy("grp").count().filter("count > 2").select("grp", F.lit(True).alias("several"))
        postings = postings.join(several, postings["doc_id"] == several["grp"], "left").select("*", F.posexplode("prefix").alias("place", "token"))
        rarest = F.coalesce(F.col("several") & (F.col("place") == 0), F.lit(False)).alias("rarest")
        # at each shingle, sizes are dealt into classes; groups of one class link to its first, so that copies share few partners
        level = F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent))).cast("int").alias("level")
        postings = stash(postings.select("token", "place", level, F.col("doc_id").alias("grp"), rarest), "postings")
        # most shingles of a prefix are in one group alone: they go by their hashes, before whole postings are sent anywhere
        shared = stash(postings.groupBy("token").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").select("token", F.lit(True).alias("shared")), "shared")
        postings = stash(postings.join(shared, "token", "left").filter("shared OR rarest").drop("shared"), "postings")
        # summed before they meet, so a hot shingle is a row for each class and task here; the join below can be split
        classes = postings.groupBy("token", "level").agg(F.min("grp").alias("first"), F.count(F.lit(1)).alias("in_class"))
        classes = classes.withColumn("of", F.sum("in_class").over(Window.partitionBy("token")))
        postings = postings.join(classes, ["token", "level"]).filter("of > 1 OR rarest")
        postings = keep(postings.select("token", "place", "grp", "first"), "postings")
    with scratch(spark) as keep:
        near = postings.filter("first <> grp").select(F.least("first", "grp").alias("a"), F.greatest("first", "grp").alias("b"))
        inside = group.filter("member <> grp").select(F.col("grp").alias("a"), F.col("member").alias("b"))
        label = keep(components(verified(near.union(inside).distinct(), docs, sets, words, percent)), "labels")

    named = group.join(label, group["member"] == label["node"], "left").select("member", "n_shingles", "grp", F.coalesce("component", "member").alias("component"))
    with scratch(spark) as keep:
        roots = label.select("node", "component")

        def joined(pairs: DataFrame) -> DataFrame:
            linked = verified(pairs, docs, sets, words, percent)
            linked = linked.join(roots.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
            return linked.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct()

        members = _open(postings, named, sets)
        usual = _usual(members)
        hot, links, parts = usual.filter("salts > 1"), [], [(members, usual)]
        if not hot.isEmpty():
            # only members at hot shingles get their new components: elsewhere the old ones name some pairs that are linked by now
            first = now = stash(members.join(hot, "token", "left_semi"), "hot")
            for turn in range(HUB_TURNS):
                with scratch(spark) as hold:
                    links.append(hold(joined(_to_hubs(now, hot, turn, percent)), "links"))
                    merged = components(reduce(DataFrame.union, links))
                    component = F.coalesce(merged["component"], first["component"]).alias("component")
                    now = hold(first.join(merged, first["component"] == merged["node"], "left").select(*(first[c] for c in first.columns if c != "component"), component), "hot")
                left = _usual(now)
                hot = left.filter("salts > 1")
                if hot.isEmpty():
                    break
            parts = [(members, usual.filter("salts = 1")), (now, left)]
        across = reduce(DataFrame.union, (_across(*part, percent) for part in parts))
        merged = keep(components(reduce(DataFrame.union, links, joined(across))), "merged")
    final = named.join(merged, named["component"] == merged["node"], "left").select("member", F.coalesce(merged["component"], named["component"]).alias("component_id"))
    final = final.groupBy("member").agg(F.min("component_id").alias("component_id"))  # a doc_id may have several texts
    ends = member.withColumnRenamed("least", "member").drop("doc_id").join(final, "member").select("leaf", *same, "component_id")
    linked = some.withColumn("leaf", leaf("doc_id")).join(ends, ["leaf", *same]).select("doc_id", "n_shingles", "component_id")
    alone = sets.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def _open(postings: DataFrame, named: DataFrame, sets: DataFrame) -> DataFrame:
    """The members at each prefix shingle that holds several components.

    Shingles that the same groups hold (told by two 64-bit hashes and the number of groups) are one: the first in the order of prefixes
    stands for them. `rest` is how many shingles a set has from there on, `before` the open ones just before it in the prefix."""
    per_group = named.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    held = [F.count(F.lit(1)).alias("groups"), F.bit_xor(F.xxhash64("grp")).alias("h1"), F.bit_xor(F.xxhash64("grp", F.lit(1))).alias("h2")]
    # all prefixes follow one order, so places in one group tell which of several shingles comes first in every group
    order = F.min_by("place", "grp").alias("order")
    tokens = postings.join(per_group, "grp").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), order, *held)
    tokens = tokens.filter("low <> high").groupBy("groups", "h1", "h2").agg(F.min_by("token", "order").alias("token")).select("token")
    before = F.collect_list("token").over(Window.partitionBy("grp").orderBy("place").rowsBetween(-BEFORE, -1)).alias("before")
    open_groups = stash(postings.select("token", "place", "grp").join(tokens, "token", "left_semi").select("*", before), "open")
    shares = sets.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("member"), "parts").dropDuplicates(["member"])
    members = named.join(open_groups.select("grp").distinct(), "grp", "left_semi").join(shares, "member")
    return stash(open_groups.join(members, "grp").select("token", "member", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.col("place")).alias("rest"), "component", "parts", "before"), "open")


def _usual(members: DataFrame) -> DataFrame:
    """The largest component of each shingle that holds several, and how many salts its odd members, those of the others, are dealt into."""
    usual = members.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("usual"), (F.sum("count") - F.max("count")).alias("n_odd"))
    return stash(usual.filter("n_odd > 0").withColumn("salts", F.ceil(F.col("n_odd") / SALT_ROWS).cast("int")), "usual")


def _to_hubs(members: DataFrame, hot: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the odd members of hot shingles and the likeliest of HUBS others there, which each shingle and turn draws by
    hash: so few that pairs grow with the members alone. Most members that link with many of a large component join it here."""
    at = members.join(hot, "token")
    drawn = F.xxhash64("member", "token", F.lit(turn))
    hubs = at.filter("component = usual").groupBy("token", F.pmod(drawn, F.lit(HUBS)).alias("slot")).agg(F.min_by("member", drawn).alias("member"))
    met = _meet(at.filter("component <> usual"), at.join(hubs.select("token", "member"), ["token", "member"], "left_semi"), percent)
    likely = met.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(NEAREST)).alias("slot")).agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    return likely.select("a", "b")


def _across(members: DataFrame, usual: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components that share a prefix shingle and may link: the odd ones of a shingle with all.

    Of a pair that links, the first shingle that both prefixes hold has as many before it as may be missing: no shingle before it
    is in both sets, so the overlap is at most what either set has from there on. A pair is named at that first shingle, which is
    open as long as the components differ, and not where the BEFORE open ones before a shingle have one in common; two odd members are named once."""
    at = members.join(usual, "token")
    places = f"{100 + percent} * least(x.rest, y.rest) >= {percent} * (x.n + y.n)"
    once = "(y.component = y.usual OR x.member < y.member) AND NOT arrays_overlap(x.before, y.before)"
    pairs = _meet(at.filter("component <> usual"), at, percent, f"{places} AND {once}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _meet(odd: DataFrame, others: DataFrame, percent: int, also: str = "true") -> DataFrame:
    """Pairs of an odd member (a) and another (b) across components that may link by sizes and parts, once for each shingle where `also`
    holds, and the least number of shingles that they can differ in. Odd members are dealt into salts, and meet the others in each."""
    x = odd.withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int")).alias("x")
    y = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    sizes = f"x.component <> y.component AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    apart = f"({' + '.join(f'bit_count(x.parts[{i}] ^ y.parts[{i}])' for i in range(1 << PART_BITS - 6))})"
    parts = f"{percent} * (x.n + y.n + {apart}) <= 100 * (x.n + y.n - {apart})"
    pairs = x.join(y, F.expr(f"x.token = y.token AND x.salt = y.salt AND {sizes} AND {also} AND {parts}"))
    return pairs.select(F.col("x.member").alias("a"), F.col("y.member").alias("b"), F.expr(apart).alias("apart"))


def drop_near(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows with their own columns, one (the smallest doc_id, null ones last) of each component of rows; each row is a
    document of its own, so of rows that repeat a doc_id and a text one stays, and rows with a null doc_id take part. Rows
    without words link with nothing and stay. An empty table gives an empty one."""
    rows, row = with_row(docs)
    ids = rows.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id"))
    with scratch(docs.sparkSession) as keep:
        near = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).filter("n_shingles > 0").select("doc_id", "component_id")
        near = stash(near, "near")
        several = near.filter("doc_id <> component_id").select(F.col("component_id").alias("root")).distinct()
        named = near.join(several, near["component_id"] == several["root"], "left_semi").join(ids, "doc_id")
        rank = F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")
        # first by leaf, so that a component with a third of all rows is a few rows where it meets
        first = named.withColumn("leaf", leaf("doc_id")).groupBy("leaf", "component_id").agg(F.min(rank).alias("best")).groupBy("component_id").agg(F.min("best").alias("best"))
        kept = first.select("component_id", F.col("best.doc_id").alias("kept"))
        gone = keep(named.join(kept, "component_id").filter("doc_id <> kept").select(F.col("doc_id").alias(row)), "gone")
    return rows.join(gone, row, "left_anti").drop(row)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=4, percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""
