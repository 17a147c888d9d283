"""HTML extraction: blocks of text, and what a page shares with the nearest page of its host deleted."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator
from itertools import takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: elements whose content is never text of the page; elements that are not part of its main text; elements that end a block
RAW = "script style noscript template iframe svg canvas object textarea select".split()
ASIDE = set("nav footer aside form menu button dialog head".split())
BLOCK = set("address article blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: what an opening tag ends, if it stands inside its own scope: elements of the first set, unless one of the second lies between
CELL = {"td", "th", "caption", "table", "html"}
LISTS = {"ul", "ol", "menu", "dir"}
IMPLIED = (
    {"li": ({"li"}, LISTS | CELL), "tr": ({"td", "th", "tr"}, {"table"}), "option": ({"option"}, {"select"})}
    | {x: ({"dt", "dd"}, {"dl"} | CELL) for x in ("dt", "dd")}
    | {x: ({"td", "th"}, {"table"}) for x in ("td", "th")}
    | {x: ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")}
)
ENDS_PARAGRAPH = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "title"}
#: roles of what stands around an article
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
#: words that name what stands around an article, in a class or id
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer header masthead toolbar share sharing social related recommended comment comments disqus widget pagination pager skip".split()
)
#: words that may stand beside them without changing what is named: where, what shape, how many
BESIDE = set(
    "site page main global top bottom left right inner outer primary secondary mobile desktop sticky fixed small large first last wrap wrapper container box bar bars block blocks section area region panel slot slots unit "
    "zone row col column group list lists link links item items button buttons btn icon icons form text title heading headline content body inline header footer reader user users post posts article articles story stories to "
    "thread count policy message messages toggle trail feed sign in up the and of a js is has id cls".split()
)
#: names that parts of an article have too, such as the header with its headline
OF_ARTICLE = {"header", "masthead", "side"}
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: attributes up to the end of a tag. A quote counts only where a value begins; groups don't give back what they took, so that a tag
#: that is never closed costs one pass
REST = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>]){REST}(?:>|\Z).*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)({REST})(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
GAP = re.compile(r"\s+")
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def names_surroundings(value: str, in_article: bool) -> bool:
    """Whether a class or id has a word that, as a whole, names menus, adverts and the like: `main-menu` and `share-buttons` do,
    `share-prices` and `related-work` don't, since they name something else."""
    names = NAMES - OF_ARTICLE if in_article else NAMES
    for word in value.split():
        parts = [re.sub(r"\d+$", "", x.lower()) for x in PARTS.split(word) if x]
        if any(x in names for x in parts) and all(x in NAMES or x in BESIDE or not x for x in parts):
            return True
    return False


def around(tag: str, attributes: str, in_article: bool, forms: bool) -> bool:
    """Whether an element is menu, header, footer, advert, form, comments or the like. forms: whether a form is."""
    if tag in ASIDE and (forms or tag != "form") or tag == "header" and not in_article:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = html.unescape("".join(values)), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and not (in_article and tag in HEADING) and names_surroundings(value, in_article):
            return True
    return False


class Open:
    """The open elements, with the state before each; where each name was opened last is known without a search."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[bool, bool]]] = []
        self.at: dict[str, list[int]] = {}

    def last(self, names: Iterable[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, tag: str, before: tuple[bool, bool]) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, before))

    def cut(self, place: int) -> tuple[bool, bool]:
        """Ends the element at a place and all inside it; the state before it."""
        while len(self.stack) > place:
            tag, before = self.stack.pop()
            self.at[tag].pop()
        return before

    def implied(self, tag: str, state: tuple[bool, bool]) -> tuple[bool, bool]:
        """The state after what an opening tag ends."""
        if tag in ENDS_PARAGRAPH and (p := self.last(["p"])) > self.last(CELL | {"button"}):
            state = self.cut(p)
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            while (place := self.last(ends)) > self.last(scope):
                state = self.cut(place)
        return state

    def closed(self, tag: str, state: tuple[bool, bool]) -> tuple[bool, bool]:
        """The state after an end tag. One without its element is ignored, as is one of an inline element that a block stands in."""
        place, scope = self.last([tag]), self.last(CELL - {tag} if tag not in CELL and tag not in ("tr", "tbody", "thead", "tfoot", "body") else {"html"} - {tag})
        if place < 0 or place < scope or tag not in BLOCK and place < self.last(BLOCK & self.at.keys()):
            return state
        return self.cut(place)


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article or main element, outside everything that surrounds an article) of each block, in order. Where a
    form holds all that there is, it isn't taken for something around the text."""
    lines = _blocks(page, True)
    return lines if any(clear for *_, clear in lines) or "<form" not in page.lower() else _blocks(page, False)


def _blocks(page: str, forms: bool) -> list[tuple[str, bool, bool]]:
    out: list[tuple[str, bool, bool]] = []
    opened, text, state = Open(), [], (False, True)

    def close(new: tuple[bool, bool], block: bool) -> None:
        nonlocal state
        if block or new != state:
            line = GAP.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((line, *state))
        state = new

    at = 0
    for m in MARKUP.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            close(opened.closed(tag, state), tag in BLOCK)
            continue
        before = opened.implied(tag, state)
        close(before, tag in BLOCK)
        if tag not in VOID:
            new = (state[0] or tag in ("article", "main"), state[1] and not around(tag, m[4] or "", state[0], forms))
            close(new, False)
            opened.push(tag, before)
    text.append(page[at:])
    close(state, True)
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """For each prefix of a, a number whose bit j is 0 where the longest common subsequence with b[:j + 1] is longer than with
    b[:j] (Hyyrö's bit-parallel recurrence)."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    now = full
    for x in a:
        met = now & places.get(x, 0)
        now = ((now + met) | (now - met)) & full
        yield now


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b, the empty one first."""
    last = (1 << len(b)) - 1
    for last in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def common_subsequence(a: list, b: list, most_bits: int = 1 << 27) -> list[int]:
    """Places in a of a longest common subsequence with b. Memory stays bounded: where the rows would take more than most_bits,
    a is halved and b is cut where both halves have most in common (Hirschberg)."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > most_bits:
        middle = len(a) // 2
        cut = int(np.argmax(_lengths(a[:middle], b) + _lengths(a[:middle - 1 : -1], b[::-1])[::-1]))
        return common_subsequence(a[:middle], b[:cut], most_bits) + [middle + i for i in common_subsequence(a[middle:], b[cut:], most_bits)]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append(i)
    return out[::-1]


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Places of the lines in a longest common subsequence of two pages: what both begin and end with, and the rest aligned."""
    a, b = 0, 0
    while a < min(len(mine), len(other)) and mine[a] == other[a]:
        a += 1
    while b < min(len(mine), len(other)) - a and mine[-1 - b] == other[-1 - b]:
        b += 1
    inner = common_subsequence(mine[a : len(mine) - b], other[a : len(other) - b])
    return set(range(a)) | set(range(len(mine) - b, len(mine))) | {a + i for i in inner}


class Page(NamedTuple):
    """A page's URL path, its blocks, and the text of those that nothing surrounds."""

    path: str
    lines: list[tuple[str, bool, bool]]

    def clear(self) -> list[str]:
        return [x for x, _, clear in self.lines if clear]


def nearness(path: str, other: str) -> tuple[int, int]:
    """Common leading parts of two URL paths, then common leading characters."""
    same = lambda x, y: sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(x, y)))
    return same(path.split("/"), other.split("/")), same(path, other)


def main_text(page: Page, before: Page | None, after: Page | None) -> tuple[str, int]:
    """The main text, and how many lines the page shares with the nearer one of its neighbours (the one before, if both are as
    near). A neighbour of the same lines is a copy of the page and tells nothing about it."""
    mine = page.clear()
    others = [x for x in (before, after) if x and x.clear() != mine]
    own, shared = [x for x, *_ in page.lines], set()
    if others:
        nearest = max(others, key=lambda x: nearness(page.path, x.path))
        shared = shared_lines(own, [x for x, *_ in nearest.lines])
    article = any(inside and clear for _, inside, clear in page.lines)
    kept = [x for i, (x, inside, clear) in enumerate(page.lines) if clear and (inside if article else i not in shared)]
    return " ".join(kept), len(shared)


def _got(data: bytes | None, size: int) -> Page | None:
    return Page(*json.loads(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True))) if data else None


#: pages that are sent to Python at once
BATCH_ROWS = 500
PARSED = "page_id long, url string, host string, path string, lines binary, size int"
#: edge: for a row whose neighbour may be in another task, 1 (the page before it may), 2 (the one after it) or 3; the page itself (own),
#: the neighbour that is known (inner), what copies have in common (same) and its place in the task are kept for it
RESULT = "page_id long, url string, text string, n_chars long, n_shared long, edge int, part int, host string, own string, inner string, same long, place long"


def parse(pages: DataFrame) -> DataFrame:
    """host, path and blocks of each page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, sizes = [], []
            for path, page in zip(batch.column("path").to_pylist(), batch.column("html")):
                plain = json.dumps(Page(path, blocks(page.as_py() or ""))).encode()
                packed.append(pa.compress(plain, codec="zstd", asbytes=True))
                sizes.append(len(plain))
            kept = [batch.column(c) for c in ("page_id", "url", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())], ["page_id", "url", "host", "path", "lines", "size"])

    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://[^/?#]*|[?#].*$", "")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html").mapInArrow(read, PARSED)


def _same(host: str | None, page: Page) -> int:
    """What the copies of a page on one host have in common, as a number."""
    return int.from_bytes(hashlib.blake2b("\n".join([host or "", *page.clear()]).encode(), digest_size=8).digest(), "little", signed=True)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of host and path: each run of copies with the different page before it and the one after it. The first
    and the last run of a task are left for whoever knows its neighbours."""
    run: list[tuple] = []  # rows of the run at work: page_id, url, part, host, page, place
    page = before = None
    first, place = True, 0
    out: list[tuple] = []

    def close(after: Page | None, last: bool) -> None:
        nonlocal first
        edge, inner = first + 2 * last, before or after
        same = _same(run[0][3], run[0][4]) if edge else None
        for page_id, url, part, host, own, at in run:
            text, shared = (None, 0) if edge else main_text(own, before, after)
            rest = (json.dumps(own), json.dumps(inner) if inner else None, same, at) if edge else (None,) * 4
            out.append((page_id, url, text, len(text or ""), shared, edge, part, host, *rest))
        first = False

    for batch in batches:
        columns = (batch.column(c) for c in ("page_id", "url", "part", "host", "lines", "size"))
        for page_id, url, part, host, lines, size in zip(*(c.to_pylist() for c in columns)):
            own = _got(lines, size)
            if run and (host != run[0][3] or own.clear() != page.clear()):
                same_host = host == run[0][3]
                close(own if same_host else None, False)
                before, run = page if same_host else None, []
            run.append((page_id, url, part, host, own, place))
            page, place = own, place + 1
        if out:
            yield _table(out)
            out.clear()
    if run:
        close(None, True)
    if out:
        yield _table(out)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    shape = [c.split() for c in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), shape)], [n for n, _ in shape])


def at_edges(rows: DataFrame) -> DataFrame:
    """The rows at the edges of tasks, with the different page beyond the edge. Where copies go on through whole tasks, those are
    skipped: a scan over the tasks, by what begins and ends each, tells the first task after (or the last before) that has
    another page, and the page is its outermost one, or the next if the copies reach into it."""
    c = F.col
    starts, stops = c("edge").bitwiseAND(1) > 0, c("edge").bitwiseAND(2) > 0
    page = F.struct("same", "host", "own")
    ends = rows.groupBy("part").agg(
        F.min_by(F.when(starts, page), F.when(starts, c("place"))).alias("head"), F.max_by(F.when(stops, page), F.when(stops, c("place"))).alias("tail"),
        F.max(F.when(c("edge") == 1, c("inner"))).alias("second"), F.max(F.when(c("edge") == 2, c("inner"))).alias("last_but"), (F.max("edge") == 3).alias("single"),
    )
    ends = stash(ends, "ends")
    order = Window.orderBy("part")  # a row of a few numbers for each task
    through = ends.select("part", "single", c("head.same").alias("head"), c("tail.same").alias("tail"))
    through = through.withColumns({"down": c("single") & F.coalesce(c("head") == F.lag("tail").over(order), F.lit(False)), "up": c("single") & F.coalesce(c("tail") == F.lead("head").over(order), F.lit(False))})
    through = through.select("part", F.min(F.when(~c("down"), c("part"))).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"), F.max(F.when(~c("up"), c("part"))).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    later = ends.select(c("part").alias("after"), c("head").alias("l"), "second")
    earlier = ends.select(c("part").alias("before"), c("tail").alias("e"), "last_but")
    known = rows.join(through, "part").join(later, "after", "left").join(earlier, "before", "left")
    beyond = lambda mask, end, inside: F.when(mask & (c(f"{end}.same") == c("same")), c(inside)).when(mask & (c(f"{end}.host") == c("host")), c(f"{end}.own"))
    known = known.select("page_id", "url", "own", "edge", "inner", beyond(starts, "e", "last_but").alias("earlier"), beyond(stops, "l", "second").alias("later"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda x: Page(*json.loads(x)) if x else None
        for batch in batches:
            found = []
            for own, edge, *others in zip(*(batch.column(c).to_pylist() for c in ("own", "edge", "inner", "earlier", "later"))):
                inner, earlier, later = map(load, others)
                text, shared = main_text(load(own), earlier if edge & 1 else inner, later if edge & 2 else inner)
                found.append((text, len(text), shared))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", "text", "n_chars", "n_shared"])

    return known.mapInArrow(decide, "page_id long, url string, text string, n_chars long, n_shared long")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_shared (lines it shares with its neighbour).

    Pages are dealt by ranges of (host, path), so a host with a third of all pages fills many tasks, and each task holds a few
    pages at a time. A page's neighbour is the nearer, by URL path, of the different pages before and after it in that order,
    of the same host. The lines of both are aligned by longest common subsequence, and shared ones go, unless the page marks
    its article: what stands inside <article> or <main> isn't deleted for being shared, as pages of a host often share
    passages of their articles. The first and the last run of copies of a task are decided in a second step, with the page beyond
    the task's edge, or beyond all tasks that the copies fill, so that the text doesn't depend on where a task begins. Elements that surround an article go by their tag, role, class or id. A null or empty html gives an
    empty text; a null or odd url has the empty host; repeated rows are each kept; null page_ids are allowed. An empty table
    gives an empty result; other columns are ignored.
    """
    ranged = parse(pages).repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    found = stash(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(compare, RESULT), "pages", BATCH_ROWS)
    shape = ["page_id", "url", "text", "n_chars", "n_shared"]
    return found.filter("edge = 0").select(shape).union(at_edges(found.filter("edge > 0")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
