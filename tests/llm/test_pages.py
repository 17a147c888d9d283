"""Lines that pages share: against a brute-force subsequence, and whatever the partitions."""

import random
import time
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import pages

BIG = 2**53 + 1


def longest(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


def test_subsequence():
    draw = random.Random(2)
    for k in range(400):
        a, b = ([draw.choice("abcdef") for _ in range(draw.randrange(14))] for _ in range(2))
        got = pages.common_subsequence(a, b, 1 << 27 if k % 2 else 20)
        assert len(got) == longest(a, b) and got == sorted(set(got))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in got)
    assert len(pages.common_subsequence(["x"] * 3000, ["x"] * 2500 + ["y"] * 500)) == 2500


def site(n, hosts=1):
    body = lambda i: "".join(f"<div>{x}</div>" for x in (f"Menu {i // 2}", "Shop", f"Own text of page {i}", f"More of page {i}", "Shop", f"Foot {(i + 1) // 2}"))
    return [(i, f"http://h{i % hosts}.org/a/{i:03d}", body(i)) for i in range(n)]


def test_partitions_make_no_difference(spark):
    df = spark.createDataFrame(site(40) + [(900, "http://h0.org/a/000", site(1)[0][2])], "page_id long, url string, html string")
    results = []
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results.append(sorted(map(tuple, pages.extract(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1] == results[2] and len(results[0]) == 41
    # the page before and the one after are as near; the one before counts, unless it is the first
    assert results[0][4][2] == "Menu 2 Own text of page 4 More of page 4"
    assert all("Shop" not in r[2] and f"Own text of page {r[0] if r[0] < 900 else 0}" in r[2] for r in results[0])


def test_runs_of_copies_over_partitions(spark):
    """Copies that fill whole tasks have the different pages before and after them as neighbours."""
    line = "".join
    page = lambda own: line(f"<div>{x}</div>" for x in ("Menu", "Shop", own, "Foot"))
    rows = [(i, f"http://h.org/{i:03d}", page(f"Own {i}")) for i in range(5)] + [(i, f"http://h.org/{i:03d}", page("Same text")) for i in range(5, 45)] + [(i, f"http://h.org/{i:03d}", page(f"Own {i}")) for i in range(45, 50)]
    rows += [(i, f"http://g.org/{i:03d}", page("Alone")) for i in range(50, 60)]
    df, results = spark.createDataFrame(rows, "page_id long, url string, html string"), []
    for parts in ("1", "7", "40", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results.append({r["page_id"]: r["text"] for r in pages.extract(df).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {i: "Same text" if 5 <= i < 45 else f"Own {i}" if i < 50 else "Menu Shop Alone Foot" for i in range(60)}
    assert results[0] == want and all(r == want for r in results)


def clear(page):
    return [x for x, _, clear in pages.blocks(page) if clear]


def test_markup():
    """Tags that others end, quotes out of place, signs that aren't tags, and names as whole words."""
    cases = {
        '<article><p class="notice">Cookies<p>Body one<p>Body two</article>': ["Body one", "Body two"],
        '<div><ul><li class="menu">Home<li>Step one<li>step two</ul><p>After</p></div>': ["Step one", "step two", "After"],
        "<ul><li class=menu>Home<ul><li>Sub</ul><li>Step</ul>": ["Step"],
        "<dl><dt class=ad>a<dd>b<dt>c</dl>d": ["b", "c", "d"],
        "<table><tr><td class=ad>a<table><tr><td>x</table><td>b<tr><td>c</table>d": ["b", "c", "d"],
        "<select><option>x</select>y": ["y"],
        "<p data-x=it's>Body</p>": ["Body"], "<p data-x=a<b>Body": ["Body"], '<p title="a > b">t</p>': ["t"], "<p a='x>y' b>t": ["t"], "<p a = \"class='ad'\">t": ["t"],
        "<p>5 < 6 & 7 > 3 <b>x</b> <3</p>": ["5 < 6 & 7 > 3 x <3"], "<p>AT&amp;T &lt;p&gt;</p>": ["AT&T <p>"],
        '<article><div class="side-by-side-comparison share-prices">x</div><div id="related-work">y</div><div class="reply">z</div><div class="share">s</div></article>': ["x", "y", "z"],
        '<div class="main-menu">m</div><div class="cookieNotice x">c</div><div class="ad-slot-2">a</div><div id=site_footer>f</div><p>t</p>': ["t"],
        "<p>a</b> b</div> c</p>": ["a b", "c"], "<script>if (a < b) '<p>'</script><p>t": ["t"], "<!-- <p>x</p> -->y": ["y"], "x <a href='y": ["x"], "": [], "<p HIDDEN>x</p>y": ["y"],
    }
    assert {k: clear(k) for k in cases} == cases


class Checker(HTMLParser):
    """The text outside dropped elements, by the parser of the standard library, for markup whose tags are all closed."""

    def __init__(self):
        super().__init__()
        self.depth, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img"):
            self.depth.append(tag in ("nav", "script", "aside") or dict(attrs).get("class") in ("ad", "menu"))

    def handle_endtag(self, tag):
        self.depth.pop()

    def handle_data(self, data):
        if not any(self.depth):
            self.parts.append(data)


def test_markup_like_another_parser():
    draw = random.Random(3)

    def made(deep):
        if not deep or draw.random() < 0.3:
            return draw.choice(["one", "a &amp; b", " ", "<br>", "x > y", "<img alt='a>b'>"])
        tag = draw.choice(["div", "section", "nav", "aside", "blockquote", "ul", "b", "span"])
        name = draw.choice(["", ' class="ad"', " class=menu", ' class="text-add"', " title='<b>'", ' data-a="1" hidden-x=2'])
        return f"<{tag}{name if tag not in ('b', 'span') else ''}>" + "".join(made(deep - 1) for _ in range(draw.randrange(4))) + f"</{tag}>"

    for _ in range(400):
        page = "".join(made(4) for _ in range(3))
        other = Checker()
        other.feed(page)
        assert "".join(clear(page)).replace(" ", "") == "".join("".join(other.parts).split()), page


def test_markup_takes_one_pass():
    began = time.perf_counter()
    for bad in ("<p><a>x</a>", "<b>x", "<a ", "<a b='", "<a b=\"c", "</p>", "<li><ul>", "<!--", "<", "<td>"):
        pages.blocks(bad * 8000)
    assert time.perf_counter() - began < 10


def test_against_brute_force(spark):
    """Every page's text, by looking for its neighbour among all pages of its host."""
    rows = site(23, hosts=3)
    pages_of = {r[0]: pages.Page(r[1].split(".org", 1)[1], pages.blocks(r[2])) for r in rows}
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i, url, _ in rows:
        fellows = sorted(r[0] for r in rows if r[1].split("/")[2] == url.split("/")[2])
        k = fellows.index(i)
        near = [pages_of[fellows[x]] for x in (k - 1, k + 1) if 0 <= x < len(fellows)]
        other = max(near, key=lambda x: pages.nearness(pages_of[i].path, x.path))
        mine, others = ([x for x, *_ in p.lines] for p in (pages_of[i], other))
        kept = [x for x in mine if x not in others]
        assert got[i] == " ".join(kept) and longest(mine, others) == len(mine) - len(kept)


def test_headlines_forms_and_shared_bodies(spark):
    rows = [
        (BIG, "http://a.org/1", '<article><div class="entry-header"><h1 class="page-header">Headline</h1></div><p>Body</p><div class="share">Tweet</div></article>'),
        (2, "http://b.org/1", "<form action=x><p>All of the page</p></form>"), (3, "http://b.org/2", "<form>Search</form><p>Text <math><mi>x</mi></math></p>"),
        (4, "http://c.org/1", "".join(f"<p>shared {i}</p>" for i in range(9)) + "<p>own 4</p>"), (5, "http://c.org/2", "".join(f"<p>shared {i}</p>" for i in range(9)) + "<p>own 5</p>"),
        (6, "http://d.org/1", "<p>copy</p>"), (7, "http://d.org/1", "<p>copy</p>"), (None, None, "<p>no url</p>"), (8, "http://e.org/1", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "edge": F.lit(1), "lines": F.lit(2)})
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert got == {BIG: "Headline Body", 2: "All of the page", 3: "Text x", 4: "own 4", 5: "own 5", 6: "copy", 7: "copy", None: "no url", 8: ""}
    assert pages.extract(df.limit(0)).count() == 0


def test_many_lines():
    page = "".join(f"<p>line {i % 7}</p>" for i in range(4000))
    lines = [x for x, *_ in pages.blocks(page)]
    assert len(pages.shared_lines(lines, lines[1:] + ["end"])) == 3999
