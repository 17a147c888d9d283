"""Benchmark items that come back with other numbers, names and units."""

import random
import time
from itertools import combinations

import numpy as np

from tidewatch.llm import decontaminate

TOM = "Tom has 5 red apples. Tom buys 3 more apples at the market for his mother. How many apples does Tom have now?"


def found(spark, texts, items, **how):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.contaminated(docs, bench, **how).collect()}


def tokens(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    t = decontaminate.Template(raw, np.array([0, len(raw)]))
    kind = {int(decontaminate.NUMBER): "N", int(decontaminate.QUANTITY): "Q", int(decontaminate.NAME): "P"}
    return "".join(kind.get(int(x), ".") for x in t.tokens)


def test_canonical_tokens():
    assert tokens("he paid 1,200 or 3.5 or 12") == "..N.N.N"
    assert tokens("it weighs 5kg or 5 kg or 5 apples") == "..Q.Q.N."
    assert tokens("then Mary Ann met Борис and Élan") == ".P.P.P"
    assert tokens("Sue left. Then came Sue again. Sue sat") == "P...P.P."
    assert tokens("") == "" and tokens("... !!") == ""


def test_reparameterised(spark):
    texts = [
        (1, "Before it. " + TOM + " After it."), (2, TOM.replace("Tom", "Sue").replace("5", "1,200").replace("3", "7.5")),
        (3, TOM.replace("Tom", "Mary Ann")), (4, TOM.replace("more apples at", "more sweet apples at")), (5, TOM.replace("at the market for", "at market for")),
        (6, TOM.replace("5", "3")), (7, "Tom has a dog. The dog has no apples at all, and the market is closed today for his mother."), (8, None), (9, ""),
        (1, "Before it. " + TOM + " After it."), (None, TOM), (10, (TOM + " ") * 300),
    ]
    got = found(spark, texts, [(1, TOM), (2, None), (3, "too short")])
    assert {d: new for (d, _), new in got.items()} == {1: False, 2: True, 3: True, 4: False, 5: False, 10: False}


def test_items_of_one_template(spark):
    """Many items of one template, with a window that half of the documents have."""
    item = "A train leaves the old station with {} people and {} more get on, so how many people does the train carry"
    items = [(i, item.format(i, i + 1000)) for i in range(300)] + [(900, item.format(5, 5))]
    got = found(spark, [(d, "Say: " + item.format(d, d + 1000)) for d in range(40)] + [(99, item.format(7, 7))], items)
    assert {i for d, i in got if d == 99} == {900} and {i for d, i in got if d == 3} == set(range(300))
    assert not got[3, 3] and got[3, 4] and not any(i == 900 for d, i in got if d != 99)


def test_chains():
    """The longest chain, against every subset."""
    draw = random.Random(4)
    ok = lambda p, q: p[0] < q[0] and p[1] < q[1] and abs((q[0] - p[0]) - (q[1] - p[1])) <= 2
    for _ in range(200):
        hits = sorted({(draw.randrange(12), draw.randrange(8)) for _ in range(draw.randrange(1, 9))})
        got = decontaminate.chains(hits, 2)
        best = max(n for n in range(1, len(hits) + 1) for c in combinations(hits, n) if all(map(ok, c, c[1:])))
        assert len(got[0]) == best and all(ok(hits[a], hits[b]) for c in got for a, b in zip(c, c[1:]))


def test_chains_of_many_hits():
    """Every place of an item of 100 at every place of a text: a hit costs some searches."""
    hits = [(d, i) for d in range(3000) for i in range(100) if (d * 7 + i) % 3]
    began = time.perf_counter()
    assert len(decontaminate.chains(hits)[0]) > 60
    assert time.perf_counter() - began < 15


def test_rows_of_one_id_are_searched_apart(spark):
    swapped = TOM.replace("5", "3")
    for order in ([TOM, swapped], [swapped, TOM], [TOM, TOM]):
        assert found(spark, [(7, t) for t in order], [(1, TOM)]) == {(7, 1): False}
    assert found(spark, [(7, swapped), (7, swapped)], [(1, TOM)]) == {}


def test_lists_of_numbers(spark):
    """Numbers alone are told by what they are: the same list is found, another isn't, and long ones end."""
    item = " ".join(str(n * n) for n in range(100))
    price = " ".join(str(n * 7 % 9973) for n in range(20_000))
    assert found(spark, [(1, "Look: " + item + " end"), (2, price), (3, item.replace("81", "80"))], [(1, item)]) == {(1, 1): False, (3, 1): False}


def test_short_items(spark):
    """An item shorter than a window matches as its whole sequence."""
    texts = [(1, "so he said open the gate now and left"), (2, "open the door"), (3, "the gate open"), (4, None)]
    assert found(spark, texts, [(1, "Open the gate"), (2, ""), (3, "Sesame")]) == {(1, 1): False}


def by_hand(text, item):
    """Whether a text of words and numbers holds an item: every way to lay its windows along one offset (edits aside)."""
    kinds = lambda x: ["#" if w.isdigit() else w for w in x.split()]
    t, i, words, own = kinds(text), kinds(item), text.split(), item.split()
    for at in range(len(t) - len(i) + 1):
        if t[at : at + len(i)] == i:
            pairs = {(own[k], words[at + k]) for k in range(len(i)) if i[k] == "#"}
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                return True
    return False


def test_whole_items_like_by_hand(spark):
    """Random items put into random texts with other numbers, found where every window fits and slots agree, and nowhere else."""
    draw = random.Random(8)
    word = lambda: draw.choice("sand lamp fern opal rush dune kelp mint".split())
    made = lambda n: " ".join(str(draw.randrange(4)) if draw.random() < 0.3 else word() for _ in range(n))
    items = [(i, f"begin{'abcdefghijkl'[i]} " + made(draw.randrange(9, 14)) + f" end{'abcdefghijkl'[i]}") for i in range(12)]
    texts = []
    for d in range(60):
        _, item = draw.choice(items)
        shift = {str(k): str(draw.randrange(6)) for k in range(4)}
        texts.append((d, f"{made(6)} . " + " ".join(shift.get(w, w) for w in item.split()) + f" . {made(6)}"))
    got = set(found(spark, texts, items, coverage=1.0, in_tokens=1.0))
    assert got == {(d, i) for d, t in texts for i, item in items if by_hand(t.replace(" . ", " "), item)}


def test_planted_in_given_tables(spark):
    """Every item put whole into a text is found, and nothing in texts that hold none."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    items = [(r["item_id"], r["text"]) for r in bench.collect() if r["text"] and len(r["text"].split()) >= 12]
    words = "river stone light night day year long short hill tree".split()
    draw = random.Random(1)
    clean = [" ".join(draw.choice(words) for _ in range(60)) for _ in items]
    texts = [(k, f"{c}. {t} {c}") for k, (c, (_, t)) in enumerate(zip(clean, items))] + [(10_000 + k, c) for k, c in enumerate(clean)]
    got = found(spark, texts, items)
    assert all((k, i) in got for k, (i, _) in enumerate(items)) and not any(d >= 10_000 for d, _ in got)
