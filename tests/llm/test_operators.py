"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, exact, jaccard, language, links, packing, pages, privacy, sharding, substrings, suffixes

DATA = "/root/testdata/sf0.001"
WORDS = "the of and sun sea hill tree wind rain snow road field river stone light night day year long short".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    base, shared = text(120), text(30)
    rows = [(1, None), (2, ""), (3, base), (4, base), (5, base + " end"), (6, base.replace("sun", "moon", 1)), (7, shared + " " + text(40)), (8, text(20) + " " + shared), (9, "ÄÖ é\t x " + shared + " " + shared)]
    rows += [(20 + i, text(int(n))) for i, n in enumerate(rng.integers(1, 90, 30))] + [(10, "the the"), (11, "THE the"), (12, ""), (13, "a" * 200), (14, "a" * 120), (8, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hashes": F.lit(1), "bucket": F.lit("x"), "keep_id": F.lit(None)})
    return df.repartition(3), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact(docs, none):
    df, rows = docs
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    want = sorted((d, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    got = exact.exact_duplicates(df, "largest", leaves=8, fan_in=2)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()) == want
    assert exact.exact_duplicates(none).count() == 0 and exact.drop_exact(df).columns == df.columns


def test_substrings(docs, none):
    df, rows = docs
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(d, first.get(tuple(w[i : i + 13]), d))
    want = []
    for d, w in words:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    got = substrings.remove_repeats(df)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == sorted(want)
    assert substrings.remove_repeats(none).count() == 0


def test_suffixes(docs, none):
    df, rows = docs
    df, rows = df.filter("doc_id <> 8").union(df.filter("doc_id = 3")), [r for r in rows if r[0] != 8] + [r for r in rows if r[0] == 3]
    data = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = []
    for d, b in data:
        gone = {j for i in range(len(b) - 49) if first[b[i : i + 50]] < d for j in range(i, i + 50)}
        want.append((d, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    got = suffixes.remove_repeated_bytes(df)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)
    assert suffixes.remove_repeated_bytes(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_suffix_order(text):
    raw = np.frombuffer(text, np.uint8)
    order = suffixes.suffix_order(raw, np.ones(len(raw), bool)).tolist() if len(raw) else []
    key = lambda i: text[i : i + 56]
    assert sorted(order) == list(range(len(text))) and all(key(a) <= key(b) for a, b in zip(order, order[1:]))


def test_jaccard(docs, none):
    df, rows = docs
    ids, sets = [d for d, _ in rows], []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    least = {d: d for d in ids}
    for _ in ids:
        for a, x in zip(ids, sets):
            for b, y in zip(ids, sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    least[a] = least[b] = min(least[a], least[b])
    got = jaccard.near_duplicates(df, 4, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((d, len(s)) for d, s in zip(ids, sets))
    assert {r["doc_id"]: r["component_id"] for r in got} == least
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_alone_group(spark, monkeypatch):
    """Members that link with each other, not with the first of their group, which alone has its prefix shingles."""
    head = "one two three four five"
    texts = [head + " " + " ".join(f"a{i}" for i in range(11))] + [head + " " + " ".join(f"b{i}" for i in range(10)) + end for end in (" x", " y")]
    raw = np.frombuffer(head.encode(), np.uint8)
    rare = jaccard.shingle_sets(raw, np.array([0, len(raw)]), 4)[0] >> np.uint64(64 - jaccard.COUNT_BITS)
    counts = np.ones(1 << jaccard.COUNT_BITS, np.int64)
    counts[rare.astype(np.int64)] = 0
    monkeypatch.setattr(jaccard, "shingle_counts", lambda docs, k: counts)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"), 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 2, 3: 2}


def test_links(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 30), (30, 50), (7, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in links.components(df).collect()} == {i: 1 for i in range(1, 21)} | {30: 30, 40: 30, 50: 30}


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df, rows = docs
    special = [(900, "x <|endoftext|> y " * 400)]
    df = df.select("doc_id", "text").union(df.sparkSession.createDataFrame(special, "doc_id long, text string"))
    got = packing.pack(df, window=64).collect()
    tokens = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in rows + special if d != 8}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d, ids in tokens.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert sum(r["length"] for r in got) > 0.9 * 64 * len(by_sequence) and packing.pack(none).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit(lengths):
    sequence, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 32)
    room, want = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(32 - n)
            want += 1
    assert len(set(sequence.tolist())) == want


def test_decontamination(spark):
    item = "Anna bought 12 kg of red apples for 30 dollars and then gave 5 kg to her kind old neighbour Boris today."
    anew = item.replace("Boris", "Viktor").replace("12", "17").replace("30", "44").replace("5 kg", "9 kg")
    broken = item.replace("12", "30")
    texts = [(1, "Some words before. " + item + " More words after."), (2, "Here it goes. " + anew), (3, "Nothing of the kind is said here at all, not even once."), (4, None), (5, ""), (6, broken), (7, item[:40])]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench)
    assert {r["doc_id"]: r["reparameterised"] for r in got.collect()} == {1: False, 2: True}
    assert decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learned(docs, 150)
    extra = spark.createDataFrame([(-1, None), (-2, "123 !!"), (-3, "")], "doc_id long, text string")
    rows = language.identify(docs.select("doc_id", "text").union(extra), model).join(docs.select("doc_id", "lang"), "doc_id", "left").withColumn("h", language.held_out()).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] < 0)
    held = [r for r in rows if r["doc_id"] >= 0 and r["h"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_training_rows(spark):
    """Languages with short texts or few texts are learned beside a large one."""
    rows = [(i, "many words of one language " * 20, "en") for i in range(300)] + [(1000 + i, "kurzer Satz", "de") for i in range(8)] + [(2000 + i, "длинный текст " * 3000, "ru") for i in range(4)]
    got = language.training_rows(spark.createDataFrame(rows + [(None, "123", "xx")], "doc_id long, text string, lang string"), 20)
    assert len(got) == 20 and {lang for _, lang in got} == {"en", "de", "ru"} and max(len(t) for t, _ in got) == language.LONGEST


def test_training_rows_by_brute_force(spark):
    """The same rows however many partitions hold them, also with more languages than rows."""
    rows = [(i % 90, f"some words {i} " * (i % 40), f"l{min(i % 13, i % 7)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample in (30, 3):
        some = df.filter("text <> ''").filter(~language.held_out()).selectExpr("text", "lang", "length(text) < 200 AS s", "xxhash64(doc_id) AS h", "xxhash64(doc_id, xxhash64(text)) AS k").collect()
        turns = []
        for lang in {r["lang"] for r in some}:
            own = sorted((r["s"], r["h"], r["k"], r["text"]) for r in some if r["lang"] == lang)
            turns += [(t, h, k, lang, text) for t, (_, h, k, text) in enumerate(own)]
        languages = len({t[3] for t in turns})
        want = sorted((t[4], t[3]) for t in sorted(turns)[: max(sample, languages)])
        assert [sorted(language.training_rows(df.repartition(n), sample)) for n in (1, 70)] == [want, want]


def test_switched_text_stays(spark, monkeypatch):
    """A text in four languages, each word certain, is kept, with a null doc_id too; one of words that no label fits is not."""
    crf = language.Crf(["a", "b", "c", "d"], {})
    crf.table = np.vstack([40 * np.eye(4), np.zeros((1, 4))])
    crf.row = {"aa": 0, "bb": 1, "cc": 2, "dd": 3, "zz": 4}
    monkeypatch.setattr(language, "learned", lambda docs: crf)
    rows = [(1, "aa bb cc dd"), (None, "dd cc bb aa"), (2, "zz zz"), (3, "12"), (4, None), (2, "aa")]
    got = language.drop_unidentified(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[5]], key=str)


def test_forward_backward():
    rng = np.random.default_rng(1)
    crf = language.Crf(["a", "b", "c"], {})
    crf.moves, crf.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(4, 3))
    total, want = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(crf.first[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(crf.moves[x, y] for x, y in zip(path, path[1:])))
        total += p
        for i, y in enumerate(path):
            want[i, y] += p
    got, _ = crf.marginals([scores, scores[:2], scores[:0]])
    assert np.allclose(got[0], want / total) and len(got[2]) == 0


def test_pages(spark):
    page = lambda body: f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a>Home</a></nav><div class='cookie-notice'>Accept</div>{body}<div class=\"ad\">Buy</div><section id=comments><article><p>First!</p></article></section><footer>&copy; x</footer></body></html>"
    rows = [
        (1, "http://h.org/a", page("<article><h1>One</h1><p>A &amp; b<br>c  d<p>e<script>var t='</p>';</script></article>")),
        (2, "http://k.org/b", "<div>Shared line</div><p>Own two</p>"), (3, "http://k.org/c", "<div>Shared line</div><p>Own three</p>"),
        (4, None, None), (5, "odd", ""), (1, "http://h.org/a", page("<article><p>again")),
    ]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "One A & b c d e", 15), (1, "again", 5), (2, "Own two", 7), (3, "Own three", 9), (4, "", 0), (5, "", 0)]


def test_privacy(spark):
    rows = [(1, "Mr. John Smith wrote to bob.x1@mail.example.com and BOB.X1@mail.example.com, +1 (619) 555-0053, card 4111 1111 1111 1111 or 4111111111111111, password=abc12 at 10.1.2.3."), (2, None), (3, ""), (4, "plain 12 words v2.0."), (5, "bob.x1@mail.example.com"), (5, "bob.x1@mail.example.com"), (6, " ".join(f"a.{i}@b.org" for i in range(10)))]
    got = sorted(privacy.replace_private(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect(), key=lambda r: r["doc_id"])
    assert [r["n_entities"] for r in got] == [9, 0, 0, 0, 1, 1, 10] and [r["text"] for r in got[1:4]] == [None, "", "plain 12 words v2.0."]
    text = got[0]["text"]
    for secret in ("John", "Smith", "bob.x1", "555-0053", "4111", "abc12", "10.1.2.3"):
        assert secret not in text
    mails = re.findall(r"\S+@mail\.example\.com", text)
    assert mails[0] == mails[1].rstrip(",") == got[4]["text"] == got[5]["text"]
    assert text.startswith("Mr. ") and len(set(got[6]["text"].split())) == 10 and not set(got[6]["text"].split()) & set(rows[6][1].split())


def test_privacy_full_pools(spark):
    """More entities than the plain surrogates of their form, and secrets without a Latin letter or digit."""
    names = ["Б" + a + b for a in "абвгдежзиклмно" for b in "абвгдежзиклмн"]
    secrets = ["****", "{}", "....", "пароль", "AKIA", "foo@bar", *"0123456789"]
    mails = [f"{c}@q.org" for c in "abcdefghijklmnopqrstuvwxyz_"]
    phones = ["+123 45 67 89", "(619) 555-0053"]
    rows = list(enumerate([f"г-н {n} идёт" for n in names] + [f"password: {x}" for x in secrets] + mails + phones))
    got = sorted(privacy.replace_private(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect(), key=lambda r: r["doc_id"])
    made = [r["text"].removeprefix("г-н ").removeprefix("password: ").removesuffix(" идёт") for r in got]
    assert all(r["n_entities"] == 1 for r in got) and len(set(made)) == len(rows) and not set(made) & {*names, *secrets, *mails, *phones}
    assert all(re.fullmatch("[А-Я][а-я]+", m) for m in made[: len(names)]) and all(m.endswith("@q.org") for m in made[-29:-2])
    assert not any(c in "пароль@*{}" for m in (made[len(names)], made[len(names) + 1]) for c in m) and made[-2].startswith("+123 ")


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = Counter(table)
    assert len(table) == 1009 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer)) < 0.5 * 1009
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id long, slot string")
    rows = sharding.place(df, "doc_id", names, 1009).collect()
    assert len(rows) == 3 and all(r["shard"] == names[table[r["slot"]]] for r in rows)
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(names, 1000)
