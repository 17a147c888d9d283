"""Ids, nulls, repeated rows and planted links: what operators do with rows that are not as usual."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontaminate, exact, jaccard, language, packing

BIG = 2**53 + 1
SF = "/root/testdata/sf0.01"


def linked(texts, k, percent):
    """The smallest id that links lead to, by trying every pair."""
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    least = {d: d for d in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return least


def test_links_beyond_the_first_of_a_group(spark):
    """Two documents with one prefix that link with each other and not with the first document that has it."""
    p, a, b = ([f"{c}{i}" for i in range(n)] for c, n in (("p", 7), ("a", 16), ("b", 16)))
    b2 = [*b[:-1], "other"]
    texts = [(1, p + a), (2, p + b), (3, p + b2)] + [(10 + i, p[-3:] + x) for i, x in enumerate([a] * 20 + [b] * 20 + [b2] * 20)]
    rows = [(d, " ".join(w)) for d, w in texts]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got[3] == got[2] == 2 and got == linked(rows, 4, 85)


def test_rows_of_one_id_are_one_document(spark):
    """Whatever the order of its texts, a doc_id is in one component with all that they link with."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a + " more"), (3, b + " more"), (5, a), (5, b), (5, b), (6, None), (6, c), (7, c), (None, a), (8, ""), (8, " ")]
    for order in (rows, rows[::-1]):
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), 4, 85).collect()}
        assert got == {(1, 28, 1), (3, 28, 1), (5, 27, 1), (6, 0, 6), (6, 27, 6), (7, 27, 6), (None, 27, None), (8, 0, 8)}


def test_links_with_planted_prefixes(spark):
    draw = random.Random(5)
    heads = [" ".join(f"h{i}w{j}" for j in range(6)) for i in range(4)]
    bodies = [[f"b{i}w{j}" for j in range(30)] for i in range(6)]
    rows = []
    for d in range(160):
        body = list(draw.choice(bodies))
        for _ in range(draw.randrange(3)):
            body[draw.randrange(30)] = f"x{draw.randrange(40)}"
        rows.append((d, f"{draw.choice(heads)} {' '.join(body)}" if d % 3 else " ".join(body)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == linked(rows, 4, 85)


def test_large_ids_beside_null(spark):
    df = spark.createDataFrame([(BIG, "one two three"), (None, "four five"), (-BIG, None)], "doc_id long, text string").coalesce(1).withColumns({"length": F.lit("x"), "_group": F.lit(1)})
    assert {r["doc_id"] for r in packing.pack(df).collect()} == {BIG, None, -BIG}
    model = language.train([("one two three four " * 9, "en"), ("eins zwei drei vier " * 9, "de")])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert got == {BIG: "en", None: "en", -BIG: "und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_letters_only():
    assert language.words_of("½ ² Ⅷ 12 _") == [] and language.words_of("x²y Ähm5b") == ["x", "y", "ähm", "b"]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in language.drop_unidentified(df).collect()] == [1]


def reference_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def test_ids_of_whole_table(spark):
    t = reference_encoder()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {}
    for r in rows.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want[r["doc_id"]] = [zlib.crc32(np.array(ids[i : i + 1024], "<u4").tobytes()) for i in range(0, len(ids), 1024)]
    got = {}
    for r in sorted(packing.cut(rows).collect(), key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).append(r["ids_crc32"])
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_of_any_text(text):
    got = packing.encoder().encode(text, allowed_special="all", disallowed_special=())
    assert got == reference_encoder_cached().encode(text, add_special_tokens=False).ids


_kept: list = []


def reference_encoder_cached():
    if not _kept:
        _kept.append(reference_encoder())
    return _kept[0]


def test_packing_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c")] * 30 + [(4, "x")] * 3 + [(5, "long " * 5000)], "doc_id long, text string")
    got = packing.pack(df, group_pieces=4).collect()
    assert sum(r["doc_id"] is None for r in got) == 30 and sum(r["doc_id"] == 4 for r in got) == 3
    for key in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == key), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


ODD = [(3, "a", 1), (5, "a", 2), (5, "b", 3), (5, "b", 4), (None, "a", 5), (None, "c", 6), (None, None, 7), (9, "", 8)]


def test_drop_exact_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, _row int")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in exact.drop_exact(df).collect())
    assert got == [(0, "c"), (3, "a"), (5, "b"), (9, "")] and exact.drop_exact(df).columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in exact.drop_exact(df, "largest").collect()) == [(0, "c"), (5, "a"), (5, "b"), (9, "")]
    assert exact.drop_exact(df.limit(0)).count() == 0


def test_drop_near_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (8, base + " end"), (8, "other words of another text here"), (4, base), (4, base), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("mine"))
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in jaccard.drop_near(df).collect()))
    assert got == sorted([(4, base), (8, "other words of another text here"), (0, ""), (2, "")])
    assert jaccard.drop_near(df).columns == df.columns and jaccard.drop_near(df.limit(0)).count() == 0


def test_drop_contaminated_rows(spark):
    item = "which of the seven long rivers of the old country runs through nine towns before the sea"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "Here: " + item), (7, "clean words only, nothing else"), (7, item), (None, "clean too"), (None, None)]
    got = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, ""), (0, "clean too"), (7, "clean words only, nothing else")]


def test_pipeline(spark, tmp_path):
    """Every stage works on what the one before kept, odd rows included."""
    model = "the river runs through the old town and the people of the town go down to the river every day of the year "
    rows = [(i, f"{model} item{i} {' '.join(f'{w}{i}' for w in 'hill tree wind rain snow road field stone light night'.split())}", "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 34 !!", None), (102, rows[0][1], "en"), (None, rows[1][1] + " end", None), (104, rows[2][1] + " once more", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[5][1].lower())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert name == "packing" or now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in now.collect()}
    assert not kept["language_id"] & {100, 101} and {0, 102, None} <= kept["language_id"]
    assert 102 not in kept["exact_dedup"] and {0, 104, None} <= kept["exact_dedup"]
    least = linked([(d if d is not None else 900, t) for d, t, _ in rows if d not in (100, 101, 102)], 5, 80)
    assert kept["near_duplicates"] == set(least.values()) - {900}
    assert 5 not in kept["decontamination"] and kept["packing"] == kept["decontamination"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == kept["packing"]


def test_pipeline_empty(spark, tmp_path):
    for name, shape in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("fan_in", [2, 5])
def test_merge_tree_keeps_the_least(spark, fan_in):
    rows = [(d if d % 5 else None, f"t{d % 7}" if d % 3 else None) for d in range(90)]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaves=8, fan_in=fan_in).collect()
    for r in got:
        same = [d for d, t in rows if (t or "") == next((t or "") for d, t in rows if d == r["doc_id"])] if r["doc_id"] is not None else None
        assert same is None or (r["keep_id"], r["group_size"]) == (min(d for d in same if d is not None), len(same))
    assert len(got) == 90


def test_equal_rows_are_dealt(spark):
    """Rows that are all the same fill as many groups as others, and groups are bounded by tokens."""
    same = spark.createDataFrame([(None, "")] * 3000, "doc_id long, text string").repartition(4)
    groups = [r["sequence_id"] >> 40 for r in packing.pack(same, group_pieces=100).collect()]
    assert len(groups) == 3000 and max(map(groups.count, set(groups))) < 200
    long = spark.createDataFrame([(i, "word " * 500) for i in range(50)], "doc_id long, text string")
    assert len({r["sequence_id"] >> 40 for r in packing.pack(long, group_tokens=2000).collect()}) > 5
