"""Hard negatives, conversation repair and sum-of-squares packing against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import dialogues, negatives, squares

SF = "/root/testdata/sf0.01"
BIG = 2**53 + 1


# hard negatives


@given(st.integers(0, 2**62 - 1))
@settings(max_examples=50, deadline=None)
def test_moduli(bound):
    primes = negatives.moduli(bound)
    assert len(set(primes)) == len(primes) and np.prod([int(p) for p in primes], dtype=object) > 2 * bound and all(p < 1024 for p in primes)


@pytest.mark.parametrize("size,width", [(3, 5), (300, 64), (10**6, 200), (10**8, 130)])
def test_exact_scores(size, width):
    draw = np.random.default_rng(size)
    a, b = (draw.integers(-size, size + 1, (n, width)) for n in (7, 11))
    a[0], b[0] = size, -size
    primes = negatives.moduli(size * size * width)
    got = negatives.Residues(a, primes).scores(slice(None), negatives.Residues(b, primes), slice(None))
    assert (got == a @ b.T).all()


def test_best():
    draw = np.random.default_rng(1)
    s = draw.integers(-3, 4, (40, 30))
    s[draw.random((40, 30)) < 0.5] = negatives.NONE
    i, j = negatives.best(s, 3)
    for row in range(40):
        want = sorted((c for c in range(30) if s[row, c] > negatives.NONE), key=lambda c: (-s[row, c], c))[:3]
        assert j[i == row].tolist() == want


def mined(rows):
    """Rows (vec_id, vector, label) by trying every pair."""
    far = lambda v: (v is None, v or 0)
    ok = [(v, [int(np.floor(256 * float(np.float32(x)))) for x in e], (y + 1) % 10 if v is not None and v % 7 == 0 else y) for v, e, y in rows if y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for n, (a, e, y) in enumerate(ok):
        if a is None or a % 50:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(e, f)), far(v), v, z) for m, (v, f, z) in enumerate(ok) if m != n), key=lambda x: x[:2])
        for minus, _, v, _ in [x for x in scored if x[3] == y][:5]:
            inside = [x for x in scored if x[3] != y and 50 * -minus <= 100 * -x[0] <= 95 * -minus]
            out += [(a, v, k + 1, x[2], -minus, -x[0]) for k, x in enumerate(inside[:3])]
    return sorted(out, key=str)


SHAPE = "vec_id long, embedding array<float>, label int, row string, place int"


def test_negatives_like_every_pair(spark):
    draw = random.Random(2)
    vec = lambda n=6: [draw.uniform(-1, 2) for _ in range(n)]
    common = vec()
    rows = [(i % 150 if i else None, draw.choice([common, vec()]), draw.randrange(3)) for i in range(400)]
    rows += [(50, None, 1), (100, vec(), None), (0, [None, 1.0], 1), (0, [float("nan"), 1.0], 1), (0, [float("-inf")], 1), (50, [], 2), (150, vec(3), 0), (BIG, vec(9), 0), (-50, vec(), 2)]
    rows += rows[:30]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE)
    for block in (8192, 37):
        got = negatives.hard_negatives(df.repartition(3), block=block).collect()
        assert sorted(map(tuple, got), key=str) == mined(rows)


def test_negatives_like_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = negatives.op11_hard_negatives(spark, SF)
    want = con.sql(negatives.OP11_SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert len(want.fetchall()) == 0 or got.count() > 0


def test_negatives_edges(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert negatives.hard_negatives(empty).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "", 1)], SHAPE)).count() == 0
    with pytest.raises(ArithmeticError):
        negatives.hard_negatives(spark.createDataFrame([(50, [3e38], 1, "", 1)], SHAPE))


# conversation repair


def searched(initials, faults):
    """Every edit of every row with up to two insertions in every gap."""
    best = None
    gaps = [("", ""), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    choices = []
    for c, f in zip(initials, faults):
        more = 5 if f == 3 else 0
        choices.append([("D", "", 2)] + ([("K", c, more), ("R", "u", 1 + more), ("R", "a", 1 + more)] if f in (0, 3) else []))
    for fill in itertools.product(gaps, repeat=len(initials) + 1):
        for some in itertools.product(*choices):
            roles = fill[0][1] + "".join(x[1] + g[1] for x, g in zip(some, fill[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                found = sum(x[2] for x in some) + 5 * sum(len(g[0]) for g in fill), fill[0][0] + "".join(x[0] + g[0] for x, g in zip(some, fill[1:]))
                best = min(best or found, found)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_cheapest_like_every_edit(n):
    draw = random.Random(n)
    for _ in range(12):
        initials, faults = [draw.choice("suax") if draw.random() < 0.95 else "" for _ in range(n)], [draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert dialogues.cheapest(initials, bytes(faults)) == searched(initials, faults), (initials, faults)


def settled(initials, faults):
    """The least (cost, audit) of every state, row by row, with whole audits."""
    go = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    def walk(q, word):
        for c in word:
            q = go[q].get(c) if q is not None else None
        return q

    def filled(at):
        out = dict(at)
        for q, (cost, audit) in at.items():
            for w in ("u", "a", "ua", "au"):
                if (to := walk(q, w)) is not None:
                    out[to] = min(out.get(to, (10**9, "")), (cost + 5 * len(w), audit + "I" * len(w)))
        return out

    at = filled({0: (0, "")})
    for c, f in zip(initials, faults):
        new = {}
        for q, (cost, audit) in at.items():
            more = 5 if f == 3 else 0
            steps = [(q, 2, "D")]
            if f in (0, 3):
                steps += [(go[q].get(c) if c else q, more, "K")] + [(go[q].get(r), 1 + more, "R") for r in "ua"]
            for to, spent, letter in steps:
                if to is not None:
                    new[to] = min(new.get(to, (10**9, "")), (cost + spent, audit + letter))
        at = filled(new)
    return min(at[q] for q in (0, 3) if q in at)


def test_cheapest_of_long_conversations():
    draw = random.Random(9)
    for n in [*range(1, 40), 200, 400]:
        initials, faults = [draw.choice("uuaas") for _ in range(n)], [draw.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert dialogues.cheapest(initials, bytes(faults)) == settled(initials, faults)
    assert dialogues.cheapest(["u", "a"] * 100_000, bytes(200_000)) == (0, "K" * 200_000)


def repaired(rows):
    """Verdicts and digests of rows (conv_id, turn, role, text) in plain Python."""
    out = {}
    show = lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in rows}:
        now = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            kind, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            now += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        now.sort(key=key)
        faults, seen = [], set()
        for _, role, text in now:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in now]
        turns = [r[0] for r in now if r[0] is not None]
        cost, audit = settled(initials, faults)
        state, kept, left = "", [], iter(now)
        for letter in audit:
            want = "assistant" if state.endswith("u") else "user"
            if letter == "I":
                kept.append((want, ""))
            else:
                _, role, text = next(left)
                if letter == "D":
                    continue
                kept.append((role if letter == "K" else want, text))
            state += kept[-1][0][:1]
        assert re.fullmatch("(s?(ua)+)?", state)
        sums = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sums)
    return out


def given_back(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in (*dialogues.COUNTS, "audit", "repaired_sha256")) for r in rows}


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert given_back(dialogues.op12_conversation_repair(spark, SF)) == repaired(rows)


def test_repair_of_odd_rows(spark, tmp_path):
    draw = random.Random(4)
    texts = [None, "", " \t", "Yes.", "No!\n", "so", "wait?  ", "a. b", " .", "x" * 5000 + ".", "Ja.\x85", "\x0b\x1c"]
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, *range(9)]), draw.choice([None, "", "user", "user", "assistant", "assistant", "system", "tool", "User"]), draw.choice(texts)) for _ in range(700)]
    rows += [(1000 + i, 0, "user", "Alone.") for i in range(60)] + [(BIG, -(2**40), "user", "Hi."), (BIG, 2**40, "assistant", "Bye.")]
    at = str(tmp_path / "conversations.parquet")
    extra = [(*r, "x", 1) for r in rows]
    spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, audit string, part int").repartition(5).write.parquet(at)
    assert given_back(dialogues.op12_conversation_repair(spark, str(tmp_path))) == repaired(rows)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "e" / "conversations.parquet"))
    assert dialogues.op12_conversation_repair(spark, str(tmp_path / "e")).count() == 0


def test_a_conversation_over_many_batches(spark):
    rows = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text", "false AS dropped")
    judged, after = dialogues.repair(rows)
    assert judged.first()["cost"] == 0 and after.count() == 30_000
    want = hashlib.sha256("\n".join(f"{'ua'[i % 2] == 'u' and 'user' or 'assistant'}:t{i}." for i in range(30_000)).encode()).hexdigest()
    assert [r["repaired_sha256"] for r in dialogues.digests(after).collect()] == [want]


# packing by sums of squares


def whole(text, end=squares.END_ID, _known=[]):  # noqa: B006
    if not _known:
        _known.append(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return np.array([*_known[0].encode(text or "", add_special_tokens=False).ids, end], "<u4")


PARTS = st.lists(st.sampled_from(["Ab", "É", "é", "́", " ", "\n", "\t", "\r\n", " ", " ", "\x1c", "İ", "Σ", "ΑΣ", "ß", "'s", "'S", "n't", "12", "!?", "<|endoftext|>", "<|startoftext|>", "a", "Zß", "ÿ", "&&&", ".", "'", "`", "漢字", "😀", "ﬁ", "한", "ᄒ", "ᅡ", "Leöng", "\x00", "Å", "​"]), max_size=12)


@given(PARTS.map("".join) | st.text(max_size=30))
@settings(max_examples=400, deadline=None)
def test_ids_of_stretches_are_ids_of_the_text(text):
    assert squares.words().ids(text).tolist() == whole(text)[:-1].tolist()


def test_places_like_the_rule():
    draw = np.random.default_rng(3)
    lengths = np.r_[draw.integers(1, 61, 300), np.full(20, 60)]
    sequence, offset = squares.sum_of_squares(lengths, 60)
    used = {}
    for i in np.argsort(-lengths, kind="stable"):
        size, gaps = lengths[i], [60 - u for u in used.values()]
        square = lambda g: sum(g.count(k) ** 2 for k in set(g) if k)
        costs = {None: square([*gaps, 60 - size])} | {g: square([*(x for n, x in enumerate(gaps) if n != gaps.index(g)), g - size]) for g in set(gaps) if g >= size}
        mine = 60 - used[sequence[i]] if sequence[i] in used else None
        assert costs[mine] == min(costs.values()) and offset[i] == used.get(sequence[i], 0)
        used[sequence[i]] = used.get(sequence[i], 0) + size
    assert max(used.values()) <= 60


def checked(rows, texts, window):
    """Pieces cover each document once, in order, with the right checksums; sequences have no gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        ids, at = whole(texts[doc]), 0
        assert len(pieces) == -(-len(ids) // window)
        for k, r in enumerate(pieces):
            part = ids[at : at + window]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, at, len(part), zlib.crc32(part.tobytes()))
            at += len(part)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    total = sum(r["length"] for r in rows)
    return len(by_sequence), -(-total // window)


def test_packing_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    made, least = checked(squares.op13_squares_packing(spark, SF).collect(), texts, 4096)
    assert made <= 1.02 * least + 2


def test_packing_of_odd_rows(spark):
    shape = "doc_id long, text string, piece string, offset int"
    texts = {1: None, 2: "", 3: "word " * 700, BIG: "<|endoftext|> x", 5: "x" * 9000}
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in texts.items()], shape)
    checked(squares.pack(df, window=50).collect(), texts, 50)
    assert squares.pack(spark.createDataFrame([], shape)).count() == 0
    same = spark.createDataFrame([(None, "a b", "", 0)] * 300, shape).repartition(4)
    rows = squares.pack(same, window=30, group_tokens=90).collect()
    assert len(rows) == 300 and {r["doc_id"] for r in rows} == {None}
    groups = [r["sequence_id"] >> squares.FIRST for r in rows]
    assert len(set(groups)) > 5 and max(map(groups.count, groups)) < 90
