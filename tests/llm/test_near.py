"""Near copies below and above the similarity against brute force, and the tables that stay."""

import random

import pytest

from tidewatch.llm import common, exact, jaccard
from tidewatch.sources.files import shared_folder, store


def variants(seed, n, edits):
    """n texts made from two bases with shared words, each with up to so many words replaced, some of them cut short."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(90)]
    bases = [base, base[:60] + [f"v{i}" for i in range(40)]]
    out = []
    for _ in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(40)}"
        out.append(" ".join(words[: draw.choice([len(words), len(words) - draw.randrange(20)])]))
    return out


def least_ids(texts, k, percent):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("seed,edits,k,percent", [(1, 6, 5, 80), (2, 4, 4, 85)])
def test_variants(spark, seed, edits, k, percent):
    texts = variants(seed, 250, edits)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, percent)
    want = least_ids(texts, k, percent)
    assert 1 < len(set(want.values())) < len(texts)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def folders(spark):
    fs, at = store(spark, shared_folder(spark))
    return {s.getPath().getName() for s in fs.listStatus(at)}


@pytest.mark.parametrize("drop", [jaccard.drop_near, exact.drop_exact])
def test_what_stays(spark, tmp_path, drop):
    spark.createDataFrame([(i, t) for i, t in enumerate(variants(5, 40, 3) * 2)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    before = folders(spark)
    left = drop(spark.read.parquet(f"{tmp_path}/d"))
    assert [n.split("-")[0] for n in folders(spark) - before] == ["gone"]
    assert 0 < left.count() < 80


def test_scratch_after_a_failure(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), common.scratch(spark) as keep:
        common.stash(spark.range(3), "lost")
        keep(spark.range(2), "kept")
        raise ZeroDivisionError
    assert [n.split("-")[0] for n in folders(spark) - before] == ["kept"]
    assert not common._open.scopes


@pytest.mark.parametrize("seed,edits,k,percent,before", [(1, 6, 5, 80, 8), (2, 4, 4, 85, 1), (7, 7, 5, 80, 0)])
def test_odd_members(spark, monkeypatch, seed, edits, k, percent, before):
    turns = []
    to_hubs = jaccard._to_hubs
    monkeypatch.setattr(jaccard, "_to_hubs", lambda *a: turns.append(a[2]) or to_hubs(*a))
    for name, value in {"SALT_ROWS": 2, "HUBS": 2, "NEAREST": 2, "BEFORE": before}.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = variants(seed, 250, edits)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == least_ids(texts, k, percent)
    assert turns


def joined_rows(spark, words):
    """Rows that joins have made whose plan has these words, over all queries of the session."""
    store, out = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        metrics, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and all(w in node.desc() for w in words):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    value = metrics.get(m.accumulatorId())
                    if m.name() == "number of output rows" and value.isDefined():
                        out += int(value.get().replace(",", ""))
    return out


def test_pairs_grow_with_members(spark):
    """A shingle's members outside its largest component meet few others, and not again at each shingle that they share."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(600):
        words = list(base)
        for at in draw.sample(range(150), 2 if i < 300 else 1):  # the first half links with the second alone
            words[at] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    before = joined_rows(spark, ["salt", "token"])
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == least_ids(texts, 5, 80)
    made = joined_rows(spark, ["salt", "token"]) - before
    assert 0 < made < 150 * len(texts), made
