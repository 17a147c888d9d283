"""Language ID: a linear-chain conditional random field labels the words of a text, which may switch between languages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .hashing import mix

#: documents that the model is fitted on, at most; hashed features; sweeps over the sample; words whose scores a task remembers
SAMPLE, FEATURE_BITS, SWEEPS, RATE, REMEMBERED = 400, 16, 3, 0.5, 300_000
#: characters of a text that the model is fitted on, at most
LONGEST = 20_000
#: the first rows of a language meet from so many groups of partitions
LEAVES = 64
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in small letters. What `re` takes for word characters holds numbers such as ½ and Ⅷ too;
    they part words."""
    words = WORD.findall(text.lower()) if text else []
    if "".join(words).isalpha():
        return words
    return [w for x in words for w in "".join(c if c.isalpha() else " " for c in x).split()]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, slot) of every feature of these words: prefixes and suffixes of two to four characters, all
    character pairs and triples, and the entry in the lexicon. Word ends count as characters."""
    n = len(words)
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, n) + 2
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(n), size)
    pad = np.r_[c, np.zeros(3, np.uint64)]
    a, b, d, e = (np.uint64(x) for x in (0x9E3779B1, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xC2B2AE3D27D4EB4F))
    two = pad[:-3] * a + pad[1:-2] * b
    three = two + pad[2:-1] * d
    pairs, triples = np.flatnonzero(np.arange(len(c)) + 1 < end[owner]), np.flatnonzero(np.arange(len(c)) + 2 < end[owner])
    each = np.arange(n)
    found = [(owner[pairs], two[pairs]), (owner[triples], three[triples]), (each, two[start]), (each, three[start]), (each, three[start] + pad[np.minimum(start + 3, end - 1)] * e)]
    found += [(each, two[end - 2]), (each, three[end - 3]), (each, three[np.maximum(end - 4, start)] + pad[end - 1] * e)]
    known = np.array([i for i, w in enumerate(words) if w in lexicon], np.int64)
    found.append((known, np.array([lexicon[words[i]] for i in known], np.uint64)))
    slots = [(mix(h + np.uint64(k << 56)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) for k, (_, h) in enumerate(found)]
    return np.concatenate([w for w, _ in found]), np.concatenate(slots)


class Crf:
    """Weights of features by label, of label pairs, and the lexicon: frequent words and the label they mostly have."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.moves, self.first = np.zeros((1 << FEATURE_BITS, n)), np.zeros((n, n)), np.zeros(n)
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, n))

    def scores(self, owner: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, self.weights[slot, c], n) for c in range(len(self.labels))], axis=1)

    def emissions(self, texts: list[list[str]]) -> list[np.ndarray]:
        """A score for each word of each text and each label. A word is scored once while it is remembered."""
        if len(self.row) > REMEMBERED:
            self.row, self.table = {}, self.table[:0]
        fresh = list(dict.fromkeys(w for t in texts for w in t if w not in self.row))
        if fresh:
            self.table = np.concatenate([self.table, self.scores(*features(fresh, self.lexicon), len(fresh))])
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh))))
        get = self.row.__getitem__
        return [self.table[np.fromiter(map(get, t), np.int64, len(t))] for t in texts]

    def marginals(self, texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Forward-backward over many texts side by side: each word's probability of each label, and the expected number of
        each move between labels."""
        n, order = len(self.labels), sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        out, moved = [np.zeros((0, n))] * len(texts), np.zeros((n, n))
        order = [i for i in order if len(texts[i])]
        if not order:
            return out, moved
        length = np.array([len(texts[i]) for i in order])
        most, rows = length[0], len(order)
        e = np.zeros((most, rows, n))
        for r, i in enumerate(order):
            x = texts[i]
            e[: len(x), r] = np.exp(np.clip(x - x.max(1, keepdims=True), -60, 0))
        move = np.exp(np.clip(self.moves, -60, 60))
        alpha, beta, live = np.zeros_like(e), np.ones_like(e), np.searchsorted(-length, -np.arange(1, most + 1), "right")
        alpha[0] = e[0] * np.exp(self.first)
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for t in range(1, most):
            a = (alpha[t - 1, : live[t]] @ move) * e[t, : live[t]] + 1e-300
            alpha[t, : live[t]] = a / a.sum(1, keepdims=True)
        for t in range(most - 2, -1, -1):
            k = live[t + 1]
            b = (e[t + 1, :k] * beta[t + 1, :k]) @ move.T + 1e-300
            beta[t, :k] = b / b.sum(1, keepdims=True)
            pair = alpha[t, :k, :, None] * move * (e[t + 1, :k] * beta[t + 1, :k])[:, None, :]
            moved += (pair / (pair.sum((1, 2), keepdims=True) + 1e-300)).sum(0)
        p = alpha * beta
        p /= p.sum(2, keepdims=True) + 1e-300
        for r, i in enumerate(order):
            out[i] = p[: len(texts[i]), r]
        return out, moved

    def fit(self, texts: list[list[str]], labels: list[np.ndarray], sweeps: int = SWEEPS, rate: float = RATE, batch: int = 32) -> Crf:
        """Gradient ascent on the likelihood of the label sequences, with a step of its own for each weight (AdaGrad)."""
        n, words = len(self.labels), list(dict.fromkeys(w for t in texts for w in t))
        number = {w: i for i, w in enumerate(words)}
        owner, slot = features(words, self.lexicon)
        ids = [np.array([number[w] for w in t], np.int64) for t in texts]
        square, square_moves, square_first = (np.full_like(x, 1e-6) for x in (self.weights, self.moves, self.first))
        draw = np.random.default_rng(7)
        for _ in range(sweeps):
            at = draw.permutation(len(texts))
            for lo in range(0, len(at), batch):
                some = [i for i in at[lo : lo + batch] if len(ids[i])]
                score = self.scores(owner, slot, len(words))
                p, moved = self.marginals([score[ids[i]] for i in some])
                miss, grad_moves, grad_first = np.zeros((len(words), n)), -moved, np.zeros(n)
                for i, q in zip(some, p):
                    np.add.at(miss, ids[i], np.eye(n)[labels[i]] - q)
                    grad_first += np.eye(n)[labels[i][0]] - q[0]
                    np.add.at(grad_moves, (labels[i][:-1], labels[i][1:]), 1)
                grad = np.stack([np.bincount(slot, miss[owner, c], len(self.weights)) for c in range(n)], axis=1)
                for value, g, s in ((self.weights, grad, square), (self.moves, grad_moves, square_moves), (self.first, grad_first, square_first)):
                    g /= max(1, len(some))
                    s += g * g
                    value += rate * 0.2 * g / np.sqrt(s)
        return self


def train(labelled: list[tuple[str, str]]) -> Crf:
    """A model of whole labelled texts. Pieces of texts in different languages are put side by side, so that the model also
    learns what a switch looks like."""
    names = sorted({lang for _, lang in labelled})
    number = {x: i for i, x in enumerate(names)}
    counts: dict[str, np.ndarray] = {}
    texts = [(words_of(t), number[lang]) for t, lang in labelled]
    for words, i in texts:
        for w in words:
            counts.setdefault(w, np.zeros(len(names)))[i] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 20 and c.max() >= 0.9 * c.sum()}
    sequences, labels = [], []
    for k, (words, i) in enumerate(texts):
        other, j = texts[(k * 7 + 3) % len(texts)]
        cut = len(other) // 8
        sequences.append(words + other[:cut])
        labels.append(np.array([i] * len(words) + [j] * cut, int))
    return Crf(names, lexicon).fit(sequences, labels)


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts, from the documents that are not held out: in turn one of each language, by a hash,
    so that every language with such a text is learned. Texts of 200 characters come first, shorter ones where a language
    lacks them. A text without letters teaches nothing; of a long one the first LONGEST characters are used. There are
    `sample` rows, or one for each language if there are more languages."""
    some = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(~held_out()).filter(F.col("text").rlike(r"\p{L}"))
    some = some.withColumn("key", F.xxhash64("doc_id", F.xxhash64("text")))
    order = ["short", F.xxhash64("doc_id"), "key"]
    # first within groups of partitions: what meets in one task for a language is LEAVES * sample small rows, whatever the input
    keys = some.select("lang", "key", "doc_id", (F.length("text") < 200).alias("short"), (F.spark_partition_id() % LEAVES).alias("leaf"))
    for by in (["lang", "leaf"], ["lang"]):
        keys = keys.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("turn") <= sample)
    first = keys.orderBy("turn", F.xxhash64("doc_id"), "key", "lang").select("key", "lang", "turn")
    picked = first.limit(sample).collect()
    if picked and picked[-1]["turn"] == 1:  # as many languages as rows, or more
        picked = first.filter("turn = 1").collect()
    chosen = {(r["key"], r["lang"]) for r in picked}
    rows = some.filter(F.col("key").isin([k for k, _ in chosen])).select("key", F.substring("text", 1, LONGEST).alias("text"), "lang").dropDuplicates(["key", "lang"]).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["key"], r["lang"])) if (r["key"], r["lang"]) in chosen]


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, n_words, n_switches.

    Every word of the whole text gets a probability of each language; the text's language is the one with the largest sum,
    and score its share. A null or empty text, or one without a letter, is `und` with score 0. Repeated rows are each
    labelled, null doc_ids allowed. An empty table gives an empty result; only the text is looked at. A model that has
    learned no language says `und` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crf, texts = shared.value, batch.column("text").to_pylist()
            for at, probabilities in by_size(crf, texts):
                out = []
                for p in probabilities:
                    if not len(p):
                        out.append((UNKNOWN, 0.0, 0, 0))
                        continue
                    mean, best = p.mean(0), p.argmax(1)
                    top = int(mean.argmax())
                    sure = float(min(1.0, mean[top])) if crf.labels[top] != UNKNOWN else 0.0
                    out.append((crf.labels[top], sure, len(p), int((best[1:] != best[:-1]).sum())))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *columns], ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    return docs.select("doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double, n_words long, n_switches long")


def by_size(crf: Crf, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Places of texts of like length, and each one's probabilities: a bounded number of words at a time, or one text."""
    size = np.array([len(t or "") for t in texts], np.int64)
    order = np.argsort(size, kind="stable")
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and end - begin < 512 and (end - begin + 1) * size[order[end]] < 1_500_000:
            end += 1
        yield order[begin:end], crf.marginals(crf.emissions([words_of(texts[i]) for i in order[begin:end]]))[0]
        begin = end


def learned(docs: DataFrame, sample: int = SAMPLE) -> Crf:
    rows = training_rows(docs, sample)
    return train(rows) if rows else Crf([UNKNOWN], {})


def certain(crf: Crf, texts: list[str | None], least: float) -> np.ndarray:
    """Whether each text has words and the mean of each word's largest probability is `least` at least. A model that has learned
    no language rejects no text with words."""
    good = np.zeros(len(texts), bool)
    for at, probabilities in by_size(crf, texts):
        good[at] = [len(p) > 0 and (crf.labels == [UNKNOWN] or p.max(1).mean() >= least) for p in probabilities]
    return good


def drop_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, whose words are told with certainty: the mean of each word's largest probability is
    `least` at least, in however many languages the text is. Texts without letters go. Each row is decided by its own text,
    whatever its doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(certain(shared.value, batch.column("text").to_pylist(), least)))

    return docs.mapInArrow(keep, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, learned(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
