import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import DOCS, WORDS, docs_df, empty_docs, odd_texts, sentence  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from softgrove.llm import katz  # noqa: E402
from softgrove.llm import toxicity as tx  # noqa: E402

SF = "/root/testdata/sf0.01"


def distance(a, b):
    """Edits with exchanged neighbours (each stretch edited once)."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def nearest(word, terms):
    best = []
    for k, (t, stem) in enumerate(terms):
        texts = [word[:n] for n in range(len(word) + 1)] if stem else [word]
        e = min(distance(t, x) for x in texts)
        if e <= tx.edits_allowed(t):
            best.append((e, k))
    return min(best, default=None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.booleans()), max_size=5, unique=True), st.lists(st.text("abcd", max_size=11), max_size=15))
def test_automaton_gives_the_nearest_term(terms, words):
    a = tx.Automaton(terms)
    for w in words:
        got, want = a.match(w), nearest(w, terms)
        assert (got is None) == (want is None) and (got is None or got[0] == want[0])


def toxic_corpus(spark, rng, n=300):
    bad = ["blockhead", "vermin", "nitwit"]
    texts, toxic = [], []
    for _ in range(n):
        own = [w for w in sentence(rng, 40).split() if w != "word"]
        hit = rng.random() < 0.2
        if hit:
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        texts.append(" ".join(own))
        toxic.append(int(hit))
    docs = docs_df(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)) + [(5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    return docs, labels


def test_misspellings_and_quotations(spark):
    rng = random.Random(3)
    docs, labels = toxic_corpus(spark, rng)
    model = tx.learn(tx.sample_of(docs, labels))
    assert {t for t, _ in model.terms} == {"blockhead", "vermin", "nitwit"}
    clean = sentence(rng, 50, [w for w in WORDS if w != "word"])
    texts = {"plain": clean, "exact": clean + " you vermin", "caps": "BLOCKHEAD " + clean, "typo": clean + " blockhaed", "typo2": clean + " verm1n " + clean,
             "quoted": clean + ' "vermin" ' + clean, "reported": clean + " he wrote nitwit of the", "both": clean + ' "vermin" you vermin', "none": "", "null": None,
             "long": clean * 200 + " nitwit " + clean * 200}
    df = spark.createDataFrame([(k, t, 1.0) for k, t in texts.items()], "doc_id string, text string, score double")
    got = {r.doc_id: r.score >= tx.THRESHOLD for r in tx.score(df, model, keep=["doc_id"]).collect()}
    assert got == {"plain": False, "exact": True, "caps": True, "typo": True, "typo2": True, "quoted": False, "reported": False, "both": True, "none": False,
                   "null": False, "long": True}


def test_learning_without_labels_or_rows(spark):
    docs, labels = toxic_corpus(spark, random.Random(1), 20)
    assert tx.learn(tx.sample_of(docs, labels.limit(0))).terms == []
    assert tx.learn(tx.sample_of(empty_docs(spark), labels)).terms == []
    model = tx.learn(tx.sample_of(docs, labels.withColumn("toxic", F.lit(0))))
    assert {r.score for r in tx.score(docs_df(spark, odd_texts(random.Random(1))), model).collect()} == {0.0}
    assert tx.score(empty_docs(spark), model).collect() == []


def test_held_out_accuracy(spark):
    from softgrove.llm.queries import op9_toxicity
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op9_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    out = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    hit = sum(t and p for t, p in out)
    assert hit > 0.85 * sum(t for t, _ in out) and hit > 0.8 * sum(p for _, p in out)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Brute:
    """The model of small corpora, in dictionaries."""

    def __init__(self, rows):
        self.uni, self.bi, self.hist = Counter(), Counter(), Counter()
        for text, train in rows:
            before = 0
            for w in self.tokens(text) if train else ():
                self.uni[w] += 1
                self.bi[before, w] += 1
                self.hist[before] += 1
                before = w
        self.n = sum(self.uni.values())
        sizes = [np.bincount(np.minimum(list(c.values()) or [0], katz.K + 2), minlength=katz.K + 3) for c in (self.bi, self.uni)]
        for s in sizes:
            s[0] = 0
        self.off = [katz.good_turing(s) for s in sizes]
        self.p = {w: self.less(c, 1) / self.n for w, c in self.uni.items()}
        self.unknown = sum(c - self.less(c, 1) for c in self.uni.values()) / self.n if self.n else 1.0
        kept, seen = defaultdict(float), defaultdict(float)
        for (h, w), c in self.bi.items():
            kept[h] += self.less(c, 0)
            seen[h] += self.p[w]
        self.a = {h: (1 - kept[h] / c) / (1 - seen[h]) for h, c in self.hist.items()}

    @staticmethod
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), 1]

    def less(self, c, k):
        return c - self.off[k][min(c, katz.K + 1)]

    def prob(self, h, w):
        c = self.bi.get((h, w), 0)
        return self.less(c, 0) / self.hist[h] if c else self.a.get(h, 1.0) * self.p.get(w, self.unknown)

    def score(self, text):
        before, base, score, known = 0, 0.0, 0.0, 0
        for w in self.tokens(text):
            base += math.log10((self.uni[w] + 1) / (self.n + len(self.uni) + 1))
            score += math.log10(self.prob(before, w))
            known += w in self.uni
            before = w
        return len(self.tokens(text)), known, self.n, base, score


def check_scores(spark, rows, monkeypatch=None, parts=None):
    df = spark.createDataFrame([(k, t, tr, 1, 2) for k, (t, tr) in enumerate(rows)], "doc_id long, text string, tr boolean, train int, score int")
    got = {r.doc_id: r for r in katz.score_corpus(df.repartition(3), F.col("tr")).collect()}
    model = Brute(rows)
    assert len(got) == len(rows)
    for k, (t, tr) in enumerate(rows):
        r, want = got[k], model.score(t)
        assert r.train == bool(tr)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert math.isclose(r.base_score, want[3], abs_tol=1e-9) and math.isclose(r.score, want[4], rel_tol=1e-9, abs_tol=1e-9)
    return model


def test_scores_match_brute_force(spark):
    rng = random.Random(12)
    texts = [*odd_texts(rng), *(sentence(rng, rng.randint(1, 80)) for _ in range(120)), *(f"rare{k} {sentence(rng, 4)}" for k in range(60))]
    model = check_scores(spark, [(t, rng.random() < 0.8 or None) for t in texts])
    words = [*model.uni, "never-seen"]
    for h in [*list(model.hist)[:20], "never-seen"]:
        assert math.isclose(sum(model.prob(h, w) for w in words), 1.0, rel_tol=1e-9)


def test_hot_words_and_small_units(spark, monkeypatch):
    monkeypatch.setattr(katz, "UNIT_BYTES", 2000)
    monkeypatch.setattr(katz, "PART_BYTES", 3000)
    rng = random.Random(13)
    texts = [sentence(rng, 60, ["the"] * 30 + ["a", "b", "c", "d"] + [f"w{k}" for k in range(200)]) for _ in range(150)]
    check_scores(spark, [(t, k % 3 > 0) for k, t in enumerate(texts)])


def test_tiny_corpora(spark):
    check_scores(spark, [("a b a", False), (None, False)])
    check_scores(spark, [("a", True), ("b", None), ("", False)])
    check_scores(spark, [(None, True), ("x y", False)])
    assert katz.score_corpus(empty_docs(spark), F.lit(True)).collect() == []
    rows = spark.createDataFrame([(None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (4, None, None, None, None)], DOCS)
    got = katz.score_corpus(rows, F.col("doc_id").isNull()).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3] and sum(r.doc_id is None for r in got) == 2


def test_good_turing_discounts():
    off = katz.good_turing(np.array([0, 1000, 400, 200, 120, 80, 60, 40]))
    assert off[0] == 0 and (off[1:] > 0).all() and (off[1:6] < np.arange(1, 6)).all()
    assert katz.good_turing(np.zeros(8)).tolist() == [0, *[0.5] * 6]


def test_query_beats_its_base_on_held_out_texts(spark):
    from softgrove.llm.queries import op4_katz
    out = op4_katz(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.max("train_tokens")).first()
    assert out[0] > 0.75 * out[1] and out[2] > 100_000


def test_scores_do_not_depend_on_arrow_batches(spark, monkeypatch):
    """Units are cut by bytes, also where batches of rows end within them."""
    monkeypatch.setattr(katz, "UNIT_BYTES", 3000)
    monkeypatch.setattr(katz, "PART_BYTES", 3000)
    rng = random.Random(14)
    rows = [(t, k % 4 > 0) for k, t in enumerate([*odd_texts(rng), *(sentence(rng, rng.randint(1, 60)) for _ in range(200))])]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (7, 1000, 10_000):
            spark.conf.set(size, n)
            check_scores(spark, rows)
    finally:
        spark.conf.set(size, before)


def test_units_are_cut_by_bytes():
    import pyarrow as pa
    texts = ["a" * n for n in (5, 0, 3, 30, 2, 2, 9, 1, 1, 12, 0)] + [None]
    table = pa.table({"text": texts})
    want = None
    for size in (1, 2, 5, 100):
        got = [t.column("text").to_pylist() for t in katz._cuts(table.to_batches(max_chunksize=size), 10)]
        assert sum(got, []) == texts
        want = want or got
        assert got == want
    assert max(sum(len(t or "") for t in g) for g in want if len(g) > 1) <= 10
