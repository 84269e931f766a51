import math
import random
import re
import sys
from collections import Counter

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import WORDS, docs_df, empty_docs, odd_texts, sentence  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from softgrove.llm import lexical_search as ls  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        query, found = terms(text), []
        for i, w in words:
            tf, m, score = Counter(w), 75 + (25 * len(w) * n_docs) // n_terms, 0
            for t in query:
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, f[2], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(4)
    words = WORDS + [f"t{k}" for k in range(150)]
    docs = odd_texts(rng) + [sentence(rng, rng.choice((3, 12, 40, 300)), words[:rng.randint(5, 180)]) for _ in range(300)]
    items = [(k, sentence(rng, rng.randint(1, 25), words)) for k in range(30)] + [(30, "THE the The zzz"), (31, None), (32, ""), (33, "漢字 É unseen"), (34, "-. ")]
    return docs, items


def items_df(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_ranking_matches_brute_force(spark):
    docs, items = corpus()
    want = brute(list(enumerate(docs)), items)
    df = docs_df(spark, docs)
    assert rows_of(ls.search(df, items_df(spark, items))) == want
    # many shards, blocks and blocks of queries
    assert rows_of(ls.search(df.repartition(5), items_df(spark, items), shard_bytes=4000, block=7, query_bytes=600)) == want


def test_fewer_than_k_and_ties(spark):
    docs = ["same words"] * 30 + ["same", "words words"]
    items = [(1, "same"), (2, "words"), (2, "words"), (3, "none")]
    got = rows_of(ls.search(docs_df(spark, docs).repartition(4), items_df(spark, items)))
    assert got == brute(list(enumerate(docs)), items)
    assert rows_of(ls.search(docs_df(spark, docs), items_df(spark, items), k=3)) == brute(list(enumerate(docs)), items, 3)


def test_null_and_repeated_ids_extra_columns(spark):
    rows = [(None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (2, "alpha"), (None, None), (3, "gamma")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("query", "score", "Rank", "term")})
    items = [(1, "alpha alpha gamma"), (None, "beta")]
    want = brute(rows, items)
    assert rows_of(ls.search(df, items_df(spark, items).withColumn("score", F.lit(2)))) == want
    named = df.withColumnsRenamed({"doc_id": "the id", "text": "a.b"})
    assert rows_of(ls.search(named, items_df(spark, items), id_col="the id", text_col="a.b")) == want


def test_empty_tables(spark):
    assert ls.search(empty_docs(spark), items_df(spark, [(1, "a")])).collect() == []
    assert ls.search(docs_df(spark, ["a"]), items_df(spark, [])).collect() == []
    assert ls.search(docs_df(spark, [None, ""]), items_df(spark, [(1, "a")])).collect() == []


def test_wide_gaps_and_frequencies_come_back():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 9, 3000)
    doc = np.sort(rng.choice(3000, 400, replace=False))
    tf = np.where(rng.random(400) < 0.01, 70_000, 1)
    s = ls.build_shard(n, np.concatenate((doc, [2999])), np.concatenate((np.zeros(400, int), [4])), np.concatenate((tf, [2])), 2048)
    shard = ls.Shard({k: v.tobytes() for k, v in s.items()}, 3000, int(n.sum()))
    got = [shard.unpack(k) for k in range(shard.first[0], shard.first[1])]
    assert np.array_equal(np.concatenate([p + 2048 * shard.block[k] for k, (p, _) in enumerate(got)]), doc)
    assert np.array_equal(np.concatenate([t for _, t in got]), tf)
    assert list(shard.lists(np.array([0, 3, 4, 9]))) == [0, -1, 1, -1]


def test_block_maxima_spare_unpacking():
    """A rare term decides; blocks of the frequent one stay packed."""
    n = np.full(20_000, 10)
    doc = np.concatenate((np.arange(20_000), np.arange(30)))
    term = np.concatenate((np.zeros(20_000, int), np.ones(30, int)))
    s = ls.build_shard(n, doc, term, np.ones(20_030, int), 512)
    shard = ls.Shard({k: v.tobytes() for k, v in s.items()}, 20_000, 200_000)
    heap = ls.Heap.empty(20)
    ls.search_shard(shard, np.arange(20_000), np.zeros(20_000, bool), np.array([0, 1]), np.array([10, 5000]), heap, 512)
    assert list(heap.doc) == list(range(20)) and shard.unpacked == 2
