import random
import re
import sys

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import docs_df, empty_docs, odd_texts, sentence  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from softgrove.llm import minhash_join as mh  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    """(doc_id, set size, smallest id reachable, kept) of each row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, len(sets[k]), low.get(find(k)), i == low.get(find(k))) for k, (i, _) in enumerate(rows)]


def near_texts(changes=(0, 6)):
    """Odd texts, copies, and texts that differ from a base by few words:
    similar enough, nearly so, and in chains."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = odd_texts(rng) + ["a b", "a b", "a b c d e", "b a"]
    for _ in range(10):
        base = sentence(rng, rng.randint(30, 200), words).split()
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(10):
            own = list(base)
            for _ in range(rng.randint(*changes)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
            if rng.random() < 0.3:
                base = own
    rng.shuffle(texts)
    return texts


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_components_match_brute_force(spark):
    texts = near_texts()
    got = rows_of(mh.near_duplicates(docs_df(spark, texts)))
    assert got == sorted(brute(list(enumerate(texts))), key=str)
    assert sum(not r[3] for r in got) > 40


def test_long_lists_are_dealt_out(spark):
    """Lists in parts of three members, clusters in parts of four, give the same."""
    texts = near_texts((3, 12))
    got = rows_of(mh.near_duplicates(docs_df(spark, texts), list_limit=3, cluster_limit=4))
    assert got == sorted(brute(list(enumerate(texts))), key=str)


def test_many_copies_and_a_shared_passage(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(500)]
    passage = sentence(rng, 30, words)
    texts = ["same text as all of these others are"] * 90 + [passage + " " + sentence(rng, 60, words) for _ in range(60)]
    base = sentence(rng, 120, words).split()
    for k in range(60):
        own = list(base)
        own[k] = "new"
        texts.append(" ".join(own))
    got = rows_of(mh.near_duplicates(docs_df(spark, texts)))
    assert got == sorted(brute(list(enumerate(texts))), key=str)
    assert sum(r[3] for r in got) == 62


def test_nulls_repeated_ids_extra_columns(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (1, "other words in this one"), (None, None), (2, ""), (2, "x"),
            (None, "alone"), (None, "words of a pair without ids one two"), (None, "words of a pair without ids one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "token", "n", "key", "Root", "count")})
    got = rows_of(mh.near_duplicates(df))
    assert got == sorted(brute(rows), key=str)
    named = df.withColumnsRenamed({"doc_id": "the id", "text": "a.b"})
    assert rows_of(mh.near_duplicates(named, "the id", "a.b")) == got


def test_empty_table(spark):
    assert mh.near_duplicates(empty_docs(spark)).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = mh.signatures([np.unique(x[:900]), np.unique(x[100:])])
    assert abs((a == b).mean() - 0.8) < 0.2
    assert (a & np.uint64(63) == np.arange(64, dtype=np.uint64)).all()
