import random
import re
import sys

import numpy as np
import xxhash

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import docs_df, empty_docs, odd_texts, sentence  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from softgrove.llm import simhash as sh  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """doc_id -> (fingerprint, smallest id reachable)."""
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, f"{fps[k]:016x}", low.get(find(k))) for k, (i, _) in enumerate(rows)]


def near_texts(n=120):
    rng = random.Random(8)
    texts = odd_texts(rng)
    for _ in range(12):
        base = sentence(rng, rng.randint(60, 300)).split()
        texts.append(" ".join(base))
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    return texts[:n]


def test_groups_match_brute_force(spark):
    texts = near_texts()
    got = sorted(map(tuple, sh.near_duplicates(docs_df(spark, texts).repartition(5)).collect()))
    assert got == sorted(brute(list(enumerate(texts))))
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got}) < len(got)


def test_hot_buckets_are_split_without_losing_links(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2 ** 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (300, 3))} | {int(x) for x in rng.integers(0, 2 ** 62, 100)})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {frozenset(x) for x in _sets(fps, [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4])}
    for limit in (sh.BUCKET_LIMIT, 16):
        edges = [tuple(r) for r in sh.links(nodes, bucket_limit=limit).collect()]
        assert all(bin(a ^ b).count("1") <= 4 * len(fps) for a, b in edges)
        assert {frozenset(x) for x in _sets(fps, edges)} == want


def _sets(nodes, edges):
    own = {n: {n} for n in nodes}
    for a, b in edges:
        if own[a] is not own[b]:
            own[a] |= own[b]
            for x in own[b]:
                own[x] = own[a]
    return {id(s): s for s in own.values()}.values()


def test_more_tables_give_the_same_links():
    rng = random.Random(1)
    for n, chosen in ((10, 1), (1 << 21, 2), (1 << 27, 3), (1 << 32, 4)):
        masks = [m % (1 << 64) for m in sh._tables(n, 4)]
        for _ in range(50):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(diff & m == 0 for m in masks), chosen


def test_pairs_of_bit_planes_match_counting():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2 ** 63, 30, dtype=np.uint64)
    fp = np.concatenate([fp, *(fp ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(6))])
    start, side = np.array([0, 100]), np.zeros(len(fp), dtype=np.int64)
    side[160:] = 1
    got = {(int(a), int(b)) for x, y in sh.linked_pairs(fp, start, side) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if (i < 100) == (j < 100)
            and (j < 100 or (i < 160 <= j)) and int(np.bitwise_count(fp[i] ^ fp[j])) <= 4}
    assert got == want


def test_null_ids_repeated_rows_and_empty_tables(spark):
    assert sh.near_duplicates(empty_docs(spark)).collect() == []
    assert sh.keep_first(empty_docs(spark)).collect() == []
    rows = [(None, "a b c d e"), (3, "a b c d e"), (2, "q r s t u"), (2, "q r s t u"), (None, "v w x y z"), (5, None), (6, ""), (9, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, sh.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    kept = sorted(((r.doc_id, r.text) for r in sh.keep_first(df).collect()), key=str)
    assert kept == [(2, "q r s t u"), (3, "a b c d e"), (5, None), (None, "v w x y z")]


def test_keep_first_keeps_columns_with_clashing_names(spark):
    texts = near_texts(60)
    df = docs_df(spark, texts)
    for c in ("_fp", "fp", "component_id", "_id", "root", "_rank"):
        df = df.withColumn(c, F.lit(c))
    got = sh.keep_first(df)
    assert got.columns == df.columns
    want = {i for i, _, c in brute(list(enumerate(texts))) if i == c}
    assert {r.doc_id for r in got.collect()} == want


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in sh.components(edges).collect()}
    assert {k: got[k] for k in range(1, 60)} == dict.fromkeys(range(1, 60), 0) and got[101] == 100
