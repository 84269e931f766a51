import hashlib
import random
import re
import sys

from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import DOCS, docs_df, empty_docs, odd_texts, sentence  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from softgrove.llm import decontaminate as dc  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts, items, window=10):
    pats = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if n else ():
            pats.setdefault(tuple(w[a:a + n]), set()).add(item)
    sizes = {len(p) for p in pats}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                own = pats.get(tuple(w[a:a + n]))
                if own:
                    hit |= set(range(a, a + n))
                    found |= {str(i) for i in own if i is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def run(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(docs, bench, keep=["doc_id"], **options).collect()
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got}


def fixture():
    rng = random.Random(5)
    items = [(k, sentence(rng, n)) for k, n in enumerate((30, 12, 10, 10, 3, 1, 25))]
    items += [(7, None), (8, ""), (9, "--- ,,"), (None, sentence(rng, 14)), (2, items[2][1]), (10, "ÉTÉ 漢字 zebra")]
    texts = odd_texts(rng)
    for k in range(30):
        base = sentence(rng, rng.randint(0, 60)).split()
        src = words(rng.choice(items)[1])
        a = rng.randint(0, max(0, len(src) - 3))
        cut = src[a:a + rng.randint(1, 30)]
        at = rng.randint(0, len(base))
        texts.append(" ".join(base[:at]) + " " + ", ".join(c.upper() if k % 2 else c for c in cut) + ". " + " ".join(base[at:]))
    return texts, items


def test_matches_brute_force(spark):
    texts, items = fixture()
    got = run(spark, docs_df(spark, texts), items)
    assert [got[k] for k in range(len(texts))] == brute(texts, items)
    assert any(x[1] for x in got.values())


def test_blocks_of_the_benchmark_give_the_same(spark):
    texts, items = fixture()
    docs = docs_df(spark, texts).repartition(3)
    assert run(spark, docs, items, block_bytes=150) == run(spark, docs, items)


def test_empty_tables_and_repeated_rows(spark):
    assert run(spark, empty_docs(spark), [(1, "a b c")]) == {}
    got = run(spark, docs_df(spark, ["a b c", None]), [])
    assert got == {0: (3, 0, []), 1: (0, 0, [])}
    two = docs_df(spark, ["a b c"]).union(docs_df(spark, ["a b c"]))
    bench = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in dc.contamination(two, bench).collect()] == [(3, ["1"])] * 2


def test_drop_keeps_columns_and_clean_rows(spark):
    docs = docs_df(spark, ["b c d", "a b c", None, ""]).withColumn("_dcn_hit", F.lit(7)).withColumn("items", F.lit("x"))
    bench = spark.createDataFrame([(1, "a b c", 5)], "item_id long, text string, n_hit int")
    got = dc.drop_contaminated(docs, bench)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 3]
    assert got.schema.fields[:5] == DOCS.fields


def test_query_matches_brute_force_and_digest(spark):
    from softgrove.llm.queries import op1_decontaminate
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([d.text for d in docs], items)
    got = {r.doc_id: r for r in op1_decontaminate(spark, sf).collect()}
    for d, (n, hit, found) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=25), max_size=4), st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=4),
       st.integers(1, 6))
def test_matcher_on_few_words(texts, items, window):
    import pyarrow as pa
    texts, items = [" ".join(t) for t in texts], [(str(k), " ".join(t)) for k, t in enumerate(items)]
    w = dc.Words(pa.array(texts, pa.string()))
    n_hit, found, _ = dc.Matcher(items, window).scan(w, [None] * len(texts), [None] * len(texts))
    assert [(int(n), f) for n, f in zip(n_hit, found)] == [x[1:] for x in brute(texts, items, window)]
