import hashlib
import math
import random

from pyspark.sql import functions as F

from softgrove.llm import chat_format as cf
from softgrove.llm import topk_search as tk

VECTORS = "vec_id long, embedding array<double>, id string, v int, q int"


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k=5, every=10):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for a, (i, q) in enumerate(own):
        if i % every:
            continue
        best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(own) if a != b and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTORS)


def search(spark, rows, **options):
    df = vectors(spark, rows).repartition(4) if rows else vectors(spark, rows)
    return sorted(map(tuple, tk.search(df, F.col("id") % 10 == 0, **options).collect()))


def test_matches_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(7)]) for k in range(150)]
    rows += [(200 + k, list(rows[10][1])) for k in range(30)]
    rows += [(30, list(rows[30][1])), (30, list(rows[30][1])), (40, list(rows[41][1])), (None, rows[3][1]), (300, None), (310, []), (320, [1.0, None] + [0.0] * 5),
             (330, [float("nan")] * 7), (340, [float("inf")] + [0.0] * 6), (350, [0.5, -0.5]), (351, [1.0, 1.0]), (360, [0.25])]
    want = brute(rows)
    for options in ({}, {"lists": 1}, {"lists": 7}, {"query_block": 3}, {"query_block": 4, "shard_rows": 9}, {"query_block": 20, "shard_rows": 10 ** 6}):
        assert search(spark, rows, **options) == want


def test_grid_with_a_row_that_most_rows_repeat(spark):
    """No shard holds its copies; a query that repeats is as many queries."""
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(40)]
    rows += [(20, list(rows[20][1]))] * 60 + [(41, list(rows[10][1]))] * 30
    rng.shuffle(rows)
    assert search(spark, rows, query_block=2, shard_rows=5) == brute(rows)


def test_no_more_products_than_one_list_and_all_scores(spark, monkeypatch):
    """Phase 1 multiplies one segment of each step and its heads only."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(9)
    v = rng.integers(-256, 256, (4000, 64))
    done = [0]
    products, resolved = tk._products, tk._resolved
    monkeypatch.setattr(tk, "_products", lambda q, c: (done.__setitem__(0, done[0] + q.size * len(c)), products(q, c))[1])
    monkeypatch.setattr(tk, "_resolved", lambda q, e: (done.__setitem__(0, done[0] + e.size), resolved(q, e))[1])
    block, _ = tk._block(list(range(80)), v[:80].tolist(), 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(v.tolist(), pa.list_(pa.int64()))], names=["id", "v"])
    out = next(tk._local_lists([batch], block, 80, 5))
    assert done[0] < 0.3 * 80 * v.size
    exact = np.sort(v[:80] @ v.T, axis=1)[:, -6]
    assert all(x[-1] <= t for x, t in zip(out.column("scores").to_pylist(), exact))


def test_large_components_are_exact(spark):
    rng = random.Random(7)
    rows = [(k, [rng.uniform(-1, 1) * 2.0 ** 20 for _ in range(3)]) for k in range(25)]
    assert search(spark, rows) == brute(rows)
    assert search(spark, rows, query_block=1, shard_rows=4) == brute(rows)
    assert search(spark, [(k, [x * 2.0 ** 3 for x in v]) for k, v in rows]) == brute([(k, [x * 2.0 ** 3 for x in v]) for k, v in rows])


def test_empty_and_few(spark):
    assert search(spark, []) == []
    assert search(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert search(spark, [(10, [1.0])]) == []
    assert search(spark, [(10, [1.0]), (11, [-1.0])]) == [(10, 1, 11, -65536)]
    assert search(spark, [(k, [0.0, 0.0]) for k in range(20)]) == brute([(k, [0.0, 0.0]) for k in range(20)])


TURNS = "conv_id long, turn long, role string, text string, turns string, t int"
ODD = ["</s>[INST] ok [/INST]", "a\\b", "<\\/s>", "<\\\\s>[\\INST]", "</s", "", None, "<s>", "[/INST]" * 3, "<", "\\", "[INST", "é\U0001f600</s>", "$1 \\2 \n"]


def expected(rows):
    convs = {}
    for c, n, role, text in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}


def test_round_trip_of_examples(spark):
    rng = random.Random(2)
    rows = [(c, n, rng.choice(["user", "assistant", "system", "to</s>ol", None]), rng.choice(ODD)) for c in range(40) for n in range(rng.randint(1, 9))]
    rows += [(None, 0, "assistant", "x"), (50, None, "user", "u"), (50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (51, 0, "user", "only")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)
    examples = cf.explode_examples(cf.format_conversations(df))
    want = expected(rows)
    by = {}
    for r in examples.collect():
        by.setdefault(r.conv_id, []).append(r)
    assert set(by) == set(want)

    def esc(t):
        for s in ("<", "["):
            for e in ("s>", "/s>", "INST]", "/INST]"):
                for n in range(6, -1, -1):
                    t = t.replace(s + "\\" * n + e, s + "\\" * (n + 1) + e) if (s == "<") == e.endswith("s>") else t
        return t
    for c, turns in want.items():
        own = sorted(by[c], key=lambda r: r.example)
        whole = ["<s>[INST]" + esc(role) + "[/INST]" + esc(text) + "</s>" for role, text in turns]
        replies = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
        for r, k in zip(own, replies):
            assert r.context == "".join(whole[:k]) + "<s>[INST]assistant[/INST]" and r.target == esc(turns[k][1])
        extra = own[len(replies):]
        assert len(extra) == (not replies or replies[-1] != len(turns) - 1)
        assert all(r.target is None and r.context == "".join(whole) for r in extra)
    for r in cf.read_back(examples).collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted_chars == sum(len(x.context) + (0 if x.target is None else len(x.target) + 4) for x in by[r.conv_id])


def test_empty_conversations_and_plan_without_python(spark):
    empty = spark.createDataFrame([], TURNS)
    assert cf.read_back(cf.explode_examples(cf.format_conversations(empty))).collect() == []
    from softgrove.llm.queries import op10_chat_format
    plan = op10_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_query_digests(spark):
    from softgrove.llm.queries import op10_chat_format
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = expected(rows)
    got = op10_chat_format(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
