import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import WORDS, empty_docs, odd_texts, sentence  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from softgrove.llm import vocabulary_audit as va  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))) for t, lang, source in rows]
    df, count = Counter(), defaultdict(Counter)
    for lang, source, w in words:
        df.update({(lang, t) for t in w})
        count[lang, source].update(w)
    out = []
    for lang in {g[0] for g in count}:
        kept = sorted(t for (la, t), n in df.items() if la == lang and n >= least)
        groups = {s: c for (la, s), c in count.items() if la == lang}

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10 ** 9 * (c[t] + 2)) // (total + 2 * len(kept)) for t in kept}
        q, p = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s, c in groups.items():
            found = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(sorted(found))]
            found = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if c[t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def corpus():
    rng = random.Random(7)
    words = WORDS + ["é", "漢字", "über", "Zed", "zeta", "the-of", "x1y"] + [f"{a}{b}" for a in "abcdeé" for b in ("", "x", "xy", "ß")]
    rows = [(t, "en", "a") for t in odd_texts(rng)]
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", "", None, "zz"])
        rows.append((sentence(rng, rng.randint(0, 30), words[:rng.randint(3, len(words))]), lang, source))
    return rows + [("alone", "xx", "a"), ("", "xx", "b"), (None, "yy", "c"), ("1 2", "en", "none")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def test_divergence_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert rows_of(va.divergence(frame(spark, rows))) == want
    # several transducers a language, several broadcasts, narrow blocks
    got = va.divergence(frame(spark, rows).repartition(5), shard_terms=7, broadcast_bytes=1, block_cells=1)
    assert rows_of(got) == want


def test_extra_columns_and_names(spark):
    rows = corpus()[:60]
    df = frame(spark, rows).withColumns({c: F.lit("a") for c in ("term", "n", "Block", "value", "ordinal", "item")})
    named = df.withColumnsRenamed({"text": "the text", "lang": "a.b", "source": "s"})
    assert rows_of(va.divergence(named, "the text", "a.b", "s")) == brute(rows)


def test_empty_table(spark):
    assert va.divergence(empty_docs(spark)).collect() == []
    rows = [(None, None, None), (None, None, "b")]
    assert rows_of(va.divergence(frame(spark, rows))) == brute(rows)


def words_in(words):
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    length = np.array([len(w) for w in words])
    return data, np.cumsum(length + 1) - length - 1, length


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=60), st.lists(st.binary(min_size=1, max_size=6), max_size=20))
def test_transducer_numbers_terms(terms, others):
    order = sorted(terms)
    t = va.Transducer.build(order)
    place = {w: k for k, w in enumerate(order)}
    asked = order + others
    assert list(t.ordinals(*words_in(asked))) == [place.get(w, -1) for w in asked]


def test_transducer_is_minimal():
    """As many states as there are different sets of endings."""
    rng = random.Random(3)
    terms = sorted({("".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) + rng.choice(["", "ing", "ed"])).encode() for _ in range(3000)})
    endings = defaultdict(set)
    for w in terms:
        for k in range(len(w) + 1):
            endings[w[:k]].add(w[k:])
    t = va.Transducer.build(terms)
    assert len(t.final) == len({frozenset(e) for e in endings.values()})
    assert list(t.ordinals(*words_in(terms))) == list(range(len(terms)))


def test_unsorted_terms_are_refused():
    for terms in ([b"b", b"a"], [b"a", b"a"], [b"ab", b"a"]):
        with pytest.raises(ValueError):
            va.Transducer.build(terms)


def test_counts_beyond_64_bits():
    big = np.array([[10 ** 12, 5], [7, 10 ** 11]])
    totals = [int(x) for x in big.sum(axis=1)]
    sums, terms = va.block_values(big, totals, 2)
    p = [[1 + (10 ** 9 * (int(c) + 2)) // (t + 4) for c in row] for row, t in zip(big, totals)]
    assert sums[0, 1] == sum((a - b) ** 2 // (a + b) for a, b in zip(*p))
