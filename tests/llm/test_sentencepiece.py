import hashlib
import random
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import docs_df, empty_docs, odd_texts, sentence  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from softgrove.llm import sentencepiece_scan as sp  # noqa: E402

TABLE = sp.load()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH)
ENCODER = sp.Encoder(TABLE)

TEXT = st.lists(st.sampled_from(["a", "th", "ing", " ", "  ", "\n", "é", "漢", "1", "==", "the ", "\t", "\U0001f600", "ll", "x" * 9, " " * 17])
                | st.text(max_size=4), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_ids_are_the_library_s(text):
    assert ENCODER.encode_all([text, None]).to_pylist() == [LIBRARY.encode(text), []]


def scan(text, chunk, sizes=None):
    t = sp.normalise(text)
    ends, rows = [*range(chunk, len(t), chunk), len(t)], []
    for no, b in enumerate(ends):
        a = ends[no - 1] if no else 0
        lo, hi = max(0, a - ENCODER.longest - 1), min(len(t), b + ENCODER.longest + 1)
        rows.append((t[lo:hi], a - lo, b - lo, ENCODER.is_cut(t, a), ENCODER.is_cut(t, b)))
    matrices = [ENCODER.matrix(*r) for r in rows]
    left = right = None
    for m in matrices:
        left = m if left is None else sp.product(left, m)
    for m in reversed(matrices):
        right = m if right is None else sp.product(m, right)
    assert left.tolist() == right.tolist() == [[0.0]]
    last = sp._scan(matrices, 0, 0)
    if sizes is not None:
        sizes += [m.shape for m in matrices]
    ids = ENCODER.ids_of([ENCODER.backtrace(*r, x, y) for r, x, y in zip(rows, [0, *last[:-1]], last)])
    return [int(i) for part in ids for i in part]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the", "tion", "1", "00", "===", "--", "é", "ll", "x", "漢", " ", "\n", "   "]), min_size=1, max_size=120).map("".join),
       st.sampled_from([5, 16, 50]))
def test_chunks_give_the_library_s_ids(text, chunk):
    assert scan(text, chunk) == LIBRARY.encode(text)


def test_most_matrices_of_a_long_text_have_several_states():
    """Chunks of prose end inside words; states there decide the path."""
    texts = [r[0] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pandas().itertuples(index=False)]
    sizes = []
    for text in sorted(texts, key=len)[-4:]:
        assert scan(text, 997, sizes) == LIBRARY.encode(text)
    assert sum(n > 1 or m > 1 for n, m in sizes) > 0.8 * len(sizes)


def test_memory_forgets_and_still_encodes(monkeypatch):
    monkeypatch.setattr(sp, "MEMORY", 50)
    monkeypatch.setattr(sp, "WORDS", 50)
    encoder = sp.Encoder(TABLE)
    rng = random.Random(1)
    for _ in range(20):
        texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(3)]
        assert encoder.encode_all(texts).to_pylist() == [LIBRARY.encode(t) for t in texts]
        assert len(encoder.memo) < 400 and len(encoder.pairs) <= 51


def test_tables_with_giant_and_odd_texts(spark):
    rng = random.Random(9)
    giant = "".join(rng.choice("abcdefghij0123456789=+/") for _ in range(30_000))
    texts = [*odd_texts(rng), giant, giant, sentence(rng, 4000), "\n".join(sentence(rng, 30) for _ in range(300)), " " * 9000, "漢" * 5000]
    df = docs_df(spark, texts).withColumn("_key", F.lit("k"))
    coded = sp.encode(df, table=TABLE, giant=2000, chunk=700)
    assert coded.columns == [*df.columns, "ids"]
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {k: LIBRARY.encode(t or "") for k, t in enumerate(texts)}
    back = {r.doc_id: r.decoded for r in sp.decode(coded, table=TABLE).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}


def test_many_runs_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(sp, "RUN", 3)
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "cd", "e", "1", "tion", " "][:5 + k % 2]) for _ in range(1500)) for k in range(3)]
    got = {r.doc_id: r.ids for r in sp.encode(docs_df(spark, texts), table=TABLE, giant=100, chunk=90).collect()}
    assert got == {k: LIBRARY.encode(t) for k, t in enumerate(texts)}


def test_empty_tables_null_ids_and_wrong_ids(spark):
    assert sp.encode(empty_docs(spark), table=TABLE).collect() == []
    df = spark.createDataFrame([(1, None), (2, []), (3, [TABLE.unknown, 1])], "doc_id int, ids array<int>")
    assert [r.decoded for r in sp.decode(df, table=TABLE).orderBy("doc_id").collect()] == ["", "", LIBRARY.decode([0, 1])[1:]]
    with pytest.raises(ValueError):
        sp.Decoder(TABLE).decode_all(pa.array([[10 ** 6]], pa.list_(pa.int32())))


def test_query_digests(spark):
    from softgrove.llm.queries import op7_sentencepiece
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_sentencepiece(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ids = LIBRARY.encode(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_letters_of_words_are_looked_up_at_once():
    """No Python step per character; characters in no piece are told apart."""
    import sys
    encoder = sp.Encoder(sp.load())
    words = ["▁hello", "a", "▁\U0001f600x", "naïve", "日本"]
    text, size = encoder._letters(words)
    assert size.tolist() == [len(w) for w in words]
    assert text.tolist() == [encoder.letters.get(c, -1) for w in words for c in w]
    calls = []
    known = [f"▁{'etaoinshr'[k % 9]}{'dlucm'[k % 5]}{'aeiou'[k % 7 % 5]}" * 9 for k in range(400)]
    encoder.paths_of(known)  # pairs are learnt
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        encoder.paths_of(known)
    finally:
        sys.setprofile(None)
    assert len(calls) < sum(map(len, known)) / 4
    for text in ("", " ", "日本 naïve \U0001f600x\n\n a" + "b" * 70, "x" * 200 + " \x00 é"):
        assert encoder.encode_all([text]).to_pylist()[0] == LIBRARY.encode(text)
