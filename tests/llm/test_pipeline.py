import random
import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import DOCS, sentence  # noqa: E402

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    """Each stage against the brute-force version of its operator, on what
    the stage before it kept."""
    import sentencepiece
    from test_decontaminate import brute as hits
    from test_language_secrets import brute_spans
    from test_simhash import brute as groups

    from softgrove.llm import language_id, sentencepiece_scan
    from softgrove.llm.common import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.Classifier(language_id.learn(docs.where(~held_out(docs.doc_id, 4, 2))))
    texts = {i: r.text for i, r in rows.items() if not model.predict(r.text)[2]}
    texts = {i: texts[i] for i, _, low in groups(list(texts.items())) if i == low}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {i: t for (i, t), h in zip(texts.items(), hits(list(texts.values()), items)) if not h[1]}
    for i, t in texts.items():
        at = 0
        out = []
        for a, _, kind, b in brute_spans(t):
            if a >= at:
                out += [t[at:a], f"[{kind}]"]
            at = max(at, b)
        texts[i] = "".join([*out, t[at:]])
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL_PATH)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts) and 0 < len(got) < len(rows)
    for i, t in texts.items():
        assert got[i].ids == library.encode(t) and got[i].n_tokens == len(got[i].ids)
        assert (got[i].lang, got[i].source) == (rows[i].lang, rows[i].source)


def test_stages_stand_odd_tables(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, sentence(rng, 30), "en", "s", 9), (4, sentence(rng, 30), "en", None, None),
            (4, sentence(rng, 30), "en", "s", 1), (6, sentence(rng, 9000), "en", "s", 1), (6, sentence(rng, 9000), "en", "s", 1)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (spark.createDataFrame([], DOCS), spark.createDataFrame(rows, DOCS)):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            path = f"{tmp_path}/{table.count()}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (table.count() > 0)


def test_stages_are_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "secret_scan", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None
