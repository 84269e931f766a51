"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.llm import chat_format, decontaminate, html_text, katz, language_id, lexical_search, minhash_join, secret_scan, sentencepiece_scan, simhash, topk_search, toxicity, vocabulary_audit
from softgrove.llm.common import held_out, read_table
from softgrove.session import materialize


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the windows of the benchmark."""
    docs = read_table(spark, sf_dir, "documents")
    out = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from those not held out."""
    out = held_out(F.col("doc_id"), 7, 2)
    scored = katz.score_corpus(read_table(spark, sf_dir, "documents"), ~out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from the rows not held out."""
    docs = read_table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    content = language_id.learn(docs.where(~out))
    return (language_id.identify(docs, content, keep=["doc_id"])
            .select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected"))


def _is(kind: str):
    return lambda span: span.kind == kind


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the documents, as digests of their spans."""
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = [F.size(F.filter("secrets", _is(k))).cast("long").alias(f"n_{k}") for k in base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    own = F.filter("secrets", lambda s: s.kind.isin(base))
    return found.select("doc_id", *count, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded again: digests of both, and whether
    the text came back."""
    docs = read_table(spark, sf_dir, "documents")
    coded = sentencepiece_scan.encode(docs, keep=["doc_id", "text"], decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector."""
    return topk_search.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from the rows not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.learn(materialize(toxicity.sample_of(docs, labels.where(~out))))
    return (toxicity.score(docs, model, keep=["doc_id"])
            .select("doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as prefix-target examples, read back from these."""
    control = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    examples = chat_format.explode_examples(chat_format.format_conversations(turns))
    back = chat_format.read_back(examples)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and by which terms."""
    return vocabulary_audit.divergence(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents by their shingle sets."""
    return minhash_join.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_katz": op4_katz,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_topk_search": op8_topk_search,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_source_audit": op11_source_audit,
    "op12_lexical_search": op12_lexical_search,
    "op13_minhash": op13_minhash,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT r, p, pos.n, item_id FROM (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM pos) pos
        JOIN win ON win.n = pos.n AND win.t = pos.t),
wd AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM hit) GROUP BY r),
it AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN wd USING (r) LEFT JOIN it USING (r)
"""


def _rule_sql(k: int, rule: secret_scan.Rule) -> str:
    """Spans of one rule: the pieces between matches and the matches, in
    turn, give the positions."""
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern
    pattern = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT r, {k} AS k, '{rule.kind}' AS kind, m[i] AS hit, pieces[i],
       list_sum([len(x) FOR x IN pieces[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0) AS a
FROM (SELECT r, m, pieces, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT r, regexp_extract_all(text, {pattern}) AS m, string_split_regex(text, {pattern}) AS pieces FROM d))
WHERE len(regexp_extract(m[i], {pattern}, {rule.group})) >= {rule.least}"""


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, k, kind, CAST(a AS BIGINT) AS a, CAST(a + len(hit) AS BIGINT) AS b
      FROM ({" UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(secret_scan.RULES))})),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_ESCAPE_SQL = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"
OP10_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             count(*) OVER (PARTITION BY conv_id) AS n, len({_ESCAPE_SQL.format('role')}) + len({_ESCAPE_SQL.format('text')}) + 20 AS size FROM c),
g AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(CAST(sum(len(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""

_LETTERS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS.format("coalesce(text, '')")} AS t FROM documents),
o AS (SELECT r, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS BIGINT) AS p FROM c JOIN s USING (lang, source)),
lq AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
ls AS (SELECT lang, sum(n) AS total, count(*) AS v FROM lq GROUP BY ALL),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS BIGINT) AS q FROM lq JOIN ls USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
WHERE part = 'pair' OR rank <= 10
"""

_TERMS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format("coalesce(text, '')")} AS t FROM benchmark),
qt AS (SELECT q, item_id, t, count(*) AS many FROM (SELECT q, item_id, unnest(t) AS t FROM q) GROUP BY ALL),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
x AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS x FROM p JOIN w USING (t), s),
f AS (SELECT q, item_id, r, doc_id, CAST(sum(many * x) AS BIGINT) AS score FROM qt JOIN x USING (t) GROUP BY ALL HAVING sum(many * x) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 20
"""

OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + 3], ' ') AS t FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS common FROM s x JOIN s y USING (t) GROUP BY 1, 2) JOIN n na ON na.r = a JOIN n nb ON nb.r = b
      WHERE 100 * common >= 80 * (na.n + nb.n - common)),
reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, l.b FROM reach JOIN l ON reach.o = l.a),
c AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op6_secret_scan": OP6_SQL, "op8_topk_search": OP8_SQL,
                              "op10_chat_format": OP10_SQL, "op11_source_audit": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_minhash": OP13_SQL}
