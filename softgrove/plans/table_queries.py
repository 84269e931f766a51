"""Operators run over the driver's tables, each with an equivalent DuckDB
SQL text for the side-by-side correctness check.

Every query reads whole tables. Floating results are rounded to six
decimals and every computed column is aliased to the same name in Spark
and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from softgrove.config import ADAM_BETA1, ADAM_BETA2, ADAM_EPS, LEARNING_RATE, EngineConfig
from softgrove.functions.columns import CLIP_HIGH, CLIP_LOW, digamma_sql, keyed_uniform_sql, norm_ppf_sql
from softgrove.operators import clean, evaluate as ev, labels as lab
from softgrove.operators.encode import LeaveOneOut
from softgrove.operators.normalize import (MinMaxNormalizer, QuantileNormalizer, StandardNormalizer,
                                          _arrow_quantile_transform)
from softgrove.operators.rank import mutual_information, rank_features
from softgrove.operators.split import stratified_split
from softgrove.operators.train import fit_soft_trees, gradient
from softgrove.session import materialize
from softgrove.operators.tree import focal_loss, init_model, predict, score

R = 6  # rounding of floating outputs


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, name):
    return F.round(c, R).alias(name)


# ---------------------------------------------------------------------------
# shared inputs

def orders_coded(spark, sf):
    """orders with label = code of o_orderstatus (F=0, O=1, P=2)."""
    coded, _ = lab.encode_label(_t(spark, sf, "orders"), "o_orderstatus", keep=True)
    return coded


ORDERS_CODED_SQL = ("(SELECT *, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS label "
                    "FROM orders)")

# Fixed feature scaling for the tree queries: totalprice / 1e5, custkey / 1e3.
TREE_FEATURES = [("o_totalprice", 1e5), ("o_custkey", 1e3)]


def _tree_features_col():
    return F.array(*[(F.col(c).cast("double") / s) for c, s in TREE_FEATURES]).alias("features")


def _tree_model():
    return init_model(2, 3, [0, 1], seed=7)


def split_sql(base: str, key: str, label: str, seed: int, valid: float = 0.2, test: float = 0.2) -> str:
    """SQL of the exact stratified split over ``base`` (a subquery with the
    key and label columns); yields base.* plus ``split``."""
    return f"""(WITH b AS (SELECT *, md5(concat_ws(':', CAST({key} AS VARCHAR), '{seed}')) AS _h FROM {base}),
cnt AS (SELECT {label} AS _l, count(*) AS n_c FROM b GROUP BY {label}),
tot AS (SELECT sum(n_c) AS n, CAST(floor(sum(n_c) * {test}) AS BIGINT) AS n_test,
               CAST(floor(sum(n_c) * {valid}) AS BIGINT) AS n_valid FROM cnt),
tq AS (SELECT _l, n_c, n, n_test, n_valid, (n_test * n_c) // n AS q, (n_test * n_c) % n AS r FROM cnt, tot),
tq2 AS (SELECT _l, n_c, n, n_test, n_valid, q + CASE WHEN row_number() OVER (ORDER BY r DESC, _l)
          <= n_test - sum(q) OVER () THEN 1 ELSE 0 END AS t FROM tq),
vq AS (SELECT _l, t, n_valid, (n_valid * (n_c - t)) // (n - n_test) AS q,
              (n_valid * (n_c - t)) % (n - n_test) AS r FROM tq2),
vq2 AS (SELECT _l, t, q + CASE WHEN row_number() OVER (ORDER BY r DESC, _l)
          <= n_valid - sum(q) OVER () THEN 1 ELSE 0 END AS v FROM vq),
rk AS (SELECT b.*, row_number() OVER (PARTITION BY {label} ORDER BY _h, {key}) AS _rn FROM b)
SELECT rk.* EXCLUDE (_h, _rn), CASE WHEN _rn <= t THEN 'test' WHEN _rn <= t + v THEN 'valid' ELSE 'train' END AS split
FROM rk JOIN vq2 ON rk.{label} = vq2._l)"""


def _mode_sql(table: str, col: str, where: str = "TRUE") -> str:
    return (f"(SELECT {col} FROM {table} WHERE {col} IS NOT NULL AND {where} GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} ASC LIMIT 1)")


# ---------------------------------------------------------------------------
# queries

def q_class_counts(spark, sf):
    return lab.class_counts(orders_coded(spark, sf), "label").select("label", "n")


def q_minority_share(spark, sf):
    df = _t(spark, sf, "labels").withColumnRenamed("quality", "label")
    m = lab.minority_share(df, "label", ratio=0.25)
    return m.select("min_count", "total", "n_classes", _r(F.col("minority_share"), "minority_share"), "needs_rebalance")


def q_num_classes(spark, sf):
    return spark.createDataFrame([(lab.num_classes(_t(spark, sf, "orders"), "o_orderstatus"),)], "num_classes long")


def q_encode_label(spark, sf):
    return orders_coded(spark, sf).select("o_orderkey", "label")


def q_derive_label_threshold(spark, sf):
    return clean.derive_label(_t(spark, sf, "events"), F.col("value") > 100, "label").select("event_id", "label")


def q_derive_label_contains(spark, sf):
    return clean.derive_label(_t(spark, sf, "orders"), F.col("o_orderpriority").contains("URGENT"),
                              "label").select("o_orderkey", "label")


def q_replace_token(spark, sf):
    return clean.replace_token(_t(spark, sf, "orders"), "o_orderpriority", "5-LOW",
                               "4-NOT SPECIFIED").select("o_orderkey", "o_orderpriority")


def q_replace_values(spark, sf):
    return clean.replace_values(_t(spark, sf, "events"), "event_type", ["view", "click"],
                                "browse").select("event_id", "event_type")


def q_fill_mode(spark, sf):
    return clean.fill_mode(_t(spark, sf, "events"), ["event_type"], token="error").select("event_id", "event_type")


def q_fill_mode_excl(spark, sf):
    return clean.fill_mode(_t(spark, sf, "orders"), ["o_orderpriority"], token="4-NOT SPECIFIED",
                           exclude_token=True).select("o_orderkey", "o_orderpriority")


def _orders_with_nulls(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("pri"),
                    F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("st"))


ORDERS_NULLS_SQL = ("(SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS pri, "
                    "nullif(o_orderstatus, 'P') AS st FROM orders)")


def q_fill_mode_all(spark, sf):
    return clean.fill_mode_all(_orders_with_nulls(spark, sf), ["pri", "st"]).select("o_orderkey", "pri", "st")


def q_fill_mean(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return clean.fill_mean(e, ["value"]).select("event_id", _r(F.col("value"), "value"))


def q_fill_const(spark, sf):
    return clean.fill_const(_orders_with_nulls(spark, sf), {"pri": "UNKNOWN"}).select("o_orderkey", "pri")


def _part_tokens(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", F.when(F.col("p_size") > 45, F.lit("?"))
                    .otherwise(F.col("p_size").cast("string")).alias("size_text"))


PART_TOKENS_SQL = ("(SELECT p_partkey, CASE WHEN p_size > 45 THEN '?' ELSE CAST(p_size AS VARCHAR) END AS size_text "
                   "FROM part)")


def q_to_numeric(spark, sf):
    return clean.to_numeric(_part_tokens(spark, sf), ["size_text"]).select("p_partkey", F.col("size_text").alias("size_num"))


def q_fill_mean_token(spark, sf):
    return clean.fill_mean(_part_tokens(spark, sf), ["size_text"], token="?").select(
        "p_partkey", _r(F.col("size_text"), "size_num"))


# Columns that the query has at least; more where a part name is longer.
NAME_LENGTH = 16


def q_split_positions(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", "p_name")
    longest = part.agg(F.max(F.length(F.trim("p_name"))).alias("n")).first()["n"]
    n = max(NAME_LENGTH, longest or 0)
    names = [f"c{i}" for i in range(n)]
    return clean.split_positions(part, "p_name", n, names).select("p_partkey", *names)


def q_stack_tables(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    closed = F.col("o_orderstatus").eqNullSafe("F")
    return clean.stack_tables([o.where(closed), o.where(~closed)])


def q_stratified_split(spark, sf):
    return stratified_split(orders_coded(spark, sf).select("o_orderkey", "label"), key="o_orderkey", seed=42) \
        .select("o_orderkey", "label", "split")


def q_stratified_split_labels(spark, sf):
    df = _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return stratified_split(df, key="doc_id", seed=43).select("doc_id", "label", "split")


def _docs_labelled(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source")
    lb = _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return materialize(stratified_split(d.join(lb, "doc_id"), key="doc_id", seed=42))


DOCS_SQL = "(SELECT d.doc_id, d.lang, d.source, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"


def _loo(spark, sf):
    df = _docs_labelled(spark, sf)
    model = LeaveOneOut(["lang", "source"], label="label").fit(df)
    return model.transform(df, out_suffix="_enc").select(
        "doc_id", "split", _r(F.col("lang_enc"), "lang_enc"), _r(F.col("source_enc"), "source_enc"))


def q_loo_train(spark, sf):
    return _loo(spark, sf).where(F.col("split") == "train")


def q_loo_apply(spark, sf):
    return _loo(spark, sf).where(F.col("split") != "train")


def _loo_sql(train: bool) -> str:
    s = split_sql(DOCS_SQL, "doc_id", "label", 42)
    cond = "split = 'train'" if train else "split <> 'train'"

    def enc(c):
        return (f"round(CASE WHEN st_{c}.n IS NULL OR st_{c}.n <= 1 THEN mu.m "
                f"WHEN s.split = 'train' THEN (st_{c}.s - s.label) / (st_{c}.n - 1) "
                f"ELSE st_{c}.s / st_{c}.n END, {R}) AS {c}_enc")
    return f"""WITH s AS (SELECT * FROM {s}),
tr AS (SELECT * FROM s WHERE split = 'train'),
mu AS (SELECT avg(label) AS m FROM tr),
st_lang AS (SELECT lang AS c, sum(label)::DOUBLE AS s, count(*) AS n FROM tr GROUP BY lang),
st_source AS (SELECT source AS c, sum(label)::DOUBLE AS s, count(*) AS n FROM tr GROUP BY source)
SELECT s.doc_id, s.split, {enc('lang')}, {enc('source')}
FROM s CROSS JOIN mu LEFT JOIN st_lang ON s.lang = st_lang.c LEFT JOIN st_source ON s.source = st_source.c
WHERE {cond}"""


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_features(spark, sf):
    return _t(spark, sf, "lineitem").select(F.array(*[F.col(c) for c in LINE_COLS]).alias("features"))


def q_minmax(spark, sf):
    df = _line_features(spark, sf)
    out = MinMaxNormalizer(-1.0, 1.0).fit(df).transform(df)
    return out.select(*[_r(F.col("features")[i], f"f{i}") for i in range(len(LINE_COLS))])


def q_standard(spark, sf):
    df = _line_features(spark, sf)
    out = StandardNormalizer().fit(df).transform(df)
    return out.select(*[_r(F.col("features")[i], f"f{i}") for i in range(len(LINE_COLS))])


def _price(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.array("o_totalprice").alias("features"))


def q_quantile_normalize(spark, sf):
    df = _price(spark, sf)
    out = QuantileNormalizer(noise=0.0, n_quantiles=1000, method="exact").fit(df).transform(df)
    return out.select(F.col("row_id").alias("o_orderkey"), _r(F.col("features")[0], "z"))


def q_quantile_uniform(spark, sf):
    df = _price(spark, sf)
    m = QuantileNormalizer(noise=0.0, n_quantiles=1000, method="exact").fit(df)
    u = _arrow_quantile_transform(df, m.local_grids(), [], "features", "u", uniform=True)
    return u.select(F.col("row_id").alias("o_orderkey"), _r(F.col("u")[0], "u"))


def _quantile_sql(out: str) -> str:
    u = ("CASE WHEN x - 1e-7 < grid[1] THEN 0.0 WHEN x + 1e-7 > grid[len(grid)] THEN 1.0 "
         "WHEN a < b THEN (a + b - 1) / (2.0 * (len(grid) - 1)) "
         "ELSE ((a - 1) + (x - grid[a]) / (grid[a + 1] - grid[a])) / (len(grid) - 1) END")
    body = f"""WITH g AS (SELECT quantile_cont(o_totalprice, list_transform(range(0, 1000), lambda i: i / 999.0)) AS grid
           FROM orders),
s AS (SELECT o_orderkey, o_totalprice AS x, grid, len(list_filter(grid, lambda v: v < o_totalprice)) AS a,
             len(list_filter(grid, lambda v: v <= o_totalprice)) AS b FROM orders, g),
uu AS (SELECT o_orderkey, {u} AS u FROM s)"""
    if out == "u":
        return body + f"\nSELECT o_orderkey, round(u, {R}) AS u FROM uu"
    return body + (f"\nSELECT o_orderkey, round(CASE WHEN u <= 0 THEN {CLIP_LOW!r} WHEN u >= 1 THEN {CLIP_HIGH!r} "
                   f"ELSE least(greatest({norm_ppf_sql('u')}, {CLIP_LOW!r}), {CLIP_HIGH!r}) END, {R}) AS z FROM uu")


def _mi_input(spark, sf):
    o = orders_coded(spark, sf)
    return o.select(F.col("o_orderkey").alias("row_id"), "label",
                    F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("features"))


def q_mi_knn(spark, sf):
    return mutual_information(_mi_input(spark, sf), method="knn", tie_noise=False).select(
        F.col("feature").cast("int").alias("feature"), _r(F.col("mi"), "mi"))


def q_mi_binned(spark, sf):
    return mutual_information(_mi_input(spark, sf), method="binned", n_bins=16).select(
        F.col("feature").cast("int").alias("feature"), _r(F.col("mi"), "mi"))


def q_rank_features(spark, sf):
    order = rank_features(mutual_information(_mi_input(spark, sf), method="knn", tie_noise=False))[()]
    return spark.createDataFrame(list(enumerate(order, 1)), "rank int, feature int").select("feature", "rank")


MI_LONG_SQL = f"""base AS (SELECT o_orderkey AS k, label, o_totalprice AS f0, CAST(o_custkey AS DOUBLE) AS f1
                FROM {ORDERS_CODED_SQL}),
long AS (SELECT k, label, 0 AS feature, f0 AS x FROM base UNION ALL SELECT k, label, 1 AS feature, f1 AS x FROM base)"""


def _mi_knn_sql(final: str) -> str:
    cands = ", ".join([f"{{'d': abs({c} - v), 'u': {c}}}" for c in ("b1", "a1", "b2", "a2", "b3", "a3")])
    return f"""WITH {MI_LONG_SQL},
cls AS (SELECT label, count(*) AS nc FROM base GROUP BY label),
vt AS (SELECT l.k, l.label, l.feature, l.x AS v, cls.nc, least(3, cls.nc - 1) AS kk
      FROM long l JOIN cls USING (label) WHERE cls.nc > 1),
nb AS (SELECT *, lag(v, 1) OVER w AS b1, lag(v, 2) OVER w AS b2, lag(v, 3) OVER w AS b3,
              lead(v, 1) OVER w AS a1, lead(v, 2) OVER w AS a2, lead(v, 3) OVER w AS a3
       FROM vt WINDOW w AS (PARTITION BY feature, label ORDER BY v, k)),
kth AS MATERIALIZED (SELECT k, feature, v, nc, kk,
               list_sort(list_filter([{cands}], lambda c: c.u IS NOT NULL))[kk] AS c FROM nb),
iv AS MATERIALIZED (SELECT k, feature, v, nc, kk, c.d AS r,
              CASE WHEN c.u < v THEN c.u ELSE v - c.d END AS lo,
              CASE WHEN c.u < v THEN v + c.d ELSE c.u END AS hi FROM kth),
ev AS (SELECT feature, v AS pos, 1 AS typ, 0 AS e, k AS id FROM iv
       UNION ALL SELECT feature, hi, CASE WHEN r = 0 THEN 2 ELSE 0 END, 1, k FROM iv
       UNION ALL SELECT feature, lo, CASE WHEN r = 0 THEN 0 ELSE 2 END, 2, k FROM iv),
rc AS MATERIALIZED (SELECT *, sum(CASE WHEN e = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY feature ORDER BY pos, typ, e, id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt FROM ev),
mt AS (SELECT feature, id, sum(CASE WHEN e = 1 THEN cnt ELSE 0 END) - sum(CASE WHEN e = 2 THEN cnt ELSE 0 END) AS m
      FROM rc WHERE e <> 0 GROUP BY feature, id),
pr AS (SELECT mt.feature, mt.m, iv.nc, iv.kk FROM mt JOIN iv ON mt.feature = iv.feature AND mt.id = iv.k),
agg AS (SELECT feature, count(*) AS n, avg({digamma_sql('kk')}) AS pk, avg({digamma_sql('nc')}) AS pn,
               avg({digamma_sql('m')}) AS pm FROM pr GROUP BY feature),
mi AS (SELECT feature, greatest({digamma_sql('n')} + pk - pn - pm, 0.0) AS mi FROM agg)
{final}"""


def _mi_binned_sql(n_bins: int) -> str:
    probs = ", ".join(repr(i / n_bins) for i in range(1, n_bins))
    return f"""WITH {MI_LONG_SQL},
e AS (SELECT feature, list_distinct(quantile_cont(x, [{probs}])) AS edges FROM long GROUP BY feature),
bl AS (SELECT l.feature, l.label, len(list_filter(list_sort(e.edges), lambda q: q < l.x)) AS bin
       FROM long l JOIN e USING (feature)),
c AS (SELECT feature, bin, label, count(*) AS n_bl FROM bl GROUP BY ALL),
c2 AS (SELECT *, sum(n_bl) OVER (PARTITION BY feature, bin) AS n_b, sum(n_bl) OVER (PARTITION BY feature, label) AS n_l,
              sum(n_bl) OVER (PARTITION BY feature) AS n FROM c)
SELECT CAST(feature AS INTEGER) AS feature,
       round(greatest(sum((n_bl / n) * ln(n_bl * n / (n_b * n_l))), 0.0), {R}) AS mi FROM c2 GROUP BY feature"""


def _tree_features(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", _tree_features_col())


def _tree_input(spark, sf):
    return orders_coded(spark, sf).select("o_orderkey", "label", _tree_features_col())


def q_soft_tree_score(spark, sf):
    s = score(_tree_features(spark, sf), _tree_model(), mode="expr")
    return s.select("o_orderkey", *[_r(F.col("scores")[c], f"s{c}") for c in range(3)])


def q_soft_tree_score_numpy(spark, sf):
    s = score(_tree_features(spark, sf), _tree_model(), mode="numpy")
    return s.select("o_orderkey", *[_r(F.col("scores")[c], f"s{c}") for c in range(3)])


def q_soft_tree_predict(spark, sf):
    return predict(_tree_input(spark, sf), _tree_model()).select("o_orderkey", "label", "prediction")


def q_focal_loss(spark, sf):
    s = score(_tree_input(spark, sf), _tree_model(), mode="expr")
    return focal_loss(s, "scores", "label", 1.0, 2.0, "mean").select(_r(F.col("focal_loss"), "focal_loss"))


def q_gradient_step(spark, sf):
    g = gradient(_tree_input(spark, sf), _tree_model())
    rows = [(i, float(v)) for i, v in enumerate(g["grad"])]
    return spark.createDataFrame(rows, "param int, grad double").select("param", _r(F.col("grad"), "grad"))


def q_accuracy(spark, sf):
    p = predict(_tree_input(spark, sf), _tree_model())
    return ev.accuracy(p).select(_r(F.col("accuracy"), "accuracy"))


def q_f1_macro(spark, sf):
    p = predict(_tree_input(spark, sf), _tree_model())
    return ev.f1_macro(p).select(_r(F.col("f1_macro"), "f1_macro"))


def q_confusion(spark, sf):
    p = predict(_tree_input(spark, sf), _tree_model())
    return ev.confusion(p).select("label", "prediction", "n")


def _tree_sql_rows() -> str:
    """Per-row closed form (identifiers differ beyond case: SQL folds case)
    of the fixed depth-2 tree on the orders input:
    decisions d0..d2, leaf probabilities P0..P3, scores, softmax, focal
    loss and the gradient pieces."""
    m = _tree_model()
    th, V = [float(v) for v in m.thresholds], m.leaves.astype(float).tolist()
    (c0, s0), (c1, s1) = TREE_FEATURES
    x = [f"(CAST({c0} AS DOUBLE) / {s0!r})", f"(CAST({c1} AS DOUBLE) / {s1!r})"]
    feats = m.node_features()
    d = [f"(1.0 / (1.0 + exp({x[int(feats[i])]} - {th[i]!r})))" for i in range(3)]
    P = ["d0 * d1", "d0 * (1 - d1)", "(1 - d0) * d2", "(1 - d0) * (1 - d2)"]
    sc = [" + ".join(f"P{l} * {V[l][c]!r}" for l in range(4)) for c in range(3)]
    e = [f"coef * ((CASE WHEN label = {c} THEN 1.0 ELSE 0.0 END) - q{c})" for c in range(3)]
    G = [" + ".join(f"e{c} * {V[l][c]!r}" for c in range(3)) for l in range(4)]
    return f"""WITH b AS (SELECT o_orderkey, label, {d[0]} AS d0, {d[1]} AS d1, {d[2]} AS d2 FROM {ORDERS_CODED_SQL}),
p AS (SELECT *, {P[0]} AS P0, {P[1]} AS P1, {P[2]} AS P2, {P[3]} AS P3 FROM b),
s AS (SELECT *, {sc[0]} AS s0, {sc[1]} AS s1, {sc[2]} AS s2 FROM p),
sm AS (SELECT *, greatest(s0, s1, s2) AS mx FROM s),
pr AS (SELECT *, exp(s0 - mx) / (exp(s0 - mx) + exp(s1 - mx) + exp(s2 - mx)) AS q0,
              exp(s1 - mx) / (exp(s0 - mx) + exp(s1 - mx) + exp(s2 - mx)) AS q1,
              exp(s2 - mx) / (exp(s0 - mx) + exp(s1 - mx) + exp(s2 - mx)) AS q2,
              (CASE label WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END) - mx
                - ln(exp(s0 - mx) + exp(s1 - mx) + exp(s2 - mx)) AS lpt FROM sm),
fl AS (SELECT *, exp(lpt) AS pt, -1.0 * power(1 - exp(lpt), 2) * lpt AS loss,
              (2.0 * (1 - exp(lpt)) * exp(lpt) * lpt - power(1 - exp(lpt), 2)) AS coef FROM pr),
ee AS (SELECT *, {e[0]} AS e0, {e[1]} AS e1, {e[2]} AS e2 FROM fl),
gg AS (SELECT *, P0 * ({G[0]}) AS g0, P1 * ({G[1]}) AS g1, P2 * ({G[2]}) AS g2, P3 * ({G[3]}) AS g3 FROM ee)"""


def _gradient_sql() -> str:
    parts = [("0", "(1 - d0) * (g0 + g1) - d0 * (g2 + g3)"), ("1", "(1 - d1) * g0 - d1 * g1"),
             ("2", "(1 - d2) * g2 - d2 * g3")]
    for leaf in range(4):
        for c in range(3):
            parts.append((str(3 + leaf * 3 + c), f"P{leaf} * e{c}"))
    sel = "\nUNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS param, round(avg({expr}), {R}) AS grad FROM gg"
                              for i, expr in parts)
    return _tree_sql_rows() + "\n" + sel


TRAIN_EPOCHS = 3


def q_train_epochs(spark, sf):
    """Three epochs of the depth-2 tree on the orders: losses per epoch."""
    df = stratified_split(_tree_input(spark, sf), key="o_orderkey", seed=42).withColumn("trial", F.lit(1))
    fit = fit_soft_trees(df, {1: _tree_model()}, EngineConfig(max_epochs=TRAIN_EPOCHS))
    hist = spark.createDataFrame(fit.history, "trial int, epoch int, train_loss double, valid_loss double")
    return hist.select("epoch", _r(F.col("train_loss"), "train_loss"), _r(F.col("valid_loss"), "valid_loss"))


def epochs_sql(epochs: int) -> str:
    """The epochs unrolled: forward pass, mean gradient and Adam step of one
    epoch feed the next one's parameters. Tables t0, t1, ... have the losses at
    the parameters of a0, a1, ..."""
    m = _tree_model()
    p0 = [*m.thresholds.astype(float).tolist(), *m.leaves.astype(float).ravel().tolist()]
    n, feats = len(p0), m.node_features()
    ctes = ["r AS (SELECT b.label, s.split, " + ", ".join(f"CAST({c} AS DOUBLE) / {k!r} AS x{i}" for i, (c, k) in enumerate(TREE_FEATURES))
            + f" FROM {ORDERS_CODED_SQL} b JOIN (SELECT o_orderkey, split FROM "
            + split_sql(f"(SELECT o_orderkey, label FROM {ORDERS_CODED_SQL})", "o_orderkey", "label", 42) + ") s USING (o_orderkey))",
            "a0 AS (SELECT " + ", ".join(f"CAST({v!r} AS DOUBLE) AS w{i}, CAST(0 AS DOUBLE) AS m{i}, CAST(0 AS DOUBLE) AS v{i}"
                                         for i, v in enumerate(p0)) + ")"]

    def leaf(l, c):
        return f"w{3 + l * 3 + c}"

    lp = ["d0 * d1", "d0 * (1 - d1)", "(1 - d0) * d2", "(1 - d0) * (1 - d2)"]
    grads = ["(1 - d0) * (g0 + g1) - d0 * (g2 + g3)", "(1 - d1) * g0 - d1 * g1", "(1 - d2) * g2 - d2 * g3"]
    grads += [f"l{k} * e{c}" for k in range(4) for c in range(3)]
    for e in range(epochs + 1):
        ctes.append(f"b{e} AS (SELECT r.*, a.*, " + ", ".join(
            f"1.0 / (1.0 + exp(x{int(feats[i])} - w{i})) AS d{i}" for i in range(3)) + f" FROM r, a{e} a)")
        ctes.append(f"c{e} AS (SELECT *, " + ", ".join(f"{x} AS l{k}" for k, x in enumerate(lp)) + f" FROM b{e})")
        ctes.append(f"s{e} AS (SELECT *, " + ", ".join(
            " + ".join(f"l{k} * {leaf(k, c)}" for k in range(4)) + f" AS s{c}" for c in range(3)) + f" FROM c{e})")
        ctes.append(f"q{e} AS (SELECT *, exp(s0 - mx) / z AS q0, exp(s1 - mx) / z AS q1, exp(s2 - mx) / z AS q2, "
                    f"(CASE label WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END) - mx - ln(z) AS lpt FROM (SELECT *, "
                    f"exp(s0 - mx) + exp(s1 - mx) + exp(s2 - mx) AS z FROM (SELECT *, greatest(s0, s1, s2) AS mx FROM s{e})))")
        ctes.append(f"f{e} AS (SELECT *, -power(1 - exp(lpt), 2) * lpt AS loss, "
                    f"2.0 * (1 - exp(lpt)) * exp(lpt) * lpt - power(1 - exp(lpt), 2) AS coef FROM q{e})")
        ctes.append(f"e{e} AS (SELECT *, " + ", ".join(
            f"coef * ((CASE WHEN label = {c} THEN 1.0 ELSE 0.0 END) - q{c}) AS e{c}" for c in range(3)) + f" FROM f{e})")
        ctes.append(f"h{e} AS (SELECT *, " + ", ".join(
            f"l{k} * (" + " + ".join(f"e{c} * {leaf(k, c)}" for c in range(3)) + f") AS g{k}" for k in range(4)) + f" FROM e{e})")
        ctes.append(f"t{e} AS (SELECT avg(loss) FILTER (split = 'train') AS tl, avg(loss) FILTER (split = 'valid') AS vl, "
                    + ", ".join(f"avg({g}) FILTER (split = 'train') AS dw{i}" for i, g in enumerate(grads)) + f" FROM h{e})")
        t = e + 1
        step = [f"w{i} - ({LEARNING_RATE!r} / {1 - ADAM_BETA1 ** t!r}) * m{i} / (sqrt(v{i}) / {(1 - ADAM_BETA2 ** t) ** 0.5!r} + {ADAM_EPS!r}) AS w{i}, m{i}, v{i}"
                for i in range(n)]
        moments = ", ".join(f"w{i}, {ADAM_BETA1!r} * m{i} + {1 - ADAM_BETA1!r} * dw{i} AS m{i}, "
                            f"{ADAM_BETA2!r} * v{i} + {1 - ADAM_BETA2!r} * dw{i} * dw{i} AS v{i}" for i in range(n))
        ctes.append(f"a{t} AS (SELECT {', '.join(step)} FROM (SELECT {moments} FROM a{e}, t{e}))")
    return "WITH RECURSIVE " + ",\n".join(ctes)


def _train_epochs_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS epoch, round(t{k - 1}.tl, {R}) AS train_loss, round(t{k}.vl, {R}) AS valid_loss "
                              f"FROM t{k - 1}, t{k}" for k in range(1, TRAIN_EPOCHS + 1))
    return epochs_sql(TRAIN_EPOCHS) + "\n" + rows


def q_fit_soft_tree(spark, sf):
    """Train a depth-8 tree on the embeddings (64 features, 10 classes),
    features in order of mutual information, until early stopping."""
    emb = _t(spark, sf, "embeddings")
    df = emb.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("features"), F.lit(1).alias("trial"))
    df = stratified_split(df, key="row_id", seed=42)
    df = materialize(QuantileNormalizer(noise=1e-3, seed=42, by=["trial"]).fit(df).transform(df))
    order = rank_features(mutual_information(df, by=["trial"]), by=["trial"])[(1,)]
    k = lab.num_classes(df)
    fit = fit_soft_trees(df, {1: init_model(8, k, order, 42)})
    return spark.createDataFrame(fit.history, "trial int, epoch int, train_loss double, valid_loss double")


def q_run_trials(spark, sf):
    """Ten seeded trials on the embeddings with the full configuration."""
    from softgrove.plans.trials import run_trials
    emb = _t(spark, sf, "embeddings")
    df = emb.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    run = run_trials(spark, df, "embeddings", [f"e{i}" for i in range(64)], cfg=EngineConfig())
    return run.summary.drop("Mean Training Time", "Mean Test Acc Time")


def q_oversample_random(spark, sf):
    from softgrove.operators.balance import oversample_random
    df = _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return oversample_random(df, "label", key="doc_id", seed=42).select("doc_id", "label", "draw")


def q_oversample_smote(spark, sf):
    """SMOTE on documents x labels (quality), features n_chars and text length."""
    from softgrove.operators.balance import oversample_smote
    d = _t(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("text_len"))
    lb = _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    df = d.join(lb, "doc_id").select("doc_id", "label",
                                     F.array(F.col("n_chars").cast("double"), F.col("text_len").cast("double"))
                                     .alias("features"))
    out = oversample_smote(df, "label", "features", "doc_id", k=5, seed=42)
    return out.select("doc_id", "label", "draw", _r(F.col("features")[0], "f0"), _r(F.col("features")[1], "f1"))


def _smote_sql() -> str:
    u = keyed_uniform_sql(42, "9", "label", "draw")
    return f"""WITH b AS (SELECT doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS x0, CAST(length(text) AS DOUBLE) AS x1
           FROM labels JOIN documents USING (doc_id)),
c AS (SELECT label, count(*) AS n_c, max(count(*)) OVER () AS n_max FROM b GROUP BY label),
r AS (SELECT b.*, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42')), doc_id) - 1 AS rn FROM b),
d AS (SELECT c.label, c.n_c, unnest(range(0, c.n_max - c.n_c)) AS draw FROM c),
pick AS (SELECT label, draw, CAST(('0x' || substr(md5(concat_ws(':', CAST(label AS VARCHAR), CAST(draw AS VARCHAR), '42')), 1, 12))::BIGINT % n_c AS BIGINT) AS rn,
                CAST(('0x' || substr(md5(concat_ws(':', CAST(label AS VARCHAR), CAST(draw AS VARCHAR), '42', 'near')), 1, 12))::BIGINT % 5 AS BIGINT) AS nn FROM d),
q AS (SELECT r.doc_id, r.label, r.x0, r.x1, pick.draw, pick.nn FROM pick JOIN r ON pick.label = r.label AND pick.rn = r.rn),
k AS (SELECT a.doc_id, b.x0 AS y0, b.x1 AS y1, row_number() OVER (PARTITION BY a.doc_id
             ORDER BY (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1), b.doc_id) - 1 AS nn
      FROM (SELECT DISTINCT doc_id, label, x0, x1 FROM q) a JOIN b ON a.label = b.label AND a.doc_id <> b.doc_id)
SELECT doc_id, label, CAST(-1 AS BIGINT) AS draw, round(x0, {R}) AS f0, round(x1, {R}) AS f1 FROM b
UNION ALL SELECT q.doc_id, q.label, q.draw, round(x0 + {u} * (y0 - x0), {R}), round(x1 + {u} * (y1 - x1), {R})
FROM q JOIN k ON q.doc_id = k.doc_id AND q.nn = k.nn"""


def _oversample_sql() -> str:
    return """WITH b AS (SELECT doc_id, quality AS label FROM labels),
c AS (SELECT label, count(*) AS n_c, max(count(*)) OVER () AS n_max FROM b GROUP BY label),
r AS (SELECT b.*, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42')), doc_id) - 1 AS rn FROM b),
d AS (SELECT c.label, c.n_c, unnest(range(0, c.n_max - c.n_c)) AS draw FROM c),
pick AS (SELECT label, draw, CAST(('0x' || substr(md5(concat_ws(':', CAST(label AS VARCHAR), CAST(draw AS VARCHAR), '42')), 1, 12))::BIGINT % n_c AS BIGINT) AS rn FROM d)
SELECT doc_id, label, CAST(-1 AS BIGINT) AS draw FROM r
UNION ALL
SELECT r.doc_id, r.label, pick.draw FROM pick JOIN r ON pick.label = r.label AND pick.rn = r.rn"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "class_counts": q_class_counts,
    "minority_share": q_minority_share,
    "num_classes": q_num_classes,
    "encode_label": q_encode_label,
    "derive_label_threshold": q_derive_label_threshold,
    "derive_label_contains": q_derive_label_contains,
    "replace_token": q_replace_token,
    "replace_values": q_replace_values,
    "fill_mode": q_fill_mode,
    "fill_mode_excl": q_fill_mode_excl,
    "fill_mode_all": q_fill_mode_all,
    "fill_mean": q_fill_mean,
    "fill_const": q_fill_const,
    "to_numeric": q_to_numeric,
    "fill_mean_token": q_fill_mean_token,
    "split_positions": q_split_positions,
    "stack_tables": q_stack_tables,
    "stratified_split": q_stratified_split,
    "stratified_split_labels": q_stratified_split_labels,
    "loo_train": q_loo_train,
    "loo_apply": q_loo_apply,
    "minmax": q_minmax,
    "standard": q_standard,
    "quantile_uniform": q_quantile_uniform,
    "quantile_normalize": q_quantile_normalize,
    "mi_knn": q_mi_knn,
    "mi_binned": q_mi_binned,
    "rank_features": q_rank_features,
    "soft_tree_score": q_soft_tree_score,
    "soft_tree_score_numpy": q_soft_tree_score_numpy,
    "soft_tree_predict": q_soft_tree_predict,
    "focal_loss": q_focal_loss,
    "gradient_step": q_gradient_step,
    "accuracy": q_accuracy,
    "f1_macro": q_f1_macro,
    "confusion": q_confusion,
    "oversample_random": q_oversample_random,
    "oversample_smote": q_oversample_smote,
    "train_epochs": q_train_epochs,
    "fit_soft_tree": q_fit_soft_tree,
    "run_trials": q_run_trials,
}


def _sql() -> dict[str, str]:
    tree_rows = _tree_sql_rows()
    pred = ("CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER)")
    return {
        "class_counts": ("SELECT CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS label, "
                         "count(*) AS n FROM orders GROUP BY o_orderstatus"),
        "minority_share": ("WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) "
                           "SELECT min(n) AS min_count, sum(n)::BIGINT AS total, count(*) AS n_classes, "
                           f"round(min(n) / sum(n), {R}) AS minority_share, "
                           "(min(n) / sum(n)) <= 0.25 / (count(*) - 1) AS needs_rebalance FROM c"),
        "num_classes": "SELECT count(DISTINCT o_orderstatus) AS num_classes FROM orders",
        "encode_label": f"SELECT o_orderkey, label FROM {ORDERS_CODED_SQL}",
        "derive_label_threshold": "SELECT event_id, COALESCE(CAST(value > 100 AS INTEGER), 0) AS label FROM events",
        "derive_label_contains": ("SELECT o_orderkey, COALESCE(CAST(contains(o_orderpriority, 'URGENT') AS INTEGER), 0) "
                                  "AS label FROM orders"),
        "replace_token": ("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '4-NOT SPECIFIED' "
                          "ELSE o_orderpriority END AS o_orderpriority FROM orders"),
        "replace_values": ("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'browse' "
                           "ELSE event_type END AS event_type FROM events"),
        "fill_mode": (f"SELECT event_id, CASE WHEN event_type = 'error' THEN {_mode_sql('events', 'event_type')} "
                      "ELSE event_type END AS event_type FROM events"),
        "fill_mode_excl": ("SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN "
                           f"{_mode_sql('orders', 'o_orderpriority', "o_orderpriority <> '4-NOT SPECIFIED'")} "
                           "ELSE o_orderpriority END AS o_orderpriority FROM orders"),
        "fill_mode_all": (f"SELECT o_orderkey, COALESCE(pri, {_mode_sql(ORDERS_NULLS_SQL, 'pri')}) AS pri, "
                          f"COALESCE(st, {_mode_sql(ORDERS_NULLS_SQL, 'st')}) AS st FROM {ORDERS_NULLS_SQL}"),
        "fill_mean": ("WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events) "
                      f"SELECT event_id, round(COALESCE(value, (SELECT avg(value) FROM e)), {R}) AS value FROM e"),
        "fill_const": f"SELECT o_orderkey, COALESCE(pri, 'UNKNOWN') AS pri FROM {ORDERS_NULLS_SQL}",
        "to_numeric": f"SELECT p_partkey, TRY_CAST(size_text AS DOUBLE) AS size_num FROM {PART_TOKENS_SQL}",
        "fill_mean_token": (f"WITH t AS (SELECT p_partkey, TRY_CAST(NULLIF(size_text, '?') AS DOUBLE) AS v FROM {PART_TOKENS_SQL}) "
                            f"SELECT p_partkey, round(COALESCE(v, (SELECT avg(v) FROM t)), {R}) AS size_num FROM t"),
        "split_positions": ("WITH t AS (SELECT p_partkey, trim(p_name) AS s, length(trim(p_name)) AS ln FROM part) "
                            "SELECT p_partkey, " + ", ".join(
                                f"CASE WHEN {i} < ln THEN substr(s, {i + 1}, 1) END AS c{i}"
                                for i in range(NAME_LENGTH)) + " FROM t"),
        "stack_tables": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL "
                         "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'"),
        "stratified_split": ("SELECT o_orderkey, label, split FROM "
                             + split_sql(f"(SELECT o_orderkey, label FROM {ORDERS_CODED_SQL})", "o_orderkey", "label", 42)),
        "stratified_split_labels": ("SELECT doc_id, label, split FROM "
                                    + split_sql("(SELECT doc_id, quality AS label FROM labels)", "doc_id", "label", 43)),
        "loo_train": _loo_sql(True),
        "loo_apply": _loo_sql(False),
        "minmax": ("WITH s AS (SELECT " + ", ".join(f"min({c}) AS mn{i}, max({c}) AS mx{i}" for i, c in enumerate(LINE_COLS))
                   + " FROM lineitem) SELECT " + ", ".join(
                       f"round(({c} - mn{i}) * (2.0 / CASE WHEN mx{i} = mn{i} THEN 1.0 ELSE mx{i} - mn{i} END) - 1.0, {R}) AS f{i}"
                       for i, c in enumerate(LINE_COLS)) + " FROM lineitem, s"),
        "standard": ("WITH s AS (SELECT " + ", ".join(f"avg({c}) AS mu{i}, stddev_pop({c}) AS sd{i}" for i, c in enumerate(LINE_COLS))
                     + " FROM lineitem) SELECT " + ", ".join(
                         f"round(({c} - mu{i}) / CASE WHEN sd{i} = 0 THEN 1.0 ELSE sd{i} END, {R}) AS f{i}"
                         for i, c in enumerate(LINE_COLS)) + " FROM lineitem, s"),
        "quantile_uniform": _quantile_sql("u"),
        "quantile_normalize": _quantile_sql("z"),
        "mi_binned": _mi_binned_sql(16),
        "mi_knn": _mi_knn_sql(f"SELECT CAST(feature AS INTEGER) AS feature, round(mi, {R}) AS mi FROM mi"),
        "rank_features": _mi_knn_sql("SELECT CAST(feature AS INTEGER) AS feature, "
                                     "CAST(row_number() OVER (ORDER BY mi DESC, feature ASC) AS INTEGER) AS rank FROM mi"),
        "soft_tree_score": tree_rows + f"\nSELECT o_orderkey, round(s0, {R}) AS s0, round(s1, {R}) AS s1, round(s2, {R}) AS s2 FROM s",
        "soft_tree_score_numpy": tree_rows + f"\nSELECT o_orderkey, round(s0, {R}) AS s0, round(s1, {R}) AS s1, round(s2, {R}) AS s2 FROM s",
        "soft_tree_predict": tree_rows + f"\nSELECT o_orderkey, label, {pred} AS prediction FROM s",
        "focal_loss": tree_rows + f"\nSELECT round(avg(loss), {R}) AS focal_loss FROM gg",
        "gradient_step": _gradient_sql(),
        "accuracy": tree_rows + f"\nSELECT round(avg(CASE WHEN label = {pred} THEN 1.0 ELSE 0.0 END), {R}) AS accuracy FROM s",
        "f1_macro": tree_rows + f""",
pp AS (SELECT label, {pred} AS prediction FROM s),
cf AS (SELECT label, prediction, count(*) AS n FROM pp GROUP BY ALL),
per AS (SELECT label AS cls, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, 0 AS fp,
               CASE WHEN label = prediction THEN 0 ELSE n END AS fn FROM cf
        UNION ALL SELECT prediction, 0, CASE WHEN label = prediction THEN 0 ELSE n END, 0 FROM cf),
pc AS (SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM per GROUP BY cls)
SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), {R}) AS f1_macro FROM pc""",
        "confusion": tree_rows + f"\nSELECT label, {pred} AS prediction, count(*) AS n FROM s GROUP BY ALL",
        "oversample_random": _oversample_sql(),
        "oversample_smote": _smote_sql(),
        "train_epochs": _train_epochs_sql(),
    }


def _positive_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB keeps the
    sign of a value rounded to zero (-0.0), Spark does not."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero(sql[j + len(key):k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


ORACLE_SQL = {k: _positive_zero(v) for k, v in _sql().items()}
