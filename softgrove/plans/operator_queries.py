"""More operators over the driver's tables, each with its DuckDB SQL: scans of
delimited files, positional zip, selection, softmax and its kin, noisy
quantile fits, normalizer switch, deep trees, evaluation, rebalancing,
encodings of many levels and trial summaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.functions.columns import CLIP_HIGH, CLIP_LOW, keyed_gaussian_sql, norm_ppf_sql, permute, softmax
from softgrove.operators import clean, evaluate as ev, labels as lab
from softgrove.operators.balance import rebalance
from softgrove.operators.encode import LeaveOneOut
from softgrove.operators.normalize import QuantileNormalizer, normalize
from softgrove.operators.split import stratified_split
from softgrove.operators.tree import SoftTreeModel, assign_features, focal_loss, score
from softgrove.plans import table_queries as tq
from softgrove.plans.trials import summarize_trials
from softgrove.session import materialize, shared_dir
from softgrove.sources.tables import read_table, read_tables, zip_by_position

R = tq.R
_t, _r = tq._t, tq._r


def _written(spark: SparkSession, df: DataFrame, **options) -> str:
    """The rows as delimited files in the shared checkpoint folder."""
    path = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    df.write.options(**options).csv(path)
    return path


def _parts(spark, sf):
    size = F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.col("p_size"))
    return _t(spark, sf, "part").select("p_partkey", "p_name", size.alias("p_size"))


PARTS_SQL = "SELECT p_partkey, p_name, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS p_size FROM part"


def q_scan_headerless(spark, sf):
    """Headerless files, own separator and null token, declared types."""
    path = _written(spark, _parts(spark, sf), sep=";", nullValue="?")
    df = read_table(spark, path, ["p_partkey", "p_name", "p_size"], sep=";", null_token="?", types={"p_partkey": "long", "p_size": "double"})
    return df.select("p_partkey", "p_name", "p_size")


def q_scan_header(spark, sf):
    """Files with their own header line."""
    path = _written(spark, _parts(spark, sf), header=True, nullValue="?")
    df = read_table(spark, path, header=True, null_token="?", types={"p_partkey": "long", "p_size": "double"})
    return df.select("p_partkey", "p_name", "p_size")


def q_scan_several(spark, sf):
    """Several files of one layout, stacked."""
    own = _parts(spark, sf)
    paths = [_written(spark, own.where(F.col("p_partkey") % 2 == k), nullValue="?") for k in (0, 1)]
    df = read_tables(spark, paths, columns=["p_partkey", "p_name", "p_size"], null_token="?", types={"p_partkey": "long", "p_size": "double"})
    return df.select("p_partkey", "p_name", "p_size")


def q_zip_by_position(spark, sf):
    """Two column sets of one file, paired again by position."""
    o = _t(spark, sf, "orders")
    return zip_by_position(o.select("o_orderkey"), o.select("o_orderstatus", "o_totalprice")).select(
        "row_id", "o_orderkey", "o_orderstatus", "o_totalprice")


def q_select_columns(spark, sf):
    return clean.select_columns(_t(spark, sf, "customer"), ["c_nationkey", "c_custkey", "c_name"])


def q_drop_columns(spark, sf):
    s = _t(spark, sf, "supplier")
    return clean.drop_columns(s, [c for c in s.columns if c not in ("s_suppkey", "s_nationkey")])


def q_fill_mode_chosen(spark, sf):
    """Mode of chosen columns only; the others keep their NULLs."""
    e = _t(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("a"),
                                       F.when(F.col("event_type") != "view", F.col("event_type")).alias("b"))
    return clean.fill_mode(e, ["a"]).select("event_id", "a", "b")


SCORES = ("l_discount * 50", "l_tax * 40", "l_quantity / 10")


def _scores(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(*[F.expr(f"CAST({s} AS DOUBLE)") for s in SCORES]).alias("scores"),
                                            (F.col("l_linenumber") % 3).cast("int").alias("label"))


def q_softmax(spark, sf):
    p = _scores(spark, sf).withColumn("p", softmax(F.col("scores")))
    return p.select("l_orderkey", "l_linenumber", *[_r(F.col("p")[k], f"p{k}") for k in range(3)])


def q_permute(spark, sf):
    """Features in another order."""
    p = _scores(spark, sf).withColumn("p", permute(F.col("scores"), [2, 0, 1]))
    return p.select("l_orderkey", "l_linenumber", *[_r(F.col("p")[k], f"p{k}") for k in range(3)])


def q_focal_none(spark, sf):
    p = focal_loss(_scores(spark, sf), reduction="none")
    return p.select("l_orderkey", "l_linenumber", _r(F.col("focal_loss"), "focal_loss"))


def q_focal_sum(spark, sf):
    p = focal_loss(_scores(spark, sf), reduction="sum", by=["label"])
    return p.select("label", F.round("focal_loss", 3).alias("focal_loss"))


_SM = "WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 3 AS INTEGER) AS label, " + ", ".join(
    f"CAST({s} AS DOUBLE) AS s{k}" for k, s in enumerate(SCORES)) + " FROM lineitem), e AS (SELECT *, greatest(s0, s1, s2) AS m FROM b), " \
    "z AS (SELECT *, exp(s0 - m) + exp(s1 - m) + exp(s2 - m) AS z FROM e), " \
    "f AS (SELECT *, (CASE label WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END) - m - ln(z) AS lp FROM z), " \
    "g AS (SELECT *, -power(1 - exp(lp), 2) * lp AS loss FROM f) "


def _price(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.array("o_totalprice").alias("features"))


NOISE = 50_000.0


def q_quantile_noise(spark, sf):
    """Grid of a noisy copy, transform of the values themselves."""
    df = _price(spark, sf)
    out = QuantileNormalizer(noise=NOISE, n_quantiles=200, seed=7).fit(df).transform(df)
    return out.select(F.col("row_id").alias("o_orderkey"), F.round(F.col("features")[0], 4).alias("z"))


def _quantile_noise_sql() -> str:
    return f"""WITH sd AS (SELECT {NOISE!r} / greatest(stddev_pop(o_totalprice), {NOISE!r}) AS k FROM orders),
g AS (SELECT quantile_cont(o_totalprice + k * {keyed_gaussian_sql(7, '0', 'o_orderkey')}, list_transform(range(0, 200), lambda i: i / 199.0)) AS grid FROM orders, sd),
s AS (SELECT o_orderkey, o_totalprice AS x, grid, len(list_filter(grid, lambda v: v < o_totalprice)) AS a,
             len(list_filter(grid, lambda v: v <= o_totalprice)) AS b FROM orders, g),
uu AS (SELECT o_orderkey, CASE WHEN x - 1e-7 < grid[1] THEN 0.0 WHEN x + 1e-7 > grid[len(grid)] THEN 1.0
         WHEN a < b THEN (a + b - 1) / (2.0 * (len(grid) - 1)) ELSE ((a - 1) + (x - grid[a]) / (grid[a + 1] - grid[a])) / (len(grid) - 1) END AS u FROM s)
SELECT o_orderkey, round(CASE WHEN u <= 0 THEN {CLIP_LOW!r} WHEN u >= 1 THEN {CLIP_HIGH!r}
       ELSE least(greatest({norm_ppf_sql('u')}, {CLIP_LOW!r}), {CLIP_HIGH!r}) END, 4) AS z FROM uu"""


def q_normalize_reuse(spark, sf):
    """Fitted on the finished orders by name, applied to the open ones."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("features"))
    _, fitted = normalize(o.where("o_orderstatus = 'F'"), "min-max")
    out, _ = normalize(o.where("o_orderstatus <> 'F'"), "min-max", fitted)
    return out.select("o_orderkey", _r(F.col("features")[0], "f0"), _r(F.col("features")[1], "f1"))


DEEP = 8


def _deep_tree() -> SoftTreeModel:
    """A depth-8 tree with parameters by rule, so that SQL can make them."""
    import numpy as np
    n = 2 ** DEEP
    return SoftTreeModel(DEEP, 3, assign_features([1, 0], DEEP)[:2], np.array([(i % 13) / 4.0 - 1.5 for i in range(n - 1)]),
                         np.array([[((leaf * 7 + c * 5) % 11) / 11.0 for c in range(3)] for leaf in range(n)]))


def _customers(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3).cast("int").alias("label"), F.array(
        F.col("c_acctbal").cast("double") / 2000, F.col("c_nationkey").cast("double") / 8).alias("features"))


def q_tree_depth8(spark, sf):
    s = score(_customers(spark, sf), _deep_tree())
    return s.select("c_custkey", *[_r(F.col("scores")[c], f"s{c}") for c in range(3)])


def q_tree_depth8_fold(spark, sf):
    """The same without Python workers."""
    s = score(_customers(spark, sf), _deep_tree(), mode="fold")
    return s.select("c_custkey", *[_r(F.col("scores")[c], f"s{c}") for c in range(3)])


def _deep_sql() -> str:
    order = _deep_tree().node_features()
    assert list(order[:2]) == [1, 0]
    return f"""WITH leaf AS (SELECT l, unnest(range(0, {DEEP})) AS d FROM (SELECT unnest(range(0, {2 ** DEEP})) AS l)),
path AS (SELECT l, (1 << d) - 1 + (l >> ({DEEP} - d)) AS node, (l >> ({DEEP} - 1 - d)) & 1 AS side FROM leaf),
x AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 2000 AS x0, CAST(c_nationkey AS DOUBLE) / 8 AS x1 FROM customer),
node AS (SELECT c_custkey, n, 1.0 / (1.0 + exp((CASE WHEN n % 2 = 0 THEN x1 ELSE x0 END) - ((n % 13) / 4.0 - 1.5))) AS p
         FROM x, (SELECT unnest(range(0, {2 ** DEEP - 1})) AS n)),
prob AS (SELECT c_custkey, l, product(CASE WHEN side = 0 THEN p ELSE 1 - p END) AS p
         FROM node JOIN path ON node.n = path.node GROUP BY c_custkey, l),
sc AS (SELECT c_custkey, """ + ", ".join(f"sum(p * (((l * 7 + {c * 5}) % 11) / 11.0)) AS s{c}" for c in range(3)) + " FROM prob GROUP BY c_custkey)"


def q_evaluate(spark, sf):
    """Accuracy and macro F1 of the depth-8 tree, by nation's half."""
    df = _customers(spark, sf).withColumn("half", (F.col("c_custkey") % 2).cast("int"))
    got, _ = ev.evaluate(df, _deep_tree(), by=["half"])
    return spark.createDataFrame([(h[0], round(m["accuracy"], R), round(m["f1_macro"], R)) for h, m in sorted(got.items())],
                                 "half int, accuracy double, f1_macro double")


def _evaluate_sql() -> str:
    return _deep_sql() + f""",
p AS (SELECT CAST(c_custkey % 2 AS INTEGER) AS half, CAST(c_custkey % 3 AS INTEGER) AS y,
             CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS q FROM sc),
k AS (SELECT half, c, count(*) FILTER (y = c AND q = c) AS tp, count(*) FILTER (y <> c AND q = c) AS fp,
             count(*) FILTER (y = c AND q <> c) AS fn FROM p, (SELECT unnest([0, 1, 2]) AS c) GROUP BY half, c),
f AS (SELECT half, avg(2.0 * tp / (2 * tp + fp + fn)) AS f1 FROM k WHERE tp + fp + fn > 0 GROUP BY half)
SELECT half, round((SELECT avg(CASE WHEN y = q THEN 1.0 ELSE 0.0 END) FROM p WHERE p.half = f.half), {R}) AS accuracy, round(f1, {R}) AS f1_macro FROM f"""


def q_rebalance(spark, sf):
    """Few toxic documents: the rare class is oversampled."""
    df = _t(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return rebalance(df, "label", "doc_id", ratio=0.25, seed=42).select("doc_id", "label")


def q_rebalance_not_needed(spark, sf):
    df = _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return rebalance(df, "label", "doc_id", ratio=0.01, seed=42).select("doc_id", "label")


def q_loo_many_levels(spark, sf):
    """Leave-one-out encoding of the customer of each order."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    df = materialize(stratified_split(o, key="o_orderkey", seed=42))
    enc = LeaveOneOut(["o_custkey"]).fit(df).transform(df, out_suffix="_enc")
    return enc.select("o_orderkey", "split", _r(F.col("o_custkey_enc"), "enc"))


def _loo_many_sql() -> str:
    o = "(SELECT o_orderkey, o_custkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"
    return f"""WITH s AS (SELECT * FROM {tq.split_sql(o, "o_orderkey", "label", 42)}),
st AS (SELECT o_custkey, sum(label)::DOUBLE AS t, count(*) AS n FROM s WHERE split = 'train' GROUP BY o_custkey),
mu AS (SELECT avg(label) AS m FROM s WHERE split = 'train')
SELECT o_orderkey, split, round(CASE WHEN n IS NULL OR n <= 1 THEN m WHEN split = 'train' THEN (t - label) / (n - 1) ELSE t / n END, {R}) AS enc
FROM s CROSS JOIN mu LEFT JOIN st USING (o_custkey)"""


def q_encode_many_levels(spark, sf):
    """Codes of the customers, in numeric order."""
    coded, _ = lab.encode_label(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", out="code", keep=True)
    return coded.select("o_orderkey", "o_custkey", "code")


def q_summarize_trials(spark, sf):
    """Summary by name and depth of rows shaped like trial results."""
    c = _t(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("name"), (8 + 3 * (F.col("c_custkey") % 2)).cast("int").alias("Depth"),
        (F.col("c_acctbal") / 1000).cast("double").alias("Test Accuracy"), (F.col("c_nationkey") / 25).cast("double").alias("Test F1 Macro"),
        F.col("c_custkey").cast("double").alias("Train Time"), (F.col("c_custkey") / 7).cast("double").alias("Test Accuracy Time"))
    s = summarize_trials(c)
    return s.select(F.col("Dataset Name").alias("name"), F.col("Depth").alias("depth"), _r(F.col("Mean Test Accuracy"), "mean_acc"),
                    _r(F.col("Std Test Accuracy"), "std_acc"), _r(F.col("Mean F1 Score"), "mean_f1"), _r(F.col("Std F1 Score"), "std_f1"),
                    _r(F.col("Mean Training Time"), "train_time"), _r(F.col("Mean Test Acc Time"), "test_time"))


def _summary_sql() -> str:
    return f"""SELECT c_mktsegment AS name, CAST(8 + 3 * (c_custkey % 2) AS INTEGER) AS depth, round(avg(c_acctbal / 1000), {R}) AS mean_acc,
round(stddev_pop(c_acctbal / 1000), {R}) AS std_acc, round(avg(c_nationkey / 25.0), {R}) AS mean_f1, round(stddev_pop(c_nationkey / 25.0), {R}) AS std_f1,
round(avg(c_custkey), {R}) AS train_time, round(avg(c_custkey / 7.0), {R}) AS test_time FROM customer GROUP BY 1, 2"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_headerless": q_scan_headerless,
    "scan_header": q_scan_header,
    "scan_several": q_scan_several,
    "zip_by_position": q_zip_by_position,
    "select_columns": q_select_columns,
    "drop_columns": q_drop_columns,
    "fill_mode_chosen": q_fill_mode_chosen,
    "softmax": q_softmax,
    "permute": q_permute,
    "focal_none": q_focal_none,
    "focal_sum": q_focal_sum,
    "quantile_noise": q_quantile_noise,
    "normalize_reuse": q_normalize_reuse,
    "tree_depth8": q_tree_depth8,
    "tree_depth8_fold": q_tree_depth8_fold,
    "evaluate": q_evaluate,
    "rebalance": q_rebalance,
    "rebalance_not_needed": q_rebalance_not_needed,
    "loo_many_levels": q_loo_many_levels,
    "encode_many_levels": q_encode_many_levels,
    "summarize_trials": q_summarize_trials,
}


def _sql() -> dict[str, str]:
    line = "SELECT l_orderkey, l_linenumber, "
    return {
        "scan_headerless": PARTS_SQL, "scan_header": PARTS_SQL, "scan_several": PARTS_SQL,
        "zip_by_position": "SELECT row_number() OVER () - 1 AS row_id, o_orderkey, o_orderstatus, o_totalprice FROM orders",
        "select_columns": "SELECT c_nationkey, c_custkey, c_name FROM customer",
        "drop_columns": "SELECT s_suppkey, s_nationkey FROM supplier",
        "fill_mode_chosen": ("WITH e AS (SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS a, "
                             "CASE WHEN event_type <> 'view' THEN event_type END AS b FROM events), "
                             "m AS (SELECT a FROM e WHERE a IS NOT NULL GROUP BY a ORDER BY count(*) DESC, a LIMIT 1) "
                             "SELECT event_id, coalesce(e.a, m.a) AS a, b FROM e, m"),
        "softmax": _SM + line + ", ".join(f"round(exp(s{k} - m) / z, {R}) AS p{k}" for k in range(3)) + " FROM z",
        "permute": _SM + line + f"round(s2, {R}) AS p0, round(s0, {R}) AS p1, round(s1, {R}) AS p2 FROM b",
        "focal_none": _SM + line + f"round(loss, {R}) AS focal_loss FROM g",
        "focal_sum": _SM + "SELECT label, round(sum(loss), 3) AS focal_loss FROM g GROUP BY label",
        "quantile_noise": _quantile_noise_sql(),
        "normalize_reuse": ("WITH f AS (SELECT min(o_totalprice) AS a0, max(o_totalprice) AS b0, min(o_custkey) AS a1, max(o_custkey) AS b1 "
                            "FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, "
                            f"round((o_totalprice - a0) * (2.0 / (b0 - a0)) - 1.0, {R}) AS f0, round((o_custkey - a1) * (2.0 / (b1 - a1)) - 1.0, {R}) AS f1 "
                            "FROM orders, f WHERE o_orderstatus <> 'F'"),
        "tree_depth8": _deep_sql() + f"\nSELECT c_custkey, round(s0, {R}) AS s0, round(s1, {R}) AS s1, round(s2, {R}) AS s2 FROM sc",
        "tree_depth8_fold": _deep_sql() + f"\nSELECT c_custkey, round(s0, {R}) AS s0, round(s1, {R}) AS s1, round(s2, {R}) AS s2 FROM sc",
        "evaluate": _evaluate_sql(),
        "rebalance": "SELECT doc_id, label FROM (" + tq._oversample_sql().replace("quality AS label", "toxic AS label") + ")",
        "rebalance_not_needed": "SELECT doc_id, quality AS label FROM labels",
        "loo_many_levels": _loo_many_sql(),
        "encode_many_levels": "SELECT o_orderkey, o_custkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS code FROM orders",
        "summarize_trials": _summary_sql(),
    }


ORACLE_SQL = {k: tq._positive_zero(v) for k, v in _sql().items()}
