"""Queries over whole flows, each with its DuckDB SQL: further kinds of files,
sinks read back, catalogue recipes, preparation, early stopping."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.config import EngineConfig
from softgrove.operators.normalize import QuantileFitState, QuantileNormalizer
from softgrove.operators.split import stratified_split
from softgrove.operators.train import epoch_job, fit_soft_trees, pack_blocks
from softgrove.plans import operator_queries as oq
from softgrove.plans import table_queries as tq
from softgrove.plans.prepare import pack_trials, preprocess
from softgrove.plans.trials import summarize_trials, write_summary, write_trials
from softgrove.session import shared_dir
from softgrove.sources.catalog import TableSpec, prepare_table
from softgrove.sources.tables import read_table, read_xy

R = tq.R
_t, _r = tq._t, tq._r
TYPES = {"p_partkey": "long", "p_size": "double"}


def q_scan_header_replaced(spark, sf):
    """Files whose header line gives way to other names."""
    path = oq._written(spark, oq._parts(spark, sf).toDF("a", "b", "c"), header=True, nullValue="?")
    return read_table(spark, path, ["p_partkey", "p_name", "p_size"], header=True, null_token="?", types=TYPES)


def q_scan_preamble(spark, sf):
    """Lines of a preamble: some marked, one with the column names."""
    rows = oq._parts(spark, sf).select(*[F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_size")])
    head = spark.createDataFrame([(";;; a table of parts", None, None), ("KEY", "NAME", "SIZE"), (";", None, None)], rows.schema)
    path = oq._written(spark, head.unionByName(rows), nullValue="?")
    return read_table(spark, path, ["p_partkey", "p_name", "p_size"], null_token="?", comment=";", types=TYPES,
                      drop_if=lambda: F.col("p_partkey").isNotNull() & F.col("p_partkey").try_cast("long").isNull())


def q_scan_xy(spark, sf):
    """A file of features and one of labels, paired by position."""
    parts = _t(spark, sf, "part")
    x = oq._written(spark, parts.select("p_partkey", "p_size"), header=True)
    y = oq._written(spark, parts.select("p_name"), header=True)
    # one folder each: what _written makes has the rows in the same order
    both = read_xy(spark, x, y)
    return both.select("row_id", F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"), "p_name")


def _trial_rows(spark, sf):
    c = _t(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select((k % 10 + 1).cast("int").alias("Trial"), (k % 10 + 42).cast("int").alias("Seed"), F.col("c_mktsegment").alias("name"),
                    F.lit(8).alias("Depth"), k.cast("int").alias("Optimal Epoch"), (F.col("c_nationkey") / 25).alias("Test Accuracy"),
                    (F.col("c_acctbal") / 1000).cast("double").alias("Test F1 Macro"), F.lit(1.0).alias("Train Time"), F.lit(0.5).alias("Test Accuracy Time"))


def q_trial_sink(spark, sf):
    """Trial rows written by trial; a later run of one trial takes the place of
    its rows only."""
    path = f"{shared_dir(spark)}/trials-{uuid.uuid4().hex}"
    rows = _trial_rows(spark, sf)
    write_trials(rows, path)
    write_trials(rows.where("Trial = 3").withColumn("Seed", F.col("Seed") + 100), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("Trial").cast("int").alias("trial"), F.col("name")).agg(
        F.count("*").alias("n"), F.sum(F.col("Seed").cast("long")).alias("seeds"), F.sum(F.col("Optimal Epoch").cast("long")).alias("epochs"))


def q_summary_sink(spark, sf):
    path = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    write_summary(summarize_trials(_trial_rows(spark, sf)), path)
    s = spark.read.option("header", True).csv(path)
    return s.select(F.col("Dataset Name").alias("name"), F.col("Depth").cast("int").alias("depth"),
                    *[_r(F.col(c).cast("double"), n) for c, n in (("Mean Test Accuracy", "mean_acc"), ("Std Test Accuracy", "std_acc"), ("Mean F1 Score", "mean_f1"))])


def q_catalog_recipe(spark, sf):
    """A recipe over a file with its own header: chosen columns, a mean for
    missing numbers, a constant for missing words, a label that is one already."""
    c = _t(spark, sf, "customer")
    k = F.col("c_custkey")
    path = oq._written(spark, c.select("c_custkey", (k % 2).alias("y"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("bal"),
                                       F.when(k % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation")), header=True)
    root, name = path.rsplit("/", 1)
    spec = TableSpec("customers", [name], None, "y", header=True, label_rule="passthrough", select=["nation", "bal", "segment", "c_custkey"],
                     categorical=["segment"], impute=[("fill_mean", {"cols": ["bal"]}), ("fill_const", {"values": {"segment": "NONE"}})])
    df, _, _ = prepare_table(spark, spec, root)
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "nation", _r(F.col("bal"), "bal"), "segment", "label")


def q_prepare(spark, sf):
    """Split, leave-one-out encoding and min-max scaling of the orders."""
    o = tq.orders_coded(spark, sf).select(F.col("o_orderkey").alias("row_id"), "label", "o_orderpriority", "o_totalprice")
    cfg = EngineConfig(normalization="min-max")
    p = preprocess(o, ["o_orderpriority", "o_totalprice"], ["o_orderpriority"], cfg=cfg, seeds=[42])
    return p.select(F.col("row_id").alias("o_orderkey"), "trial", "seed", "split", "label", _r(F.col("features")[0], "f0"), _r(F.col("features")[1], "f1"))


def q_prepare_packed(spark, sf):
    """The same for two seeds, from rows kept once with the splits of both."""
    o = tq.orders_coded(spark, sf).select(F.col("o_orderkey").alias("row_id"), "label", "o_orderpriority", "o_totalprice")
    cfg = EngineConfig(normalization="min-max")
    p = pack_trials(o, ["o_orderpriority", "o_totalprice"], ["o_orderpriority"], cfg=cfg, seeds=[42, 43]).prepare(cfg)
    return p.select(F.col("row_id").alias("o_orderkey"), "trial", "seed", "split", "label", _r(F.col("features")[0], "f0"), _r(F.col("features")[1], "f1"))


def _prepare_sql(trial: int = 1, seed: int = 42) -> str:
    base = f"(SELECT o_orderkey, label, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS price FROM {tq.ORDERS_CODED_SQL})"
    return f"""WITH s AS (SELECT * FROM {tq.split_sql(base, "o_orderkey", "label", seed)}),
st AS (SELECT o_orderpriority AS c, sum(label)::DOUBLE AS t, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1),
mu AS (SELECT avg(label) AS m FROM s WHERE split = 'train'),
e AS (SELECT s.*, CASE WHEN n IS NULL OR n <= 1 THEN m WHEN split = 'train' THEN (t - label) / (n - 1) ELSE t / n END AS enc
      FROM s CROSS JOIN mu LEFT JOIN st ON s.o_orderpriority = st.c),
b AS (SELECT min(enc) AS a0, max(enc) AS b0, min(price) AS a1, max(price) AS b1 FROM e WHERE split = 'train')
SELECT o_orderkey, CAST({trial} AS INTEGER) AS trial, CAST({seed} AS INTEGER) AS seed, split, label,
       round((enc - a0) * (2.0 / (b0 - a0)) - 1.0, {R}) AS f0, round((price - a1) * (2.0 / (b1 - a1)) - 1.0, {R}) AS f1 FROM e, b"""


def q_prepare_rebalanced(spark, sf):
    """The same with few rows of one class: its training rows are drawn again."""
    d = _t(spark, sf, "documents").select("doc_id", "n_chars").join(_t(spark, sf, "labels").select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")
    cfg = EngineConfig(normalization="min-max", rebalance="random", balance_ratio=0.5)
    p = preprocess(d, ["n_chars"], label="label", key="doc_id", cfg=cfg, seeds=[42, 43])
    return p.groupBy("trial", "seed", "split", "label").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_ids"))


def _prepare_rebalanced_sql() -> str:
    base = "(SELECT doc_id, CAST(toxic AS INTEGER) AS label FROM labels JOIN documents USING (doc_id))"
    one = lambda t, s: f"SELECT {t} AS trial, {s} AS seed, doc_id, label, split FROM {tq.split_sql(base, 'doc_id', 'label', s)}"
    pick = "('0x' || substr(md5(concat_ws(':', d.cls, CAST(draw AS VARCHAR), '42')), 1, 12))::BIGINT"
    return f"""WITH s AS ({one(1, 42)} UNION ALL {one(2, 43)}),
tr AS (SELECT *, trial || ':' || label AS cls FROM s WHERE split = 'train'),
c AS (SELECT trial, seed, label, cls, count(*) AS n_c FROM tr GROUP BY ALL),
m AS (SELECT max(n_c) AS n_max, (SELECT min(k) / sum(k) <= 0.5 / (count(*) - 1) FROM (SELECT sum(n_c) AS k FROM c GROUP BY label)) AS small FROM c),
r AS (SELECT tr.*, row_number() OVER (PARTITION BY cls ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42')), doc_id) - 1 AS rn FROM tr),
d AS (SELECT trial, seed, label, cls, n_c, unnest(range(0, CASE WHEN small THEN n_max - n_c ELSE 0 END)) AS draw FROM c, m),
p AS (SELECT d.trial, d.seed, d.label, r.doc_id FROM d JOIN r ON d.cls = r.cls AND r.rn = {pick} % d.n_c),
a AS (SELECT trial, seed, split, label, doc_id FROM s UNION ALL SELECT trial, seed, 'train', label, doc_id FROM p)
SELECT CAST(trial AS INTEGER) AS trial, CAST(seed AS INTEGER) AS seed, split, label, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM a GROUP BY ALL"""


def q_quantile_refit(spark, sf):
    """Quantile fit of the orders in two parts, by price: the first part's
    state is stored and read back, the second's merged with it, and all orders
    are normalized by the merged fit."""
    norm = QuantileNormalizer(noise=0.0, n_quantiles=1000)
    o = tq._price(spark, sf).withColumn("dear", F.get("features", F.lit(0)) > 150000)
    path = f"{shared_dir(spark)}/quantiles-{uuid.uuid4().hex}"
    norm.state(o.where("NOT dear")).write(path)
    state = QuantileFitState.read(spark, path)
    state = state.merge(norm.state(o.where("dear"), base=state))
    out = norm.fit_state(state).transform(o)
    return out.select(F.col("row_id").alias("o_orderkey"), _r(F.col("features")[0], "z"))


#: Name, least improvement, patience, largest number of epochs.
STOPS = (("patience", 0.5, 3, 50), ("improving", 1e-9, 2, 5), ("some", 4e-3, 2, 6))
STOP_EPOCHS = 8


def q_early_stopping(spark, sf):
    """Training of the depth-2 tree until it stops, by three rules: where it
    stops, which epoch was best, and the restored tree and its loss."""
    df = stratified_split(tq._tree_input(spark, sf), key="o_orderkey", seed=42).withColumn("trial", F.lit(1))
    blocks, rows = pack_blocks(df.where("split <> 'test'")).cache(), []
    for name, least, patience, most in STOPS:
        cfg = EngineConfig(min_improvement=least, patience=patience, max_epochs=most)
        fit = fit_soft_trees(df, {1: tq._tree_model()}, cfg, epochs_per_job=3)
        st, model = fit.stats[1], fit.models[1]
        sums = epoch_job(blocks, {1: model}, cfg.alpha, cfg.gamma)[1]
        rows.append((name, int(st["stop_epoch"]), int(st["best_epoch"]), round(sums["valid_loss"] / sums["n_valid"], R), round(st["last_valid_loss"], R),
                     *[round(float(v), R) for v in np.concatenate([model.thresholds, model.leaves[0]])]))
    blocks.unpersist()
    return spark.createDataFrame(rows, "rule string, stop_epoch int, best_epoch int, restored_loss double, last_loss double, "
                                 + ", ".join(f"w{k} double" for k in range(6)))


def _early_stopping_sql() -> str:
    losses = " UNION ALL ".join(f"SELECT {k} AS epoch, vl, " + ", ".join(f"w{i}" for i in range(6)) + f" FROM t{k}, a{k}" for k in range(1, STOP_EPOCHS + 1))
    rules = ", ".join(f"('{n}', CAST({a!r} AS DOUBLE), {p}, {m})" for n, a, p, m in STOPS)
    return tq.epochs_sql(STOP_EPOCHS) + f""",
loss AS MATERIALIZED ({losses}),
rule(name, least, patience, most) AS (VALUES {rules}),
run(name, least, patience, most, epoch, best, best_epoch, waited, stopped) AS (
  SELECT name, least, patience, most, 0, CAST('inf' AS DOUBLE), 0, 0, FALSE FROM rule
  UNION ALL
  SELECT name, least, patience, most, loss.epoch, CASE WHEN best - vl > least THEN vl ELSE best END,
         CASE WHEN best - vl > least THEN loss.epoch ELSE best_epoch END, CASE WHEN best - vl > least THEN 0 ELSE waited + 1 END,
         (CASE WHEN best - vl > least THEN 0 ELSE waited + 1 END) >= patience OR loss.epoch >= most
  FROM run JOIN loss ON loss.epoch = run.epoch + 1 WHERE NOT stopped)
SELECT run.name AS rule, CAST(run.epoch AS INTEGER) AS stop_epoch, CAST(best_epoch AS INTEGER) AS best_epoch, round(b.vl, {R}) AS restored_loss,
       round(l.vl, {R}) AS last_loss, """ + ", ".join(f"round(b.w{i}, {R}) AS w{i}" for i in range(6)) + """
FROM run JOIN loss b ON b.epoch = best_epoch JOIN loss l ON l.epoch = run.epoch WHERE stopped"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_header_replaced": q_scan_header_replaced,
    "scan_preamble": q_scan_preamble,
    "scan_xy": q_scan_xy,
    "trial_sink": q_trial_sink,
    "summary_sink": q_summary_sink,
    "catalog_recipe": q_catalog_recipe,
    "prepare": q_prepare,
    "prepare_packed": q_prepare_packed,
    "prepare_rebalanced": q_prepare_rebalanced,
    "early_stopping": q_early_stopping,
    "quantile_refit": q_quantile_refit,
}

_SQL = {
    "scan_header_replaced": oq.PARTS_SQL,
    "scan_preamble": oq.PARTS_SQL,
    "scan_xy": "SELECT row_number() OVER () - 1 AS row_id, CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, p_name FROM part",
    "trial_sink": ("SELECT CAST(c_custkey % 10 + 1 AS INTEGER) AS trial, c_mktsegment AS name, count(*) AS n, "
                   "CAST(sum(c_custkey % 10 + 42 + CASE WHEN c_custkey % 10 = 2 THEN 100 ELSE 0 END) AS BIGINT) AS seeds, "
                   "CAST(sum(c_custkey) AS BIGINT) AS epochs FROM customer GROUP BY 1, 2"),
    "summary_sink": (f"SELECT c_mktsegment AS name, CAST(8 AS INTEGER) AS depth, round(avg(c_nationkey / 25.0), {R}) AS mean_acc, "
                     f"round(stddev_pop(c_nationkey / 25.0), {R}) AS std_acc, round(avg(c_acctbal / 1000), {R}) AS mean_f1 FROM customer GROUP BY 1"),
    "catalog_recipe": ("WITH m AS (SELECT avg(c_acctbal) AS m FROM customer WHERE c_custkey % 5 <> 0) "
                       f"SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, round(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal ELSE m END, {R}) AS bal, "
                       "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE 'NONE' END AS segment, CAST(c_custkey % 2 AS INTEGER) AS label FROM customer, m"),
    "prepare": _prepare_sql(),
    "prepare_packed": f"SELECT * FROM ({_prepare_sql()}) UNION ALL SELECT * FROM ({_prepare_sql(2, 43)})",
    "prepare_rebalanced": _prepare_rebalanced_sql(),
    "early_stopping": _early_stopping_sql(),
    "quantile_refit": tq._quantile_sql("z"),
}
ORACLE_SQL = {k: tq._positive_zero(v) for k, v in _SQL.items()}
