"""Rows kept once for all trials give what rows written once per seed give."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from softgrove.config import EngineConfig
from softgrove.plans.prepare import pack_trials, preprocess
from softgrove.plans.trials import run_trials

COLS = ["a", "kind", "b", "c"]


def _rows(spark, n=300):
    rng = np.random.default_rng(13)
    rows = [(i, int(i % 7 == 0) + int(i % 3 == 0), float(rng.normal()), None if i % 17 == 0 else f"k{i % 5}", float(i % 4), float(rng.normal() + i % 3))
            for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, a double, kind string, b double, c double").repartition(5)


def _got(df):
    return {(r.trial, r.row_id): (r.seed, r.split, r.label, tuple(r.features)) for r in df.collect()}


@pytest.mark.parametrize("technique", ["quantile", "min-max"])
def test_packed_rows_equal_rows_per_seed(spark, technique):
    df, cfg = _rows(spark), EngineConfig(normalization=technique)
    seeds = [42, 43, 44]
    packed = pack_trials(df, COLS, ["kind"], cfg=cfg, seeds=seeds)
    assert packed.rows.count() == 300
    got, want = _got(packed.prepare(cfg)), _got(preprocess(df, COLS, ["kind"], cfg=cfg, seeds=seeds))
    assert got == want
    some = _got(packed.prepare(cfg, [3]))
    assert some == {k: v for k, v in want.items() if k[0] == 3}


def test_more_trials_than_a_word_holds(spark):
    df = _rows(spark, 60)
    seeds = list(range(100, 170))
    packed = pack_trials(df, ["a"], seeds=seeds)
    assert [c for c in packed.rows.columns if c.startswith("_codes")] == ["_codes0", "_codes1", "_codes2"]
    got = {(r.trial, r.seed, r.row_id): r.split for r in packed.trials().collect()}
    assert len(got) == 70 * 60
    from softgrove.operators.split import stratified_split
    for t in (1, 32, 33, 64, 65, 70):
        want = stratified_split(df, key="row_id", seed=seeds[t - 1]).collect()
        assert all(got[t, seeds[t - 1], r.row_id] == r.split for r in want)


def test_ten_seeds_take_hardly_more_bytes_than_the_table(spark, tmp_path):
    """Of the written files, features that do not compress."""
    df = spark.range(20_000, numPartitions=2).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"),
                                                     *[F.rand(k).alias(f"f{k}") for k in range(8)])
    cols = [f"f{k}" for k in range(8)]
    df.write.parquet(str(tmp_path / "table"))
    stored = spark.read.parquet(str(tmp_path / "table"))
    pack_trials(stored, cols, seeds=range(42, 52)).rows.write.parquet(str(tmp_path / "packed"))
    size = lambda p: sum(os.path.getsize(p / f) for f in os.listdir(p) if f.endswith(".parquet"))
    assert size(tmp_path / "packed") <= 1.2 * size(tmp_path / "table")


def test_trials_over_packed_rows_give_the_same_results(spark):
    df = _rows(spark)
    plain, packed = (run_trials(spark, df, "t", COLS, ["kind"], cfg=EngineConfig(max_epochs=8, depth=3, packed_trials=p), seeds=[42, 43],
                                trial_batch=n) for p, n in ((False, 2), (None, 1)))
    keep = ["Trial", "Seed", "Optimal Epoch", "Train Accuracy", "Test Accuracy", "Train Loss", "Validation Loss"]
    assert sorted(plain.trials.select(*keep).collect()) == sorted(packed.trials.select(*keep).collect())


def test_rebalanced_packed_rows(spark):
    df, cfg = _rows(spark), EngineConfig(normalization="min-max", rebalance="random", balance_ratio=2.0)
    count = lambda p: sorted(p.groupBy("trial", "seed", "split", "label").agg(F.count("*"), F.sum(F.get("features", F.lit(0)))).collect())
    a = count(pack_trials(df, ["a", "b"], cfg=cfg, seeds=[42, 43]).prepare(cfg))
    b = count(preprocess(df, ["a", "b"], cfg=cfg, seeds=[42, 43]))
    assert [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[5] for x in a], [x[5] for x in b])
