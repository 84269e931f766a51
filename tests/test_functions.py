import math
import statistics

from pyspark.sql import functions as F

from softgrove.functions.columns import (CLIP_HIGH, CLIP_LOW, count_less, count_less_equal, digamma,
                                         digamma_scalar, keyed_gaussian, norm_ppf, norm_ppf_scalar)


def test_norm_ppf_matches_statistics():
    nd = statistics.NormalDist()
    for p in [1e-9, 1e-7, 1e-3, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-7]:
        assert abs(norm_ppf_scalar(p) - nd.inv_cdf(p)) < 1e-12
    assert abs(CLIP_LOW + 5.199337582) < 1e-6 and abs(CLIP_HIGH - 5.199337582) < 1e-6


def test_norm_ppf_column(spark):
    nd = statistics.NormalDist()
    ps = [1e-6, 0.1, 0.5, 0.93, 0.999999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select(norm_ppf(F.col("p")).alias("z")).collect()
    for p, r in zip(ps, rows):
        assert abs(r["z"] - nd.inv_cdf(p)) < 1e-12


def test_digamma(spark):
    g = 0.5772156649015329
    assert abs(digamma_scalar(1) + g) < 1e-9
    assert abs(digamma_scalar(4) - (1 + 1 / 2 + 1 / 3 - g)) < 1e-9
    rows = spark.range(1, 30).select("id", digamma(F.col("id")).alias("d")).collect()
    for r in rows:
        h = sum(1.0 / i for i in range(1, r["id"]))
        assert abs(r["d"] - (h - g)) < 1e-9


def test_keyed_gaussian_is_standard_normal_and_repeatable(spark):
    df = spark.range(20000).select(keyed_gaussian(42, 1, F.col("id")).alias("z"))
    st = df.agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    assert abs(st["m"]) < 0.03 and abs(st["s"] - 1) < 0.03
    a = df.repartition(7).agg(F.sum("z")).first()[0]
    b = df.agg(F.sum("z")).first()[0]
    assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_binary_search_counts(spark):
    grid = [1.0, 2.0, 2.0, 2.0, 5.0, 7.0]
    xs = [0.5, 1.0, 2.0, 3.0, 7.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", count_less(F.lit(grid), F.col("x"), 6).alias("a"), count_less_equal(F.lit(grid), F.col("x"), 6).alias("b"))
    for r in df.collect():
        assert r["a"] == sum(g < r["x"] for g in grid)
        assert r["b"] == sum(g <= r["x"] for g in grid)
