import numpy as np

from softgrove.operators.encode import LeaveOneOut
from softgrove.operators.normalize import MinMaxNormalizer, QuantileNormalizer, StandardNormalizer


def test_leave_one_out(spark):
    rows = [(1, "a", 1, "train"), (2, "a", 0, "train"), (3, "a", 1, "train"), (4, "b", 1, "train"),
            (5, "a", 0, "test"), (6, "b", 0, "test"), (7, "z", 1, "test"), (8, None, 0, "train")]
    df = spark.createDataFrame(rows, "row_id long, c string, label int, split string")
    out = {r["row_id"]: r["c"] for r in LeaveOneOut(["c"]).fit(df).transform(df).collect()}
    mean = 3 / 5
    assert out[1] == 0.5 and out[2] == 1.0 and out[3] == 0.5  # (2 - y) / 2
    assert out[4] == mean  # single-row level
    assert abs(out[5] - 2 / 3) < 1e-12  # sum / count
    assert out[6] == mean and out[7] == mean and out[8] == mean  # single, unseen, missing


def test_quantile_monotone_and_bounded(spark):
    rng = np.random.default_rng(0)
    xs = rng.lognormal(size=500)
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(xs)], "row_id long, features array<double>")
    m = QuantileNormalizer(noise=1e-3, n_quantiles=100).fit(df)
    out = sorted((r["row_id"], r["features"][0]) for r in m.transform(df).collect())
    z = np.array([v for _, v in out])
    order = np.argsort(xs)
    assert np.all(np.diff(z[order]) >= -1e-9)
    assert z.max() <= 5.2 and z.min() >= -5.2 and abs(np.median(z)) < 0.1


def test_minmax_and_standard(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],), ([2.0, 5.0],)], "features array<double>")
    mm = [r["features"] for r in MinMaxNormalizer().fit(df).transform(df).collect()]
    assert sorted(v[0] for v in mm) == [-1.0, 0.0, 1.0] and all(v[1] == -1.0 for v in mm)
    st = [r["features"] for r in StandardNormalizer().fit(df).transform(df).collect()]
    assert abs(sum(v[0] for v in st)) < 1e-12 and all(v[1] == 0.0 for v in st)


def test_quantile_engines_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 2), [float(v) for v in rng.normal(size=3)] + [float(i % 7)]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, trial int, features array<double>")
    m = QuantileNormalizer(noise=1e-3, n_quantiles=50, by=["trial"]).fit(df)
    a = {r["row_id"]: r["features"] for r in m.transform(df, engine="arrow").collect()}
    b = {r["row_id"]: r["features"] for r in m.transform(df, engine="jvm").collect()}
    for k in a:
        assert np.allclose(a[k], b[k], atol=1e-12)


def test_leave_one_out_broadcast_and_shuffle_joins_agree(spark, monkeypatch):
    import softgrove.operators.encode as enc
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), f"c{rng.integers(0, 6)}", None if i % 17 == 0 else f"d{rng.integers(0, 3)}",
             int(rng.integers(0, 2)), "train" if i % 4 else "test") for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, trial int, a string, b string, label int, split string")
    model = enc.LeaveOneOut(["a", "b"], by=["trial"]).fit(df)
    lit = {r["row_id"]: (r["a"], r["b"]) for r in model.transform(df).collect()}
    monkeypatch.setattr(enc, "maybe_broadcast", lambda small, n: small)
    joined = {r["row_id"]: (r["a"], r["b"]) for r in model.transform(df).collect()}
    assert lit.keys() == joined.keys()
    for k in lit:
        assert np.allclose(lit[k], joined[k], atol=1e-12)


def test_fits_ignore_missing_values(spark):
    rows = [(i, [float(i) if i % 10 else float("nan"), float(i % 7)]) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    for m in (QuantileNormalizer(noise=0.0, n_quantiles=50).fit(df), MinMaxNormalizer().fit(df), StandardNormalizer().fit(df)):
        out = {r["row_id"]: r["features"] for r in m.transform(df).collect()}
        assert np.isnan(out[0][0]) and not np.isnan(out[1][0]) and not np.isnan(out[0][1])
        finite = [v[0] for k, v in out.items() if k % 10]
        assert max(finite) <= 5.2 and min(finite) >= -5.2


def test_leave_one_out_sum_identity(spark):
    rng = np.random.default_rng(11)
    rows = [(i, f"c{rng.integers(0, 8)}", int(rng.integers(0, 3)), "train") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, c string, label int, split string")
    out = LeaveOneOut(["c"]).fit(df).transform(df, out_suffix="_enc").collect()
    by_level = {}
    for r in out:
        by_level.setdefault(r["c"], []).append((r["c_enc"], r["label"]))
    for level, vals in by_level.items():
        if len(vals) > 1:  # sum over a level of (s - y)/(n - 1) equals s
            assert abs(sum(v for v, _ in vals) - sum(y for _, y in vals)) < 1e-9


def test_normalize_dispatch_and_reuse(spark):
    import pytest
    from softgrove.operators.normalize import normalize
    df = spark.createDataFrame([([float(i)],) for i in range(10)], "features array<double>")
    out, fitted = normalize(df, "min-max")
    again, same = normalize(df, "min-max", fitted=fitted)
    assert same is fitted
    assert sorted(r["features"][0] for r in out.collect()) == sorted(r["features"][0] for r in again.collect())
    _, f2 = normalize(df, "mean")
    assert f2.kind == "standard"
    with pytest.raises(ValueError):
        normalize(df, "nope")


def test_leave_one_out_by_shuffle_splits_hot_levels(spark, monkeypatch):
    """A level of a third of all rows, a third without one, many others; with
    and without groups, the same as by broadcast, and no task gets the level's rows."""
    from pyspark.sql import functions as F

    from softgrove.operators import _util
    df = spark.range(6000).selectExpr(
        "id AS row_id", "CAST(id % 2 + 1 AS INT) AS trial", "CAST((id div 3) % 3 = 0 AS INT) AS label", "IF(id % 5 = 4, 'test', 'train') AS split",
        "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN NULL ELSE CONCAT('c', id div 12) END AS c", "id % 700 AS d")
    for by in ([], ["trial"]):
        got = []
        for limit in (2_000_000, 0):
            monkeypatch.setattr(_util, "BROADCAST_ROW_LIMIT", limit)
            out = LeaveOneOut(["c", "d"], by=by).fit(df).transform(df, out_suffix="_enc")
            got.append({r.row_id: (r.c, r.d, r.c_enc, r.d_enc) for r in out.collect()})
        assert got[0] == got[1] and len(got[0]) == 6000
    joins = out._jdf.queryExecution().executedPlan().toString()
    assert "isnull(_hn0" in joins and "_salt" in joins
    # the key by which rows are dealt: as many rows in one as chance gives
    model = LeaveOneOut(["c"]).fit(df)
    dealt = model.transform(df).select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert dealt < 2000
