"""Values in blocks: the noise, and the fits that read them against the ones
over counted values."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from softgrove.functions.columns import keyed_gaussian
from softgrove.operators import normalize, rank
from softgrove.operators.blocks import KeyTexts
from softgrove.operators.normalize import QuantileNormalizer
from softgrove.operators.rank import mutual_information
from softgrove.operators.tree import Columns, columns, init_model, loss_and_grad, scores_np


def test_uniforms_have_the_bits_of_the_digest():
    keys = [*map(str, range(0, 3000, 7)), None, "", "ä" * 20, "x" * 60]
    around = [([str(s), str(f)], ["0", "14"]) for s in (42, -7) for f in (3, 4, 11)] + [([], ["42", "9"]), ([], ["42", "12"])]
    got = KeyTexts(pa.array(keys)).uniform(around)
    for row, (before, after) in zip(got, around):
        texts = [":".join(x for x in (*before, k, *after) if x is not None) for k in keys]
        assert row.tolist() == [(int(hashlib.md5(t.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52 for t in texts]


def test_gaussians_are_those_of_the_column(spark):
    df = spark.range(300).select((F.col("id") * 37).alias("k"))
    rows = df.select("k", *[keyed_gaussian(42, F.lit(p), F.col("k")).alias(f"g{p}") for p in (0, 5)]).collect()
    got = KeyTexts(pa.array([str(r.k) for r in rows])).gaussian([([], ["42"], p) for p in (0, 5)])
    assert np.allclose(got, [[r.g0 for r in rows], [r.g5 for r in rows]], rtol=0, atol=1e-12)


def _odd_rows(spark):
    """Missing and equal values, arrays of unequal length, keys that are missing
    or come twice, a missing label, a class of one row, two groups."""
    rng = np.random.default_rng(31)
    rows = []
    for i in range(900):
        x = [float(rng.normal() + i % 3), None if i % 11 == 0 else float(i % 7), float("nan") if i % 13 == 0 else round(float(rng.normal()), 1), -0.0]
        rows.append((None if i % 50 == 0 else i // 2 if i < 40 else i, i % 2, None if i % 97 == 0 else 9 if i == 5 else i % 3, 40 + i % 2,
                     None if i == 77 else x[:2] if i % 29 == 0 else x))
    return spark.createDataFrame(rows, "row_id long, g int, label int, seed int, features array<double>").repartition(5)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_noisy_fit_and_ranking_as_over_counted_values(spark, monkeypatch, by):
    df = _odd_rows(spark).cache()
    kw = {"by": by, "seed": "seed" if by else 42}

    def both():
        mi = mutual_information(df, **kw)
        params = QuantileNormalizer(noise=1e-3, n_quantiles=50, by=by).fit(df).params
        return (sorted(map(tuple, mi.collect())), {tuple(r[b] for b in by): r._grids for r in params.collect()}, mi, params)

    mi, grids, *plans = both()
    # no row for each value, neither noised nor counted by the JVM
    assert not any("Generate" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    for module in (normalize, rank):
        monkeypatch.setattr(module, "BLOCK_VALUES", 0)
    want, counted, *plans = both()
    assert all("Generate" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    assert mi == want and grids.keys() == counted.keys()
    for g in grids:
        assert len(grids[g]) == len(counted[g]) and all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(grids[g], counted[g]))
    df.unpersist()


def test_powers_and_values_give_the_same():
    """exp(x) exp(-theta) where both are moderate, exp(x - theta) elsewhere."""
    rng = np.random.default_rng(32)
    X, y, m = rng.standard_normal((90, 5)), rng.integers(0, 3, 90), init_model(6, 3, [4, 2, 0, 1, 3], 5)
    assert columns(X).powers and not columns(X * 1000).powers and not columns(np.full((2, 5), np.nan)).powers
    plain = Columns(np.ascontiguousarray(X.T), False)
    for a, b in ((loss_and_grad(columns(X), y, m, 1.0, 2.0), loss_and_grad(plain, y, m, 1.0, 2.0)),):
        assert abs(a[0] - b[0]) < 1e-9 and np.allclose(a[1], b[1], rtol=0, atol=1e-11)
    m.thresholds[3] = 800.0  # beyond what a power holds
    assert np.allclose(scores_np(columns(X), m), scores_np(plain, m), rtol=0, atol=1e-12) and np.isfinite(scores_np(X * 1e6, m)).all()
