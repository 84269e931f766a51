import numpy as np
from pyspark.sql import functions as F

from softgrove.operators.quantiles import exact_quantiles
from softgrove.operators.rank import mutual_information


def test_quantiles_match_numpy_with_ties_and_buckets(spark):
    rng = np.random.default_rng(4)
    data = {0: np.r_[rng.normal(size=400), np.full(300, 0.25), [0.0, -0.0]], 1: np.full(50, 3.0), 2: np.array([5.0]), 3: rng.integers(0, 4, 90).astype(float)}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    for parts in (1, 9, 100):
        for buckets in (1, 7):
            got = {r.g: r.grid for r in exact_quantiles(df, ["g"], "x", parts, 4, buckets).collect()}
            for g, xs in data.items():
                want = np.percentile(xs, [100.0 * k / parts for k in range(parts + 1)])
                assert np.allclose(got[g], want, atol=1e-12), (g, parts, buckets)


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "g int, x double")
    assert exact_quantiles(df, ["g"], "x", 4, 1).collect() == []


def _mi(df, **kw):
    return {r.feature: r.mi for r in mutual_information(df, **kw).collect()}


def test_mutual_information_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 3, 900)
    rows = [(i, int(c), [round(float(rng.normal() + c) * 1000, 2), float(round(rng.normal(), 1))]) for i, c in enumerate(label)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    for kw in ({"tie_noise": False}, {"tie_noise": True}, {"method": "binned", "n_bins": 16}):
        one, seven, many = (_mi(df.repartition(n), **kw) for n in (1, 7, 64))
        assert one == seven == many


def test_mutual_information_of_mostly_equal_values(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [0.0 if rng.random() < 0.9 else float(rng.normal() + 5 * (i % 2))]) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    one, many = _mi(df, tie_noise=False, buckets=1), _mi(df, tie_noise=False, buckets=5)
    assert one == many and one[0] >= 0


def test_scale_of_a_feature_does_not_matter(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, [float(rng.normal() + i % 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    big = df.withColumn("features", F.transform("features", lambda x: x * 1024))
    assert _mi(df, tie_noise=False) == _mi(big, tie_noise=False)


def test_counted_values_match_brute_force(spark):
    """Mostly equal values, rare classes whose balls cross many buckets, a
    class of one row; any number of buckets gives the same."""
    from softgrove.operators.rank import mi_brute_force
    rng = np.random.default_rng(8)
    label = np.r_[rng.choice(4, 500, p=[0.6, 0.3, 0.09, 0.01]), [7]]
    cols = [np.where(rng.random(501) < 0.9, 1.0, rng.normal(size=501)), rng.normal(size=501) + label, rng.integers(0, 6, 501).astype(float),
            np.exp(4 * rng.normal(size=501)), np.zeros(501)]
    rows = [(i, int(label[i]), [float(c[i]) for c in cols]) for i in range(501)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    for k in (1, 3):
        want = {f: mi_brute_force(c, label, k) for f, c in enumerate(cols)}
        for buckets in (1, 2, 9):
            got = _mi(df, tie_noise=False, k=k, buckets=buckets)
            assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want), (k, buckets)


def test_a_shared_value_is_one_row_of_its_bucket(spark, monkeypatch):
    """Rows that a task gets don't grow with the repeats of a value."""
    from softgrove.operators import rank
    sizes = []
    plain = rank._counts_in_balls
    monkeypatch.setattr(rank, "_counts_in_balls", lambda counted, *a: (sizes.append(counted.count()), plain(counted, *a))[1])
    for repeats in (10, 1000):
        df = spark.range(repeats + 50).selectExpr("id AS row_id", "CAST(id % 2 AS INT) AS label", f"array(IF(id < {repeats}, 0D, CAST(id - {repeats} AS DOUBLE))) AS features")
        _mi(df, tie_noise=False)
    assert sizes[0] == sizes[1] == 2 + 49


def test_a_bucket_task_gets_its_own_edges_only(spark, monkeypatch):
    """A row does not carry the edges of all buckets, so a task's Python does
    not grow with their number, and the bucket is a fraction of a worker's memory."""
    from softgrove.operators import rank
    plans, plain = [], rank.materialize
    monkeypatch.setattr(rank, "materialize", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df))[1])
    df = spark.range(400).selectExpr("id AS row_id", "CAST(id % 3 AS INT) AS label", "array(CAST(id * 7 % 401 AS DOUBLE)) AS features")
    one, many = _mi(df, tie_noise=False, buckets=1), _mi(df, tie_noise=False, buckets=20)
    assert one == many
    python = [line for p in plans for line in p.splitlines() if "InArrow" in line]
    assert python and not any("_edges" in line for line in python)
    assert rank.KNN_BUCKET_ROWS <= 250_000


def _parts_of_rows(spark):
    rng = np.random.default_rng(21)
    rows = [(i, i % 2, [float(rng.normal()), 0.5 if i % 3 else float(rng.integers(0, 9)), None if i % 11 == 0 else float(i % 7)]) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, g int, features array<double>").repartition(4)
    return df, df.where("row_id < 200"), df.where("row_id >= 200 AND row_id < 210"), df.where("row_id >= 210")


def _grid_rows(model):
    return {r.g: [np.array(g) for g in r._grids] for r in model.params.collect()}


def test_states_of_parts_merge_to_the_grid_of_the_whole(spark, tmp_path):
    from softgrove.operators.normalize import QuantileFitState, QuantileNormalizer
    norm = QuantileNormalizer(noise=0.0, n_quantiles=100, by=["g"])
    whole, *parts = _parts_of_rows(spark)
    want = _grid_rows(norm.fit(whole))
    state = norm.state(parts[0])
    state.write(str(tmp_path / "state"))
    state = QuantileFitState.read(spark, str(tmp_path / "state"), ["g"])
    for part in parts[1:]:
        state = state.merge(norm.state(part, base=state))
    assert state.rows.agg(F.sum("n")).first()[0] == 900
    for buckets in (1, 6):
        got = _grid_rows(norm.fit_state(state, buckets))
        assert got.keys() == want.keys()
        assert all(np.array_equal(a, b) for g in want for a, b in zip(got[g], want[g]))


def test_merged_states_with_noise_do_not_depend_on_the_cut(spark):
    """The first part's spread scales the noise of all rows."""
    from softgrove.operators.normalize import QuantileNormalizer
    norm = QuantileNormalizer(noise=1e-3, n_quantiles=50, by=["g"])
    whole, a, b, c = _parts_of_rows(spark)
    first = norm.state(a)
    one = first.merge(norm.state(b.unionByName(c), base=first))
    two = first.merge(norm.state(b, base=first)).merge(norm.state(c, base=first))
    x, y = _grid_rows(norm.fit_state(one)), _grid_rows(norm.fit_state(two))
    assert all(np.array_equal(p, q) for g in x for p, q in zip(x[g], y[g]))
    plain = _grid_rows(norm.fit(a))
    same = _grid_rows(norm.fit_state(first))
    assert all(np.allclose(p, q, atol=1e-12) for g in plain for p, q in zip(plain[g], same[g]))


def test_state_of_a_new_group_and_of_no_rows(spark):
    from softgrove.operators.normalize import QuantileNormalizer
    norm = QuantileNormalizer(noise=1e-3, n_quantiles=5, by=["g"])
    df, *_ = _parts_of_rows(spark)
    first = norm.state(df.where("g = 0"))
    state = first.merge(norm.state(df.where("g = 1"), base=first)).merge(norm.state(df.where("false"), base=first))
    new = _grid_rows(norm.fit_state(state))
    raw = _grid_rows(QuantileNormalizer(noise=0.0, n_quantiles=5, by=["g"]).fit(df))
    assert all(np.array_equal(p, q) for p, q in zip(new[1], raw[1])) and set(new) == {0, 1}
