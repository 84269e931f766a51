import numpy as np

from softgrove.operators.rank import mi_brute_force, mutual_information, rank_features
from softgrove.operators.tree import (focal_loss_np, forward, init_model, loss_and_grad, predict,
                                      score, scores_np)


def test_mi_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 400
    y = rng.integers(0, 3, n)
    x0 = rng.normal(size=n) + y * 0.8
    x1 = np.round(rng.normal(size=n), 1)  # ties
    rows = [(i, int(y[i]), [float(x0[i]), float(x1[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    got = {r["feature"]: r["mi"] for r in mutual_information(df, tie_noise=False).collect()}
    for j, x in enumerate([x0, x1]):
        assert abs(got[j] - mi_brute_force(x / x.std(), y)) < 1e-9
    order = rank_features(mutual_information(df, tie_noise=True))[()]
    assert order == [0, 1]


def test_gradient_finite_differences():
    rng = np.random.default_rng(0)
    X = rng.standard_normal((30, 3))
    y = rng.integers(0, 3, 30)
    m = init_model(3, 3, [2, 0, 1], 7)
    _, g = loss_and_grad(X, y, m, 1.0, 2.0)
    p, eps = m.params(), 1e-6
    for i in range(len(p)):
        a, b = p.copy(), p.copy()
        a[i] += eps
        b[i] -= eps
        num = (focal_loss_np(scores_np(X, m.with_params(a)), y, 1, 2).sum()
               - focal_loss_np(scores_np(X, m.with_params(b)), y, 1, 2).sum()) / (2 * eps)
        assert abs(num - g[i]) < 1e-6


def test_leaf_probabilities_sum_to_one():
    X = np.random.default_rng(1).standard_normal((50, 4))
    P, _ = forward(X, init_model(5, 2, [3, 1, 0, 2], 1))
    assert np.allclose(P.sum(axis=1), 1.0)


def test_single_row_batch():
    m = init_model(3, 2, [0], 2)
    assert scores_np(np.array([[0.3]]), m).shape == (1, 2)


def test_expr_and_numpy_scoring_agree(spark):
    m = init_model(3, 4, [1, 0], 11)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(np.random.default_rng(2).normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    a = {r["id"]: r["scores"] for r in score(df, m, mode="expr").collect()}
    b = {r["id"]: r["scores"] for r in score(df, m, mode="numpy").collect()}
    for k in a:
        assert np.allclose(a[k], b[k], atol=1e-12)
    p = {r["id"]: r["prediction"] for r in predict(df, m).collect()}
    assert all(p[k] == int(np.argmax(a[k])) for k in a)


def test_mi_knn_bucketed_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    n = 600
    y = rng.integers(0, 4, n)
    y[:2] = 3  # a small class
    x0 = rng.normal(size=n) + y * 0.5
    x1 = rng.exponential(size=n) * (1 + (y == 1))
    rows = [(i, int(y[i]), [float(x0[i]), float(x1[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    one = {r["feature"]: r["mi"] for r in mutual_information(df, tie_noise=False, buckets=1).collect()}
    many = {r["feature"]: r["mi"] for r in mutual_information(df, tie_noise=False, buckets=13).collect()}
    for j, x in enumerate([x0, x1]):
        ref = mi_brute_force(x / x.std(), y)
        assert abs(one[j] - ref) < 1e-9
        assert abs(many[j] - ref) < 1e-9


def test_chunked_kernel_equals_whole(monkeypatch):
    import softgrove.operators.tree as tr
    rng = np.random.default_rng(8)
    X = rng.standard_normal((1000, 4))
    y = rng.integers(0, 3, 1000)
    m = init_model(4, 3, [1, 0, 3, 2], 3)
    whole = tr.loss_and_grad(X, y, m, 1.0, 2.0)
    monkeypatch.setattr(tr, "CHUNK_CELLS", 16 * 300)  # 300-row chunks at depth 4
    part = tr.loss_and_grad_chunked(X, y, m, 1.0, 2.0)
    assert abs(whole[0] - part[0]) < 1e-9 and np.allclose(whole[1], part[1])
    assert np.allclose(tr.scores_chunked(X, m), tr.scores_np(X, m))
    assert abs(tr.focal_loss_sum(X, y, m, 1.0, 2.0) - whole[0]) < 1e-9


def test_public_gradient_matches_kernel(spark):
    from softgrove.operators.train import gradient
    rng = np.random.default_rng(12)
    X = rng.standard_normal((200, 3))
    y = rng.integers(0, 3, 200)
    m = init_model(3, 3, [0, 2, 1], 4)
    df = spark.createDataFrame([([float(v) for v in X[i]], int(y[i])) for i in range(200)],
                               "features array<double>, label int").repartition(5)
    g = gradient(df, m)
    loss, grad = loss_and_grad(X, y, m, 1.0, 2.0)
    assert abs(g["loss"] - loss / 200) < 1e-12 and np.allclose(g["grad"], grad / 200)


def test_deep_trees_score_alike_in_the_jvm(spark):
    """Depth 8 and 11 and several trials' trees; no Python in the plan."""
    from softgrove.operators.tree import init_model, score
    rng = np.random.default_rng(2)
    rows = [(i, i % 2 + 1, [float(v) for v in rng.normal(size=5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, trial int, features array<double>")
    for depth in (1, 8, 11):
        for model in (init_model(depth, 4, [3, 0, 4, 1, 2], 5), {1: init_model(depth, 4, [0, 1, 2, 3, 4], 1), 2: init_model(depth, 4, [4, 3, 2, 1, 0], 2)}):
            fold, kernel = score(df, model, mode="fold"), score(df, model, mode="numpy")
            assert "Arrow" not in fold._jdf.queryExecution().executedPlan().toString()
            a, b = ({r.row_id: r.scores for r in x.collect()} for x in (fold, kernel))
            assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-12) for i in a)
