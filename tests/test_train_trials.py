import numpy as np
from pyspark.sql import functions as F

from fixtures import iris_like
from softgrove.config import EngineConfig
from softgrove.operators.balance import oversample_random
from softgrove.operators.labels import encode_label
from softgrove.operators.train import fit_soft_trees
from softgrove.operators.tree import init_model
from softgrove.plans.prepare import preprocess
from softgrove.plans.trials import TRIALS_SCHEMA, run_trials, summarize_trials

FEATURES = ["sepal_length", "sepal_width", "petal_length", "petal_width"]


def _iris(spark):
    df = spark.createDataFrame(iris_like()).withColumn("row_id", F.monotonically_increasing_id())
    return encode_label(df, "class")[0]


def test_training_matches_a_local_loop(spark):
    from softgrove.operators.train import AdamState
    from softgrove.operators.tree import loss_and_grad
    prep = preprocess(_iris(spark), FEATURES, seeds=[42, 43]).cache()
    init = {t: init_model(3, 3, [2, 3, 0, 1], 40 + t) for t in (1, 2)}
    cfg = EngineConfig(max_epochs=15, restore="last")
    fit = fit_soft_trees(prep.repartition(7), init, cfg)
    for t in (1, 2):
        rows = prep.where((F.col("trial") == t) & (F.col("split") == "train")).collect()
        X, y = np.array([r.features for r in rows]), np.array([r.label for r in rows])
        m = init[t]
        adam = AdamState(np.zeros(m.params().size), np.zeros(m.params().size))
        for _ in range(15):
            m = m.with_params(adam.step(m.params(), loss_and_grad(X, y, m, cfg.alpha, cfg.gamma)[1] / len(y), cfg.learning_rate))
        assert np.allclose(fit.models[t].params(), m.params(), atol=1e-9)
        assert fit.stats[t]["stop_epoch"] == 15


def test_training_refuses_missing_values(spark):
    import pytest
    for bad in ([1.0, None], [1.0, float("nan")], [1.0], None):
        rows = [(1, "train" if k % 3 else "valid", [1.0, float(k)], k % 2) for k in range(12)] + [(1, "train", bad, 1)]
        df = spark.createDataFrame(rows, "trial int, split string, features array<double>, label int")
        with pytest.raises(Exception, match="NULL|NaN|unequal"):
            fit_soft_trees(df, {1: init_model(2, 2, [0, 1], 1)}, EngineConfig(max_epochs=2))


def test_iris_like_end_to_end(spark):
    import tempfile
    sink = tempfile.mkdtemp(prefix="sg-trials-") + "/trials"
    run = run_trials(spark, _iris(spark), "iris_like", FEATURES, cfg=EngineConfig(max_epochs=250), seeds=[42, 43], trial_batch=1, sink=sink)
    s = run.summary.first()
    assert sorted(int(r["Trial"]) for r in spark.read.option("header", True).csv(sink).collect()) == [1, 2]
    assert s["Depth"] == 8
    assert s["Mean Test Accuracy"] >= 0.90
    sizes = run.prepared.where(F.col("trial") == 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in sizes} == {"train": 90, "valid": 30, "test": 30}


def test_summarize_published_trials(spark):
    # The ten published trial rows (seed, test accuracy, test macro F1).
    published = [(42, 0.9666666666666667, 0.9665831244778613), (43, 0.8666666666666667, 0.8653198653198654),
                 (44, 0.9666666666666667, 0.9665831244778613), (45, 0.9333333333333333, 0.9326599326599326),
                 (46, 0.9666666666666667, 0.9665831244778613), (47, 0.9666666666666667, 0.9665831244778612),
                 (48, 0.9666666666666667, 0.9665831244778613), (49, 0.9666666666666667, 0.9665831244778613),
                 (50, 1.0, 1.0), (51, 0.9333333333333333, 0.934609250398724)]
    rows = [(i + 1, s, "Iris", 8, 0, 0.0, acc, 0.0, f1, 0.0, 0.0, 0.0, 0.0, 0) for i, (s, acc, f1) in enumerate(published)]
    s = summarize_trials(spark.createDataFrame(rows, TRIALS_SCHEMA)).first()
    assert round(s["Mean Test Accuracy"], 6) == 0.953333
    assert round(s["Std Test Accuracy"], 6) == 0.033993
    assert round(s["Mean F1 Score"], 6) == 0.953209
    assert round(s["Std F1 Score"], 6) == 0.034286


def test_oversample_random_balances(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(100)], "row_id long, label int")
    out = oversample_random(df, key="row_id", seed=3)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 90, 1: 90}
    extra = out.where(F.col("draw") >= 0)
    assert extra.where(F.col("label") != 1).count() == 0
    assert extra.select("row_id").distinct().count() <= 10


def test_trial_and_summary_sinks(spark):
    import tempfile
    from softgrove.plans.trials import write_summary, write_trials
    rows = [(t, 41 + t, "x", 8, 10, 1.0, 0.9, 1.0, 0.9, 0.1, 0.2, 1.0, 0.01, 9) for t in (1, 2)]
    trials = spark.createDataFrame(rows, TRIALS_SCHEMA)
    d = tempfile.mkdtemp(prefix="sg-sink-")
    write_trials(trials, f"{d}/trials")
    # re-running one trial replaces only its partition
    write_trials(trials.where(F.col("Trial") == 2).withColumn("Seed", F.lit(99)), f"{d}/trials")
    back = spark.read.option("header", True).csv(f"{d}/trials")
    got = {int(r["Trial"]): int(r["Seed"]) for r in back.collect()}
    assert got == {1: 42, 2: 99}
    write_summary(summarize_trials(trials), f"{d}/summary")
    s = spark.read.option("header", True).csv(f"{d}/summary").first()
    assert s["Dataset Name"] == "x" and float(s["Mean Test Accuracy"]) == 0.9


def test_epoch_partials_tree_combine_matches_driver_sum(spark, monkeypatch):
    import softgrove.operators.train as tr
    rng = np.random.default_rng(0)
    rows = [(t, "train" if i % 5 else "valid", [float(v) for v in rng.normal(size=3)], int(rng.integers(0, 3)))
            for t in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "trial int, split string, features array<double>, label int").repartition(16)
    models = {1: init_model(3, 3, [0, 1, 2], 1), 2: init_model(3, 3, [2, 1, 0], 2)}
    blocks = tr.pack_blocks(df)
    a = tr.epoch_job(blocks, models, 1.0, 2.0)
    monkeypatch.setattr(tr, "FAN_IN", 3)
    b = tr.epoch_job(blocks, models, 1.0, 2.0)
    for t in (1, 2):
        assert a[t]["n_train"] == b[t]["n_train"] == 320
        assert np.allclose(a[t]["grad"], b[t]["grad"])
        assert abs(a[t]["valid_loss"] - b[t]["valid_loss"]) < 1e-9


def test_restore_last_keeps_final_weights(spark):
    prep = preprocess(_iris(spark), FEATURES, seeds=[42]).cache()
    init = {1: init_model(3, 3, [2, 3, 0, 1], 7)}
    best = fit_soft_trees(prep, init, EngineConfig(max_epochs=40, restore="best"))
    last = fit_soft_trees(prep, init, EngineConfig(max_epochs=40, restore="last"))
    assert best.stats[1]["stop_epoch"] == last.stats[1]["stop_epoch"]
    assert best.stats[1]["best_epoch"] <= best.stats[1]["stop_epoch"]
    if best.stats[1]["best_epoch"] < best.stats[1]["stop_epoch"]:
        assert not np.allclose(best.models[1].params(), last.models[1].params())


def test_rebalance_only_when_needed(spark):
    from softgrove.operators.balance import rebalance
    skewed = spark.createDataFrame([(i, 1 if i < 5 else 0) for i in range(100)], "row_id long, label int")
    even = spark.createDataFrame([(i, i % 2) for i in range(100)], "row_id long, label int")
    assert rebalance(even).count() == 100
    out = rebalance(skewed)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 95, 1: 95}


def test_trial_batches_equal_one_plan(spark):
    cfg = EngineConfig(max_epochs=12)
    a = run_trials(spark, _iris(spark), "iris_like", FEATURES, cfg=cfg, seeds=[42, 43, 44])
    b = run_trials(spark, _iris(spark), "iris_like", FEATURES, cfg=cfg, seeds=[42, 43, 44], trial_batch=1)
    ka = {r["Seed"]: (r["Trial"], r["Test Accuracy"], r["Train Loss"]) for r in a.trials.collect()}
    kb = {r["Seed"]: (r["Trial"], r["Test Accuracy"], r["Train Loss"]) for r in b.trials.collect()}
    assert ka.keys() == kb.keys()
    for s in ka:
        assert ka[s][0] == kb[s][0] and ka[s][1] == kb[s][1] and abs(ka[s][2] - kb[s][2]) < 1e-9


def test_prepared_table_independent_of_partitioning(spark):
    base = _iris(spark).cache()
    outs = []
    for n in (1, 7, 64):
        p = preprocess(base.repartition(n), FEATURES, seeds=[42, 43], materialize_output=False)
        outs.append({(r["trial"], r["row_id"]): (r["split"], tuple(r["features"])) for r in p.collect()})
    for o in outs[1:]:
        assert o.keys() == outs[0].keys()
        for k in o:
            assert o[k][0] == outs[0][k][0] and np.allclose(o[k][1], outs[0][k][1], atol=1e-12)


def test_oversample_smote(spark):
    from softgrove.operators.balance import oversample_smote
    rng = np.random.default_rng(2)
    rows = [(i, 1 if i < 20 else 0, [float(v) for v in rng.normal(size=2) + (3.0 if i < 20 else 0.0)])
            for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    out = oversample_smote(df, k=5, seed=7)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 100, 1: 100}
    minority = np.array([r[2] for r in rows if r[1] == 1])
    synth = [r for r in out.collect() if r["draw"] >= 0]
    assert len(synth) == 80 and all(r["label"] == 1 for r in synth)
    for r in synth:  # on the segment from its base row towards a class neighbour
        base = np.array(rows[r["row_id"]][2])
        d = np.array(r["features"]) - base
        if np.linalg.norm(d) > 1e-12:
            ends = minority - base
            cos = (ends @ d) / (np.linalg.norm(ends, axis=1) * np.linalg.norm(d) + 1e-300)
            assert np.isclose(cos.max(), 1.0, atol=1e-9)
    again = sorted(tuple(r["features"]) for r in oversample_smote(df, k=5, seed=7).collect() if r["draw"] >= 0)
    assert again == sorted(tuple(r["features"]) for r in synth)


def _random_rows(spark, n=3000, trials=(1, 2), parts=None):
    rng = np.random.default_rng(4)
    rows = [(t, i, "train" if i % 5 else "valid", [float(v) for v in rng.normal(size=3)], int(rng.integers(0, 3))) for t in trials for i in range(n)]
    df = spark.createDataFrame(rows, "trial int, row_id long, split string, features array<double>, label int")
    return df.repartition(parts) if parts else df


def test_equal_bits_for_any_partitions_and_paths(spark, monkeypatch):
    """1, 7 and 64 partitions, epochs in one task or as jobs, sums in a tree."""
    import softgrove.operators.train as tr
    monkeypatch.setattr(tr, "CELL_ROWS", 100)
    monkeypatch.setattr(tr, "MIN_PARTITION_ROWS", 100)
    init = {1: init_model(4, 3, [0, 1, 2], 1), 2: init_model(4, 3, [2, 1, 0], 2)}
    cfg = EngineConfig(max_epochs=6)
    got = []
    for parts, in_task, fan_in in ((1, False, 32), (7, False, 2), (64, False, 3), (7, True, 32), (64, True, 32)):
        monkeypatch.setattr(tr, "FAN_IN", fan_in)
        fit = fit_soft_trees(_random_rows(spark, 1000, parts=parts), init, cfg, key="row_id", in_task=in_task, epochs_per_job=4)
        got.append((fit.history, {t: m.params().tobytes() for t, m in fit.models.items()}, {t: s["stop_epoch"] for t, s in fit.stats.items()}))
    assert all(g == got[0] for g in got[1:])


def test_fixed_point_sums_ignore_order():
    from softgrove.operators.train import add_fixed, fixed, from_fixed
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 50)) * 10.0 ** rng.integers(-12, 9, (200, 50))
    totals = []
    for _ in range(4):
        acc = np.zeros((2, 50), dtype=np.int64)
        for row in x[rng.permutation(200)]:
            acc = add_fixed(acc, fixed(row))
        totals.append(from_fixed(acc))
    assert all(t.tobytes() == totals[0].tobytes() for t in totals)
    from fractions import Fraction
    exact = [float(sum(map(Fraction, col))) for col in x.T]
    assert np.allclose(totals[0], exact, rtol=1e-12, atol=1e-16)
    import pytest
    with pytest.raises(ValueError, match="diverged"):
        fixed(np.array([1.0, float("inf")]))


def test_interrupted_training_goes_on_from_its_snapshot(spark, monkeypatch):
    import tempfile

    import pytest

    import softgrove.operators.train as tr
    df, cfg = _random_rows(spark, 300), EngineConfig(max_epochs=23)
    init = {1: init_model(3, 3, [0, 1, 2], 1), 2: init_model(3, 3, [2, 1, 0], 2)}
    whole = fit_soft_trees(df, init, cfg, key="row_id")
    write = tr.write_snapshot
    for in_task in (True, False):
        folder, calls = tempfile.mkdtemp(prefix="sg-snap-") + "/s", []

        def cut_off(*a):
            write(*a)
            calls.append(1)
            if len(calls) == 3:
                raise KeyboardInterrupt
        monkeypatch.setattr(tr, "write_snapshot", cut_off)
        with pytest.raises(KeyboardInterrupt):
            fit_soft_trees(df, init, cfg, key="row_id", in_task=in_task, epochs_per_job=5, snapshot=folder)
        # one of the two slots is not readable: the other one is taken
        monkeypatch.setattr(tr, "write_snapshot", write)
        epochs = []
        step = tr.advance
        monkeypatch.setattr(tr, "advance", lambda st, *a: (epochs.append(st.epoch), step(st, *a)))
        again = fit_soft_trees(df, init, cfg, key="row_id", in_task=in_task, epochs_per_job=5, snapshot=folder)
        monkeypatch.setattr(tr, "advance", step)
        assert in_task or min(epochs) == 15
        assert again.history == whole.history
        assert all(again.models[t].params().tobytes() == whole.models[t].params().tobytes() for t in init)
        # nothing is left to do
        assert fit_soft_trees(df, init, cfg, key="row_id", in_task=in_task, snapshot=folder).history == whole.history
        with pytest.raises(ValueError, match="other models or settings"):
            fit_soft_trees(df, init, EngineConfig(max_epochs=24), key="row_id", snapshot=folder)


def test_early_stopping_follows_the_loss_history(spark):
    """Stop epoch, best epoch and restored weights, told from the losses."""
    cfg = EngineConfig(max_epochs=400, patience=4, min_improvement=2e-3, learning_rate=0.3)
    init = {1: init_model(3, 3, [0, 1, 2], 1), 2: init_model(3, 3, [2, 1, 0], 5)}
    df = _random_rows(spark, 200)
    for in_task in (True, False):
        fit = fit_soft_trees(df, init, cfg, key="row_id", in_task=in_task, epochs_per_job=7)
        for t in init:
            best, best_epoch, waited = float("inf"), 0, 0
            losses = [h["valid_loss"] for h in fit.history if h["trial"] == t]
            for epoch, v in enumerate(losses, 1):
                best, best_epoch, waited = (v, epoch, 0) if best - v > 2e-3 else (best, best_epoch, waited + 1)
                if waited == 4:
                    break
            assert epoch == len(losses) < 400
            assert fit.stats[t]["stop_epoch"] == epoch and fit.stats[t]["best_epoch"] == best_epoch
            assert fit.stats[t]["best_valid_loss"] == best


def _near_brute(rows, asks, k):
    out = {}
    for i, c, x in asks:
        d = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, own, y in rows if own == c and j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def test_neighbours_by_cells_match_brute_force(spark):
    """Clusters, a vector that a third of the rows share, a grid with ties;
    many pivots, cells dealt out in parts."""
    from softgrove.operators.balance import nearest_in_class
    rng = np.random.default_rng(3)
    rows = [(i, 0, [float(v) for v in rng.normal(size=3) + 10 * (i % 4)]) for i in range(150)]
    rows += [(i, 0, [1.5, 2.0, -1.0]) for i in range(150, 250)]
    rows += [(i, 1, [float(v) for v in rng.integers(0, 4, 3)]) for i in range(250, 400)]
    rows += [(i, 2, [float(i), 0.0, 0.0]) for i in range(400, 409)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    asks = df.where("row_id % 3 <> 1")
    for k in (1, 5):
        want = _near_brute(rows, [r for r in rows if r[0] % 3 != 1], k)
        for cell_rows in (8192, 40, 7):
            got = {r.row_id: [x.k for x in r.near] for r in nearest_in_class(df, asks, k, "label", "features", "row_id", cell_rows).collect()}
            assert got == want, (k, cell_rows)


def test_far_cells_are_not_visited():
    from softgrove.operators.balance import distances, visited_cells
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(size=(200, 4)) + 50 * c for c in range(8)])
    pivots = X[::100]
    d = np.sqrt(distances(X, pivots))
    cell, dp = d.argmin(axis=1), d.min(axis=1)
    own = [np.sort(dp[cell == c]) for c in range(len(pivots))]
    bound = {"n": np.array([len(o) for o in own]), "lo": np.array([o[0] for o in own]), "hi": np.array([o[-1] for o in own]),
             "least": np.array([o[:6] for o in own])}
    go = visited_cells(X, pivots, bound, 5)
    assert go.sum(axis=1).max() <= 3 and go[np.arange(len(X)), cell].all()
    near = np.argsort(distances(X, X), axis=1)[:, 1:6]
    assert go[np.arange(len(X))[:, None], cell[near]].all()


def test_smote_of_a_large_class_is_one_join(spark):
    """10^6 rows: cells of pivots, no union per block of asking rows."""
    from softgrove.operators.balance import nearest_in_class
    df = spark.range(1_000_000).selectExpr("id AS row_id", "0 AS label", "array(CAST(id % 1000 AS DOUBLE), CAST(id div 1000 AS DOUBLE)) AS features")
    out = nearest_in_class(df, df.where("row_id % 1000 < 2"), 5, "label", "features", "row_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Union") == 1
    got = {r.row_id: [x.k for x in r.near] for r in out.where("row_id IN (0, 500001)").collect()}
    assert got == {0: [1, 1000, 1001, 2, 2000], 500001: [499001, 500000, 500002, 501001, 499000]}


def test_preparation_rebalances_training_rows_only(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 10 == 0), float(rng.normal()), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, b double")
    plain = preprocess(df, ["a", "b"], seeds=[42, 43])
    for strategy in ("random", "smote"):
        out = preprocess(df, ["a", "b"], cfg=EngineConfig(rebalance=strategy), seeds=[42, 43])
        n = {(r["trial"], r["split"], r["label"]): r["count"] for r in out.groupBy("trial", "split", "label").count().collect()}
        before = {(r["trial"], r["split"], r["label"]): r["count"] for r in plain.groupBy("trial", "split", "label").count().collect()}
        for t in (1, 2):
            assert n[t, "train", 1] == n[t, "train", 0] == before[t, "train", 0] > before[t, "train", 1]
            assert all(n[t, s, c] == before[t, s, c] for s in ("valid", "test") for c in (0, 1))
        assert out.columns == plain.columns and out.where("trial = 1 AND seed <> 42").isEmpty()
    # not needed: as it was
    assert preprocess(df, ["a", "b"], cfg=EngineConfig(rebalance="random", balance_ratio=0.01), seeds=[42]).count() == 400


def _traffic(spark, job):
    """What ``job`` gives, and the bytes that its collects brought to the driver."""
    import pytest
    from pyspark import RDD
    got = []
    with pytest.MonkeyPatch.context() as m:
        import pickle
        plain = RDD.collect
        m.setattr(RDD, "collect", lambda self: (out := plain(self), got.append(len(pickle.dumps(out))))[0])
        return job(), sum(got)


def test_chained_epochs_are_the_same_and_send_no_gradients_to_the_driver(spark, monkeypatch):
    """Chains between tasks have the bits of in-task epochs; what the driver
    gets doesn't follow partitions x epochs."""
    import softgrove.operators.train as tr
    monkeypatch.setattr(tr, "CELL_ROWS", 100)
    monkeypatch.setattr(tr, "MIN_PARTITION_ROWS", 100)
    init = {1: init_model(4, 3, [0, 1, 2], 1), 2: init_model(4, 3, [2, 1, 0], 2)}
    cfg = EngineConfig(max_epochs=30, patience=6, learning_rate=0.05)
    df = _random_rows(spark, 1000, parts=7).cache()
    want = fit_soft_trees(df, init, cfg, key="row_id", in_task=True)
    monkeypatch.setattr(tr, "IN_TASK_VALUES", 0)
    sent = []
    for chain, epochs in ((25, 200), (4, 6)):
        monkeypatch.setattr(tr, "CHAIN", chain)
        got, n = _traffic(spark, lambda: fit_soft_trees(df, init, cfg, key="row_id", epochs_per_job=epochs))
        sent.append(n)
        assert got.history == want.history and got.models.keys() == want.models.keys()
        assert all(got.models[t].params().tobytes() == want.models[t].params().tobytes() for t in init)
        assert all(got.stats[t][c] == want.stats[t][c] for t in init for c in ("stop_epoch", "best_epoch", "best_valid_loss"))
    epochs_run = max(s["stop_epoch"] for s in want.stats.values())
    gradient_bytes = 16 * init[1].params().size
    assert sent[0] < epochs_run * len(init) * gradient_bytes


def test_chained_training_goes_on_from_its_snapshot(spark, monkeypatch, tmp_path):
    import pytest

    import softgrove.operators.train as tr
    df, cfg = _random_rows(spark, 300), EngineConfig(max_epochs=12)
    init = {1: init_model(3, 3, [0, 1, 2], 1), 2: init_model(3, 3, [2, 1, 0], 2)}
    whole = fit_soft_trees(df, init, cfg, key="row_id")
    monkeypatch.setattr(tr, "IN_TASK_VALUES", 0)
    write = tr.write_snapshot

    def cut_off(*a):
        write(*a)
        raise KeyboardInterrupt
    monkeypatch.setattr(tr, "write_snapshot", cut_off)
    with pytest.raises(KeyboardInterrupt):
        fit_soft_trees(df, init, cfg, key="row_id", epochs_per_job=5, snapshot=str(tmp_path / "s"))
    monkeypatch.setattr(tr, "write_snapshot", write)
    again = fit_soft_trees(df, init, cfg, key="row_id", epochs_per_job=5, snapshot=str(tmp_path / "s"))
    assert again.history == whole.history
    only_valid = df.where("trial = 1 OR split = 'valid'")
    with pytest.raises(ValueError, match="no training rows"):
        fit_soft_trees(only_valid, init, cfg, key="row_id")


def test_more_trials_than_cores_take_turns_in_tasks(spark, monkeypatch, tmp_path):
    """Large trials are trained in tasks where they keep the cores busy, no more
    at a time than cores; results and the epochs of snapshots stay the same."""
    import softgrove.operators.train as tr
    cores = spark.sparkContext.defaultParallelism
    trials = range(1, cores + 4)
    df = _random_rows(spark, 60, parts=3).where("trial = 1").drop("trial").withColumn("trial", F.explode(F.lit([*trials]))).cache()
    init = {t: init_model(3, 3, [0, 1, 2], t) for t in trials}
    cfg = EngineConfig(max_epochs=13, patience=3, learning_rate=0.2)
    want = fit_soft_trees(df, init, cfg, key="row_id", in_task=True, epochs_per_job=100)
    at_once, seen, task, write = [], [], tr._task_epochs, tr.write_snapshot
    monkeypatch.setattr(tr, "IN_TASK_VALUES", 0)
    monkeypatch.setattr(tr, "TURN_VALUES", 0)
    monkeypatch.setattr(tr, "TURN_EPOCHS", 2)
    monkeypatch.setattr(tr, "_chained_rounds", None)
    monkeypatch.setattr(tr, "_task_epochs", lambda bc, *a: (at_once.append(len(bc.value)), task(bc, *a))[1])
    monkeypatch.setattr(tr, "write_snapshot", lambda *a: (seen.append({s.epoch for s in a[-1].values() if not s.stopped}), write(*a)))
    got = fit_soft_trees(df, init, cfg, key="row_id", epochs_per_job=5, snapshot=str(tmp_path / "s"))
    assert got.history == want.history and all(got.models[t].params().tobytes() == want.models[t].params().tobytes() for t in trials)
    assert len(at_once) > 1 and max(at_once) <= cores
    assert seen[0] <= {5} and seen[1] <= {10} and seen[-1] == set()
    df.unpersist()
