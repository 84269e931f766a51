"""Repeated seeded trials: prepare, rank features, train, evaluate, and
summarize — every trial in the same Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.config import EngineConfig
from softgrove.operators.evaluate import evaluate
from softgrove.operators.rank import mutual_information, rank_features
from softgrove.operators.train import fit_soft_trees
from softgrove.operators.tree import choose_depth, init_model
from softgrove.plans.prepare import PackedTrials, pack_trials, preprocess

TRIALS_SCHEMA = ("Trial int, Seed int, name string, Depth int, `Optimal Epoch` int, `Train Accuracy` double, "
                 "`Test Accuracy` double, `Train F1 Macro` double, `Test F1 Macro` double, `Train Loss` double, "
                 "`Validation Loss` double, `Train Time` double, `Test Accuracy Time` double, `Best Epoch` int")


@dataclass
class TrialRun:
    trials: DataFrame
    summary: DataFrame
    models: dict
    history: list
    prepared: DataFrame


# All trials are prepared together (rows repeated once per seed) while
# rows x features x trials stays within this many values; beyond it, seeds
# run in batches (one seed at a time for the largest inputs), so that no
# batch's fits and training cells exceed the bound. The rows of all batches
# are then kept once, packed, unless the configuration says otherwise.
TRIAL_BATCH_VALUES = 2_000_000_000


def run_trials(spark: SparkSession, df: DataFrame, name: str, feature_cols: list[str],
               categorical: list[str] | None = None, cfg: EngineConfig | None = None,
               label: str = "label", key: str = "row_id", seeds=None,
               trial_batch: int | None = None, sink: str | None = None, snapshot: str | None = None) -> TrialRun:
    """``sink``: a folder to which each batch's trial rows are written as soon
    as the batch ends, so a failure later loses none of them. ``snapshot``: a
    shared folder for training states; a run that was cut off goes on from
    the last of them when it is called again."""
    cfg = cfg or EngineConfig()
    seeds = list(seeds if seeds is not None else cfg.seeds)
    if trial_batch is None:
        n_rows = df.count()
        per_trial = max(1, n_rows * max(1, len(feature_cols)))
        trial_batch = max(1, min(len(seeds), TRIAL_BATCH_VALUES // per_trial))
    rows, models, history, prepared_all = [], {}, [], None
    packed = None
    if trial_batch < len(seeds) if cfg.packed_trials is None else cfg.packed_trials:
        packed = pack_trials(df, feature_cols, categorical, label, key, cfg, seeds)
    for start in range(0, len(seeds), trial_batch):
        batch = seeds[start:start + trial_batch]
        res = _run_batch(df, name, feature_cols, categorical, cfg, label, key, batch, start,
                         f"{snapshot}/trials-{start + 1}" if snapshot else None, packed)
        rows += res[0]
        if sink:
            write_trials(spark.createDataFrame(res[0], TRIALS_SCHEMA), sink)
        models.update(res[1])
        history += res[2]
        prepared_all = res[3] if prepared_all is None else prepared_all.unionByName(res[3])
    trials = spark.createDataFrame(rows, TRIALS_SCHEMA)
    return TrialRun(trials, summarize_trials(trials), models, history, prepared_all)


def _run_batch(df, name, feature_cols, categorical, cfg, label, key, seeds, offset, snapshot=None, packed: PackedTrials | None = None):
    """Trials ``offset + 1 ..`` for ``seeds``: prepare, rank, train, evaluate."""
    trial_ids = list(range(offset + 1, offset + len(seeds) + 1))
    if packed is not None:
        prepared = packed.prepare(cfg, trial_ids)
    else:
        prepared = preprocess(df, feature_cols, categorical, label, key, cfg, seeds)
        if offset:
            prepared = prepared.withColumn("trial", F.col("trial") + offset)
    # Classes over train + valid + test (codes are contiguous by construction).
    num_classes = prepared.where(F.col("trial") == trial_ids[0]).agg(F.countDistinct("label")).first()[0]
    depth = cfg.depth or choose_depth(len(feature_cols))
    mi = mutual_information(prepared, by=["trial"], seed="seed", method=cfg.mi_method, k=cfg.mi_neighbours)
    orders = rank_features(mi, by=["trial"])
    init = {t: init_model(depth, num_classes, orders[(t,)], s) for t, s in zip(trial_ids, seeds)}
    fit = fit_soft_trees(prepared, init, cfg, key="row_id", snapshot=snapshot)
    train_m, _ = evaluate(prepared.where(F.col("split") == "train"), fit.models, by=["trial"])
    test_m, test_time = evaluate(prepared.where(F.col("split") == "test"), fit.models, by=["trial"])
    rows = []
    for t, seed in zip(trial_ids, seeds):
        st = fit.stats[t]
        rows.append((t, int(seed), name, depth, int(st["stop_epoch"]),
                     float(train_m[(t,)]["accuracy"]), float(test_m[(t,)]["accuracy"]),
                     float(train_m[(t,)]["f1_macro"]), float(test_m[(t,)]["f1_macro"]),
                     float(st["last_train_loss"]), float(st["last_valid_loss"]), float(st["train_time"]),
                     float(test_time / len(seeds)), int(st["best_epoch"])))
    return rows, fit.models, fit.history, prepared


def summarize_trials(trials: DataFrame) -> DataFrame:
    """Per (name, depth): mean and population std of test accuracy and
    macro F1, mean training and test-scoring times."""
    return trials.groupBy(F.col("name").alias("Dataset Name"), F.col("Depth")).agg(
        F.avg("Test Accuracy").alias("Mean Test Accuracy"),
        F.stddev_pop("Test Accuracy").alias("Std Test Accuracy"),
        F.avg("Test F1 Macro").alias("Mean F1 Score"),
        F.stddev_pop("Test F1 Macro").alias("Std F1 Score"),
        F.avg("Train Time").alias("Mean Training Time"),
        F.avg("Test Accuracy Time").alias("Mean Test Acc Time"))


def write_trials(trials: DataFrame, path: str) -> None:
    """Trial rows partitioned by trial; re-running a trial overwrites only
    its own partition."""
    (trials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("Trial").option("header", True).csv(path))


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
