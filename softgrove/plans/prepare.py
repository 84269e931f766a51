"""Preparation plan: trials -> exact stratified split -> leave-one-out
encoding -> feature array -> fitted normalization (-> rebalanced training
rows, if asked for).

All trials are prepared in ONE plan: each input row is repeated once per
seed (``explode`` of a literal array, not a join) and ``trial`` is a
grouping key of every fit. The output is
``(trial, seed, row_id, split, label, features ARRAY<DOUBLE>)``.

``pack_trials`` keeps the rows of any number of trials once: a row with the
split codes of all trials, two bits each. The output above is then a view of
it that repeats, encodes and normalizes rows as they are read, so nothing is
written once per seed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.config import EngineConfig
from softgrove.operators._util import maybe_broadcast, qcol
from softgrove.operators.balance import oversample_random, oversample_smote
from softgrove.operators.encode import LeaveOneOut
from softgrove.operators.labels import minority_share
from softgrove.operators.normalize import MinMaxNormalizer, QuantileNormalizer, StandardNormalizer
from softgrove.operators.split import split_cuts, split_hash, split_of, stratified_split
from softgrove.session import materialize


def with_trials(df: DataFrame, seeds) -> DataFrame:
    trials = F.array(*[F.struct(F.lit(i + 1).alias("trial"), F.lit(int(s)).alias("seed"))
                       for i, s in enumerate(seeds)])
    return df.select("*", F.explode(trials).alias("_t")).select("*", "_t.trial", "_t.seed").drop("_t")


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> Column:
    return F.array(*[qcol(c).cast("double") for c in cols]).alias(out)


def rebalance_training(df: DataFrame, strategy: str, ratio: float, seed: int = 42, store: bool = False) -> DataFrame:
    """Adds rows of small classes to each trial's training rows, if the
    smallest class has at most ``ratio / (K - 1)`` of them. A stratified split
    gives all trials the same class sizes, so one decision holds for all.
    ``store``: the added rows are stored."""
    train = df.where(F.col("split") == "train")
    if not minority_share(train, "label", ratio).first()["needs_rebalance"]:
        return df
    cls = F.concat_ws(":", F.col("trial").cast("string"), F.col("label").cast("string"))
    own = train.select("row_id", cls.alias("_class"), "features")
    if strategy == "smote":
        more = oversample_smote(own, "_class", "features", "row_id", seed=seed)
    elif strategy == "random":
        more = oversample_random(own, "_class", "row_id", seed)
    else:
        raise ValueError(f"unknown rebalancing strategy: {strategy}")
    more = more.where("draw >= 0")
    seeds = df.select("trial", "seed").distinct()
    part = F.split("_class", ":")
    more = more.select(part[0].cast("int").alias("trial"), "row_id", F.lit("train").alias("split"), part[1].cast("int").alias("label"), "features")
    # as many rows as trials
    more = more.join(F.broadcast(seeds), "trial").select(*df.columns)
    return df.unionByName(materialize(more) if store else more)


# Split codes of two bits that a 64-bit word holds.
WORD_TRIALS = 32
SPLITS = ("train", "valid", "test")


@dataclass
class PackedTrials:
    """Rows of several trials, each stored once."""

    rows: DataFrame  # row_id, label, _codes0, _codes1, ..., the input columns
    seeds: list[int]
    feature_cols: list[str]
    categorical: list[str]

    def trials(self, which: list[int] | None = None) -> DataFrame:
        """(row_id, label, input columns, trial, seed, split) of the trials
        ``which`` (from 1; all by default): a view, no shuffle."""
        which = list(which or range(1, len(self.seeds) + 1))
        each = F.array(*[F.struct(F.lit(t).alias("trial"), F.lit(int(self.seeds[t - 1])).alias("seed"),
                                  F.lit(2 * ((t - 1) % WORD_TRIALS)).alias("shift"),
                                  F.col(f"_codes{(t - 1) // WORD_TRIALS}").alias("word")) for t in which])
        own = [qcol(c) for c in self.feature_cols]
        code = F.call_function("shiftright", F.col("_t.word"), F.col("_t.shift")).bitwiseAND(F.lit(3)).cast("int")
        return (self.rows.select("row_id", "label", *own, F.explode(each).alias("_t"))
                .select("row_id", "label", *own, "_t.trial", "_t.seed",
                        F.get(F.array(*[F.lit(s) for s in SPLITS]), code).alias("split")))

    def prepare(self, cfg: EngineConfig | None = None, which: list[int] | None = None) -> DataFrame:
        """The prepared rows of the trials ``which``, as ``preprocess`` gives
        them: fitted now, encoded and normalized whenever they are read. Rows
        that rebalancing adds are stored."""
        cfg = cfg or EngineConfig()
        out = _fitted(self.trials(which), self.feature_cols, self.categorical, cfg, store=True)
        return rebalance_training(out, cfg.rebalance, cfg.balance_ratio, store=True) if cfg.rebalance else out


def pack_trials(df: DataFrame, feature_cols: list[str], categorical: list[str] | None = None, label: str = "label",
                key: str = "row_id", cfg: EngineConfig | None = None, seeds=None) -> PackedTrials:
    """Splits of all seeds, on one stored copy of the rows. The cuts are found
    on (key, label, seed) alone; a row meets its class's cuts of all trials in
    one join (broadcast behind a check of classes x trials)."""
    cfg = cfg or EngineConfig()
    seeds = [int(s) for s in (seeds if seeds is not None else cfg.seeds)]
    base = df.select(F.col(key).alias("row_id"), F.col(label).cast("int").alias("label"), *[qcol(c) for c in feature_cols])
    cuts, bound = split_cuts(with_trials(base.select("row_id", "label"), seeds), valid_fraction=cfg.valid_fraction,
                             test_fraction=cfg.test_fraction, seed="seed", by=["trial"])
    own = cuts.groupBy(F.col("label").alias("_label")).agg(
        F.array_sort(F.collect_list(F.struct("trial", "_test_cut", "_valid_cut"))).alias("_cuts"))
    rows = base.join(maybe_broadcast(own, bound), F.col("label") == F.col("_label"))

    def code(i: int) -> Column:
        cut = F.get("_cuts", F.lit(i))
        split = split_of(split_hash(F.col("row_id"), F.lit(seeds[i])), F.col("row_id"), cut["_test_cut"], cut["_valid_cut"])
        number = F.when(split == SPLITS[0], 0).when(split == SPLITS[1], 1).otherwise(2).cast("long")
        return F.shiftleft(number, 2 * (i % WORD_TRIALS))

    words = [reduce(lambda a, b: a.bitwiseOR(b), [code(i) for i in range(w, min(w + WORD_TRIALS, len(seeds)))])
             for w in range(0, len(seeds), WORD_TRIALS)]
    rows = rows.select("row_id", "label", *[w.alias(f"_codes{k}") for k, w in enumerate(words)], *[qcol(c) for c in feature_cols])
    return PackedTrials(materialize(rows), seeds, list(feature_cols), [c for c in (categorical or []) if c in feature_cols])


def _fitted(t: DataFrame, feature_cols: list[str], categorical: list[str], cfg: EngineConfig, store: bool = False) -> DataFrame:
    """Fits the encoder and the normalizer on the training rows of each trial
    and returns the rows with both applied. ``store``: parameters are stored,
    so a view that is read more than once doesn't fit them again."""
    if categorical:
        t = LeaveOneOut(categorical, label="label", by=["trial"]).fit(t).transform(t)
    t = t.select("trial", "seed", "row_id", "split", "label", assemble(t, feature_cols))
    if cfg.normalization == "quantile":
        norm = QuantileNormalizer(noise=cfg.quantile_noise, n_quantiles=cfg.n_quantiles,
                                  seed=cfg.quantile_noise_seed, method=cfg.quantile_method,
                                  by=["trial"]).fit(t)
    elif cfg.normalization == "min-max":
        norm = MinMaxNormalizer(by=["trial"]).fit(t)
    elif cfg.normalization == "mean":
        norm = StandardNormalizer(by=["trial"]).fit(t)
    else:
        raise ValueError(f"unknown normalization: {cfg.normalization}")
    if store:
        norm.params = materialize(norm.params)
    return norm.transform(t).select("trial", "seed", "row_id", "split", "label", "features")


def preprocess(df: DataFrame, feature_cols: list[str], categorical: list[str] | None = None,
               label: str = "label", key: str = "row_id", cfg: EngineConfig | None = None,
               seeds=None, materialize_output: bool = True) -> DataFrame:
    """With ``materialize_output`` the prepared table is checkpointed (the
    shared checkpoint folder) and the split, which every fit reads, is kept
    in the cache only while the fits run."""
    cfg = cfg or EngineConfig()
    seeds = list(seeds if seeds is not None else cfg.seeds)
    categorical = [c for c in (categorical or []) if c in feature_cols]
    base = df.select(F.col(key).alias("row_id"), F.col(label).cast("int").alias("label"),
                     *[qcol(c) for c in feature_cols])
    t = with_trials(base, seeds)
    t = stratified_split(t, label="label", key="row_id", valid_fraction=cfg.valid_fraction,
                         test_fraction=cfg.test_fraction, seed="seed", by=["trial"])
    split_cache = t.persist(StorageLevel.MEMORY_AND_DISK) if materialize_output else None
    t = split_cache if split_cache is not None else t
    out = _fitted(t, feature_cols, categorical, cfg)
    if materialize_output:
        out = materialize(out)
        split_cache.unpersist()
    if cfg.rebalance:
        out = rebalance_training(out, cfg.rebalance, cfg.balance_ratio)
        out = materialize(out) if materialize_output else out
    return out
