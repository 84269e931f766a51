"""Full-batch training of soft trees by gradient descent (Adam) on the mean
focal loss, with early stopping on the validation loss.

Rows are dealt once into cells of about ``CELL_ROWS`` rows by a hash of their
key, whatever the input's partitions, and sorted within the cell. Loss and
gradient of a cell come from the numpy kernel; the cells' sums are added in
fixed point (``fixed``), so the total has the same bits in whatever order and on
however many partitions they are added.

The epochs then run in one of these ways, of which the size of a trial chooses
the first or the second. All take the same step (``advance``) on the same
sums, so the result is the same:

* A trial of at most ``IN_TASK_VALUES`` rows times leaves (an epoch of a
  fraction of a second) is one task's work: each job trains every trial for
  ``EPOCHS_PER_JOB`` epochs, next to its cached cells, and gives back the state.
  Stopped trials drop out of later jobs. Larger trials, up to ``IN_TASK_BYTES``,
  are so where there are about as many as cores or more, as no epoch then waits
  for another task or reads its cells again. If they are more than cores, a job
  takes as many trials as cores, those with the fewest epochs, for some seconds.
* Of other trials a job is a chain of ``CHAIN`` epochs over the cached cells,
  shared by all trials that still run. An epoch is two small shuffles: the
  parameters go to the partitions that hold the trial's cells, and the sums of
  these to the task that takes the trial's step. The driver sees the states
  once a chain and no gradients.
* With ``in_task=False`` each epoch is a job whose sums come back to the driver
  through a tree, and the driver takes the step.

Exchanging sums between the tasks of a barrier stage is no third way: each
``allGather`` of Spark's takes a second, as its waiting side sleeps that long.

The validation loss at the parameters of epoch ``e`` is produced by the
same pass that computes the gradient of epoch ``e + 1``; when it says stop,
that gradient is discarded.

With a ``snapshot`` folder the states (parameters, Adam moments, patience,
history) are written there every ``EPOCHS_PER_JOB`` epochs, in turn to one of
two slots, and a later call goes on from the last one written.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.config import ADAM_BETA1, ADAM_BETA2, ADAM_EPS, EngineConfig
from softgrove.operators.tree import SoftTreeModel, arrow_matrix, columns, focal_loss_sum, loss_and_grad_chunked

# Target bytes of feature values per block partition.
PARTITION_BYTES = 128 * 1024 * 1024
# Rows a partition should hold before another core is used.
MIN_PARTITION_ROWS = 512
# Rows of a cell, whose sums are added in fixed point.
CELL_ROWS = 2048
# Rows times leaves of a trial that one task trains on.
IN_TASK_VALUES = 4_000_000
# Bytes of feature values of a larger trial that one task trains on.
IN_TASK_BYTES = 384 * 1024 * 1024
# Rows times leaves times epochs that a task trains on in some seconds, and the
# least epochs for which it reads its cells.
TURN_VALUES, TURN_EPOCHS = 200_000_000, 10
# Epochs between two states that the driver sees (in-task) or writes.
EPOCHS_PER_JOB = 200
# Epochs of larger trials in one job.
CHAIN = 25
# Partial sums that one task (or the driver) adds up.
FAN_IN = 32

BLOCK_SCHEMA = "trial int, train boolean, n int, x binary, y binary"


@dataclass
class AdamState:
    m: np.ndarray
    v: np.ndarray
    t: int = 0

    def step(self, params: np.ndarray, grad: np.ndarray, lr: float) -> np.ndarray:
        self.t += 1
        self.m = ADAM_BETA1 * self.m + (1 - ADAM_BETA1) * grad
        self.v = ADAM_BETA2 * self.v + (1 - ADAM_BETA2) * grad * grad
        bc1 = 1 - ADAM_BETA1 ** self.t
        bc2 = 1 - ADAM_BETA2 ** self.t
        denom = np.sqrt(self.v) / np.sqrt(bc2) + ADAM_EPS
        return params - (lr / bc1) * self.m / denom


@dataclass
class TrialState:
    model: SoftTreeModel
    adam: AdamState
    epoch: int = 0
    best_val: float = float("inf")
    best_epoch: int = 0
    best_params: np.ndarray | None = None
    no_improve: int = 0
    stopped: bool = False
    stop_epoch: int = 0
    last_train_loss: float = float("nan")
    last_valid_loss: float = float("nan")
    pending_train_loss: float = float("nan")
    train_time: float = 0.0
    history: list[tuple[int, float, float]] = field(default_factory=list)


@dataclass
class FitResult:
    models: dict[int, SoftTreeModel]
    history: list[dict]
    stats: dict[int, dict] = field(default_factory=dict)


# ---------------------------------------------------------------------------
# sums that do not depend on their order

_HIGH, _LOW = 2.0 ** 12, 2.0 ** 52
_MASK = (1 << 52) - 1


def fixed(x: np.ndarray) -> np.ndarray:
    """[2, n] integers: the values in units of 2^-64, in two words of which
    the lower has 52 bits."""
    if not np.isfinite(x).all() or np.abs(x).max(initial=0.0) >= 2.0 ** 50:
        raise ValueError("training diverged: a loss or gradient is not finite")
    scaled = x * _HIGH
    high = np.floor(scaled)
    out = np.stack([high, np.rint((scaled - high) * _LOW)]).astype(np.int64)
    return _carried(out)


def _carried(a: np.ndarray) -> np.ndarray:
    a[0] += a[1] >> 52
    a[1] &= _MASK
    return a


def add_fixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _carried(a + b)


def from_fixed(a: np.ndarray) -> np.ndarray:
    return a[0] / _HIGH + a[1] / (_HIGH * _LOW)


# ---------------------------------------------------------------------------
# cells

def _pack_fn(features: str, label: str, trial_col: str, split_col: str):
    def fn(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        held: dict[tuple[int, bool, int], list] = {}
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = arrow_matrix(rb.column(features))
            if np.isnan(X).any():
                raise ValueError("training features hold NaN; fill missing values first")
            if rb.column(label).null_count:
                raise ValueError("training labels hold NULL")
            y = rb.column(label).to_numpy(zero_copy_only=False).astype(np.int32)
            trial = rb.column(trial_col).to_numpy(zero_copy_only=False).astype(np.int64)
            train = pc.equal(rb.column(split_col), "train").to_numpy(zero_copy_only=False)
            cell = rb.column("_cell").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((cell, train, trial))
            of = np.stack([trial[order], train[order], cell[order]])
            start = np.flatnonzero(np.append(True, (of[:, 1:] != of[:, :-1]).any(axis=0)))
            for a, b in zip(start, np.append(start[1:], len(order))):
                own = order[a:b]
                held.setdefault((int(of[0, a]), bool(of[1, a]), int(of[2, a])), []).append((X[own], y[own]))
        for t, part, cell in sorted(held):
            blocks = held.pop((t, part, cell))
            X = np.concatenate([b[0] for b in blocks])
            y = np.concatenate([b[1] for b in blocks])
            order = np.lexsort((*X.T[::-1], y))
            X, y = np.ascontiguousarray(X[order]), y[order]
            yield pa.RecordBatch.from_pydict({
                "trial": pa.array([t], pa.int32()), "train": [part], "n": pa.array([len(y)], pa.int32()),
                "x": pa.array([X.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})
    return fn


def _unpacked(r) -> tuple[int, bool, np.ndarray, np.ndarray]:
    return r.trial, r.train, np.frombuffer(r.x).reshape(r.n, -1), np.frombuffer(r.y, dtype=np.int32)


def pack_blocks(df: DataFrame, features: str = "features", label: str = "label", trial_col: str = "trial",
                split_col: str = "split", key: str | None = None, n_cells: int | None = None, n_parts: int | None = None) -> RDD:
    """The rows as cells (trial, is training, X, y), dealt by a hash of
    ``key`` (None: of features and label; a key spreads repeated rows).
    ``n_cells``: of each trial and split, by default from their counted rows.
    Raises on NULL or NaN features and on rows of unequal length."""
    if n_cells is None:
        most = df.groupBy(trial_col, split_col).count().agg(F.max("count")).first()[0] or 1
        n_cells = -(-most // CELL_ROWS)
    dealt = F.xxhash64(*([key] if key else [features, label]))
    rows = df.select(trial_col, split_col, features, label, F.pmod(dealt, F.lit(n_cells)).alias("_cell"))
    by = [trial_col, "_cell"]
    rows = rows.repartition(n_parts, *by) if n_parts else rows.repartition(*by)
    return rows.mapInArrow(_pack_fn(features, label, trial_col, split_col), BLOCK_SCHEMA).rdd.map(_unpacked)


def _laid_out(cell: tuple) -> tuple:
    """A cell as the epochs read it: features in columns."""
    t, train, X, y = cell
    return t, train, columns(X), y


# ---------------------------------------------------------------------------
# one pass

def _cell_sums(cells: Iterable, models: dict[int, SoftTreeModel], alpha: float, gamma: float) -> dict[int, list]:
    """Per trial: training rows, validation rows, and in fixed point the
    training loss, the validation loss and the gradient."""
    acc: dict[int, list] = {}
    for t, train, X, y in cells:
        m = models.get(t)
        if m is None:
            continue
        part = np.zeros(2 + m.thresholds.size + m.leaves.size)
        if train:
            part[0], part[2:] = loss_and_grad_chunked(X, y, m, alpha, gamma)
        else:
            part[1] = focal_loss_sum(X, y, m, alpha, gamma)
        acc = _add(acc, {t: [len(y) if train else 0, 0 if train else len(y), fixed(part)]})
    return acc


def _add(a: dict[int, list], b: dict[int, list]) -> dict[int, list]:
    out = dict(a)
    for t, (n, v, x) in b.items():
        out[t] = [out[t][0] + n, out[t][1] + v, add_fixed(out[t][2], x)] if t in out else [n, v, x]
    return out


def _read_out(total: dict[int, list]) -> dict[int, dict]:
    out = {}
    for t, (n, v, x) in total.items():
        x = from_fixed(x)
        out[t] = {"n_train": n, "n_valid": v, "train_loss": float(x[0]), "valid_loss": float(x[1]), "grad": x[2:]}
    return out


def epoch_job(blocks: RDD, models: dict[int, SoftTreeModel], alpha: float, gamma: float) -> dict[int, dict]:
    """One job: per trial, summed train loss and gradient and summed
    validation loss at the given parameters."""
    bc = blocks.context.broadcast(models)
    try:
        parts = blocks.mapPartitions(lambda cells: iter([_cell_sums(cells, bc.value, alpha, gamma)]))
        n = blocks.getNumPartitions()
        if n <= FAN_IN:
            total = reduce(_add, parts.collect(), {})
        else:
            total = parts.treeReduce(_add, depth=math.ceil(math.log(n, FAN_IN)))
    finally:
        bc.destroy()
    return _read_out(total)


def gradient(df: DataFrame, model: SoftTreeModel, alpha: float = 1.0, gamma: float = 2.0,
             features: str = "features", label: str = "label", key: str | None = None) -> dict:
    """Mean focal loss over the training rows and its gradient (rows
    without a ``split`` column all count as training rows)."""
    d = df.withColumn("_trial", F.lit(0))
    split = "split"
    if "split" not in df.columns:
        d, split = d.withColumn("_split", F.lit("train")), "_split"
    r = epoch_job(pack_blocks(d, features, label, "_trial", split, key), {0: model}, alpha, gamma)[0]
    return {"loss": r["train_loss"] / r["n_train"], "grad": r["grad"] / r["n_train"]}


# ---------------------------------------------------------------------------
# epochs

def advance(st: TrialState, r: dict | None, cfg: EngineConfig) -> None:
    """One epoch of a trial, given the sums at its parameters: judges the
    epoch before by its validation loss, then takes the next Adam step."""
    if r is None or r["n_train"] == 0:
        raise ValueError("a trial has no training rows")
    tl = r["train_loss"] / r["n_train"]
    vl = r["valid_loss"] / r["n_valid"] if r["n_valid"] else float("nan")
    if st.epoch >= 1:
        st.last_valid_loss = vl
        st.last_train_loss = st.pending_train_loss
        st.history.append((st.epoch, st.pending_train_loss, vl))
        if st.best_val - vl > cfg.min_improvement:
            st.best_val, st.best_epoch, st.no_improve = vl, st.epoch, 0
            st.best_params = st.model.params().copy()
        else:
            st.no_improve += 1
        if st.no_improve >= cfg.patience or st.epoch >= cfg.max_epochs:
            st.stopped, st.stop_epoch = True, st.epoch
            return
    st.pending_train_loss = tl
    st.model = st.model.with_params(st.adam.step(st.model.params(), r["grad"] / r["n_train"], cfg.learning_rate))
    st.epoch += 1


def _task_epochs(bc, cfg: EngineConfig, epochs: int):
    """Trains the trials whose cells are in this partition."""
    def fn(cells: Iterable) -> Iterator[tuple[int, TrialState]]:
        states, own = bc.value, {}
        for c in cells:
            if c[0] in states:
                own.setdefault(c[0], []).append(c)
        for t, mine in own.items():
            st, began = states[t], time.time()
            for _ in range(epochs):
                advance(st, _read_out(_cell_sums(mine, {t: st.model}, cfg.alpha, cfg.gamma)).get(t), cfg)
                if st.stopped:
                    break
            st.train_time += time.time() - began
            yield t, st
    return fn


def _in_task_rounds(blocks: RDD, places: dict[int, int], states: dict[int, TrialState], cfg: EngineConfig, epochs: int, turn: int) -> Iterator[None]:
    """Jobs of several epochs; a trial's cells are in the partition that
    ``places`` names. With more trials than cores a job is ``turn`` epochs of as
    many trials as cores, those behind first. Yields whenever all that run are
    ``epochs`` further, and at the end. A state's history stays behind."""
    sc, ahead = blocks.context, dict.fromkeys(states, 0)
    while active := [t for t, st in states.items() if not st.stopped]:
        least = min(ahead[t] for t in active)
        crowded = len(active) > sc.defaultParallelism
        own = sorted((t for t in active if ahead[t] < epochs), key=lambda t: ahead[t])[:sc.defaultParallelism if crowded else None]
        length = min(epochs - ahead[t] for t in own)
        if crowded or least > 0:
            length = min(length, turn)
        before = {t: states[t].history for t in own}
        for t in own:
            states[t].history = []
        bc = sc.broadcast({t: states[t] for t in own})
        try:
            got = dict(sc.runJob(blocks, _task_epochs(bc, cfg, length), [places[t] for t in own]))
        finally:
            bc.destroy()
        if missing := set(own) - got.keys():
            raise ValueError(f"trials {sorted(missing)} have no training rows")
        for t, st in got.items():
            st.history = before[t] + st.history
            states[t] = st
            ahead[t] += length
        left = [t for t in active if not states[t].stopped]
        if all(ahead[t] >= epochs for t in left):
            ahead = dict.fromkeys(states, 0)
            yield


def _job_rounds(blocks: RDD, states: dict[int, TrialState], cfg: EngineConfig, epochs: int) -> Iterator[None]:
    """Jobs of one epoch, shared by all trials that still run. Yields every
    ``epochs`` of them, and at the end."""
    done = 0
    while active := [t for t, st in states.items() if not st.stopped]:
        began = time.time()
        sums = epoch_job(blocks, {t: states[t].model for t in active}, cfg.alpha, cfg.gamma)
        for t in active:
            advance(states[t], sums.get(t), cfg)
            states[t].train_time += time.time() - began
        done += 1
        if done % epochs == 0 or all(st.stopped for st in states.values()):
            yield


def _place(k: int) -> int:
    return k


def _spread(places: dict[int, list[int]]):
    """A state goes to the first of its trial's partitions of cells, which
    hands it on, and the parameters of a running trial to the others."""
    def fn(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        for _, (t, st) in rows:
            yield places[t][0], (t, st)
            if not st.stopped:
                yield from ((p, (t, st.model)) for p in places[t][1:])
    return fn


def _partial_sums(slots: dict[int, int], alpha: float, gamma: float):
    """Of a partition, in which states and parameters stand before the cells:
    the states as they are, and the cells' sums."""
    def fn(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        models = {}

        def cells() -> Iterator[tuple]:
            for _, x in rows:
                if len(x) > 2:  # all are read: a worker that leaves rows unread is not used again
                    yield x
                elif isinstance(x[1], TrialState):
                    states.append(x)
                    if not x[1].stopped:
                        models[x[0]] = x[1].model
                else:
                    models[x[0]] = x[1]

        states: list[tuple] = []
        sums = _cell_sums(cells(), models, alpha, gamma)
        yield from ((slots[t], (t, st)) for t, st in states)
        yield from ((slots[t], (t, x)) for t, x in sums.items())
    return fn


def _steps(cfg: EngineConfig):
    """Adds up the sums of each trial and takes its step. A trial without
    training rows is left out."""
    def fn(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        states, sums = {}, {}
        for slot, (t, x) in rows:
            if isinstance(x, TrialState):
                states[t] = slot, x
            else:
                sums = _add(sums, {t: x})
        sums = _read_out(sums)
        for t, (slot, st) in states.items():
            if not st.stopped:
                if t not in sums or sums[t]["n_train"] == 0:
                    continue
                advance(st, sums[t], cfg)
            yield slot, (t, st)
    return fn


def _dealt(blocks: RDD, places: dict[int, list[int]]) -> RDD:
    """The cells, a trial's in turn to the partitions ``places`` names."""
    def fn(part: int, cells: Iterable) -> Iterator[tuple[int, tuple]]:
        turn = dict.fromkeys(places, part)
        for c in cells:
            if c[0] in places:
                yield places[c[0]][turn[c[0]] % len(places[c[0]])], c
                turn[c[0]] += 1
    return blocks.mapPartitionsWithIndex(fn).partitionBy(sum(map(len, places.values())), _place)


def _chained_rounds(cells: RDD, places: dict[int, list[int]], states: dict[int, TrialState], cfg: EngineConfig, epochs: int) -> Iterator[None]:
    """Jobs of up to ``CHAIN`` epochs, shared by all trials that still run;
    ``cells`` are those of ``_dealt``. Yields every ``epochs`` of them, and at the
    end. A state's history stays behind."""
    sc, n, done = cells.context, cells.getNumPartitions(), 0
    while active := {t: st for t, st in states.items() if not st.stopped}:
        began, before = time.time(), {t: st.history for t, st in active.items()}
        for st in active.values():
            st.history = []
        slots = {t: k % max(1, sc.defaultParallelism) for k, t in enumerate(active)}
        n_slots = max(slots.values()) + 1
        rows = sc.parallelize([(slots[t], (t, st)) for t, st in active.items()], n_slots)
        length = min(CHAIN, epochs - done % epochs)
        for _ in range(length):
            # both sides are dealt alike, so the union puts partition to partition
            mixed = rows.mapPartitions(_spread(places)).partitionBy(n, _place).union(cells)
            if mixed.getNumPartitions() != n:
                raise RuntimeError("parameters and cells are not dealt alike")
            rows = mixed.mapPartitions(_partial_sums(slots, cfg.alpha, cfg.gamma)).partitionBy(n_slots, _place).mapPartitions(_steps(cfg))
        got = dict(rows.values().collect())
        if missing := active.keys() - got.keys():
            raise ValueError(f"trials {sorted(missing)} have no training rows")
        for t, st in got.items():
            st.history = before[t] + st.history
            st.train_time += time.time() - began
            states[t] = st
        done += length
        if done % epochs == 0 or all(st.stopped for st in states.values()):
            yield


# ---------------------------------------------------------------------------
# snapshots

SNAPSHOT_SCHEMA = ("settings string, step long, trial int, epoch int, params array<double>, m array<double>, v array<double>, t int, best_val double, "
                   "best_epoch int, best_params array<double>, no_improve int, stopped boolean, stop_epoch int, last_train_loss double, last_valid_loss double, "
                   "pending_train_loss double, train_time double, history array<struct<epoch:int,train_loss:double,valid_loss:double>>")
_PLAIN = ("epoch", "best_val", "best_epoch", "no_improve", "stopped", "stop_epoch", "last_train_loss", "last_valid_loss", "pending_train_loss", "train_time")


def _settings(init: dict[int, SoftTreeModel], cfg: EngineConfig) -> str:
    """Digest of what a snapshot has to agree on."""
    said = [(t, m.depth, m.num_classes, list(map(int, m.feature_order)), m.params().tolist()) for t, m in sorted(init.items())]
    said.append((cfg.alpha, cfg.gamma, cfg.learning_rate, cfg.max_epochs, cfg.patience, cfg.min_improvement))
    return hashlib.sha256(repr(said).encode()).hexdigest()


def write_snapshot(spark: SparkSession, folder: str, settings: str, step: int, states: dict[int, TrialState]) -> None:
    """One row per trial, in the slot that does not hold the snapshot before."""
    rows = [(settings, step, t, *(getattr(st, c) for c in _PLAIN[:1]), st.model.params().tolist(), st.adam.m.tolist(), st.adam.v.tolist(), st.adam.t,
             st.best_val, st.best_epoch, None if st.best_params is None else st.best_params.tolist(), *(getattr(st, c) for c in _PLAIN[3:]), st.history)
            for t, st in states.items()]
    spark.createDataFrame(rows, SNAPSHOT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/slot-{step % 2}")


def read_snapshot(spark: SparkSession, folder: str, settings: str, states: dict[int, TrialState]) -> int:
    """Puts the newest whole snapshot into ``states`` and returns its step, 0
    without one. Raises if it was written under other settings."""
    found: list = []
    for slot in (0, 1):
        try:
            rows = spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{folder}/slot-{slot}").collect()
        except AnalysisException:  # no such folder
            continue
        if len(rows) == len(states) and rows[0].step > (found[0].step if found else 0):
            found = rows
    for r in found:
        if r.settings != settings:
            raise ValueError(f"the snapshot in {folder} belongs to other models or settings")
        st = states[r.trial]
        st.model = st.model.with_params(np.array(r.params))
        st.adam = AdamState(np.array(r.m), np.array(r.v), r.t)
        st.best_params = None if r.best_params is None else np.array(r.best_params)
        st.history = [tuple(h) for h in r.history]
        for c in _PLAIN:
            setattr(st, c, r[c])
    return found[0].step if found else 0


def _many_trials(trials: int, cores: int) -> bool:
    """Whether a task for each trial keeps the cores busier than chains do,
    which take some 1.6 times the time for a row."""
    return trials > 1 and 8 * trials >= 5 * cores


def fit_soft_trees(df: DataFrame, init: dict[int, SoftTreeModel], cfg: EngineConfig | None = None,
                   features: str = "features", label: str = "label", trial_col: str = "trial",
                   split_col: str = "split", key: str | None = None, in_task: bool | None = None,
                   epochs_per_job: int = EPOCHS_PER_JOB, snapshot: str | None = None) -> FitResult:
    """Train one model per trial on the rows of that trial.

    ``in_task``: whether a trial is trained within a task, or if not, by the
    driver's steps (None: by its size, and the number of trials, within a task
    or in chains).
    ``snapshot``: a shared folder for the states; a call that finds one of the
    same models and settings there goes on from it."""
    cfg = cfg or EngineConfig()
    spark = df.sparkSession
    rows = df.where(F.col(split_col).isin("train", "valid"))
    sizes = rows.groupBy(trial_col, split_col).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("f"))
    n_rows, most, n_feat = sizes.agg(F.sum("n"), F.max("n"), F.max("f")).first()
    n_rows, most, n_feat = n_rows or 0, most or 1, n_feat or 1
    chained = False
    if in_task is None:
        leaves = max(2 ** m.depth for m in init.values())
        cores = spark.sparkContext.defaultParallelism
        in_task = most * leaves <= IN_TASK_VALUES or _many_trials(len(init), cores) and n_rows * n_feat * 8 // len(init) <= IN_TASK_BYTES
        chained = not in_task
    n_cells = -(-most // CELL_ROWS)
    # Partitions sized by data, and for small tables by a least number of
    # rows up to the number of cores.
    by_size = -(-(n_rows * n_feat * 8) // PARTITION_BYTES)
    n_parts = max(1, by_size, min(spark.sparkContext.defaultParallelism, n_rows // MIN_PARTITION_ROWS))
    blocks = pack_blocks(rows, features, label, trial_col, split_col, key, n_cells, n_parts).map(_laid_out)
    if in_task:
        place = {t: k for k, t in enumerate(sorted(init))}
        blocks = blocks.keyBy(lambda c: c[0]).partitionBy(len(place), lambda t: place.get(t, 0)).values()
        turn = max(TURN_EPOCHS, TURN_VALUES // max(1, n_rows // len(init) * max(2 ** m.depth for m in init.values())))
    elif chained:
        # few partitions a trial, as each of them sends a gradient an epoch;
        # more than cores where trials stop one after the other
        cores = min(spark.sparkContext.defaultParallelism, n_rows // MIN_PARTITION_ROWS) * (2 if len(init) > 1 else 1)
        own = max(1, -(-max(by_size, cores) // len(init)))
        places = {t: list(range(k * own, (k + 1) * own)) for k, t in enumerate(sorted(init))}
        blocks = _dealt(blocks, places)
    # as the bytes that Python reads, which a chain does every epoch
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    states = {t: TrialState(m, AdamState(np.zeros(m.params().size), np.zeros(m.params().size))) for t, m in init.items()}
    settings, step = _settings(init, cfg), 0
    if snapshot:
        step = read_snapshot(spark, snapshot, settings, states)
    try:
        rounds = (_chained_rounds(blocks, places, states, cfg, epochs_per_job) if chained
                  else _in_task_rounds(blocks, place, states, cfg, epochs_per_job, turn) if in_task
                  else _job_rounds(blocks, states, cfg, epochs_per_job))
        for _ in rounds:
            step += 1
            if snapshot:
                write_snapshot(spark, snapshot, settings, step, states)
    finally:
        blocks.unpersist()
    models, history, stats = {}, [], {}
    for t, st in states.items():
        best = cfg.restore == "best" and st.best_params is not None
        models[t] = st.model.with_params(st.best_params) if best else st.model
        history += [{"trial": t, "epoch": e, "train_loss": a, "valid_loss": b} for e, a, b in st.history]
        stats[t] = {"best_epoch": st.best_epoch, "stop_epoch": st.stop_epoch,
                    "last_train_loss": st.last_train_loss, "last_valid_loss": st.last_valid_loss,
                    "best_valid_loss": st.best_val, "train_time": st.train_time}
    return FitResult(models, history, stats)
