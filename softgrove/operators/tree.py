"""Soft axis-aligned decision tree: model, scoring, prediction, focal loss.

A complete tree of depth ``d`` has ``2**d - 1`` inner nodes in breadth-first
order and ``2**d`` leaves. Inner node ``i`` tests feature
``order[i mod F]`` with left probability ``sigmoid(theta_i - x)``; a leaf's
probability is the product of the decisions on its path (child ``2j`` is
left, ``2j + 1`` right, within a level); class scores are the leaf
probabilities times the leaf matrix ``[2**d, K]``.

Scoring of shallow trees (d <= EXPR_DEPTH_LIMIT) is generated Column
arithmetic (whole-stage codegen); deeper trees run the numpy kernel below
on Arrow batches with the model broadcast, or with ``mode="fold"`` stay in the
JVM: a fold over arrays of nodes, level by level, with higher-order functions.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.config import DEEP_FEATURE_LIMIT, DEPTH_DEEP, DEPTH_SHALLOW
from softgrove.functions.columns import argmax, log_softmax, softmax

EXPR_DEPTH_LIMIT = 4


@dataclass
class SoftTreeModel:
    depth: int
    num_classes: int
    feature_order: list[int]
    thresholds: np.ndarray  # [2**d - 1]
    leaves: np.ndarray  # [2**d, K]
    meta: dict = field(default_factory=dict)

    @property
    def n_nodes(self) -> int:
        return 2 ** self.depth - 1

    def node_features(self) -> np.ndarray:
        f = len(self.feature_order)
        return np.array([self.feature_order[i % f] for i in range(self.n_nodes)], dtype=np.int64)

    def params(self) -> np.ndarray:
        return np.concatenate([self.thresholds.ravel(), self.leaves.ravel()])

    def with_params(self, p: np.ndarray) -> "SoftTreeModel":
        n = self.n_nodes
        return SoftTreeModel(self.depth, self.num_classes, list(self.feature_order), p[:n].copy(),
                             p[n:].reshape(2 ** self.depth, self.num_classes).copy(), dict(self.meta))

    def to_row(self) -> dict:
        return {"depth": self.depth, "num_classes": self.num_classes, "feature_order": list(map(int, self.feature_order)),
                "thresholds": self.thresholds.tolist(), "leaves": self.leaves.tolist()}

    @staticmethod
    def from_row(r) -> "SoftTreeModel":
        return SoftTreeModel(int(r["depth"]), int(r["num_classes"]), list(r["feature_order"]),
                             np.asarray(r["thresholds"], dtype=np.float64), np.asarray(r["leaves"], dtype=np.float64))


MODEL_SCHEMA = "trial int, depth int, num_classes int, feature_order array<int>, thresholds array<double>, leaves array<array<double>>"


def choose_depth(n_features: int) -> int:
    """Deep tree for more than 100 features, else shallow."""
    return DEPTH_DEEP if n_features > DEEP_FEATURE_LIMIT else DEPTH_SHALLOW


def assign_features(order: list[int], depth: int) -> list[int]:
    """Feature tested by each inner node, breadth-first: ``order[i mod F]``."""
    return [order[i % len(order)] for i in range(2 ** depth - 1)]


def init_model(depth: int, num_classes: int, feature_order: list[int], seed: int) -> SoftTreeModel:
    """Thresholds and leaf values drawn from N(0, 1) with a seeded generator."""
    rng = np.random.default_rng(seed)
    th = rng.standard_normal(2 ** depth - 1)
    lv = rng.standard_normal((2 ** depth, num_classes))
    return SoftTreeModel(depth, num_classes, list(feature_order), th, lv)


# ---------------------------------------------------------------------------
# numpy kernel (runs inside tasks on Arrow batches)

# Values and thresholds up to which exp(x) * exp(-theta) neither overflows nor
# loses bits.
POWER_LIMIT = 300.0
_OWN = threading.local()


def _scratch(name: str, rows: int, n: int) -> np.ndarray:
    """A working array, kept from call to call: fresh memory for each costs
    more than what is computed in it."""
    held = _OWN.__dict__.setdefault("arrays", {})
    if name not in held or held[name].size < rows * n:
        held[name] = np.empty(rows * n)
    return held[name][:rows * n].reshape(rows, n)


@dataclass
class Columns:
    """Feature values ``[F, n]``, a feature's next to each other: exp(x), which no
    epoch changes, where no value is too large for that."""

    values: np.ndarray
    powers: bool

    def __len__(self) -> int:
        return self.values.shape[1]

    def __getitem__(self, rows: slice) -> "Columns":
        return Columns(self.values[:, rows], self.powers)


def columns(X) -> Columns:
    """``Columns`` of a matrix ``[n, F]`` (or as they are)."""
    if isinstance(X, Columns):
        return X
    values = np.array(X.T, dtype=np.float64, order="C")
    powers = bool(np.abs(values).max(initial=0.0) <= POWER_LIMIT)  # not if NaN
    return Columns(np.exp(values, out=values) if powers else values, powers)


@lru_cache(maxsize=32)
def _layout(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which the kernel keeps inner nodes and leaves: level by
    level, all left children of a level before the right ones, so a level is
    computed from the one before in whole pieces of memory."""
    own, nodes = np.zeros(1, dtype=np.int64), [np.zeros(0, dtype=np.int64)]
    for lv in range(depth):
        nodes.append(2 ** lv - 1 + own)
        own = np.concatenate([2 * own, 2 * own + 1])
    return np.concatenate(nodes), own


def _decisions(X: Columns, model: SoftTreeModel) -> np.ndarray:
    """sigmoid(theta - x) = 1 / (1 + exp(x - theta)), ``[nodes, n]``."""
    nodes, _ = _layout(model.depth)
    th = model.thresholds[nodes, None]
    D = _scratch("decisions", model.n_nodes, len(X))
    if max(model.feature_order) >= len(X.values):
        raise IndexError(f"the model tests feature {max(model.feature_order)} of {len(X.values)}")
    np.take(X.values, np.asarray(model.feature_order)[nodes % len(model.feature_order)], axis=0, out=D, mode="clip")
    if X.powers and bool(np.abs(th).max(initial=0.0) <= POWER_LIMIT):
        D *= np.exp(-th)
    else:
        if X.powers:
            np.log(D, out=D)
        D -= th
        with np.errstate(over="ignore"):
            np.exp(D, out=D)
    D += 1.0
    return np.divide(1.0, D, out=D)


def _forward(X: Columns, model: SoftTreeModel) -> tuple[np.ndarray, np.ndarray]:
    """Decisions ``[nodes, n]`` and leaf probabilities ``[2**d, n]`` in the order of
    ``_layout``, both to be used before the next call."""
    D = _decisions(X, model)
    P = _scratch("probabilities", 2 * model.n_nodes + 1, len(X))
    P[0] = 1.0
    for lv in range(model.depth):
        lo, hi = 2 ** lv - 1, 2 ** (lv + 1) - 1
        left = P[hi:2 * hi - lo]
        np.multiply(P[lo:hi], D[lo:hi], out=left)
        np.subtract(P[lo:hi], left, out=P[2 * hi - lo:2 * hi + 1])
    return D, P[model.n_nodes:]


def forward(X, model: SoftTreeModel) -> tuple[np.ndarray, np.ndarray]:
    """Leaf probabilities ``[n, 2**d]`` and decisions ``[n, nodes]``."""
    nodes, leaves = _layout(model.depth)
    D, P = _forward(columns(X), model)
    return P[np.argsort(leaves)].T, D[np.argsort(nodes)].T


def scores_np(X, model: SoftTreeModel) -> np.ndarray:
    return _forward(columns(X), model)[1].T @ model.leaves[_layout(model.depth)[1]]


def _log_softmax_np(S: np.ndarray) -> np.ndarray:
    m = S.max(axis=1, keepdims=True)
    return S - m - np.log(np.exp(S - m).sum(axis=1, keepdims=True))


def focal_loss_np(S: np.ndarray, y: np.ndarray, alpha: float, gamma: float) -> np.ndarray:
    lp = _log_softmax_np(S)[np.arange(len(y)), y]
    pt = np.exp(lp)
    return -alpha * (1.0 - pt) ** gamma * lp


def loss_and_grad(X, y: np.ndarray, model: SoftTreeModel, alpha: float, gamma: float):
    """Sum of focal losses over the rows and its gradient with respect to
    (thresholds, leaves), flattened like ``SoftTreeModel.params``. ``X``: a
    matrix ``[n, F]`` or ``Columns``."""
    n, at = len(y), np.arange(len(y))
    nodes, own = _layout(model.depth)
    leaves = model.leaves[own]
    D, leaf = _forward(columns(X), model)
    S = leaves.T @ leaf
    S -= S.max(axis=0)
    E = np.exp(S)
    total = E.sum(axis=0)
    lp = S[y, at] - np.log(total)
    pt = np.exp(lp)
    loss = -alpha * (1.0 - pt) ** gamma * lp
    # d loss / d S_c = alpha [gamma (1-pt)^(gamma-1) pt ln pt - (1-pt)^gamma] (onehot_c - p_c)
    coef = alpha * (gamma * (1.0 - pt) ** (gamma - 1.0) * pt * lp - (1.0 - pt) ** gamma)
    E /= -total
    E[y, at] += 1.0
    E *= coef
    g_leaves = leaf @ E.T
    # With w = P_leaf d loss / d P_leaf and w of a node the sum over its leaves,
    # d loss / d theta = sum over the rows of w_left - D w. Sums of w over the
    # rows alone follow from the gradient of the leaves.
    w = np.matmul(leaves, E, out=_scratch("leaf weights", len(leaves), n))
    w *= leaf
    weights = _scratch("node weights", model.n_nodes, n)
    sums = np.einsum("ij,ij->i", leaves, g_leaves)
    g_th = np.empty(model.n_nodes)
    for lv in range(model.depth - 1, -1, -1):
        lo, hi = 2 ** lv - 1, 2 ** (lv + 1) - 1
        half = hi - lo
        w = np.add(w[:half], w[half:], out=weights[lo:hi])
        g_th[lo:hi] = sums[:half]
        sums = sums[:half] + sums[half:]
    g_th -= np.einsum("ij,ij->i", D, weights)
    return float(loss.sum()), np.concatenate([g_th[np.argsort(nodes)], g_leaves[np.argsort(own)].ravel()])


# Rows per kernel call: bounds the [2**depth, rows] working arrays of the
# forward/backward pass (about 100 K cells, 0.8 MB per array, which the
# processor's caches hold; rows of a power of two would fall on each other
# there) at any depth.
CHUNK_CELLS = 102_400


def chunk_rows(depth: int) -> int:
    return max(64, CHUNK_CELLS // (2 ** depth))


def loss_and_grad_chunked(X, y: np.ndarray, model: SoftTreeModel, alpha: float, gamma: float):
    """``loss_and_grad`` summed over row chunks (same sums, bounded memory)."""
    step = chunk_rows(model.depth)
    if len(X) <= step:
        return loss_and_grad(X, y, model, alpha, gamma)
    loss, grad = 0.0, np.zeros(model.thresholds.size + model.leaves.size)
    for i in range(0, len(X), step):
        lc, gc = loss_and_grad(X[i:i + step], y[i:i + step], model, alpha, gamma)
        loss += lc
        grad += gc
    return loss, grad


def scores_chunked(X, model: SoftTreeModel) -> np.ndarray:
    step = chunk_rows(model.depth)
    if len(X) <= step:
        return scores_np(X, model)
    return np.concatenate([scores_np(X[i:i + step], model) for i in range(0, len(X), step)])


def focal_loss_sum(X, y: np.ndarray, model: SoftTreeModel, alpha: float, gamma: float) -> float:
    step = chunk_rows(model.depth)
    return float(sum(focal_loss_np(scores_np(X[i:i + step], model), y[i:i + step], alpha, gamma).sum()
                     for i in range(0, len(X), step)))


def features_matrix(s: pd.Series) -> np.ndarray:
    if len(s) == 0:
        return np.zeros((0, 0))
    return np.stack(s.to_numpy()).astype(np.float64, copy=False)


def arrow_matrix(col, missing: str = "raise") -> np.ndarray:
    """``[n, F]`` view of an Arrow list<double> column of equal-length rows
    (no per-row Python objects). NULL values raise, or with
    ``missing="nan"`` become NaN."""
    import pyarrow as pa
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    sizes = np.diff(col.offsets.to_numpy())
    if col.null_count or (sizes != sizes[0]).any():
        raise ValueError("feature arrays are NULL or of unequal length")
    values = col.flatten()
    if values.null_count and missing == "raise":
        raise ValueError("feature arrays hold NULL; fill missing values first")
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, int(sizes[0]))


def arrow_list(M: np.ndarray):
    """Arrow list<double> column from the rows of ``M``."""
    import pyarrow as pa
    n, k = M.shape
    offsets = pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(M).ravel(), type=pa.float64()))


# ---------------------------------------------------------------------------
# Spark operators

def _expr_scores(model: SoftTreeModel, features: str) -> Column:
    """Class-score array as generated arithmetic (shallow trees only)."""
    f = F.col(features)
    feats = model.node_features()
    paths = [F.lit(1.0)]
    for lv in range(model.depth):
        lo = 2 ** lv - 1
        nxt = []
        for j, pp in enumerate(paths):
            i = lo + j
            d = F.lit(1.0) / (F.lit(1.0) + F.exp(f[int(feats[i])] - F.lit(float(model.thresholds[i]))))
            nxt += [pp * d, pp * (F.lit(1.0) - d)]
        paths = nxt
    cls = []
    for c in range(model.num_classes):
        s = F.lit(0.0)
        for leaf, pp in enumerate(paths):
            s = s + pp * F.lit(float(model.leaves[leaf, c]))
        cls.append(s)
    return F.array(*cls)


def _doubles(values) -> Column:
    """A literal array of doubles."""
    return F.lit([float(v) for v in values])


def _fold_scores(model: SoftTreeModel, features: str) -> Column:
    """Class-score array by a fold over the tree's levels: the array of a
    level's probabilities becomes that of the next. The expression grows with
    the depth, not with the nodes, which are literal arrays."""
    f = F.col(features)
    feats = model.node_features()
    probs = F.array(F.lit(1.0))
    for lv in range(model.depth):
        lo, hi = 2 ** lv - 1, 2 ** (lv + 1) - 1
        # the features that the level's nodes test, less their thresholds
        own = F.transform(F.lit([int(i) + 1 for i in feats[lo:hi]]), lambda i: F.element_at(f, i))
        left = F.zip_with(own, _doubles(model.thresholds[lo:hi]), lambda x, t: F.lit(1.0) / (F.lit(1.0) + F.exp(x - t)))
        probs = F.flatten(F.zip_with(probs, left, lambda p, d: F.array(p * d, p * (F.lit(1.0) - d))))
    leaves = F.array(*[_doubles(values) for values in model.leaves.T])
    # the probabilities are made once and bound to a name for all classes
    return F.transform(F.array(probs), lambda own: F.transform(leaves, lambda values: F.aggregate(
        F.zip_with(own, values, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)))[0]


def score(df: DataFrame, model: SoftTreeModel | dict, features: str = "features", out: str = "scores",
          trial_col: str = "trial", mode: str = "auto") -> DataFrame:
    """Add the class-score array. ``model`` is one model or ``{trial: model}``
    (then rows are matched on ``trial_col``). ``mode``: ``expr`` (generated
    arithmetic), ``fold`` (both in the JVM), ``numpy``, or ``auto``."""
    single = isinstance(model, SoftTreeModel)
    if mode == "auto":
        mode = "expr" if single and model.depth <= EXPR_DEPTH_LIMIT else "numpy"
    if mode in ("expr", "fold"):
        made = _expr_scores if mode == "expr" else _fold_scores
        if single:
            return df.withColumn(out, made(model, features))
        expr = None
        for t, m in model.items():
            e = made(m, features)
            expr = F.when(F.col(trial_col) == t, e) if expr is None else expr.when(F.col(trial_col) == t, e)
        return df.withColumn(out, expr)
    return _score_numpy(df, model, features, out, trial_col)


def _score_numpy(df: DataFrame, model, features: str, out: str, trial_col: str) -> DataFrame:
    import pyarrow as pa
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(model)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    single = isinstance(model, SoftTreeModel)

    def fn(batches):
        mdl = bc.value
        k = mdl.num_classes if single else next(iter(mdl.values())).num_classes
        for rb in batches:
            X = arrow_matrix(rb.column(features))
            if single:
                S = scores_chunked(X, mdl) if len(X) else np.zeros((0, k))
            else:
                tr = rb.column(trial_col).to_numpy(zero_copy_only=False)
                S = np.zeros((len(tr), k))
                for t in np.unique(tr):
                    idx = np.nonzero(tr == t)[0]
                    S[idx] = scores_chunked(X[idx], mdl[int(t)])
            yield pa.RecordBatch.from_arrays(list(rb.columns) + [arrow_list(S)],
                                             names=list(rb.schema.names) + [out])

    return df.mapInArrow(fn, schema)


def predict(df: DataFrame, model, features: str = "features", out: str = "prediction",
            keep_scores: bool = False, **kw) -> DataFrame:
    """Softmax of the scores, then the first argmax."""
    s = score(df, model, features, "_scores", **kw)
    s = s.withColumn("probabilities", softmax(F.col("_scores"))) if keep_scores else s
    s = s.withColumn(out, argmax(F.col("_scores")))
    return s.withColumnRenamed("_scores", "scores") if keep_scores else s.drop("_scores")


def focal_loss(df: DataFrame, scores: str = "scores", label: str = "label", alpha: float = 1.0,
               gamma: float = 2.0, reduction: str = "mean", by: list[str] | None = None):
    """Focal loss ``-alpha (1 - p_t)^gamma ln p_t``: per row (``none``) or
    reduced per group by mean / sum."""
    lp = F.element_at(log_softmax(F.col(scores)), F.col(label) + 1)
    row_loss = F.lit(-alpha) * F.pow(F.lit(1.0) - F.exp(lp), F.lit(gamma)) * lp
    if reduction == "none":
        return df.withColumn("focal_loss", row_loss)
    agg = F.avg(row_loss) if reduction == "mean" else F.sum(row_loss)
    return df.groupBy(*(by or [])).agg(agg.alias("focal_loss"))
