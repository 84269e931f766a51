"""Fitted feature normalizers over an ``ARRAY<DOUBLE>`` feature column.

Fits run on training rows only and produce one small row per group
(``by`` keys, e.g. ``trial``) holding per-position parameters; transforms
join that row (broadcast, rows = groups) and map the array with a
higher-order function, so they stay JVM-side and shuffle-free.

* ``QuantileNormalizer`` — Gaussian output: noisy copy for the fit,
  quantile grid, mean of forward and backward interpolation, inverse
  normal CDF, clip.
* ``MinMaxNormalizer`` — to [low, high], no clipping of unseen values.
* ``StandardNormalizer`` — ``(x - mean) / std_pop``, zero std -> 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.functions.columns import (BOUNDS_THRESHOLD, CLIP_HIGH, CLIP_LOW, count_less,
                                         count_less_equal, keyed_gaussian, norm_ppf)
from softgrove.operators._util import maybe_broadcast, one_row
from softgrove.operators.blocks import BLOCK_VALUES
from softgrove.operators.quantiles import QuantileState, exact_quantiles, noisy_quantiles, quantile_state, read_state
from softgrove.session import materialize

# Accuracy of the sketch that ``method="approx"`` asks for.
APPROX_ACCURACY = 100_000


def _train(df: DataFrame, train_rows: Column | None) -> DataFrame:
    if train_rows is None and "split" in df.columns:
        train_rows = F.col("split") == "train"
    return df.where(train_rows) if train_rows is not None else df


def _long(df: DataFrame, by: list[str], features: str, key: str | None) -> DataFrame:
    """Long form (group, position, value) of the training values; missing
    values (NULL or NaN) take no part in a fit."""
    extra = [key] if key else []
    return (df.select(*by, *extra, F.posexplode(features).alias("pos", "x"))
            .where(F.col("x").isNotNull() & ~F.isnan("x")))


def _attach(df: DataFrame, params: DataFrame, by: list[str], n_groups: int, row_doubles: int = 1) -> DataFrame:
    """Join the per-group row; it is broadcast while all rows' doubles
    (``row_doubles`` each) stay within BROADCAST_GRID_LIMIT."""
    if by:
        return df.join(maybe_broadcast(params, n_groups * row_doubles, BROADCAST_GRID_LIMIT), by, "left")
    row = one_row(params)
    out = df
    for c, v in row.items():
        out = out.withColumn(c, F.lit(v))
    return out


@dataclass
class ArrayNormalizerModel:
    by: list[str]
    params: DataFrame
    n_groups: int
    features: str
    kind: str
    low: float = -1.0
    high: float = 1.0

    def transform(self, df: DataFrame, out: str | None = None, engine: str = "auto") -> DataFrame:
        out = out or self.features
        if self.kind == "quantile" and engine in ("auto", "arrow"):
            local = self.local_grids()
            if local is not None:
                return _arrow_quantile_transform(df, local, self.by, self.features, out)
        p = _attach(df, self.params, self.by, self.n_groups, max(self.n_features, 1) * (self.params_nq if self.kind == "quantile" else 2))
        f = F.col(self.features)
        if self.kind == "quantile":
            res = quantile_normal_array(f, F.col("_grids"), self.params_nq)
            drop = ["_grids"]
        elif self.kind == "minmax":
            res = F.transform(f, lambda x, i: x * F.get(F.col("_scale"), i) + F.get(F.col("_min"), i))
            drop = ["_scale", "_min"]
        else:
            res = F.transform(f, lambda x, i: (x - F.get(F.col("_mean"), i)) / F.get(F.col("_std"), i))
            drop = ["_mean", "_std"]
        return p.withColumn(out, res).drop(*drop)

    params_nq: int = 1000
    n_features: int = 0
    _local: dict | None = None

    def local_grids(self) -> dict | None:
        """Grids per group as numpy arrays, when their total size is within
        BROADCAST_GRID_LIMIT (groups x features x quantiles doubles)."""
        if self._local is not None:
            return self._local
        if self.n_groups * max(self.n_features, 1) * self.params_nq > BROADCAST_GRID_LIMIT:
            return None
        import numpy as np
        rows = self.params.collect()
        self._local = {tuple(r[b] for b in self.by): np.asarray(r["_grids"], dtype=np.float64) for r in rows}
        return self._local


def _quantile_stats(x: Column, grid: Column, n_max: int) -> Column:
    """Stage 1: binary search for the number of grid points below x."""
    return F.struct(x.alias("x"), count_less(grid, x, n_max).alias("a"))


def _quantile_ties(s: Column, grid: Column, n_max: int) -> Column:
    """Stage 1b: points at most x; a second search only when x sits on a
    grid point (otherwise it equals the first count)."""
    x, a = s["x"], s["a"]
    b = F.when(F.get(grid, a) == x, count_less_equal(grid, x, n_max)).otherwise(a)
    return F.struct(x.alias("x"), a.alias("a"), b.alias("b"))


def _quantile_u(s: Column, grid: Column) -> Column:
    """Stage 2: mean of forward and backward linear interpolation onto an
    evenly spaced [0, 1] reference; values within 1e-7 of an end map to it.
    The grid is read from the outer column, never copied per value."""
    x, a, b, n = s["x"], s["a"], s["b"], F.size(grid)
    nm1 = (n - 1).cast("double")
    g_lo, g_hi = F.get(grid, a - 1), F.get(grid, a)
    between = ((a - 1).cast("double") + (x - g_lo) / (g_hi - g_lo)) / nm1
    u = (F.when(x - BOUNDS_THRESHOLD < F.get(grid, 0), F.lit(0.0))
         .when(x + BOUNDS_THRESHOLD > F.get(grid, n - 1), F.lit(1.0))
         .when(a < b, (a + b - 1).cast("double") / (2.0 * nm1))
         .otherwise(between))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(u)


def _normal_z(u: Column) -> Column:
    """Stage 3: inverse normal CDF, clipped at the transform's bounds."""
    z = F.when(u <= 0.0, F.lit(CLIP_LOW)).when(u >= 1.0, F.lit(CLIP_HIGH)).otherwise(
        F.least(F.greatest(norm_ppf(u), F.lit(CLIP_LOW)), F.lit(CLIP_HIGH)))
    return F.when(u.isNull() | F.isnan(u), u).otherwise(z)


def quantile_uniform_array(features: Column, grids: Column, n_max: int) -> Column:
    s1 = F.transform(features, lambda x, i: _quantile_stats(x, F.get(grids, i), n_max))
    s1 = F.transform(s1, lambda s, i: _quantile_ties(s, F.get(grids, i), n_max))
    return F.transform(s1, lambda s, i: _quantile_u(s, F.get(grids, i)))


def quantile_normal_array(features: Column, grids: Column, n_max: int) -> Column:
    return F.transform(quantile_uniform_array(features, grids, n_max), _normal_z)


def quantile_kernel(X, grids, uniform: bool = False):
    """numpy version of the quantile transform: ``X [n, F]``, ``grids [F, nq]``."""
    import numpy as np
    from softgrove.functions.columns import norm_ppf_np
    X = np.asarray(X, dtype=np.float64)
    Z = np.empty_like(X)
    for j in range(X.shape[1]):
        g, x = grids[j], X[:, j]
        nm1 = len(g) - 1
        a = np.searchsorted(g, x, "left")
        b = np.searchsorted(g, x, "right")
        lo, hi = np.clip(a - 1, 0, nm1), np.clip(a, 0, nm1)
        with np.errstate(all="ignore"):
            between = ((a - 1) + (x - g[lo]) / (g[hi] - g[lo])) / nm1 if nm1 > 0 else np.full_like(x, 0.5)
            tied = (a + b - 1) / (2.0 * nm1) if nm1 > 0 else np.full_like(x, 0.5)
        u = np.where(a < b, tied, between)
        u = np.where(x + BOUNDS_THRESHOLD > g[-1], 1.0, u)
        u = np.where(x - BOUNDS_THRESHOLD < g[0], 0.0, u)
        nan = np.isnan(x)
        if uniform:
            Z[:, j] = np.where(nan, np.nan, u)
            continue
        inner = (u > 0.0) & (u < 1.0) & ~nan
        z = np.where(u <= 0.0, CLIP_LOW, CLIP_HIGH)
        z[inner] = np.clip(norm_ppf_np(u[inner]), CLIP_LOW, CLIP_HIGH)
        Z[:, j] = np.where(nan, np.nan, z)
    return Z


# Grids up to this many doubles (groups x features x quantiles) are
# broadcast to a vectorised transform; larger fits use the join + JVM path.
BROADCAST_GRID_LIMIT = 25_000_000


def _arrow_quantile_transform(df: DataFrame, grids: dict, by: list[str], features: str, out: str,
                              uniform: bool = False) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    from softgrove.operators.tree import arrow_list, arrow_matrix
    bc = df.sparkSession.sparkContext.broadcast(grids)
    fields = [f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))]
    schema = T.StructType(fields)

    def fn(batches):
        g = bc.value
        for rb in batches:
            X = arrow_matrix(rb.column(features), missing="nan")
            if by:
                cols = [rb.column(b).to_numpy(zero_copy_only=False) for b in by]
                Z = np.empty_like(X)
                if len(cols) == 1:
                    groups = [((k,), np.nonzero(cols[0] == k)[0]) for k in np.unique(cols[0])]
                else:
                    keys = list(zip(*[c.tolist() for c in cols]))
                    pos: dict = {}
                    for i, kk in enumerate(keys):
                        pos.setdefault(kk, []).append(i)
                    groups = [(kk, np.asarray(ix)) for kk, ix in pos.items()]
                for k, idx in groups:
                    k = tuple(v.item() if hasattr(v, "item") else v for v in k)
                    Z[idx] = quantile_kernel(X[idx], g[k], uniform)
            else:
                Z = quantile_kernel(X, g[()], uniform) if len(X) else X
            cols = [rb.column(i) for i, n in enumerate(rb.schema.names) if n != out]
            names = [n for n in rb.schema.names if n != out]
            if rb.num_rows == 0:
                Z = np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays(cols + [arrow_list(Z) if rb.num_rows else pa.array([], pa.list_(pa.float64()))],
                                             names=names + [out])

    return df.mapInArrow(fn, schema)


@dataclass
class QuantileFitState:
    """What a quantile fit keeps for later rows. ``spread`` holds the standard
    deviations that the noise is scaled by: those of the first part, so a value
    gets the same noise whichever part it comes with."""

    by: list[str]
    values: QuantileState  # by..., pos
    rows: DataFrame  # by..., n: training rows
    spread: DataFrame  # by..., pos, _sd

    def merge(self, other: QuantileFitState) -> QuantileFitState:
        both = self.rows.unionByName(other.rows)
        rows = both.groupBy(*self.by).agg(F.sum("n").alias("n"))
        return QuantileFitState(self.by, self.values.merge(other.values), materialize(rows), self.spread)

    def write(self, path: str) -> None:
        self.values.write(f"{path}/values")
        self.rows.write.parquet(f"{path}/rows")
        self.spread.write.parquet(f"{path}/spread")

    @classmethod
    def read(cls, spark: SparkSession, path: str, by: list[str] | None = None) -> QuantileFitState:
        by = list(by or [])
        return cls(by, read_state(spark, f"{path}/values", [*by, "pos"]), spark.read.parquet(f"{path}/rows"),
                   spark.read.parquet(f"{path}/spread"))


class QuantileNormalizer:
    def __init__(self, noise: float = 1e-3, n_quantiles: int = 1000, seed: int = 42,
                 method: str = "exact", by: list[str] | None = None, features: str = "features",
                 key: str = "row_id"):
        if method not in ("exact", "approx"):
            raise ValueError(f"unknown quantile method: {method}")
        self.noise, self.n_quantiles, self.seed = noise, n_quantiles, seed
        self.method, self.by, self.features, self.key = method, list(by or []), features, key

    def fit(self, df: DataFrame, train_rows: Column | None = None) -> ArrayNormalizerModel:
        by = self.by
        train = _train(df, train_rows)
        sizes = train.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(self.features)).alias("f")).collect()
        n_groups = len(sizes)
        n_min = min(r["n"] for r in sizes)
        n_feat = max((r["f"] or 0 for r in sizes), default=0)
        nq = max(1, min(self.n_quantiles, n_min))
        probs = [i / (nq - 1) for i in range(nq)] if nq > 1 else [0.5]
        if self.noise > 0 and self.method == "exact" and n_feat > 0 and max(r["n"] for r in sizes) <= BLOCK_VALUES:
            grids = noisy_quantiles(train, by, self.features, self.key, max(nq - 1, 1), n_feat, self.noise, self.seed)
            if nq == 1:  # a single training row: one grid point
                grids = grids.withColumn("grid", F.slice("grid", 1, 1))
            return self._model(grids, nq, n_groups, n_feat)
        long = _long(train, by, self.features, self.key if self.noise > 0 else None)
        if self.noise > 0:
            # Noise std q / max(std, q) per (group, position), std over the
            # training rows (population std).
            stds = long.groupBy(*by, "pos").agg(F.stddev_pop("x").alias("_sd"))
            long = self._noisy(long.join(maybe_broadcast(stds, n_groups * max(n_feat, 1)), by + ["pos"]))
        if self.method == "exact":
            grids = exact_quantiles(long.select(*by, "pos", "x"), [*by, "pos"], "x", max(nq - 1, 1), n_groups * max(n_feat, 1))
            if nq == 1:  # a single training row: one grid point
                grids = grids.withColumn("grid", F.slice("grid", 1, 1))
        else:
            probs_col = F.array(*[F.lit(p) for p in probs])
            grids = long.groupBy(*by, "pos").agg(
                F.percentile_approx(F.col("x"), probs_col, APPROX_ACCURACY).alias("grid"))
        return self._model(grids, nq, n_groups, n_feat)

    def _noisy(self, long: DataFrame) -> DataFrame:
        nstd = F.when(F.col("_sd").isNull(), 0.0).otherwise(F.lit(self.noise) / F.greatest(F.col("_sd"), F.lit(self.noise)))
        return long.withColumn("x", F.col("x") + nstd * keyed_gaussian(self.seed, F.col("pos"), F.col(self.key)))

    def _model(self, grids: DataFrame, nq: int, n_groups: int, n_feat: int) -> ArrayNormalizerModel:
        by = self.by
        # One row per group with the grids in position order (features x nq doubles).
        params = grids.groupBy(*by).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "grid"))), lambda s: s["grid"]).alias("_grids"))
        m = ArrayNormalizerModel(by, params, n_groups, self.features, "quantile")
        m.params_nq = nq
        m.n_features = n_feat
        return m

    def state(self, df: DataFrame, train_rows: Column | None = None, base: QuantileFitState | None = None) -> QuantileFitState:
        """State of the training rows of ``df``, to be merged with others and
        fitted by ``fit_state``. ``base`` is the state that it will be merged
        with: its spread scales the noise; values of a group or position that
        it does not know get none."""
        train = _train(df, train_rows)
        rows = materialize(train.groupBy(*self.by).agg(F.count(F.lit(1)).alias("n")))
        long = _long(train, self.by, self.features, self.key if self.noise > 0 else None)
        spread = base.spread if base else materialize(long.groupBy(*self.by, "pos").agg(F.stddev_pop("x").alias("_sd")))
        if self.noise > 0:
            long = self._noisy(long.join(maybe_broadcast(spread, spread.count()), [*self.by, "pos"], "left"))
        return QuantileFitState(self.by, quantile_state(long.select(*self.by, "pos", "x"), [*self.by, "pos"], "x"), rows, spread)

    def fit_state(self, state: QuantileFitState, buckets: int | None = None) -> ArrayNormalizerModel:
        """The exact fit of all rows in ``state``, without reading them."""
        if self.method != "exact":
            raise ValueError("a fit from states is exact")
        n_groups, n_min = state.rows.agg(F.count(F.lit(1)), F.min("n")).first()
        n_feat = (state.values.summary.agg(F.max("pos")).first()[0] or 0) + 1
        nq = max(1, min(self.n_quantiles, n_min))
        grids = state.values.grids(max(nq - 1, 1), buckets)
        if nq == 1:
            grids = grids.withColumn("grid", F.slice("grid", 1, 1))
        return self._model(grids, nq, n_groups, n_feat)


class MinMaxNormalizer:
    def __init__(self, low: float = -1.0, high: float = 1.0, by: list[str] | None = None,
                 features: str = "features"):
        self.low, self.high, self.by, self.features = low, high, list(by or []), features

    def fit(self, df: DataFrame, train_rows: Column | None = None) -> ArrayNormalizerModel:
        by = self.by
        long = _long(_train(df, train_rows), by, self.features, None)
        st = long.groupBy(*by, "pos").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
        rng = F.col("mx") - F.col("mn")
        scale = F.lit(self.high - self.low) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
        st = st.select(*by, "pos", scale.alias("sc"), (F.lit(self.low) - F.col("mn") * scale).alias("mi"))
        params = st.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "sc", "mi"))).alias("_p")) \
            .select(*by, F.transform("_p", lambda s: s["sc"]).alias("_scale"),
                    F.transform("_p", lambda s: s["mi"]).alias("_min"))
        n_groups = params.count() if by else 1
        return ArrayNormalizerModel(by, params, n_groups, self.features, "minmax", self.low, self.high)


class StandardNormalizer:
    def __init__(self, by: list[str] | None = None, features: str = "features"):
        self.by, self.features = list(by or []), features

    def fit(self, df: DataFrame, train_rows: Column | None = None) -> ArrayNormalizerModel:
        by = self.by
        long = _long(_train(df, train_rows), by, self.features, None)
        st = long.groupBy(*by, "pos").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
        sd = F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd"))
        params = st.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "mu", sd.alias("sd")))).alias("_p")) \
            .select(*by, F.transform("_p", lambda s: s["mu"]).alias("_mean"),
                    F.transform("_p", lambda s: s["sd"]).alias("_std"))
        n_groups = params.count() if by else 1
        return ArrayNormalizerModel(by, params, n_groups, self.features, "standard")


def normalize(df: DataFrame, technique: str = "quantile", fitted: ArrayNormalizerModel | None = None,
              **kw) -> tuple[DataFrame, ArrayNormalizerModel]:
    """Fit (unless ``fitted`` is given) and apply a normalizer by name:
    ``quantile``, ``min-max`` or ``mean`` (standardize)."""
    if fitted is None:
        if technique == "quantile":
            fitted = QuantileNormalizer(**kw).fit(df)
        elif technique == "min-max":
            fitted = MinMaxNormalizer(**kw).fit(df)
        elif technique == "mean":
            fitted = StandardNormalizer(**kw).fit(df)
        else:
            raise ValueError(f"unknown normalization technique: {technique}")
    return fitted.transform(df), fitted
