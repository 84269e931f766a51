"""Leave-one-out target encoding of categorical columns.

Fit (training rows only): per (group, column, category) the sum and count
of the target, and the global target mean per group — one aggregate pass
over all categorical columns at once (the columns are stacked into a long
``(column, category)`` form, so the shuffle carries only distinct levels
after the map-side partial aggregation).

Transform: training rows get ``(sum - y) / (count - 1)``; other rows get
``sum / count``; a level seen once in training, an unseen level or a
missing value gets the global mean. The target is the class code, also
for more than two classes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.operators import _util
from softgrove.operators._util import maybe_broadcast, one_row, qcol
from softgrove.session import materialize

# A level with more than this part of a group's training rows is hot.
HOT_PARTS = 500
# Keys that rows without a level to look up are dealt over.
SALTS = 1 << 16


@dataclass
class LeaveOneOutModel:
    cols: list[str]
    label: str
    by: list[str]
    stats: DataFrame  # by..., column, category, s, n
    means: DataFrame  # by..., mean, n
    n_stats: int

    def transform(self, df: DataFrame, loo_rows: Column | None = None, out_suffix: str = "") -> DataFrame:
        """Encode ``cols``. ``loo_rows`` marks rows that get the leave-one-out
        value (default: ``split = 'train'`` when a split column exists)."""
        if loo_rows is None:
            loo_rows = (F.col("split") == "train") if "split" in df.columns else F.lit(False)
        return self._transform_join(df, loo_rows, out_suffix)

    def _encode(self, s: Column, n: Column, mean: Column, loo: Column) -> Column:
        y = F.col(self.label).cast("double")
        return (F.when(n.isNull() | (n <= 1), mean)
                .when(loo, (s - y) / (n - 1))
                .otherwise(s / n))

    def _transform_join(self, df: DataFrame, loo_rows: Column, out_suffix: str) -> DataFrame:
        by = self.by
        out = df.withColumn("_loo", loo_rows)
        if by:
            out = out.join(maybe_broadcast(self.means.drop("_n"), self.n_stats), by, "left")
        else:  # one scalar: the global target mean
            out = out.withColumn("_mean", F.lit(one_row(self.means)["_mean"]).cast("double"))
        few = self.n_stats <= _util.BROADCAST_ROW_LIMIT
        if not few:
            sizes = self.means.select(*by, F.col("_n").alias("_all"))
            if by:
                stats = self.stats.join(maybe_broadcast(sizes, self.n_stats), by)
            else:
                stats = self.stats.withColumn("_all", F.lit(one_row(sizes)["_all"]))
            stats = stats.withColumn("_hot", F.col("n") * HOT_PARTS > F.col("_all")).drop("_all")
            # from the row itself: the same when a task runs again
            salt = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[qcol(x) for x in df.columns]), F.lit(SALTS)).cast("string"))
            out = out.withColumn("_salt", salt)
        for i, c in enumerate(self.cols):
            level = qcol(c).cast("string")
            if few:
                out = self._joined(out, F.broadcast(self.stats), i, c, level, "")
                continue
            out = self._joined(out, F.broadcast(stats.where("_hot").drop("_hot")), i, c, level, "h")
            key = F.when(F.col(f"_hn{i}").isNull() & level.isNotNull(), level).otherwise(F.col("_salt"))
            out = self._joined(out, stats.where("NOT _hot").drop("_hot"), i, c, key, "c")
            out = out.withColumns({f"_{x}{i}": F.coalesce(F.col(f"_h{x}{i}"), F.col(f"_c{x}{i}")) for x in "sn"})
        # all encodings in one projection after the joins
        enc = {c + out_suffix: self._encode(F.col(f"_s{i}"), F.col(f"_n{i}"), F.col("_mean"), F.col("_loo"))
               for i, c in enumerate(self.cols)}
        cols = [x for x in df.columns if x not in enc]
        res = out.select(*[qcol(x) for x in cols], *[e.alias(n) for n, e in enc.items()])
        return res.select(*[qcol(x) for x in (df.columns + [n for n in enc if n not in df.columns])])


    def _joined(self, out: DataFrame, stats: DataFrame, i: int, c: str, key: Column, mark: str) -> DataFrame:
        """Adds sum and count of the levels of column ``c`` under ``key``."""
        st = stats.where(F.col("column") == c).select(
            *[F.col(b).alias(f"_{mark}g{i}_{j}") for j, b in enumerate(self.by)],
            F.col("category").alias(f"_{mark}l{i}"), F.col("s").alias(f"_{mark}s{i}"), F.col("n").alias(f"_{mark}n{i}"))
        cond = key == F.col(f"_{mark}l{i}")
        for j, b in enumerate(self.by):
            cond = cond & (F.col(b) == F.col(f"_{mark}g{i}_{j}"))
        return out.join(st, cond, "left")


class LeaveOneOut:
    def __init__(self, cols: list[str], label: str = "label", by: list[str] | None = None):
        self.cols = list(cols)
        self.label = label
        self.by = list(by or [])

    def fit(self, df: DataFrame, train_rows: Column | None = None) -> LeaveOneOutModel:
        if train_rows is None and "split" in df.columns:
            train_rows = F.col("split") == "train"
        train = df.where(train_rows) if train_rows is not None else df
        by, y = self.by, F.col(self.label).cast("double")
        means = materialize(train.groupBy(*by).agg(F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("_n")))
        if self.cols:
            levels = F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("category")) for c in self.cols]))
            long = train.select(*by, y.alias("_y"), levels.alias("lv")).select(*by, "_y", "lv.column", "lv.category")
            stats = (long.where(F.col("category").isNotNull())
                     .groupBy(*by, "column", "category")
                     .agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n")))
            stats = materialize(stats)
            n_stats = stats.count()
        else:
            stats = train.sparkSession.createDataFrame([], "column string, category string, s double, n long")
            n_stats = 0
        return LeaveOneOutModel(self.cols, self.label, by, stats, means, n_stats)
