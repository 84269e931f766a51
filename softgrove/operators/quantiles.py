"""Exact order statistics of long data, distributed.

Values are first counted (a groupBy with map-side combine, so a value that
a third of all rows share is one row), the distinct values are dealt into
buckets by an approximate sketch of their quantiles, running counts within
buckets plus the buckets' offsets give each value its ranks, and the wanted
ranks are read off. The sketch only decides the buckets: results are exact,
and no task holds a whole column.

``QuantileState`` keeps what a later fit needs when rows are added: the
counted values and a mergeable KLL summary of each group. States of two parts
merge without reading either part again, and the merged summaries pick the
buckets of the exact pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from softgrove.functions.columns import count_less
from softgrove.operators._util import maybe_broadcast
from softgrove.operators.blocks import KeyTexts, feature_blocks, joined
from softgrove.session import materialize

# Rows of a group per bucket of values.
BUCKET_ROWS = 1_000_000
# Size of the stored summaries: ranks within about 0.3 % of a group's rows,
# some 30 KB a group.
SUMMARY_K = 1000


def _counted(long: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., _x, _c): distinct values and their rows."""
    # an IEEE zero has two signs; they are one value
    return long.groupBy(*group, (F.col(value) + F.lit(0.0)).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))


def exact_quantiles(long: DataFrame, group: list[str], value: str, parts: int, n_groups: int,
                    buckets: int | None = None) -> DataFrame:
    """(group..., grid): the quantiles k / parts for k = 0..parts of each
    group, linearly interpolated between the two nearest ranks.

    ``n_groups`` bounds the number of groups (for size-checked broadcasts of
    the per-group tables). NULL and NaN values must be filtered out before."""
    counted = _counted(long, group, value)
    sizes = long.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if buckets is None:
        biggest = sizes.agg(F.max("_n")).first()[0] or 0
        buckets = max(1, -(-biggest // BUCKET_ROWS))
    edges = None
    if buckets > 1:
        probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        edges = long.groupBy(*group).agg(F.array_sort(F.array_distinct(
            F.percentile_approx(value, probs, 10 * buckets))).alias("_edges"))
    return _grids(counted, sizes, edges, group, parts, n_groups, buckets)


def _grids(counted: DataFrame, sizes: DataFrame, edges: DataFrame | None, group: list[str], parts: int, n_groups: int,
           buckets: int) -> DataFrame:
    """(group..., grid) of counted values; ``edges`` cut them into buckets."""
    counted = counted.join(maybe_broadcast(sizes, n_groups), group)
    if edges is not None:
        counted = counted.join(maybe_broadcast(edges, n_groups * buckets), group).withColumn(
            "_b", count_less(F.col("_edges"), F.col("_x"), buckets)).drop("_edges")
        per = counted.groupBy(*group, "_b").agg(F.sum("_c").alias("_s"))
        before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(*group, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
        counted = counted.join(maybe_broadcast(per, n_groups * buckets), [*group, "_b"])
    else:
        counted = counted.withColumn("_b", F.lit(0)).withColumn("_off", F.lit(0))
    keys = [counted.schema[c] for c in group]

    def key_columns(table: pa.Table) -> list[pa.Array]:
        return [table.column(c).slice(0, 1).combine_chunks() for c in group]

    def piece(table: pa.Table) -> pa.Table:
        """The values of a bucket at the wanted ranks: for each k that of the
        rank below the quantile, and that of the next one."""
        x, c = (table.column(f).to_numpy() for f in ("_x", "_c"))
        order = np.argsort(x, kind="stable")
        x, off = x[order], table.column("_off")[0].as_py()
        upto = off + np.cumsum(c[order])
        low = np.arange(parts + 1) * (table.column("_n")[0].as_py() - 1) // parts
        out = []
        for rank in (low, low + 1):
            k = np.flatnonzero((rank >= off) & (rank < upto[-1]))
            out += [pa.array([k], pa.list_(pa.int64())), pa.array([x[np.searchsorted(upto, rank[k], side="right")]], pa.list_(pa.float64()))]
        return pa.table([*key_columns(table), table.column("_n").slice(0, 1), *out], names=[*group, "_n", "_k0", "_v0", "_k1", "_v1"])

    def joined(table: pa.Table) -> pa.Table:
        low, high = np.full(parts + 1, np.nan), np.full(parts + 1, np.nan)
        for to, k, v in ((low, "_k0", "_v0"), (high, "_k1", "_v1")):
            to[table.column(k).combine_chunks().flatten().to_numpy()] = table.column(v).combine_chunks().flatten().to_numpy()
        at = np.arange(parts + 1) * (table.column("_n")[0].as_py() - 1) / parts
        part = at - np.floor(at)
        grid = np.where(np.isnan(high) | (part == 0), low, low + (high - low) * part)
        return pa.table([*key_columns(table), pa.array([grid], pa.list_(pa.float64()))], names=[*group, "grid"])

    ranks, values = ArrayType(LongType()), ArrayType(DoubleType())
    fields = [StructField("_n", LongType()), *(StructField(f, t) for f, t in (("_k0", ranks), ("_v0", values), ("_k1", ranks), ("_v1", values)))]
    pieces = counted.groupBy(*group, "_b").applyInArrow(piece, StructType([*keys, *fields]))
    return pieces.groupBy(*group).applyInArrow(joined, StructType([*keys, StructField("grid", values)]))


def noisy_quantiles(df: DataFrame, by: list[str], features: str, key: str, parts: int, n_feat: int, noise: float, seed: int) -> DataFrame:
    """(by..., pos, grid): ``exact_quantiles`` of each feature's values, to which
    keyed noise of ``noise / max(std, noise)`` is added. For groups of at most
    ``BLOCK_VALUES`` rows; a task sorts the values of a group and feature."""
    def draw(texts: KeyTexts, _) -> np.ndarray:
        return texts.gaussian([([], [str(int(seed))], pos) for pos in range(n_feat)])

    kept = [df.schema[c] for c in by]

    def grid(table: pa.Table) -> pa.Table:
        x, g = joined(table, "_x"), joined(table, "_noise")
        there = ~np.isnan(x)
        x, g = x[there], g[there]
        grids = []
        if len(x):
            # in order of value, so the last bits don't depend on the order of rows
            x = x + noise / np.maximum(np.sort(x).std(), noise) * g
            x = np.sort(x + 0.0)
            at = np.arange(parts + 1) * (len(x) - 1) / parts
            rank = np.arange(parts + 1) * (len(x) - 1) // parts
            low, high = x[rank], x[np.minimum(rank + 1, len(x) - 1)]
            part = at - np.floor(at)
            grids = [np.where(part == 0, low, low + (high - low) * part)]
        n = len(grids)
        keys = [table.column(c).slice(0, n) for c in (*by, "feature")]
        return pa.table([*keys, pa.array(grids, pa.list_(pa.float64()))], names=[*by, "pos", "grid"])

    blocks = feature_blocks(df, by, features, n_feat, F.col(key), draw)
    return blocks.groupBy(*by, "feature").applyInArrow(grid, StructType([*kept, StructField("pos", IntegerType()), StructField("grid", ArrayType(DoubleType()))]))


@dataclass
class QuantileState:
    """What is kept of the values seen so far; two stored tables."""

    group: list[str]
    counted: DataFrame  # group..., _x, _c
    summary: DataFrame  # group..., _sketch (KLL), as many rows as groups

    def merge(self, other: QuantileState) -> QuantileState:
        """The state of both parts' rows; reads the two states only."""
        if self.group != other.group:
            raise ValueError(f"states of different groups: {self.group}, {other.group}")
        g = self.group
        counted = self.counted.unionByName(other.counted).groupBy(*g, "_x").agg(F.sum("_c").alias("_c"))
        summary = self.summary.unionByName(other.summary).groupBy(*g).agg(F.kll_merge_agg_double("_sketch").alias("_sketch"))
        return QuantileState(g, materialize(counted), materialize(summary))

    def grids(self, parts: int, buckets: int | None = None) -> DataFrame:
        """(group..., grid) as ``exact_quantiles`` of all rows gives it. Sizes
        and buckets come from the summaries, so the counted values are read
        once and the rows behind them not at all."""
        sizes = self.summary.select(*self.group, F.kll_sketch_get_n_double("_sketch").alias("_n"))
        n_groups, biggest = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
        if buckets is None:
            buckets = max(1, -(-(biggest or 0) // BUCKET_ROWS))
        edges = None
        if buckets > 1:
            probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
            edges = self.summary.select(*self.group, F.array_sort(F.array_distinct(
                F.kll_sketch_get_quantile_double("_sketch", probs))).alias("_edges"))
        return _grids(self.counted, sizes, edges, self.group, parts, n_groups, buckets)

    def write(self, path: str) -> None:
        """Stores the state under a folder that has none yet."""
        self.counted.write.parquet(f"{path}/counted")
        self.summary.write.parquet(f"{path}/summary")


def quantile_state(long: DataFrame, group: list[str], value: str) -> QuantileState:
    """State of the rows of ``long``; missing values must be filtered out
    before. Summaries are drawn at random inside, so they are stored: a task
    that runs again reads the same ones. Both are made from the counted
    values' one shuffle and a map-side combined aggregate."""
    x = F.col(value).cast("double")
    summary = long.groupBy(*group).agg(F.kll_sketch_agg_double(x, F.lit(SUMMARY_K)).alias("_sketch"))
    return QuantileState(list(group), materialize(_counted(long, group, value)), materialize(summary))


def read_state(spark: SparkSession, path: str, group: list[str]) -> QuantileState:
    return QuantileState(list(group), spark.read.parquet(f"{path}/counted"), spark.read.parquet(f"{path}/summary"))
