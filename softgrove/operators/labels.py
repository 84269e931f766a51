"""Label coding and class statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.operators._util import maybe_broadcast, one_row, qcol, with_position
from softgrove.session import materialize


# Levels up to this many are ranked by the driver (a bounded list); more are
# ranked by a distributed sort. Both give the same codes.
LEVEL_COLLECT_LIMIT = 10_000


def _sort_key(v):
    if isinstance(v, float) and math.isnan(v):
        return (1, 0.0)
    return (0, v)


def encode_label(df: DataFrame, col: str, out: str = "label", keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct values sorted ascending -> codes 0..K-1 (numbers in numeric
    order, strings lexicographically). Returns the coded table and the
    mapping ``(value, code)``; rows are coded by a join with the mapping,
    broadcast while its counted rows are few."""
    levels = df.select(qcol(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    vals = [r["value"] for r in levels.limit(LEVEL_COLLECT_LIMIT + 1).collect()]
    if len(vals) <= LEVEL_COLLECT_LIMIT:
        n = len(vals)
        mapping = df.sparkSession.createDataFrame(
            [(v, i) for i, v in enumerate(sorted(vals, key=_sort_key))],
            T.StructType([T.StructField("value", df.schema[col].dataType), T.StructField("code", T.IntegerType())]))
    else:
        # a stored table, so that the positions counted are those used
        ordered = materialize(levels.orderBy("value"))
        n = ordered.count()
        mapping = with_position(ordered, "code").withColumn("code", F.col("code").cast("int"))
    m = maybe_broadcast(mapping.select(F.col("value").alias("_level"), F.col("code").alias("_code")), n)
    cols = [qcol(c) for c in df.columns if c != out and (keep or c != col)]
    coded = df.join(m, qcol(col) == F.col("_level"), "left").select(*cols, F.col("_code").alias(out))
    return coded, mapping


def class_counts(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def num_classes(df: DataFrame, label: str = "label") -> int:
    return one_row(df.agg(F.countDistinct(label).alias("k")))["k"]


def minority_share(df: DataFrame, label: str = "label", ratio: float = 0.25) -> DataFrame:
    """min class count / total, and whether ``share <= ratio / (K - 1)``."""
    counts = class_counts(df, label)
    stats = counts.agg(F.min("n").alias("min_count"), F.sum("n").alias("total"),
                       F.count(F.lit(1)).alias("n_classes"))
    share = F.col("min_count") / F.col("total")
    return stats.select(
        "min_count", "total", "n_classes", share.alias("minority_share"),
        F.when(F.col("n_classes") < 2, F.raise_error(F.lit("balance test needs at least two classes")))
        .otherwise(share <= F.lit(ratio) / (F.col("n_classes") - 1)).alias("needs_rebalance"))
