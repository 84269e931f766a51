"""Exact stratified train / validation / test split.

Sizes follow the experiment: ``int(n * test)`` test rows, then
``int(n * valid)`` validation rows out of the rest, both stratified by
class. Per-class quotas use largest remainders (ties: lower class first).
Within a class, rows are ordered by ``md5("key:seed")`` (then key), so the
split is deterministic, independent of partitioning, and the same in SQL.

Scale plan (no task ever holds a whole class; the input is read twice before
the split is, and not again by later actions on it):
1. histogram of rows per (group, class, hash prefix): a map-side-combined
   aggregate, stored; class sizes are its sums;
2. a running sum over that small histogram finds, per class, the bucket
   holding the test cut and the validation cut;
3. only the rows of those (at most two) buckets per class are ranked, which
   yields the exact cut ``(hash, key)`` per class, stored: classes x groups rows;
4. every row is labelled by comparing its ``(hash, key)`` with the cuts of
   its class, a broadcast join behind a check of their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softgrove.operators._util import maybe_broadcast
from softgrove.session import materialize

# Hex digits of the histogram's hash prefix: 65 536 buckets a class.
PREFIX_HEX = 4


def prefix_width(largest_class: int) -> int:
    """Hex digits of the hash prefix so that buckets per class ~ sqrt(rows of
    the largest class): the histogram and the ranked boundary buckets then
    stay about equally small (1e12 rows -> 5 digits, ~5e5 rows per bucket)."""
    target = max(1.0, math.sqrt(max(1, largest_class)))
    return int(min(8, max(1, math.ceil(math.log(target, 16)))))


def split_hash(key: Column, seed: Column) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), seed.cast("string")))


def _largest_remainder(counts: dict, total_quota: int) -> dict:
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    base = {c: (total_quota * k) // n for c, k in counts.items()}
    rem = {c: (total_quota * k) % n for c, k in counts.items()}
    left = total_quota - sum(base.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c))[:left]:
        base[c] += 1
    return base


def split_quotas(counts: dict, valid_fraction: float, test_fraction: float) -> dict:
    """class -> (test quota, validation quota) for one group."""
    n = sum(counts.values())
    n_test = int(n * test_fraction)
    n_valid = int(n * valid_fraction)
    tq = _largest_remainder(counts, n_test)
    rest = {c: counts[c] - tq[c] for c in counts}
    vq = _largest_remainder(rest, n_valid)
    return {c: (tq[c], vq[c]) for c in counts}


def stratified_split(df: DataFrame, label: str = "label", key: str = "row_id",
                     valid_fraction: float = 0.2, test_fraction: float = 0.2,
                     seed: int | str = 42, by: list[str] | None = None,
                     out: str = "split") -> DataFrame:
    """Add ``out`` in {train, valid, test}. ``seed`` is an int or the name of
    a per-group seed column; ``by`` holds group keys (e.g. ``trial``). Keys
    have to be unique within a group; one that repeats across a cut raises."""
    by = list(by or [])
    keys = by + [label]
    cuts, bound = split_cuts(df, label, key, valid_fraction, test_fraction, seed, by)
    hashed = df.withColumn("_h", split_hash(F.col(key), _seed_col(seed)))
    return (hashed.join(maybe_broadcast(cuts, bound), keys, "left")
            .withColumn(out, split_of(F.col("_h"), F.col(key), F.col("_test_cut"), F.col("_valid_cut")))
            .drop("_h", "_test_cut", "_valid_cut"))


def _seed_col(seed: int | str) -> Column:
    return F.col(seed) if isinstance(seed, str) else F.lit(int(seed))


def split_of(h: Column, key: Column, test_cut: Column, valid_cut: Column) -> Column:
    """The split of a row with hash ``h``, by the cuts of its class."""
    pos = F.struct(h.alias("_h"), key.alias("_k"))
    return F.when(pos <= test_cut, F.lit("test")).when(pos <= valid_cut, F.lit("valid")).otherwise(F.lit("train"))


def split_cuts(df: DataFrame, label: str = "label", key: str = "row_id", valid_fraction: float = 0.2,
               test_fraction: float = 0.2, seed: int | str = 42, by: list[str] | None = None) -> tuple[DataFrame, int]:
    """(by..., label, _test_cut, _valid_cut), stored, and its number of rows:
    steps 1 to 3. A cut is the last (hash, key) of its part, NULL if empty."""
    by = list(by or [])
    keys = by + [label]
    hashed = df.withColumn("_h", split_hash(F.col(key), _seed_col(seed))).withColumn("_b", F.substring("_h", 1, PREFIX_HEX))
    hist = materialize(hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt")))
    counts_rows = hist.groupBy(*keys).agg(F.sum("_cnt").alias("n")).collect()
    groups: dict[tuple, dict] = {}
    for r in counts_rows:
        if r[label] is None:
            raise ValueError("stratified split needs a label on every row")
        groups.setdefault(tuple(r[b] for b in by), {})[r[label]] = r["n"]
    quota_rows = []
    for g, counts in groups.items():
        small = {c: k for c, k in counts.items() if k < 2}
        if small:
            raise ValueError(f"The least populated class has only 1 member: {small} (group {g})")
        for c, (t, v) in split_quotas(counts, valid_fraction, test_fraction).items():
            quota_rows.append((*g, c, int(t), int(t + v)))
    spark = df.sparkSession
    label_type = df.schema[label].dataType.simpleString()
    schema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
                       + [f"`{label}` {label_type}", "t_end long", "v_end long"])
    quotas = spark.createDataFrame(quota_rows, schema)
    bound = len(quota_rows)

    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_cum", F.sum("_cnt").over(w))
    targets = (hist.join(maybe_broadcast(quotas, bound), keys)
               .select(*keys, "_b", "_cnt", "_cum",
                       F.explode(F.array(F.struct(F.lit("test").alias("which"), F.col("t_end").alias("target")),
                                         F.struct(F.lit("valid").alias("which"), F.col("v_end").alias("target"))))
                       .alias("t"))
               .select(*keys, "_b", "t.which", "t.target", (F.col("_cum") - F.col("_cnt")).alias("_before"), "_cum")
               .where((F.col("_before") < F.col("target")) & (F.col("target") <= F.col("_cum")))
               .select(*keys, "_b", "which", (F.col("target") - F.col("_before")).alias("_need")))

    ranked = (hashed.select(*keys, "_b", "_h", F.col(key).alias("_k"))
              .join(maybe_broadcast(targets, 2 * bound), keys + ["_b"]))
    wr = Window.partitionBy(*keys, "which").orderBy("_h", "_k")
    # a key that repeats across a cut would make the sizes inexact
    again = F.raise_error(F.concat(F.lit(f"the split needs unique keys; {key} repeats: "), F.col("_k").cast("string")))
    own = F.when(F.col("_next") == F.col("_k"), again.cast(df.schema[key].dataType)).otherwise(F.col("_k"))
    cut_rows = (ranked.withColumn("_rn", F.row_number().over(wr)).withColumn("_next", F.lead("_k").over(wr))
                .where(F.col("_rn") == F.col("_need"))
                .select(*keys, "which", F.struct("_h", own.alias("_k")).alias("_cut")))
    cuts = cut_rows.groupBy(*keys).agg(
        F.max(F.when(F.col("which") == "test", F.col("_cut"))).alias("_test_cut"),
        F.max(F.when(F.col("which") == "valid", F.col("_cut"))).alias("_valid_cut"))
    return materialize(cuts), bound
