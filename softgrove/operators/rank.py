"""Mutual information of each feature with the class, and feature ranking.

``method="knn"`` is the nearest-neighbour estimator for a continuous
feature and a discrete target (Ross 2014, PLoS ONE 9(2):e87357), k = 3:

    MI = max(0, psi(N) + <psi(k_i)> - <psi(n_class_i)> - <psi(m_i)>)

with the conventions of the common library implementation: a keyed noise of
1e-10 of the feature's largest absolute value breaks ties (counts of
neighbours do not depend on a feature's scale, so values are not divided by
their std, whose last bits depend on the order of summation), classes with
one row are left out, ``k_i = min(k, n_class - 1)``, the
radius is the distance to the k-th same-class neighbour (open ball), and
``m_i`` counts rows of all classes inside it, the row itself included.

Spark plan (no pairwise join): equal values of a class have one radius and one
count, so the data are counted first, ``(group, feature, value, label, count)``,
and a value that most rows share is one row from there on. A feature's counted
values are cut into buckets at approximate quantiles of its distinct values
(one bucket up to ``KNN_BUCKET_ROWS``), and a task takes a bucket in value
order, in numpy:

* radius: a value stands for at most ``k + 1`` copies; the k nearest same-class
  neighbours are among the k copies before and after it. The first and last k
  copies of each class go to the next buckets that hold the class.
* ``m_i`` is a difference of two running counts, read at the interval's ends. An
  end that lies in another bucket is counted there, in a second pass over
  the ends that do (few: an interval has to cross the bucket's edge).

``method="binned"`` is the plug-in estimator on equal-frequency bins
(``groupBy(feature, bin, label).count()``); it is a different estimator, used
only when asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DoubleType, IntegerType, LongType, ShortType, StructField, StructType

from softgrove.functions.columns import count_less, digamma, digamma_scalar, keyed_gaussian
from softgrove.operators._util import maybe_broadcast
from softgrove.operators.blocks import BLOCK_VALUES, NO_LABEL, KeyTexts, feature_blocks, joined
from softgrove.operators.quantiles import exact_quantiles
from softgrove.session import materialize

# Counted values (and rows, by which it is set) of a feature in one task. A
# task's Python holds some 500 bytes for each.
KNN_BUCKET_ROWS = 250_000
# Values of a class whose neighbours are found at a time.
BALLS_AT_ONCE = 65_536


def _long(df: DataFrame, by: list[str], features: str, label: str, key: str) -> DataFrame:
    return df.select(*by, F.col(key).alias("_key"), F.col(label).alias("_label"),
                     F.posexplode(features).alias("feature", "x"))


def mutual_information(df: DataFrame, features: str = "features", label: str = "label",
                       by: list[str] | None = None, key: str = "row_id", k: int = 3,
                       method: str = "knn", seed: int | str = 42, tie_noise: bool = True,
                       train_rows: Column | None = None, n_bins: int = 64,
                       buckets: int | None = None) -> DataFrame:
    """Returns ``(by..., feature, mi)``. ``seed`` is an int or a per-group
    seed column name (for the tie-breaking noise). ``buckets``: value
    buckets per feature for the kNN windows (default: one per
    ``KNN_BUCKET_ROWS`` rows)."""
    by = list(by or [])
    if train_rows is None and "split" in df.columns:
        train_rows = F.col("split") == "train"
    if train_rows is not None:
        df = df.where(train_rows)
    if method not in ("knn", "binned"):
        raise ValueError(f"unknown estimator: {method}")
    seed_col = F.col(seed) if isinstance(seed, str) else F.lit(int(seed))
    if method == "binned":
        return _mi_binned(df, features, label, by, key, n_bins)
    long = df.select(*by, F.col(key).alias("_key"), F.col(label).alias("_label"), seed_col.alias("_seedv"),
                     F.posexplode(features).alias("feature", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    g = by + ["feature"]
    # One small job sizes everything: rows per group (value buckets) and
    # groups x features (the analytic bound of the per-feature tables).
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("f")).collect()
    n_keys = max(1, len(sizes) * max((r["f"] or 0 for r in sizes), default=1))
    biggest = max((r["n"] for r in sizes), default=0)
    if (tie_noise and buckets is None and 0 < biggest <= BLOCK_VALUES and max(r["f"] or 0 for r in sizes) > 0
            and isinstance(df.schema[label].dataType, ByteType | ShortType | IntegerType)):
        return _mi_of_blocks(df, by, features, label, key, seed_col, k, max(r["f"] or 0 for r in sizes))
    v = F.col("x")
    if tie_noise:
        # the largest absolute value is the same however rows are dealt out
        top = long.groupBy(*g).agg(F.max(F.abs("x")).alias("_top"))
        long = long.join(maybe_broadcast(top, n_keys), g)  # rows = groups x features
        v = v + F.lit(1e-10) * F.col("_top") * _seeded_gaussian(F.col("_seedv"), F.col("feature"), F.col("_key"))
    long = long.select(*g, "_key", "_label", v.alias("v"))

    # Class sizes; classes with a single row are left out entirely.
    cls = df.groupBy(*by, F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_nc"))
    n_classes = len(sizes) * (df.agg(F.approx_count_distinct(label)).first()[0] + 1) * 2
    long = long.join(maybe_broadcast(cls, n_classes), by + ["_label"]).where(F.col("_nc") > 1)
    if buckets is None:  # every feature of a group has one value per training row
        buckets = max(1, -(-biggest // KNN_BUCKET_ROWS))
    # an IEEE zero has two signs; they are one value
    counted = long.groupBy(*g, "_label", "_nc", (F.col("v") + F.lit(0.0)).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    counted = _counts_in_balls(counted, g, k, buckets, n_keys)
    agg = counted.groupBy(*g, "_nc", "_k", "m").agg(F.sum("w").alias("w")).groupBy(*g).agg(
        F.sum("w").alias("n"), *[(F.sum(F.col("w") * digamma(F.col(c))) / F.sum("w")).alias(p) for c, p in (("_k", "pk"), ("_nc", "pn"), ("m", "pm"))])
    mi = digamma(F.col("n")) + F.col("pk") - F.col("pn") - F.col("pm")
    return agg.select(*g, _steady(mi).alias("mi"))


# ---------------------------------------------------------------------------
# values in blocks

def _mi_of_blocks(df: DataFrame, by: list[str], features: str, label: str, key: str, seed: Column, k: int, n_feat: int) -> DataFrame:
    """The estimate with the noise that breaks ties, for groups of at most
    ``BLOCK_VALUES`` rows: a task has all values of a group and feature."""
    def draw(texts: KeyTexts, own: str | None) -> np.ndarray:
        # ``_seeded_gaussian``
        return texts.gaussian([([*([] if own is None else [own]), str(j)], ["0"], 7) for j in range(n_feat)])

    kept = [df.schema[c] for c in by]

    def run(table: pa.Table) -> pa.Table:
        mi = mi_of_values(joined(table, "_x"), joined(table, "_noise"), joined(table, "_label", np.int64), k)
        n = 0 if mi is None else 1
        keys = [table.column(c).slice(0, n) for c in (*by, "feature")]
        return pa.table([*keys, pa.array([mi] * n, pa.float64())], names=[*by, "feature", "mi"])

    blocks = feature_blocks(df, by, features, n_feat, F.col(key), draw, seed, F.col(label))
    out = blocks.groupBy(*by, "feature").applyInArrow(run, StructType([*kept, StructField("feature", IntegerType()), StructField("mi", DoubleType())]))
    return out.select(*by, "feature", _steady(F.col("mi")).alias("mi"))


def mi_of_values(x: np.ndarray, g: np.ndarray, y: np.ndarray, k: int) -> float | None:
    """The estimate of values ``x`` with classes ``y`` (a missing value is NaN, a
    missing class ``NO_LABEL``), with noise of 1e-10 of the largest absolute
    value times ``g``. None if no value is left."""
    there = ~np.isnan(x)
    if not there.any():
        return None
    v = x + 1e-10 * np.abs(x[there]).max() * g
    classes, of, size = np.unique(y, return_inverse=True, return_counts=True)
    keep = there & (y != NO_LABEL) & (size[of] > 1)
    if not keep.any():
        return None
    v, of = v[keep] + 0.0, of[keep]
    order = np.lexsort((v, of))
    v, of = v[order], of[order]
    at = np.sort(v)
    start = np.searchsorted(of, np.arange(len(classes) + 1))
    m, sums = np.zeros(len(v), dtype=np.int64), []
    for c in np.flatnonzero(np.diff(start)):
        own, ki = v[start[c]:start[c + 1]], min(k, int(size[c]) - 1)
        for i in range(0, len(own), BALLS_AT_ONCE):
            part = own[i:i + BALLS_AT_ONCE]
            r, lo, hi = _nearest(own, np.arange(i, i + len(part)), ki)
            zero = r == 0
            lo, hi = np.where(zero, part, lo), np.where(zero, part, hi)
            inside = np.searchsorted(at, hi, "left") - np.searchsorted(at, lo, "right")
            inside[zero] = np.searchsorted(at, part[zero], "right") - np.searchsorted(at, part[zero], "left")
            m[start[c] + i:start[c] + i + len(part)] = inside
        sums.append((len(own), digamma_scalar(ki), digamma_scalar(int(size[c]))))
    n = len(v)
    found, times = np.unique(m, return_counts=True)
    mean = lambda pairs: math.fsum(w * p for w, p in pairs) / n
    return (digamma_scalar(n) + mean((w, p) for w, p, _ in sums) - mean((w, p) for w, _, p in sums)
            - mean(zip(times.tolist(), map(digamma_scalar, found.tolist()))))


def _nearest(own: np.ndarray, i: np.ndarray, ki: int) -> tuple[np.ndarray, ...]:
    """(radius, lo, hi) of the ``ki`` nearest neighbours of values ``i`` of a class
    in ascending order; of equal distances the smaller value first."""
    v, last = own[i], len(own) - 1
    left, right = i - 1, i + 1
    for _ in range(ki):
        dl = np.where(left >= 0, v - own[np.maximum(left, 0)], np.inf)
        dr = np.where(right <= last, own[np.minimum(right, last)] - v, np.inf)
        down = dl <= dr
        r = np.where(down, dl, dr)
        u = np.where(down, own[np.maximum(left, 0)], own[np.minimum(right, last)])
        left, right = left - down, right + ~down
    u = np.where(np.isinf(r), np.inf, u)
    # open interval; on the neighbour's side its own value is the bound
    return r, np.where(u < v, u, v - r), np.where(u < v, v + r, u)


# ---------------------------------------------------------------------------
# neighbours among counted values

def _class_order(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Class (as a number), value, count, class size and own, in order of class
    and value, and that order."""
    label = table.column("_label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    v, w, nc = (table.column(c).to_numpy() for c in ("v", "w", "_nc"))
    own = table.column("_own").to_numpy().astype(bool)
    order = np.lexsort((v, label))
    return label[order], v[order], w[order], nc[order], own[order], order


def ball_ends(label: np.ndarray, v: np.ndarray, w: np.ndarray, nc: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of counted values in order of class and value: (k_i, radius, lo, hi)."""
    copies = np.minimum(w, k + 1)
    at = np.cumsum(copies) - copies  # of each value's first copy
    of = np.repeat(label, copies)
    a = np.repeat(v, copies)
    d, u = (np.full((len(v), 2 * k), np.inf) for _ in range(2))
    for j in range(1, k + 1):
        for col, to in ((j - 1, at - j), (k + j - 1, at + j)):
            there = (to >= 0) & (to < len(a))
            to = np.clip(to, 0, max(len(a) - 1, 0))
            there &= of[to] == label
            u[there, col] = a[to[there]]
            d[there, col] = np.abs(a[to[there]] - v[there])
    # ascending distance, of equal distances the smaller value first
    order = np.argsort(u, axis=1, kind="stable")
    d, u = np.take_along_axis(d, order, axis=1), np.take_along_axis(u, order, axis=1)
    order = np.argsort(d, axis=1, kind="stable")
    ki = np.minimum(k, nc - 1)
    pick = np.take_along_axis(order, (ki - 1)[:, None], axis=1)
    r, u = np.take_along_axis(d, pick, axis=1)[:, 0], np.take_along_axis(u, pick, axis=1)[:, 0]
    # open interval; on the neighbour's side its own value is the bound
    return ki, r, np.where(u < v, u, v - r), np.where(u < v, v + r, u)


def _edge_copies(g: list[str], k: int):
    """The first and last k copies of each class in a bucket."""
    def run(table: pa.Table) -> pa.Table:
        label, v, w, _, _, order = _class_order(table)
        start = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        copies = np.minimum(w, k)
        before = np.cumsum(copies) - copies
        size = np.add.reduceat(copies, start)
        part = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(v))))
        first = before - before[start][part] < k
        last = before - before[start][part] + copies > size[part] - k
        out = table.take(pa.array(order)).append_column("_first", pa.array(first)).append_column("_last", pa.array(last))
        return out.filter(pa.array(first | last)).select([*g, "_b", "_label", "_nc", "v", "w", "_first", "_last"])
    return run


def _contexts(edges: DataFrame, g: list[str], k: int) -> DataFrame:
    """For each bucket that holds a class: the last k copies in the buckets
    before and the first k in those after, as rows of that bucket."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("_b", "ascending"), ("v", "ascending")])
        b, w = rows.column("_b").to_numpy(), np.minimum(rows.column("w").to_numpy(), k)
        first, last = (np.flatnonzero(rows.column(c).to_numpy().astype(bool)) for c in ("_first", "_last"))
        take, to = [], []
        for own in np.unique(b):
            # each row holds a copy at least, so k rows of a side will do
            at, end = np.searchsorted(b[last], own, "left"), np.searchsorted(b[first], own, "right")
            for side in (last[max(0, at - k):at][::-1], first[end:end + k]):
                near = side[np.cumsum(w[side]) - w[side] < k]
                take += near.tolist()
                to += [own] * len(near)
        out = rows.take(pa.array(take, pa.int64()))
        return out.set_column(out.schema.get_field_index("_b"), "_b", pa.array(to, pa.int32())).select([*g, "_b", "_label", "_nc", "v", "w"])

    schema = StructType([f for f in edges.schema.fields if f.name not in ("_first", "_last")])
    return edges.groupBy(*g, "_label").applyInArrow(run, schema)


def _counts_in_balls(counted: DataFrame, g: list[str], k: int, buckets: int, n_keys: int) -> DataFrame:
    """(group..., _nc, _k, m, w): for ``w`` rows of a class of ``_nc`` the ball to the
    ``_k``-th neighbour holds ``m`` rows."""
    kept = [f for f in counted.schema.fields if f.name in g]
    fields = [StructField("_nc", LongType()), StructField("_k", LongType()), StructField("m", LongType()), StructField("w", LongType()),
              StructField("lo", DoubleType()), StructField("hi", DoubleType())]
    if buckets > 1:
        probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        cuts = counted.groupBy(*g).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", probs, 10 * buckets))).alias("_edges"))
        cuts = maybe_broadcast(materialize(cuts), n_keys * buckets)
        counted = counted.join(cuts, g).withColumn("_b", count_less(F.col("_edges"), F.col("v"), buckets).cast("int"))
        # a task needs the edges of its own bucket only; all of them on each
        # row would be rows x buckets
        counted = counted.withColumns({"_below": F.get("_edges", F.col("_b") - 1), "_above": F.get("_edges", F.col("_b"))})
        counted = materialize(counted.drop("_edges"))
        edge_schema = StructType([*kept, *(counted.schema[c] for c in ("_b", "_label", "_nc", "v", "w")),
                                  *(StructField(c, BooleanType()) for c in ("_first", "_last"))])
        edges = materialize(counted.withColumn("_own", F.lit(True)).groupBy(*g, "_b").applyInArrow(_edge_copies(g, k), edge_schema))
        rows = counted.withColumn("_own", F.lit(True)).unionByName(
            _contexts(edges, g, k).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    else:
        none = F.lit(None).cast("double")
        rows = counted.withColumns({"_b": F.lit(0), "_own": F.lit(True), "_below": none, "_above": none})

    def run(table: pa.Table) -> pa.Table:
        # the bucket's edges, of which the first and last bucket have one
        below, above = (table.column(c).drop_null()[:1].to_pylist() for c in ("_below", "_above"))
        cut, b = below + above, len(below)
        label, v, w, nc, own, _ = _class_order(table)
        ki, r, lo, hi = (x[own] for x in ball_ends(label, v, w, nc, k))
        v, w, nc = v[own], w[own], nc[own]
        order = np.argsort(v, kind="stable")
        at, upto = v[order], np.concatenate(([0], np.cumsum(w[order])))
        zero = r == 0
        m = np.where(zero, upto[np.searchsorted(at, v, "right")] - upto[np.searchsorted(at, v, "left")],
                     upto[np.searchsorted(at, hi, "left")] - upto[np.searchsorted(at, lo, "right")])
        here = zero | ((np.searchsorted(cut, lo, "left") == b) & (np.searchsorted(cut, hi, "left") == b))
        # rows with equal counts are added up; the others keep their ends
        found = np.stack([nc[here], ki[here], m[here]])
        order = np.lexsort(found[::-1])
        found = found[:, order]
        new = np.flatnonzero(np.append(found.shape[1] > 0, (found[:, 1:] != found[:, :-1]).any(axis=0)))
        total = np.add.reduceat(w[here][order], new) if len(new) else np.zeros(0, dtype=np.int64)
        found = found[:, new]
        n, far = found.shape[1], int((~here).sum())
        cols = [np.concatenate(x) for x in ((found[0], nc[~here]), (found[1], ki[~here]), (found[2], m[~here]), (total, w[~here]))]
        ends = [np.concatenate((np.zeros(n), x[~here])) for x in (lo, hi)]
        open_ = np.arange(n + far) < n
        arrays = [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], mask=~open_), pa.array(cols[3]), *(pa.array(e, mask=open_) for e in ends)]
        keys = [pa.array([table.column(c)[0].as_py()] * (n + far), table.schema.field(c).type) for c in g]
        return pa.table([*keys, *arrays], names=[*g, *(f.name for f in fields)])

    found = rows.groupBy(*g, "_b").applyInArrow(run, StructType([*kept, *fields]))
    if buckets == 1:
        return found.drop("lo", "hi")
    found = materialize(found)
    done = found.where("m IS NOT NULL").drop("lo", "hi")
    return done.unionByName(_far_ends(found.where("m IS NULL"), counted, cuts, g, buckets, n_keys))


def _far_ends(open_: DataFrame, counted: DataFrame, cuts: DataFrame, g: list[str], buckets: int, n_keys: int) -> DataFrame:
    """The counts of balls that end in other buckets: rows below ``hi`` less
    rows up to ``lo``, each read in the bucket it lies in."""
    open_ = open_.withColumn("_id", F.monotonically_increasing_id())
    ends = F.explode(F.array(F.struct(F.col("hi").alias("v"), F.lit(1).alias("s")), F.struct(F.col("lo").alias("v"), F.lit(-1).alias("s"))))
    ends = open_.select(*g, "_id", ends.alias("e")).select(*g, "_id", "e.v", "e.s").join(cuts, g)
    ends = ends.withColumn("_b", count_less(F.col("_edges"), F.col("v"), buckets).cast("int")).drop("_edges")
    per = counted.groupBy(*g, "_b").agg(F.sum("w").alias("_n"))
    before = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*g, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rows = counted.select(*g, "_b", "v", "w", F.lit(None).cast("long").alias("_id"), F.lit(0).alias("s")).unionByName(
        ends.select(*g, "_b", "v", F.lit(0).cast("long").alias("w"), "_id", "s"))

    def run(table: pa.Table) -> pa.Table:
        v, w, s = (table.column(c).to_numpy() for c in ("v", "w", "s"))
        value = s == 0
        order = np.argsort(v[value], kind="stable")
        at, upto = v[value][order], np.concatenate(([0], np.cumsum(w[value][order])))
        hi, lo = s == 1, s == -1
        n = np.concatenate((upto[np.searchsorted(at, v[hi], "left")], -upto[np.searchsorted(at, v[lo], "right")]))
        ids = table.column("_id").to_numpy(zero_copy_only=False)
        ids = np.concatenate((ids[hi], ids[lo])).astype(np.int64)
        sign = np.concatenate((np.ones(int(hi.sum()), np.int64), -np.ones(int(lo.sum()), np.int64)))
        keys = [pa.array([table.column(c)[0].as_py()] * len(n), table.schema.field(c).type) for c in [*g, "_b"]]
        return pa.table([*keys, pa.array(ids), pa.array(n.astype(np.int64)), pa.array(sign)], names=[*g, "_b", "_id", "n", "s"])

    schema = StructType([*(f for f in counted.schema.fields if f.name in g), StructField("_b", IntegerType()), *(StructField(c, LongType()) for c in ("_id", "n", "s"))])
    read = rows.groupBy(*g, "_b").applyInArrow(run, schema)
    read = read.join(maybe_broadcast(per, n_keys * buckets), [*g, "_b"], "left")
    m = read.groupBy("_id").agg(F.sum(F.col("n") + F.col("s") * F.coalesce("_off", F.lit(0))).alias("m"))
    return open_.drop("m", "lo", "hi").join(m, "_id").select(*g, "_nc", "_k", "m", "w")


def _steady(mi: Column) -> Column:
    """Not below zero, and without the last bits, which depend on the order
    in which means were summed (they would decide ties in the ranking)."""
    return F.round(F.greatest(mi, F.lit(0.0)), 12)


def _seeded_gaussian(seed: Column, feature: Column, key: Column) -> Column:
    # keyed_gaussian takes a literal seed; here the seed is a column, so it
    # goes into the hash as one more key.
    return keyed_gaussian(0, 7, seed, feature, key)


def _mi_binned(df: DataFrame, features: str, label: str, by: list[str], key: str, n_bins: int) -> DataFrame:
    long = _long(df, by, features, label, key)
    g = by + ["feature"]
    n_keys = max(1, df.select(*by).distinct().count() if by else 1) * (df.select(F.max(F.size(features))).first()[0] or 1)
    clean = long.where(F.col("x").isNotNull() & ~F.isnan("x"))
    edges = exact_quantiles(clean, g, "x", n_bins, n_keys).select(*g, F.array_distinct(F.slice("grid", 2, n_bins - 1)).alias("_edges"))
    binned = clean.join(maybe_broadcast(edges, n_keys), g).withColumn("bin", count_less(F.col("_edges"), F.col("x"), n_bins))
    cnt = binned.groupBy(*g, "bin", "_label").agg(F.count(F.lit(1)).alias("n_bl"))
    wb = Window.partitionBy(*g, "bin")
    wl = Window.partitionBy(*g, "_label")
    wt = Window.partitionBy(*g)
    cnt = cnt.select(*g, "n_bl", F.sum("n_bl").over(wb).alias("n_b"), F.sum("n_bl").over(wl).alias("n_l"),
                     F.sum("n_bl").over(wt).alias("n"))
    term = (F.col("n_bl") / F.col("n")) * F.log(F.col("n_bl") * F.col("n") / (F.col("n_b") * F.col("n_l")))
    return cnt.groupBy(*g).agg(_steady(F.sum(term)).alias("mi"))


def rank_features(mi: DataFrame, by: list[str] | None = None) -> dict:
    """Feature order per group: MI descending, ties by lower index. The
    result is groups x features integers."""
    by = list(by or [])
    w = Window.partitionBy(*by).orderBy(F.desc("mi"), F.asc("feature"))
    rows = mi.select(*by, "feature", F.row_number().over(w).alias("rank")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(tuple(r[b] for b in by), []).append(int(r["feature"]))
    return out


def mi_brute_force(values, labels, k: int = 3) -> float:
    """Reference O(n^2) estimator on the driver, for tests on small fixtures
    (values already scaled, no noise)."""
    x = np.asarray(values, dtype=float)
    y = np.asarray(labels)
    n_c = {c: int((y == c).sum()) for c in np.unique(y)}
    keep = np.array([n_c[c] > 1 for c in y])
    x, y = x[keep], y[keep]
    ks, ncs, ms = [], [], []
    for i in range(len(x)):
        same = np.abs(x[y == y[i]] - x[i])
        same = np.sort(same)[1:]  # drop itself
        kk = min(k, n_c[y[i]] - 1)
        r = same[kk - 1]
        d = np.abs(x - x[i])
        m = int((d < r).sum()) if r > 0 else int((d <= 0).sum())
        ks.append(kk); ncs.append(n_c[y[i]]); ms.append(m)
    n = len(x)
    mi = (digamma_scalar(n) + np.mean([digamma_scalar(a) for a in ks])
          - np.mean([digamma_scalar(a) for a in ncs]) - np.mean([digamma_scalar(a) for a in ms]))
    return max(0.0, float(mi))
