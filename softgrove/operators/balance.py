"""Class rebalancing: random oversampling to the majority class count.

Every class keeps all its rows (``draw = -1``) and receives
``n_max - n_c`` extra rows drawn with replacement: draw ``d`` of class
``c`` takes the row whose within-class rank (order ``md5(key:seed)``)
equals ``hash(c:d:seed) mod n_c``.

Scale: ranks come from a (class, hash-prefix bucket) histogram plus a
window per bucket, never a window over a whole class; draws are generated
in blocks (distributed) and matched to rows by an equi-join on (class, rank).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from softgrove.functions.columns import keyed_uniform
from softgrove.operators._util import maybe_broadcast
from softgrove.operators.labels import minority_share
from softgrove.operators.split import PREFIX_HEX, prefix_width, split_hash
from softgrove.operators.tree import arrow_matrix
from softgrove.session import materialize


def _hex_int(h):
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")


def within_class_rank(df: DataFrame, label: str, key: str, seed: int, largest: int | None = None) -> DataFrame:
    """0-based rank of each row inside its class by ``(md5(key:seed), key)``."""
    width = prefix_width(largest) if largest else PREFIX_HEX
    h = df.withColumn("_h", split_hash(F.col(key), F.lit(seed))).withColumn("_b", F.substring("_h", 1, width))
    hist = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.select(label, "_b", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    local = Window.partitionBy(label, "_b").orderBy("_h", key)
    # at most one row per class and hash prefix
    bound = 16 ** width * max(1, df.select(label).distinct().count())
    return (h.join(maybe_broadcast(offs, bound), [label, "_b"])
            .withColumn("_rank", F.col("_off") + F.row_number().over(local) - 1)
            .drop("_h", "_b", "_off"))


def _missing(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(label, n, need) of the classes with fewer rows than the largest one,
    and that one's size."""
    counts = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    n_max = counts.agg(F.max("_n")).first()[0] or 0
    return counts.where(F.col("_n") < n_max).withColumn("_need", F.lit(n_max) - F.col("_n")), n_max


def oversample_random(df: DataFrame, label: str = "label", key: str = "row_id", seed: int = 42) -> DataFrame:
    need, n_max = _missing(df, label)
    base = df.withColumn("draw", F.lit(-1).cast("long"))
    if need.isEmpty():
        return base
    # draws of a class in blocks, so that no task makes all of them
    last = F.floor((F.col("_need") - 1) / DRAW_BLOCK)
    blocks = need.select(label, "_n", "_need", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block")).repartition(label, "_block")
    draw = F.explode(F.sequence(F.col("_block") * DRAW_BLOCK, F.least((F.col("_block") + 1) * DRAW_BLOCK, F.col("_need")) - 1))
    draws = blocks.select(label, "_n", draw.alias("draw"))
    pick = _hex_int(F.md5(F.concat_ws(":", F.col(label).cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))))
    draws = draws.select(label, "draw", (pick % F.col("_n")).alias("_rank"))
    ranked = within_class_rank(df, label, key, seed, n_max)
    extra = ranked.join(draws, [label, "_rank"]).drop("_rank")
    return base.unionByName(extra.select(*base.columns))


# ---------------------------------------------------------------------------
# neighbours within classes

# Draws of one block.
DRAW_BLOCK = 1 << 16
# Rows of a class for each pivot, and of a part of a cell in one task.
CELL_ROWS = 8192
# Pivots of a class, and feature values of all pivots, which are broadcast.
MAX_PIVOTS = 1024
PIVOT_VALUES = 1 << 22
# Cells of a task's distance work.
DISTANCE_CELLS = 1 << 21
# Bounds are loosened by this part, more than rounding can come to.
SLACK = 1e-9


def distances(Q: np.ndarray, X: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, summed by feature in order."""
    out = np.empty((len(Q), len(X)))
    step = max(1, DISTANCE_CELLS // max(1, X.size))
    for at in range(0, len(Q), step):
        out[at:at + step] = ((Q[at:at + step, None, :] - X[None, :, :]) ** 2).sum(axis=2)
    return out


def _pivots(rows: DataFrame, label: str, key: str, features: str, cell_rows: int) -> dict:
    """Per class of over ``cell_rows`` rows the vectors of its pivots: the first
    rows by a hash of their keys, one for ``cell_rows`` rows. Bounded."""
    shape = rows.agg(F.max(F.size(features)), F.approx_count_distinct(label)).first()
    most = max(1, min(MAX_PIVOTS, PIVOT_VALUES // max(1, (shape[0] or 1) * (shape[1] or 1))))
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell_rows)
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    first = rows.select(label, key, features).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= most)
    first = first.join(sizes, label).where(F.col("_i") <= F.ceil(F.col("_n") / cell_rows))
    out: dict = {}
    for r in first.orderBy(label, "_i").collect():
        out.setdefault(r[label], []).append(r[features])
    return {c: np.array(x, dtype=np.float64) for c, x in out.items()}


def _by_class(rb, label: str):
    """(class, positions) of a batch."""
    import pyarrow.compute as pc
    col = rb.column(label)
    for value in pc.unique(col):
        yield value.as_py(), np.flatnonzero(pc.equal(col, value).to_numpy(zero_copy_only=False))


def _with_cells(rows: DataFrame, sent, label: str, features: str) -> DataFrame:
    """Adds the number of the nearest pivot (0 in classes without) and the
    distance from it."""
    schema = StructType([*rows.schema.fields, StructField("_cell", IntegerType()), StructField("_dp", DoubleType())])

    def fn(batches):
        import pyarrow as pa
        for rb in batches:
            if not rb.num_rows:
                continue
            X = arrow_matrix(rb.column(features))
            cell, dp = np.zeros(len(X), dtype=np.int32), np.zeros(len(X))
            for c, own in _by_class(rb, label):
                if c in sent.value:
                    d = distances(X[own], sent.value[c])
                    cell[own] = d.argmin(axis=1)
                    dp[own] = np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell), pa.array(dp)], names=schema.names)

    return rows.mapInArrow(fn, schema)


def _cell_bounds(cells: DataFrame, pivots: dict, k: int, label: str) -> dict:
    """Per class, of each cell: rows, smallest and largest distance from the
    pivot, and the k + 1 smallest (infinite where it has fewer)."""
    near = Window.partitionBy(label, "_cell").orderBy("_dp")
    least = cells.select(label, "_cell", "_dp").withColumn("_i", F.row_number().over(near)).where(F.col("_i") <= k + 1)
    least = least.groupBy(label, "_cell").agg(F.sort_array(F.collect_list("_dp")).alias("_least"))
    stats = cells.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_dp").alias("_lo"), F.max("_dp").alias("_hi"))
    out: dict = {}
    # as many rows as pivots, and one for each other class
    for r in stats.join(least, [label, "_cell"]).collect():
        n = len(pivots.get(r[label], [0]))
        b = out.setdefault(r[label], {"n": np.zeros(n, np.int64), "lo": np.full(n, np.inf), "hi": np.zeros(n), "least": np.full((n, k + 1), np.inf)})
        c = r["_cell"]
        b["n"][c], b["lo"][c], b["hi"][c] = r["_n"], r["_lo"], r["_hi"]
        b["least"][c, :len(r["_least"])] = r["_least"]
    return out


def visited_cells(Q: np.ndarray, pivots: np.ndarray, bound: dict, k: int) -> np.ndarray:
    """[query, cell]: whether the cell can hold one of the k nearest rows.

    The k + 1 smallest of d(q, pivot) + d(pivot, row) bound the distance of the
    k-th neighbour from above (one row may be the query itself). A cell's
    rows are at least d(q, pivot) - hi and lo - d(q, pivot) away, and no nearer
    than the plane between its pivot and the query's nearest one."""
    d2 = distances(Q, pivots)
    d = np.sqrt(d2)
    above = np.sort((d[:, :, None] + bound["least"][None, :, :]).reshape(len(Q), -1), axis=1)[:, k]
    between = np.sqrt(distances(pivots, pivots))
    own = d.argmin(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d2 - d2[np.arange(len(Q)), own][:, None]) / (2 * between[own])
    plane = np.where(between[own] > 0, plane, 0.0)
    below = np.maximum(np.maximum(d - bound["hi"], bound["lo"] - d), plane)
    scale = 1 + d.max(axis=1) + above.clip(max=d.max() + 1)
    return (below <= (above + SLACK * scale)[:, None]) & (bound["n"] > 0)


def _visits(asking: DataFrame, sent, bounds, k: int, label: str, features: str, parts: int) -> DataFrame:
    """A row for each asking row, cell it has to visit, and part of the cell."""
    schema = StructType([*asking.schema.fields, *(StructField(c, IntegerType()) for c in ("_cell", "_part", "_ask"))])

    def fn(batches):
        import pyarrow as pa
        for rb in batches:
            if not rb.num_rows:
                continue
            X, h = arrow_matrix(rb.column(features)), rb.column("_h").to_numpy()
            for c, own in _by_class(rb, label):
                bound, pivots = bounds.value[c], sent.value.get(c)
                go = np.ones((len(own), 1), bool) if pivots is None else visited_cells(X[own], pivots, bound, k)
                row, cell = np.nonzero(go)
                many = -(-bound["n"][cell] // parts)
                to = np.repeat(np.arange(len(row)), many)
                part = np.arange(len(to)) - np.repeat(np.cumsum(many) - many, many)
                row, cell, many = own[row[to]], cell[to], many[to]
                out = rb.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)),
                                                  pa.array((h[row] % many).astype(np.int32))], names=schema.names)

    return asking.mapInArrow(fn, schema)


def _dealt(cells: DataFrame, bounds, label: str, parts: int) -> DataFrame:
    """Rows of cells, in the part they belong to, for each block of asking
    rows that visits it."""
    schema = StructType([*cells.schema.fields, *(StructField(c, IntegerType()) for c in ("_part", "_ask"))])

    def fn(batches):
        import pyarrow as pa
        for rb in batches:
            for c, own in _by_class(rb, label):
                cell, h = (rb.column(x).to_numpy()[own] for x in ("_cell", "_h"))
                many = -(-bounds.value[c]["n"][cell] // parts)
                to = np.repeat(np.arange(len(own)), many)
                ask = np.arange(len(to)) - np.repeat(np.cumsum(many) - many, many)
                # another hash than that of the asking rows' blocks
                part = (h // many % many)[to]
                out = rb.take(pa.array(own[to]))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(part.astype(np.int32)), pa.array(ask.astype(np.int32))], names=schema.names)

    return cells.mapInArrow(fn, schema)


def _nearest(k: int, label: str, key: str, features: str, near_type):
    """The k nearest rows of a part of a cell for each row that visits it."""
    def fn(table):
        import pyarrow as pa
        table = table.sort_by(key)
        asks = table.column("_asks").to_numpy().astype(bool)
        mask = pa.array(asks)
        rows, own = table.filter(pa.array(~asks)), table.filter(mask)
        keys, who = rows.column(key).to_pylist(), own.column(key).to_pylist()
        X, Q = arrow_matrix(rows.column(features)), arrow_matrix(own.column(features))
        place = {x: i for i, x in enumerate(keys)}
        near: list[list] = []
        step = max(1, DISTANCE_CELLS // max(1, len(keys)))
        for at in range(0, len(who) if len(keys) else 0, step):
            d = distances(Q[at:at + step], X)
            me = [(q, place[x]) for q, x in enumerate(who[at:at + step]) if x in place]
            if me:
                d[tuple(np.array(me).T)] = np.inf
            limit = np.partition(d, min(k, len(keys)) - 1, axis=1)[:, min(k, len(keys)) - 1]
            # rows are in order of their keys, so ties are too
            q, j = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            order = np.lexsort((j, d[q, j], q))
            q, j = q[order], j[order]
            first = np.searchsorted(q, np.arange(len(d)))
            keep = np.arange(len(q)) - first[q] < k
            hits: list[list] = [[] for _ in range(len(d))]
            for a, b in zip(q[keep].tolist(), j[keep].tolist()):
                hits[a].append({"d": float(d[a, b]), "k": keys[b]})
            near += hits
        near += [[] for _ in range(len(who) - len(near))]
        return pa.table([own.column(label), own.column(key), pa.array(near, near_type)], names=[label, key, "near"])
    return fn


def nearest_in_class(df: DataFrame, asking: DataFrame, k: int, label: str, features: str, key: str, cell_rows: int = 0) -> DataFrame:
    """(label, key, near): distance and key of the k nearest rows of its class
    for each asking row, exact, by Euclidean distance and then key.

    A join over a metric partition: rows belong to the cell of their nearest
    pivot, and triangle inequalities tell which cells an asking row has to
    visit (``visited_cells``). Cells of over ``cell_rows`` rows are dealt out
    in parts, for blocks of asking rows. Of rows with one vector only the
    first k + 1 keys are looked at: no others can be among the k nearest."""
    import pyarrow as pa
    cell_rows = cell_rows or CELL_ROWS
    sc = df.sparkSession.sparkContext
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40)).alias("_h")
    asking = asking.select(label, key, features, h).dropDuplicates([label, key])
    same = Window.partitionBy(label, features).orderBy(key)
    rows = df.join(asking.select(label).distinct(), label, "left_semi").select(label, key, features, h)
    rows = materialize(rows.withColumn("_i", F.row_number().over(same)).where(F.col("_i") <= k + 1).drop("_i"))
    pivots = _pivots(rows, label, key, features, cell_rows)
    sent = sc.broadcast(pivots)
    cells = _with_cells(rows, sent, label, features)
    if pivots:
        cells = materialize(cells)
    bounds = sc.broadcast(_cell_bounds(cells, pivots, k, label))
    visits = _visits(asking, sent, bounds, k, label, features, cell_rows).withColumn("_asks", F.lit(True))
    both = _dealt(cells.drop("_dp"), bounds, label, cell_rows).withColumn("_asks", F.lit(False)).unionByName(visits)
    near = ArrayType(StructType([StructField("d", DoubleType()), StructField("k", df.schema[key].dataType)]))
    schema = StructType([df.schema[label], df.schema[key], StructField("near", near)])
    near_type = pa.list_(pa.struct([("d", pa.float64()), ("k", to_arrow_type(df.schema[key].dataType))]))
    found = both.groupBy(label, "_cell", "_part", "_ask").applyInArrow(_nearest(k, label, key, features, near_type), schema)
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
    return found.groupBy(label, key).agg(merged.alias("near"))


def oversample_smote(df: DataFrame, label: str = "label", features: str = "features", key: str = "row_id",
                     k: int = 5, seed: int = 42, cell_rows: int = 0) -> DataFrame:
    """SMOTE: each minority class gets ``n_max - n_c`` synthetic rows
    ``x + u (x_nn - x)`` with ``x`` a random row of the class, ``x_nn`` one
    of its ``k`` nearest neighbours in the class (exact, Euclidean, ties by
    key) and ``u`` uniform; all three draws are keyed by md5 of (label, draw,
    seed). Synthetic rows carry the key of their base row and ``draw >= 0``;
    original rows have ``draw = -1``. Keys have to be unique. If a class has
    at most ``k`` rows, all classes fall back to random oversampling (as the
    library's error path does)."""
    need, _ = _missing(df, label)
    if not need.where(F.col("_n") <= k).isEmpty():
        return oversample_random(df, label, key, seed)
    df = df.select(key, label, F.col(features).cast("array<double>").alias(features))
    base = df.withColumn("draw", F.lit(-1).cast("long"))
    if need.isEmpty():
        return base
    drawn = materialize(oversample_random(df, label, key, seed).where("draw >= 0"))
    near = nearest_in_class(df, drawn, k, label, features, key, cell_rows)
    text = [F.col(label).cast("string"), F.col("draw").cast("string"), F.lit(str(seed))]
    which = (_hex_int(F.md5(F.concat_ws(":", *text, F.lit("near")))) % F.size("near") + 1).cast("int")
    picked = drawn.join(near, [label, key]).select(*drawn.columns, F.element_at("near", which)["k"].alias("_to"))
    # vectors of the neighbours drawn only
    to = df.select(F.col(label).alias("_to_label"), F.col(key).alias("_to"), F.col(features).alias("_y"))
    picked = picked.join(to.withColumnRenamed("_to_label", label), [label, "_to"])
    u = keyed_uniform(seed, 9, F.col(label), F.col("draw"))
    new = F.zip_with(features, "_y", lambda x, y: x + u * (y - x))
    return base.unionByName(picked.select(key, label, new.alias(features), "draw"))


def rebalance(df: DataFrame, label: str = "label", key: str = "row_id", ratio: float = 0.25,
              strategy: str = "random", seed: int = 42, features: str = "features") -> DataFrame:
    """Oversample only if the minority share is at most ``ratio / (K - 1)``,
    by ``smote`` or ``random`` oversampling."""
    row = minority_share(df, label, ratio).first()
    if not row["needs_rebalance"]:
        return df
    if strategy == "smote":
        return oversample_smote(df, label, features, key, seed=seed).drop("draw")
    return oversample_random(df, label, key, seed).drop("draw")
