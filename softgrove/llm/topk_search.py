"""Exact top-k inner-product search by a three-phase uniform threshold.

The vector's components are cut into ``lists`` segments; a segment's inner
product is an entry's score in that segment's local list, and the sum over
the segments is its score.

1. Every task gathers local score lists: of each step of its rows one
   segment's, the segments taking turns, and of these the entries with the best
   local scores for each query. It resolves them and reports the best full
   scores. The (k + 1)-th of all reports is a *safe cutoff* t: no smaller score
   can be in the result (one more than k, as the query's own row may be
   among them).
2. The cutoffs are broadcast. With m segments, an entry that reaches t has a
   segment score of at least t / m; each task collects these entries and
   drops those whose bound (known segment scores, t / m for the others)
   stays below t.
3. The scores of the entries left are resolved exactly; each task returns its
   best k + 1 for each query, and these are merged.

Up to ``QUERY_BLOCK`` queries are one block, broadcast with its cutoffs. More
are never collected: equal rows are counted once, queries are cut into blocks
and rows into shards by their hashes, and both phases run over the grid of
(block, shard) cells in one job each; a cutoff travels with its query. A row
counted more than k + 2 times is sent k + 2 times, as no result can hold more of
its copies. Components are floor(scale * x); products are exact (floats where
sums stay below 2^53, else Python integers).

Edge cases: vectors that are NULL, empty, or hold NULL, NaN or infinite
components take no part, nor do rows whose id is NULL; vectors of another
length than the query's are no candidates. Ids may repeat: each row is a
candidate and, where it applies, a query of its own, and only the query's own
row (one row with its id and vector) is left out. Empty tables, or tables without
queries, give an empty result. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.session import materialize

K = 5
SCALE = 256
LISTS = 4
QUERY_BLOCK = 4096
#: Distinct rows in a shard of the grid.
SHARD_ROWS = 100_000
#: Scores that a task holds at a time, per segment.
CELLS = 1 << 20
_EXACT = float(1 << 53)
#: Below every score: an entry's cutoff while fewer than k + 1 are known.
_LOWEST = -(1 << 200)


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of the usable vectors, as longs."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    ok = F.col(f"`{vec_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & (F.size(f"`{vec_col}`") > 0) & ~bad
    return df.where(ok).select(F.col(f"`{id_col}`").cast("long").alias("id"),
                               F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


class _Vectors:
    """Rows of one vector length, cut into segments."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, lists: int):
        self.ids, self.v = ids, v
        edges = [v.shape[1] * k // lists for k in range(lists + 1)]
        self.parts = [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, queries by rows."""
    top = float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * q.shape[1]
    if top < _EXACT:
        return q.astype(np.float64) @ c.astype(np.float64).T
    return q.astype(object) @ c.astype(object).T


def _resolved(q: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact inner products of each query with its own entries."""
    top = float(np.abs(q.astype(float)).max()) * float(np.abs(entries.astype(float)).max()) * q.shape[1]
    kind = np.int64 if top < _EXACT else object
    return (q.astype(kind)[:, None, :] * entries.astype(kind)).sum(axis=2)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows of each vector length."""
    v = batch.column("v")
    size = np.diff(v.offsets.to_numpy())
    ids = batch.column("id").to_numpy()
    flat = v.flatten().to_numpy()
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield ids[rows], flat[begin[rows][:, None] + np.arange(n)]


def _best(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best: score descending, id ascending, own first."""
    return np.lexsort((~own, ids, -scores))[:n]


def _local_lists(batches, queries: list[_Vectors], n_queries: int, k: int):
    """Phase 1: the best full scores known for each query."""
    known: list[np.ndarray] = [np.zeros(0, dtype=object)] * n_queries
    for step, (_, c, first, qs) in enumerate(_pairs(batches, queries)):
        part = qs.parts[step % len(qs.parts)]
        local = _products(qs.v[:, part], c[:, part])
        top = min(k + 1, c.shape[0])
        heads = np.argpartition(-local, top - 1, axis=1)[:, :top]
        score = _resolved(qs.v, c[heads])
        for row in range(len(qs.ids)):
            own = np.concatenate([known[first + row], score[row]])
            known[first + row] = np.sort(own)[::-1][:k + 1]
    rows = [(q, [int(s) for s in x]) for q, x in enumerate(known) if len(x)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                                     names=["q", "scores"])


def _pairs(batches, queries: list[_Vectors]):
    """(ids, vectors, number of the first query, queries of that length), a
    bounded number of cells at a time."""
    first = np.concatenate(([0], np.cumsum([len(q.ids) for q in queries]))).tolist()
    for batch in batches:
        for ids, c in _by_length(batch):
            for at, qs in zip(first, queries):
                if qs.v.shape[1] != c.shape[1]:
                    continue
                step = max(1, CELLS // len(qs.ids))
                for a in range(0, len(ids), step):
                    yield ids[a:a + step], c[a:a + step], at, qs


def _collect(batches, queries: list[_Vectors], cutoff: list[int | None], k: int):
    """Phases 2 and 3: the best exact scores that reach the cutoff."""
    found: dict[int, tuple] = {}
    query_ids: dict[int, int] = {}
    for ids, c, first, qs in _pairs(batches, queries):
        per = [_products(qs.v[:, s], c[:, s]) for s in qs.parts]
        # a segment's floats are exact; sums of segments are made of integers
        kind = object if any(p.dtype == object for p in per) else np.int64
        lowest = _LOWEST if kind is object else -(1 << 62)
        t = np.array([lowest if cutoff[first + r] is None else cutoff[first + r] for r in range(len(qs.ids))], dtype=kind)[:, None]
        share = t // len(per)
        seen = per[0] >= share
        for p in per[1:]:
            seen |= p >= share
        row, col = np.nonzero(seen)
        if not len(row):
            continue
        values = [p[row, col] for p in per]
        values = [x if x.dtype == object else x.astype(np.int64).astype(kind) for x in values]
        t, share = t[row, 0], share[row, 0]
        bound = sum(np.maximum(v, share) for v in values)
        left = bound >= t
        score = sum(v[left] for v in values)
        row, col, t = row[left], col[left], t[left]
        left = score >= t
        row, col, score = row[left], col[left], score[left]
        edges = np.searchsorted(row, np.arange(len(qs.ids) + 1))
        for r in np.flatnonzero(np.diff(edges)):
            a, b = edges[r], edges[r + 1]
            own_ids, own_score = ids[col[a:b]], score[a:b]
            own = own_ids == qs.ids[r]
            own[own] = (c[col[a:b][own]] == qs.v[r]).all(axis=1)
            had = found.get(first + r)
            if had is not None:
                own_ids, own_score, own = (np.concatenate(x) for x in zip(had, (own_ids, own_score, own)))
            keep = _best(own_ids, own_score, own, k + 1)
            found[first + r] = own_ids[keep], own_score[keep], own[keep]
            query_ids[first + r] = int(qs.ids[r])
    hit = pa.list_(pa.struct([("minus", pa.int64()), ("id", pa.int64()), ("other", pa.bool_())]))
    rows = [(q, query_ids[q], [{"minus": -int(s), "id": int(i), "other": not o} for i, s, o in zip(*x)]) for q, x in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                      pa.array([r[2] for r in rows], hit)], names=["q", "query_id", "hits"])


def _merged(lists_col: str) -> Column:
    return F.sort_array(F.flatten(F.collect_list(lists_col)))


def _block(ids: list, vectors: list, lists: int) -> tuple[list[_Vectors], list[int]]:
    """The queries by vector length, and their places in the input."""
    order = sorted(range(len(ids)), key=lambda i: (len(vectors[i]), ids[i], vectors[i]))
    out = []
    for n in sorted({len(v) for v in vectors}):
        own = [i for i in order if len(vectors[i]) == n]
        out.append(_Vectors(np.array([ids[i] for i in own], dtype=np.int64), np.array([vectors[i] for i in own], dtype=np.int64), lists))
    return out, order


def _ranked(hits: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """The k best of each query's merged hits ``h``, its own row left out."""
    at = F.array_position(F.transform("h", lambda x: x.other), False).cast("int")
    others = F.when(at > 0, F.concat(F.slice("h", F.lit(1), at - 1), F.slice("h", at + 1, F.size("h")))).otherwise(F.col("h"))
    return (hits.select("query_id", *keep, F.posexplode(F.slice(others, 1, k)).alias("p", "x"))
            .select("query_id", *keep, (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score")))


def _cutoff(k: int) -> Column:
    """The (k + 1)-th best of the reports, NULL while there are fewer."""
    kth = F.element_at(F.slice(F.reverse(_merged("scores")), k + 1, 1), 1)
    return F.when(F.size(_merged("scores")) > k, kth)


_HITS = "array<struct<minus:long,id:long,other:boolean>>"


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
           scale: int = SCALE, lists: int = LISTS, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for
    which ``is_query`` (over the column ``id``) holds."""
    rows = quantised(vectors, id_col, vec_col, scale)
    n_queries = rows.where(is_query).count()
    if n_queries > query_block:
        return _over_grid(rows, is_query, n_queries, k, lists, query_block, shard_rows)
    return _one_block(rows, rows.where(is_query), k, lists)


def _one_block(rows: DataFrame, queries: DataFrame, k: int, lists: int) -> DataFrame:
    """All queries, at most a block of them, broadcast to every row."""
    sc = rows.sparkSession.sparkContext
    own = queries.collect()
    block, _ = _block([r.id for r in own], [list(r.v) for r in own], lists)
    n = len(own)
    sent = sc.broadcast(block)
    reports = rows.mapInArrow(lambda it: _local_lists(it, sent.value, n, k), "q int, scores array<long>")
    cutoff: list[int | None] = [None] * n
    for r in reports.groupBy("q").agg(_cutoff(k).alias("t")).collect():
        cutoff[r.q] = r.t
    cut = sc.broadcast(cutoff)
    hits = rows.mapInArrow(lambda it: _collect(it, sent.value, cut.value, k), f"q int, query_id long, hits {_HITS}")
    return _ranked(hits.groupBy("q", "query_id").agg(_merged("hits").alias("h")), k, []).drop("q")


def _over_grid(rows: DataFrame, is_query: Column, n_queries: int, k: int, lists: int, query_block: int, shard_rows: int) -> DataFrame:
    """Any number of queries: one job a phase over (query block, row shard)."""
    counted = materialize(rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")))
    blocks, shards = -(-n_queries // query_block), -(-counted.count() // shard_rows)
    # two numbers of the vector tell a query from others with its id
    key = F.concat_ws(":", "id", F.xxhash64("v"), F.hash("v"), F.size("v"))
    dealt = F.xxhash64("id", "v", F.lit(7))
    queries = counted.where(is_query).select(key.alias("key"), "id", "v", "copies", F.pmod(dealt, F.lit(blocks)).alias("block"))
    row_side = counted.select(
        "id", "v", F.pmod(dealt, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.least("copies", F.lit(k + 2)).cast("int").alias("n"))
    row_side = row_side.select("id", "v", "shard", "block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_n")).drop("_n")

    def cells(queries: DataFrame, fn, schema: str) -> DataFrame:
        each = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return each.groupBy("block", "shard").cogroup(row_side.groupBy("block", "shard")).applyInArrow(fn, schema)

    def parts(q: pa.Table, r: pa.Table) -> tuple[list[_Vectors], list[int], list[pa.RecordBatch]]:
        block, order = _block(q.column("id").to_pylist(), q.column("v").to_pylist(), lists)
        return block, order, r.select(["id", "v"]).combine_chunks().to_batches()

    def lists_of(q: pa.Table, r: pa.Table) -> pa.Table:
        block, order, batches = parts(q, r)
        out = next(_local_lists(batches, block, len(order), k))
        keys = q.column("key").take(pa.array(order, pa.int64())).take(out.column("q"))
        return pa.table({"key": keys, "scores": out.column("scores")})

    def hits_of(q: pa.Table, r: pa.Table) -> pa.Table:
        block, order, batches = parts(q, r)
        own = q.take(pa.array(order, pa.int64()))
        out = next(_collect(batches, block, own.column("t").to_pylist(), k))
        own = own.take(out.column("q"))
        return pa.table({"key": own.column("key"), "query_id": out.column("query_id"), "copies": own.column("copies"), "hits": out.column("hits")})

    cutoffs = cells(queries, lists_of, "key string, scores array<long>").groupBy("key").agg(_cutoff(k).alias("t"))
    queries = materialize(queries.join(cutoffs, "key", "left"))
    hits = cells(queries, hits_of, f"key string, query_id long, copies long, hits {_HITS}")
    best = _ranked(hits.groupBy("key", "query_id", "copies").agg(_merged("hits").alias("h")), k, ["copies"])
    # every copy of a query is one
    return best.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_n", "copies")
