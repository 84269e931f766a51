"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: 64 bits over the XXH64 values (seed 42) of a text's word
shingles; a bit is 1 if it is set in over half of them.

Linking (fingerprints at most ``radius`` bits apart):

1. Equal fingerprints are one node (a groupBy with map-side combine, so a
   text that a third of all rows share is one row from here on).
2. Pigeonhole buckets: the 64 bits are cut into pieces and a table is made
   for each choice of ``pieces - radius`` of them, keyed by these pieces'
   bits; two fingerprints within the radius agree on one table's key at
   least. More nodes take more, narrower tables, so that buckets stay small;
   every choice gives the same links.
3. A bucket larger than ``BUCKET_LIMIT`` is dealt out as pairs of
   sub-buckets, so no task holds a bucket whole and no pair is lost.
4. Within a bucket: bit planes are stored vertically (64 fingerprints to a
   machine word and plane), each fingerprint's distances to the 64 of a word
   are counted at once by carry-save counters, and words whose 64 distances
   all exceed the radius are abandoned every few planes. A bucket emits
   the edges of a spanning forest of its links, never all its pairs.
5. Connected components of these edges by alternating large-star and
   small-star rounds on DataFrames, checkpointed each round.

Edge cases: a NULL or empty text, or one without words, has fingerprint zero
and is linked like any other; a text of fewer words than a shingle is one
shingle. Rows with a NULL id take part in links; the component id is the
smallest id that is not NULL (NULL if there is none). Repeated rows give
repeated rows. Empty tables give empty results. Other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from softgrove.llm.common import LOWER_BYTES, add_fields, fresh, steps
from softgrove.session import materialize

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a bucket (or sub-bucket) that are compared in one task.
BUCKET_LIMIT = 8192
#: A fingerprint with more than this part of all rows is joined by broadcast.
HOT_PARTS = 500
#: Nodes up to which tables keyed by 1, 2, 3 pieces keep buckets small.
TABLE_STEPS = ((1 << 20, 1), (1 << 26, 2), (1 << 31, 3))
_CHUNK = 1 << 17
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the space-joined word shingles, repeats included."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    ends = ends.tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[shingle - 1:]) if len(words) >= shingle else ((0, len(line)),)
    return np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of the texts, as unsigned 64-bit integers."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for k, text in enumerate(texts):
        h = shingle_hashes(text, shingle)
        n = len(h)
        if not n:
            continue
        count = np.zeros(64, dtype=np.int64)
        for a in range(0, n, 1 << 14):
            bits = np.unpackbits(h[a:a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(df: DataFrame, text_col: str = "text", name: str = "_fp", shingle: int = SHINGLE,
                     keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and the fingerprint as a signed long."""
    keep = df.columns if keep is None else keep
    need = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])

    def run(batches):
        for batch in batches:
            for part in steps(batch, text_col, 16 << 20):
                fp = fingerprints(part.column(text_col).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fp)], names=[*keep, name])

    return need.mapInArrow(run, add_fields(df.select(*[F.col(f"`{c}`") for c in keep]).schema, [(name, LongType())]))


# ---------------------------------------------------------------------------
# comparison within buckets

def _planes(lanes: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64 fingerprints: [plane, row]."""
    place = np.arange(64, dtype=np.uint64)
    return np.stack([np.bitwise_or.reduce(((lanes >> np.uint64(k)) & _ONE) << place, axis=1) for k in range(64)])


def linked_pairs(fp: np.ndarray, start: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions in ``fp``) at most ``radius`` bits apart within each
    bucket. ``start``: where each bucket begins, ``side``: 0 or 1; a bucket
    with both sides compares side 0 with side 1 only (``fp`` is sorted by
    bucket and side)."""
    if radius > 6:
        raise ValueError("three-bit counters hold a radius of up to 6")
    n = len(fp)
    stop = np.append(start[1:], n)
    size = stop - start
    ones = np.add.reduceat(side, start) if n else size
    # lanes: the members to compare with; a two-sided bucket's are those of side 1
    lane_from = np.where(ones > 0, stop - ones, start)
    rows = -(-(stop - lane_from) // 64)
    row_at = np.concatenate(([0], np.cumsum(rows)))
    bucket_of_row = np.repeat(np.arange(len(start)), rows)
    first = lane_from[bucket_of_row] + 64 * (np.arange(row_at[-1]) - row_at[bucket_of_row])
    lane = first[:, None] + np.arange(64)
    there = lane < stop[bucket_of_row][:, None]
    lanes = fp[np.minimum(lane, n - 1)]
    planes = _planes(lanes)
    valid = np.bitwise_or.reduce(there.astype(np.uint64) << np.arange(64, dtype=np.uint64), axis=1)
    # entries: each asking fingerprint with each row of lanes that holds a later one
    bucket = np.repeat(np.arange(len(start)), size)
    asks = (side == 0) & (size[bucket] > 1)
    ask = np.flatnonzero(asks)
    b = bucket[ask]
    row0 = row_at[b] + np.where(ones[b] > 0, 0, (ask - start[b]) // 64)
    many = row_at[b + 1] - row0
    total = np.cumsum(many)
    at = 0
    while at < len(ask):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _CHUNK, side="right")))
        k = many[at:to]
        q = np.repeat(ask[at:to], k)
        r = np.repeat(row0[at:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        yield from _compare(fp, planes, valid, first, q, r, ones[bucket[q]] > 0, radius)
        at = to


def _compare(fp, planes, valid, first, q, r, two_sided, radius):
    own = fp[q]
    alive = valid[r]
    # lanes before and at the asking fingerprint itself don't count
    gap = np.clip(q - first[r] + 1, 0, 64)
    later = np.where(gap >= 64, np.uint64(0), _ALL << np.minimum(gap, 63).astype(np.uint64))
    alive = np.where(two_sided, alive, alive & later)
    c0, c1, c2 = (np.zeros(len(q), dtype=np.uint64) for _ in range(3))
    limit = radius + 1
    for plane in range(64):
        x = planes[plane][r] ^ (np.uint64(0) - ((own >> np.uint64(plane)) & _ONE))
        x &= alive
        t = c0 & x
        c0 ^= x
        u = c1 & t
        c1 ^= t
        c2 ^= u
        # the counters reach radius + 1 before they could overflow
        over = _ALL
        for bit, c in enumerate((c0, c1, c2)):
            over = over & (c if limit >> bit & 1 else ~c)
        alive &= ~over
        if plane % 4 == 3 and plane >= 11:
            keep = np.flatnonzero(alive)
            if len(keep) < len(q):
                q, r, own, alive, c0, c1, c2 = (a[keep] for a in (q, r, own, alive, c0, c1, c2))
            if not len(q):
                return
    hit = np.flatnonzero(alive)
    for a in range(0, len(hit), 1 << 14):
        h = hit[a:a + (1 << 14)]
        bits = np.unpackbits(alive[h].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        e, lane = np.nonzero(bits)
        yield q[h[e]], first[r[h[e]]] + lane


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i]; ``root`` points to smaller positions."""
    while len(a):
        a, b = root[a], root[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def bucket_forest(fp: np.ndarray, start: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each bucket."""
    root = np.arange(len(fp))
    for a, b in linked_pairs(fp, start, side, radius):
        _hook(root, a, b)
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child], fp[root[child]]


def _tables(n_nodes: int, radius: int) -> list[list[int]]:
    """Masks of the pigeonhole tables, as signed longs."""
    chosen = next((c for limit, c in TABLE_STEPS if n_nodes <= limit), 4)
    pieces = radius + chosen
    edges = [64 * k // pieces for k in range(pieces + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    sums = [sum(masks[i] for i in c) for c in combinations(range(pieces), chosen)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def links(nodes: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``nodes``
    (column ``fp``) within the radius of each other."""
    masks = _tables(nodes.count(), radius)
    rows = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)])).alias("k"))
    rows = rows.select("fp", "k.t", "k.key")
    hot = rows.groupBy("t", "key").count().where(F.col("count") > bucket_limit)
    parts = F.ceil(F.col("count") / bucket_limit).cast("int")
    rows = rows.join(hot.select("t", "key", parts.alias("parts")), ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = (rows.withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("fp", "t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                    (F.col("mine") > F.col("other")).cast("int").alias("side")))
    rows = rows.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "side", "fp")

    def run(batches):
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = pa.Table.from_batches([batch])
            got = got if rest is None else pa.concat_tables([rest, got])
            cut = _last_bucket(got)
            rest = got.slice(cut)
            if cut:
                yield from _forest_batches(got.slice(0, cut), radius)
        if rest is not None:
            yield from _forest_batches(rest, radius)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _bucket_starts(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for c in ("t", "key", "i", "j"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _last_bucket(t: pa.Table) -> int:
    """Row at which the last, perhaps unfinished, bucket begins."""
    return int(_bucket_starts(t)[-1])


def _forest_batches(t: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    fp = t.column("fp").to_numpy().view(np.uint64)
    a, b = bucket_forest(fp, _bucket_starts(t), t.column("side").to_numpy().astype(np.int64), radius)
    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


# ---------------------------------------------------------------------------
# connected components

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b)."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e)
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (e.join(low, "a").where("b > m").select("b", "m").toDF("a", "b")
             .unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        e = materialize(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _grouped(documents: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """(doc_id, fp, root, component_id) of each row; root names the group."""
    docs = with_fingerprint(documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                            "text", "fp", shingle, keep=["doc_id"])
    docs = materialize(docs)
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"), radius))
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root")).distinct()
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("node", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of = linked.join(lows, "root").select("node", "root", "component_id")
    named = nodes.join(of, nodes["fp"] == of["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("node").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    # fingerprints that hold over 1 / HOT_PARTS of the rows: fewer than HOT_PARTS, so
    # they are joined by broadcast, and no task gets all rows of one
    hot = [r.fp for r in nodes.where(F.col("n") * HOT_PARTS > docs.count()).select("fp").collect()]
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    out = docs.where(~is_hot).join(named.where(~is_hot), "fp")
    if hot:
        out = out.unionByName(docs.where(is_hot).join(F.broadcast(named.where(is_hot)), "fp"))
    return out.select("doc_id", "fp", "root", "component_id")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and
    ``component_id``, the smallest id reachable over links."""
    return _grouped(documents, id_col, text_col, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               radius: int = RADIUS) -> DataFrame:
    """One row of each group (all columns): that with the smallest id; if
    that id repeats in the group, the first of its rows by fingerprint and by
    a hash of the columns. A group whose ids are all NULL keeps one row."""
    group = materialize(_grouped(documents, id_col, text_col, shingle, radius))
    cols = [F.col(f"`{c}`") for c in documents.columns]
    key, fp, root, rank = (fresh(documents.columns, c) for c in ("_key", "_fp", "_root", "_rank"))
    first = group.where("doc_id <=> component_id")
    unique = group.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    if unique:
        first = first.select(F.col("doc_id").alias(key))
        return documents.join(first, F.col(f"`{id_col}`") == F.col(key), "left_semi")
    first = first.select(F.col("doc_id").alias(key), F.col("fp").alias(f"{key}f"), F.col("root").alias(root)).distinct()
    rows = with_fingerprint(documents, text_col, fp, shingle)
    rows = rows.join(first, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.col(fp) == F.col(f"{key}f")))
    order = Window.partitionBy(root).orderBy(fp, F.xxhash64(*cols))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*cols)
