"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is the set of its distinct word shingles (64-bit hashes); two
documents are linked if ``100 * intersection >= percent * union``.

1. Equal sets are one node, named by a 128-bit digest of the sorted set, so a
   text that a third of all rows share is one row from here on. A node has
   ``COORDINATES`` min-hashes; a token is a coordinate with its value.
2. Postings: nodes under each of their tokens. Tokens that one node alone
   holds only shorten its prefix. Of the others each node keeps those of its
   prefix: in order of (list length, token) the first
   ``COORDINATES - MATCHES + 1`` of its tokens. Two nodes that agree on
   ``MATCHES`` coordinates or more share a token of both prefixes, so the
   longest lists (common passages) are skipped and no such pair is lost.
3. Within a prefix list collisions are counted over all coordinates (one byte
   of each: a pair may pass wrongly, never fail wrongly), and pairs with
   ``MATCHES`` or more are candidates. A list gives the edges of a spanning
   forest of its candidates: members that are connected already are skipped, so
   a list of near copies takes one pass. Long lists are dealt out as pairs of
   parts.
4. Clusters are the components of these edges: every candidate pair lies
   within one. Full sets, hashed again from the texts, are sent to their
   cluster once (a large cluster is dealt out as pairs of parts), and sizes of
   intersections counted over the part's own postings of shingles. Links with
   enough of them are confirmed; again the edges of a spanning forest go on.
5. Connected components by star rounds (shared with the SimHash operator).

A pair with similarity of exactly ``percent`` = 80 agrees on fewer than 34 of
64 coordinates with a chance of 3 in 10 million, more similar ones with less.

Edge cases: NULL or empty text, or one without words, has the empty set and
is linked with nothing; fewer words than a shingle are one shingle. Rows with
a NULL id take part in links; a component's id is its smallest id that is not
NULL (NULL if it has none), and ``kept`` compares null-safely. Repeated rows
give repeated rows; an empty table an empty result; other columns, whatever
their names, are passed by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from softgrove.llm.common import steps
from softgrove.llm.simhash import components, shingle_hashes
from softgrove.operators._util import qcol
from softgrove.session import materialize

SHINGLE = 4
PERCENT = 80
COORDINATES = 64
MATCHES = 34
#: Members of a list (or part of one) that are compared in one task.
LIST_LIMIT = 4096
#: Members, and shingles of all of them, of a cluster (or part of one) in one task.
CLUSTER_LIMIT = 4096
CLUSTER_SHINGLES = 2_000_000
#: A set with more than this part of all rows is joined by broadcast.
HOT_PARTS = 500
#: Candidate nodes up to which their texts are picked by a broadcast join.
BROADCAST_NODES = 1_000_000
_STEP = 1 << 16
_LOW6 = np.uint64(COORDINATES - 1)
#: An odd factor for each coordinate.
_FACTORS = np.random.default_rng(13).integers(1 << 62, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def set_key(hashes: np.ndarray) -> bytes:
    """Name of a set: 16 bytes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Tokens of the (not empty) sets, [set, coordinate]: the smallest hash
    under the coordinate's factor, with the coordinate in the last six bits."""
    out = np.zeros((len(sets), COORDINATES), dtype=np.uint64)
    if not sets:
        return out
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    at = 0
    while at < len(sets):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + _STEP, side="right")))
        h = np.concatenate(sets[at:to])
        starts = ends[at:to] - size[at:to] - base
        for k in range(COORDINATES):
            out[at:to, k] = np.minimum.reduceat(h * _FACTORS[k], starts)
        at = to
    return (out & ~_LOW6) | np.arange(COORDINATES, dtype=np.uint64)


def with_signature(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n, key, tokens, mini) of rows (doc_id, text); ``mini`` is a byte
    of each coordinate. Of empty sets key, tokens and mini are NULL."""
    schema = StructType([df.schema["doc_id"], StructField("n", LongType()), StructField("key", BinaryType()),
                         StructField("tokens", ArrayType(LongType())), StructField("mini", BinaryType())])

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                sets = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                some = [k for k, s in enumerate(sets) if len(s)]
                sig = signatures([sets[k] for k in some])
                mini = ((sig >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
                keys, minis = [None] * len(sets), [None] * len(sets)
                ends = np.zeros(len(sets), dtype=np.int64)
                for i, k in enumerate(some):
                    keys[k], minis[k], ends[k] = set_key(sets[k]), mini[i].tobytes(), COORDINATES
                offsets = np.concatenate(([0], np.cumsum(ends))).astype(np.int32)
                empty = pa.array(np.append(ends == 0, False))
                tokens = pa.ListArray.from_arrays(pa.array(offsets, mask=empty.to_numpy(zero_copy_only=False)), pa.array(sig.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                                                  tokens, pa.array(minis, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def _nodes(docs: DataFrame) -> DataFrame:
    """One row per distinct set: node (a number), key, low (smallest id),
    count, n, tokens, mini."""
    found = docs.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("count"), F.first("n").alias("n"),
                                                   F.first("tokens").alias("tokens"), F.first("mini").alias("mini"))
    # numbers are given to the stored rows, so that they stay the same when a
    # part is computed again
    return materialize(found).withColumn("node", F.monotonically_increasing_id())


def prefix_postings(nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(token, node, n, mini) of the tokens in the nodes' prefixes that at
    least two nodes hold."""
    posted = nodes.select("node", F.explode("tokens").alias("token"))
    lengths = posted.groupBy("token").agg(F.count("*").alias("len")).where("len > 1")
    shared = posted.join(lengths, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("len", "token"))).alias("own"))
    # tokens of one node come first in the order: they take their places
    places = F.size("own") - (matches - 1)
    prefix = shared.where(places > 0).select("node", F.explode(F.slice("own", F.lit(1), places)).alias("own"))
    return prefix.select("node", F.col("own.token").alias("token")).join(nodes.select("node", "n", "mini"), "node")


def _bytes(col: pa.Array) -> np.ndarray:
    """A binary column of COORDINATES bytes each as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def _dealt(rows: DataFrame, keys: list[str], parts) -> DataFrame:
    """Rows of each key as pairs of parts (i, j, side): side 0 and 1 of a
    pair of different parts are to be compared with each other only."""
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = (rows.withColumn("parts", parts.cast("int")).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": (F.col("mine") > F.col("other")).cast("int")}))
    return rows.drop("parts", "mine", "other").repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "side", "node")


def _by_key(keys: list[str], edges):
    """Runs ``edges(table)`` on the rows of each key of sorted partitions and
    gives the edges (a, b) of a partition once."""
    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for c in keys:
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        rest: list[pa.RecordBatch] = []
        found, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = starts(pa.Table.from_batches([batch]))
            joined = rest and all(rest[0].column(c)[0] == batch.column(c)[0] for c in keys)
            cuts = [*([] if joined or not rest else [0]), *begin[1:].tolist()]
            at = 0
            for cut in cuts:
                done = pa.Table.from_batches([*rest, batch.slice(at, cut - at)])
                rest, at = [], cut
                found.append(edges(done))
                held += len(found[-1])
            rest.append(batch.slice(at))
            if held > 1 << 18:
                yield out(found)
                found, held = [], 0
        if rest:
            found.append(edges(pa.Table.from_batches(rest)))
        if found:
            yield out(found)

    return run


def _forest(node: np.ndarray, side: np.ndarray, linked) -> np.ndarray:
    """Edges of a spanning forest. ``linked(k, rest)`` says which of the
    positions ``rest`` are linked with ``k``; it isn't asked for those that are
    connected with it already."""
    n = len(node)
    two = int(np.searchsorted(side, 1))
    root = np.arange(n)
    for k in range(two if two < n else n - 1):
        rest = np.arange(two if two < n else k + 1, n)
        rest = rest[root[rest] != root[k]]
        if not len(rest):
            continue
        hit = rest[linked(k, rest)]
        if len(hit):
            trees = np.append(root[hit], root[k])
            root[np.isin(root, trees)] = trees.min()
    child = np.flatnonzero(root != np.arange(n))
    pairs = np.stack([node[root[child]], node[child]], axis=1)
    return np.sort(pairs, axis=1)


def candidates(postings: DataFrame, matches: int = MATCHES, percent: int = PERCENT, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all nodes which collide in ``matches``
    coordinates and have sizes near enough."""
    sizes = postings.groupBy("token").agg(F.count("*").alias("len")).where("len > 1")
    rows = _dealt(postings.join(sizes, "token"), ["token"], F.ceil(F.col("len") / list_limit))

    def edges(t: pa.Table) -> np.ndarray:
        n, side = (t.column(c).to_numpy() for c in ("n", "side"))
        mini = _bytes(t.column("mini").combine_chunks())
        half = COORDINATES // 2

        def collide(k: int, rest: np.ndarray) -> np.ndarray:
            near = 100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k])
            # skip ahead: half of the coordinates, with what the others could add
            got = (mini[rest, :half] == mini[k, :half]).sum(axis=1)
            open_ = np.flatnonzero(near & (got >= matches - half))
            got = got[open_] + (mini[rest[open_], half:] == mini[k, half:]).sum(axis=1)
            return open_[got >= matches]
        return _forest(t.column("node").to_numpy(), side, collide)

    return rows.select("token", "i", "j", "side", "node", "n", "mini").mapInArrow(_by_key(["token", "i", "j"], edges), "a long, b long").distinct()


def _sets_of(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the wanted nodes (node, key, low), from the texts of
    the documents that have their smallest ids."""
    count = wanted.count()  # of a stored table
    named = wanted.withColumnRenamed("low", "id")
    rows = texts.join(F.broadcast(named) if count <= BROADCAST_NODES else named, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "key", "text")

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                node, sets = [], []
                for i, key, text in zip(*(part.column(c).to_pylist() for c in ("node", "key", "text"))):
                    h = shingle_set(text, shingle)
                    if set_key(h) == key:
                        node.append(i)
                        sets.append(h.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    # rows with one id and one set repeat
    return rows.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def similar(hashes: list[np.ndarray], percent: int = PERCENT):
    """For a list of sets: ``linked(k, rest)`` as ``_forest`` asks it, by counts
    over the sets' own postings."""
    size = np.array([len(h) for h in hashes])
    owner = np.repeat(np.arange(len(hashes)), size)
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    owner, sorted_ = owner[order], flat[order]

    def linked(k: int, rest: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(sorted_, hashes[k], side="left"), np.searchsorted(sorted_, hashes[k], side="right")
        many = b - a
        at = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(hashes))[rest]
        return np.flatnonzero(100 * both >= percent * (size[rest] + size[k] - both))
    return linked


def links(clusters: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
          cluster_limit: int = CLUSTER_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all nodes of a cluster (node, root) whose
    full sets are similar enough."""
    members = materialize(clusters.join(nodes.select("node", "key", "low", "n"), "node"))
    sizes = members.groupBy("root").agg(F.count("*").alias("len"), F.sum("n").alias("shingles"))
    sets = materialize(_sets_of(texts, members.select("node", "key", "low"), shingle))
    rows = members.select("node", "root").join(sizes, "root").join(sets, "node")
    rows = _dealt(rows, ["root"], F.greatest(F.ceil(F.col("len") / cluster_limit), F.ceil(F.col("shingles") / CLUSTER_SHINGLES)))

    def edges(t: pa.Table) -> np.ndarray:
        hashes = [np.frombuffer(h, dtype=np.uint64) for h in t.column("hashes").to_pylist()]
        return _forest(t.column("node").to_numpy(), t.column("side").to_numpy(), similar(hashes, percent))

    return rows.select("root", "i", "j", "side", "node", "hashes").mapInArrow(_by_key(["root", "i", "j"], edges), "a long, b long")


def _rooted(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that ``edges`` (a, b) touch."""
    found = components(edges)
    return materialize(found.unionAll(found.select(F.col("root").alias("node"), "root")).distinct())


def link_components(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES,
                    list_limit: int = LIST_LIMIT, cluster_limit: int = CLUSTER_LIMIT) -> DataFrame:
    """(node, root) of the nodes that are linked with another one; texts:
    (doc_id, text)."""
    clusters = _rooted(candidates(materialize(prefix_postings(nodes, matches)), matches, percent, list_limit))
    return _rooted(links(clusters, nodes, texts, shingle, percent, cluster_limit))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    matches: int = MATCHES, list_limit: int = LIST_LIMIT, cluster_limit: int = CLUSTER_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id
    reachable over links) and kept (doc_id equals component_id)."""
    texts = documents.select(qcol(id_col).alias("doc_id"), qcol(text_col).alias("text"))
    docs = materialize(with_signature(texts, shingle))
    nodes = _nodes(docs)
    comp = link_components(nodes, texts, shingle, percent, matches, list_limit, cluster_limit)
    linked = nodes.select("node", "low").join(comp, "node")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of = linked.join(lows, "root").select("node", "component_id")
    named = (nodes.select("node", "key", "low", "count").join(of.withColumn("in", F.lit(True)), "node", "left")
             .select("key", "count", F.when(F.col("in"), F.col("component_id")).otherwise(F.col("low")).alias("component_id")))
    named = materialize(named)
    # sets that hold over 1 / HOT_PARTS of the rows: fewer than HOT_PARTS, so they
    # are joined by broadcast, and no task gets all rows of one
    hot = named.where(F.col("count") * HOT_PARTS > docs.count()).select("key", "component_id")
    docs = docs.select("doc_id", F.col("n").alias("n_shingles"), "key")
    keys = [r.key for r in hot.collect()]
    is_hot = F.col("key").isin([F.lit(bytes(k)) for k in keys]) if keys else F.lit(False)
    rest = docs.where(F.col("key").isNotNull() & ~is_hot).join(named.where(~is_hot).drop("count"), "key")
    parts = [rest, docs.where(F.col("key").isNull()).withColumn("component_id", F.col("doc_id"))]
    if keys:
        parts.append(docs.where(is_hot).join(F.broadcast(hot), "key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
