"""Ranked lexical search by Block-Max MaxScore.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
With ``n`` terms in a document, ``N`` documents with a term and ``L`` terms in
all of them, a term of weight ``w = floor(1000 ln((2N+2) / (2df+1)))`` that
occurs ``tf`` times adds ``w * ((10^9 tf) div (1000 tf + 12 m))`` for each of its
occurrences in the query, where ``m = 75 + (25 n N) div L``.

1. Index: one map over the documents. Each task cuts its rows into shards of
   ``SHARD_BYTES`` of text; a shard is one row with the postings of the queries'
   terms, cut into blocks of ``BLOCK`` document places: gaps and frequencies in
   one byte where a block allows it, and per block the largest frequency and
   the smallest document length. The table is stored, so it is built once.
2. ``N``, ``L`` and the document frequencies are sums over the shards.
3. Search: a task keeps one heap of ``k`` documents per query for all of its
   shards. A list's global bound is the largest of its block bounds. Sorted by
   bound, the lists whose bounds together stay under the heap's lowest score
   are not essential: they can't bring a document in alone. A block whose
   lists' block maxima together stay under it is passed over; otherwise the
   essential lists are summed, and the others are unpacked, largest bound first,
   only while a document's sum with the remaining block maxima reaches it.
4. The tasks' heaps are merged, in two steps.

Queries are taken in blocks of ``QUERY_BYTES`` of text, each of which is one
index and one search (a stated query set against all documents).

Edge cases: NULL, empty and blank texts have no terms: such documents are
neither counted nor found, and such queries find nothing. Equal scores are
ranked by ascending id, NULL last, repeated rows next to each other; queries
that repeat give their rows again. Scores of 0 are left out. Empty tables give
an empty result; other columns, whatever their names, are passed by.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from softgrove.llm.common import LOWER_BYTES
from softgrove.operators._util import qcol
from softgrove.session import materialize

K = 20
#: Text bytes of a shard.
SHARD_BYTES = 16 << 20
#: Document places of a posting block.
BLOCK = 2048
#: Text bytes of the queries that are searched at a time.
QUERY_BYTES = 8 << 20
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Arrays of a shard. Lists are in order of their terms, blocks in that of
#: their list and place.
ARRAYS = {"n": np.int64, "term": np.int32, "first": np.int32, "block": np.int32, "count": np.int32, "max_tf": np.int32, "min_n": np.int64,
          "gap_wide": np.bool_, "gap_at": np.int64, "tf_wide": np.bool_, "tf_at": np.int64,
          "gap_small": np.uint8, "gap_large": np.uint16, "tf_small": np.uint8, "tf_large": np.uint32}
INDEX_SCHEMA = "n_docs long, n_terms long, ids array<long>, " + ", ".join(f"`{a}` binary" for a in ARRAYS)


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().translate(LOWER_BYTES))


# ---------------------------------------------------------------------------
# index

def _packed(values: np.ndarray, wide: np.ndarray, size: np.ndarray, large) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of narrow and of wide blocks, and where each block begins."""
    of = np.repeat(wide, size)
    at = np.where(wide, np.cumsum(np.where(wide, size, 0)), np.cumsum(np.where(wide, 0, size))) - size
    return values[~of].astype(np.uint8), values[of].astype(large), at


def build_shard(n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, block: int = BLOCK) -> dict[str, np.ndarray]:
    """The shard's arrays from its postings (doc: places in the shard)."""
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    place = doc // block
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(doc)))
    gap = doc - place * block
    gap[1:] = np.where(new[1:], gap[1:], doc[1:] - doc[:-1])
    some = len(start) > 0
    max_tf = np.maximum.reduceat(tf, start) if some else size
    wide_gap = (np.maximum.reduceat(gap, start) if some else size) > 255
    wide_tf = max_tf > 255
    gap_small, gap_large, gap_at = _packed(gap, wide_gap, size, np.uint16)
    tf_small, tf_large, tf_at = _packed(tf, wide_tf, size, np.uint32)
    list_new = np.ones(len(start), dtype=bool)
    list_new[1:] = term[start][1:] != term[start][:-1]
    out = {"n": n, "term": term[start][list_new], "first": np.append(np.flatnonzero(list_new), len(start)), "block": place[start], "count": size,
           "max_tf": max_tf, "min_n": np.minimum.reduceat(n[doc], start) if some else size, "gap_wide": wide_gap, "gap_at": gap_at,
           "tf_wide": wide_tf, "tf_at": tf_at, "gap_small": gap_small, "gap_large": gap_large, "tf_small": tf_small, "tf_large": tf_large}
    return {k: v.astype(ARRAYS[k]) for k, v in out.items()}


def index_documents(docs: DataFrame, vocabulary: dict[bytes, int], shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per shard of ``docs`` (doc_id, text) with the postings of the
    terms in ``vocabulary`` (term to number)."""
    if block > 1 << 16:
        raise ValueError("gaps within a block are held in two bytes at most")
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def shard(ids: list, size: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        many = [len(t) for t, _ in found]
        doc = np.repeat(np.arange(len(ids)), many)
        n = np.array(size, dtype=np.int64)
        term, tf = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        arrays = build_shard(n, doc, term, tf, block)
        values = [[len(ids)], [int(n.sum())], [ids], *([a.tobytes()] for a in arrays.values())]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * len(arrays)]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["n_docs", "n_terms", "ids", *arrays])

    def run(batches):
        number = known.value
        ids, size, found, held = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = terms_of(text.as_py())
                if not words:
                    continue
                count = Counter(words)
                asked = count.keys() & number.keys()
                ids.append(i)
                size.append(len(words))
                found.append((np.fromiter((number[w] for w in asked), np.int64, len(asked)), np.fromiter((count[w] for w in asked), np.int64, len(asked))))
                held += sum(map(len, words)) + len(words)
                if held >= shard_bytes:
                    yield shard(ids, size, found)
                    ids, size, found, held = [], [], [], 0
        if ids:
            yield shard(ids, size, found)

    return docs.mapInArrow(run, INDEX_SCHEMA)


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                first, count = (np.frombuffer(batch.column(c)[k].as_py(), dtype=ARRAYS[c]) for c in ("first", "count"))
                total = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column("term")[k].as_py(), dtype=np.int32)),
                                                  pa.array(total[first[1:]] - total[first[:-1]])], names=["term", "df"])

    return index.select("term", "first", "count").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


# ---------------------------------------------------------------------------
# search

class Shard:
    """A shard's arrays, with what its documents' lengths come to."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        for name, kind in ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], dtype=kind))
        self.m = 75 + (25 * self.n * n_docs) // n_terms
        least = 75 + (25 * self.min_n * n_docs) // n_terms
        self.bound = saturation(self.max_tf.astype(np.int64), least)
        self.unpacked = 0

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Positions of the terms' lists, -1 where there is none."""
        at = np.searchsorted(self.term, terms)
        there = (at < len(self.term)) & (self.term[np.minimum(at, len(self.term) - 1)] == terms) if len(self.term) else np.zeros(len(terms), bool)
        return np.where(there, at, -1)

    def unpack(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places within block ``k`` and the frequencies there."""
        self.unpacked += 1
        size, g, t = self.count[k], self.gap_at[k], self.tf_at[k]
        gap = (self.gap_large if self.gap_wide[k] else self.gap_small)[g:g + size]
        tf = (self.tf_large if self.tf_wide[k] else self.tf_small)[t:t + size]
        return np.cumsum(gap, dtype=np.int64), tf.astype(np.int64)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Heap:
    """The best documents of one query so far, best first."""
    score: np.ndarray
    doc: np.ndarray
    null: np.ndarray
    k: int

    @classmethod
    def empty(cls, k: int) -> Heap:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), k)

    @property
    def lowest(self) -> int:
        """Score that a further document needs at least."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        best = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[best], doc[best], null[best]


def search_shard(shard: Shard, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, weight: np.ndarray, heap: Heap, block: int = BLOCK) -> None:
    """Puts the shard's best documents into the heap. ``weight``: of the
    query's distinct terms, times their occurrences in it."""
    own = shard.lists(terms)
    there = (own >= 0) & (weight > 0)
    own, weight = own[there], weight[there]
    if not len(own):
        return
    n_blocks = -(-len(shard.n) // block)
    maxima = np.zeros((len(own), n_blocks), dtype=np.int64)
    where = np.zeros((len(own), n_blocks), dtype=np.int64) - 1
    for i, (k, w) in enumerate(zip(own, weight)):
        a, b = shard.first[k], shard.first[k + 1]
        maxima[i, shard.block[a:b]] = w * shard.bound[a:b]
        where[i, shard.block[a:b]] = np.arange(a, b)
    order = np.argsort(maxima.max(axis=1), kind="stable")
    maxima, where, weight = maxima[order], where[order], weight[order]
    below = np.cumsum(maxima.max(axis=1))
    total = maxima.sum(axis=0)
    for b in np.argsort(-total, kind="stable"):
        need = heap.lowest
        if total[b] < need:
            return
        essential = int(np.searchsorted(below, need))
        m = shard.m[b * block:(b + 1) * block]
        got = np.zeros(len(m), dtype=np.int64)
        for i in range(essential, len(where)):
            if where[i, b] >= 0:
                place, tf = shard.unpack(where[i, b])
                got[place] += weight[i] * saturation(tf, m[place])
        rest = int(maxima[:essential, b].sum())
        doc = np.flatnonzero((got > 0) & (got + rest >= need))
        for i in range(essential - 1, -1, -1):
            if not len(doc):
                break
            if where[i, b] < 0:
                continue
            place, tf = shard.unpack(where[i, b])
            at = np.minimum(np.searchsorted(place, doc), len(place) - 1)
            hit = place[at] == doc
            got[doc[hit]] += weight[i] * saturation(tf[at[hit]], m[doc[hit]])
            rest -= int(maxima[i, b])
            doc = doc[got[doc] + rest >= need]
        if len(doc):
            heap.add(got[doc], ids[b * block + doc], null[b * block + doc])


def search_index(index: DataFrame, queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int = K,
                 block: int = BLOCK) -> DataFrame:
    """(query, doc_id, score): the best documents of each query (term number
    to occurrences), by position in ``queries``."""
    asked = [(np.array(sorted(q), dtype=np.int32), np.array([weights[t] * q[t] for t in sorted(q)], dtype=np.int64)) for q in queries]
    asked = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        heaps = [Heap.empty(k) for _ in asked.value]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ARRAYS}
                shard, held = Shard(row, n_docs, n_terms), batch.column("ids")[r].values
                null = np.asarray(held.is_null())
                ids = held.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
                for (terms, weight), heap in zip(asked.value, heaps):
                    search_shard(shard, ids, null, terms, weight, heap, block)
        score, doc, null = (np.concatenate([getattr(h, c) for h in heaps]) if heaps else np.zeros(0, np.int64) for c in ("score", "doc", "null"))
        query = np.repeat(np.arange(len(heaps)), [len(h.score) for h in heaps])
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["query", "doc_id", "score"])

    found = index.mapInArrow(run, "query long, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    slot = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    for keys in (["query", slot], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return found


def _query_blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The items (id, text) in blocks of ``size`` bytes of text."""
    block, held = [], 0
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1] or "")
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(documents: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", shard_bytes: int = SHARD_BYTES, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    spark = documents.sparkSession
    docs = documents.select(qcol(id_col).cast(LongType()).alias("doc_id"), qcol(text_col).alias("text"))
    kind = items.schema[item_col].dataType
    out = None
    for rows in _query_blocks(items.select(qcol(item_col), qcol(item_text_col)), query_bytes):
        counts = [Counter(terms_of(t)) for _, t in rows]
        number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        index = materialize(index_documents(docs, number, shard_bytes, block))
        n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        # as many rows as the block's queries have terms at most
        df = {r.term: r.df for r in document_frequencies(index).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(number))], dtype=np.int64)
        found = search_index(index, [{number[t]: c for t, c in q.items()} for q in counts], weights, n_docs, n_terms, k, block)
        named = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"query long, item_id {kind.simpleString()}")
        found = materialize(found.join(F.broadcast(named), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out
