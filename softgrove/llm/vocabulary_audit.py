"""Divergence of sources by term, over minimal acyclic transducers.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. Each
language keeps the ``V`` terms that at least ``LEAST_DOCS`` of its documents hold. A
(language, source) group or a language gives a kept term with ``count``
occurrences ``p = 1 + (10^9 (count + 2)) div (N + 2V)``, ``N`` the sum of its
counts; two of these diverge in a term by ``((p - q)^2) div (p + q)``. Part
``pair`` has for each group the sums against every other source of the language,
part ``term`` the group's ``TOP`` terms that it uses more than the language.

1. Document counts: one map over the texts adds up its terms by language
   before the shuffle.
2. Vocabulary: the kept terms are sorted by range (no language meets in one
   task) and numbered: a term's ordinal is its place among its language's.
3. Transducers: of each language's ``SHARD_TERMS`` consecutive terms a task
   builds the minimal acyclic automaton from the sorted terms (equal states
   are merged as soon as no later term can change them). An arc's output is
   the number of terms before it, so the outputs along a term's path add up to
   its ordinal. States are packed into one array, displaced by their arcs.
4. Recount: the transducers are broadcast in groups of ``BROADCAST_BYTES`` and
   the texts streamed through: all words of a step follow their arcs at
   once. A task adds up (group, ordinal) and sends a row per group and block
   of ordinals.
5. Blocks: a task has all groups of a block of a language's ordinals, with as
   many ordinals as keep it under ``BLOCK_CELLS`` counts, and gives partial
   sums for pairs and its first ``TOP`` terms. Equal values are ranked by
   ordinal, which is their UTF-8 order; the terms themselves are looked up
   for the ranked rows only.

All arithmetic is on integers (64 bits, Python's where counts need more).

Edge cases: NULL text, language and source are the empty text. Groups without
kept terms have counts of 0; of a language without kept terms all pairs have
value 0. Repeated rows count again. An empty table gives an empty result; other
columns, whatever their names, are passed by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from softgrove.llm.common import LOWER_BYTES, LOWER_TABLE, steps, text_bytes
from softgrove.operators._util import qcol
from softgrove.session import materialize

LEAST_DOCS = 10
TOP = 10
#: Terms of one transducer.
SHARD_TERMS = 250_000
#: Bytes of transducers that are broadcast at a time.
BROADCAST_BYTES = 64 << 20
#: Counts (groups times ordinals) of a block that one task holds.
BLOCK_CELLS = 1 << 18
#: Entries that a task adds up before it sends them on.
HELD_ENTRIES = 2_000_000
SCALE = 1_000_000_000
TERM = re.compile(rb"[a-z\x80-\xff]+")
_IN_TERM = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().translate(LOWER_BYTES))


# ---------------------------------------------------------------------------
# transducer

class Transducer:
    """Minimal acyclic automaton of sorted distinct terms that gives each its
    ordinal. Arc ``byte`` of state ``s`` lies at ``place[s] + byte``, if that slot
    is owned by ``s``; it leads to ``target`` and adds ``out``."""

    ARRAYS = {"place": np.int32, "final": np.bool_, "owner": np.int32, "target": np.int32, "out": np.int32}

    def __init__(self, arrays: dict[str, np.ndarray], root: int, n_terms: int):
        self.__dict__.update(arrays)
        self.root, self.n_terms = root, n_terms

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        known: dict[tuple, int] = {}
        arcs_of: list[tuple] = []
        final: list[bool] = []
        count: list[int] = []

        def state(is_final: bool, arcs: tuple) -> int:
            """Number of the state with these arcs, an old one if there is one."""
            s = known.setdefault((is_final, arcs), len(arcs_of))
            if s == len(arcs_of):
                arcs_of.append(arcs)
                final.append(is_final)
                count.append(is_final + sum(count[t] for _, t in arcs))
            return s

        # the open path: final flag and closed arcs of each state on it
        path: list[list] = [[False, []]]
        last, n = b"", 0
        for term in terms:
            same = next((k for k, (x, y) in enumerate(zip(last, term)) if x != y), min(len(last), len(term)))
            if n and (same == len(term) or last[same:same + 1] > term[same:same + 1]):
                raise ValueError("terms are not sorted and distinct")
            while len(path) > same + 1:
                is_final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], state(is_final, tuple(arcs))))
            path += [[False, []] for _ in term[same:]]
            path[-1][0] = True
            last, n = term, n + 1
        while len(path) > 1:
            is_final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], state(is_final, tuple(arcs))))
        root = state(path[0][0], tuple(path[0][1]))
        return cls(cls._pack(arcs_of, final, count), root, n)

    @staticmethod
    def _pack(arcs_of: list[tuple], final: list[bool], count: list[int]) -> dict[str, np.ndarray]:
        used = bytearray(2048 + 2 * sum(map(len, arcs_of)))
        place = [0] * len(arcs_of)
        # slots below 256 stay empty, so that no place is negative
        slots, front, single = [], 256, False
        # states with many arcs first; single arcs fill what is left
        for s in sorted(range(len(arcs_of)), key=lambda s: -len(arcs_of[s])):
            own = [b - arcs_of[s][0][0] for b, _ in arcs_of[s]]
            if not own:
                continue
            if len(own) == 1 and not single:
                single, front = True, 256
            at, tries = used.find(0, front), 1
            while any(used[at + b] for b in own):
                at, tries = used.find(0, at + 1), tries + 1
            if single or tries > 64:
                front = at  # what lies before is too dense
            if at + 1024 > len(used):
                used.extend(bytes(len(used)))
            place[s] = at - arcs_of[s][0][0]
            seen = int(final[s])
            for b, t in arcs_of[s]:
                used[place[s] + b] = 1
                slots.append((place[s] + b, s, t, seen))
                seen += count[t]
        size = max((k for k, *_ in slots), default=0) + 257
        owner, target, out = (np.full(size, -1, dtype=np.int32) for _ in range(3))
        if slots:
            k, s, t, o = np.array(slots, dtype=np.int64).T
            owner[k], target[k], out[k] = s, t, o
        return {"place": np.array(place, dtype=np.int32), "final": np.array(final, dtype=np.bool_), "owner": owner, "target": target, "out": out}

    def nbytes(self) -> int:
        return sum(getattr(self, a).nbytes for a in self.ARRAYS)

    def ordinals(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Ordinals of the words ``data[start:start + length]``, -1 of those that
        it doesn't hold. All words take a step at a time."""
        found = np.full(len(start), -1, dtype=np.int64)
        word = np.arange(len(start))
        state = np.full(len(start), self.root, dtype=np.int64)
        total = np.zeros(len(start), dtype=np.int64)
        k = 0
        while len(word):
            slot = self.place[state] + data[start[word] + k].astype(np.int64)
            on = self.owner[slot] == state
            word, slot, total = word[on], slot[on], total[on]
            state = self.target[slot].astype(np.int64)
            total = total + self.out[slot]
            k += 1
            ends = length[word] == k
            here = ends & self.final[state]
            found[word[here]] = total[here]
            word, state, total = word[~ends], state[~ends], total[~ends]
        return found


# ---------------------------------------------------------------------------
# document counts, vocabulary

def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of the language that hold the term."""
    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, count in held.items():
            terms, n = list(count), list(count.values())
            for a in range(0, len(terms), 1 << 16):
                part = pa.array(terms[a:a + (1 << 16)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(n[a:a + (1 << 16)], pa.int64())], names=["lang", "term", "n"])

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
                    held.setdefault(lang, Counter()).update(set(terms_of(text.as_py())))
                if sum(map(len, held.values())) > HELD_ENTRIES:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, ordinal): the kept terms, numbered from 0 in UTF-8 order."""
    kept = document_counts(docs).where(F.col("n") >= least).select("lang", "term")
    stored = materialize(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term"))
    rows = stored.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    # a few rows: each part's languages
    first = rows.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("lang", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return materialize(rows.join(first, ["lang", "part"]).select("lang", "term", (F.col("at") - F.col("first") + F.col("before")).alias("ordinal")))


def transducers(vocab: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, shard, n_terms, root, nbytes and the arrays) of each language's
    consecutive terms."""
    rows = vocab.withColumn("shard", F.floor(F.col("ordinal") / shard_terms)).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "ordinal")
    schema = "lang string, shard long, n_terms long, root long, nbytes long, " + ", ".join(f"{a} binary" for a in Transducer.ARRAYS)

    def row(key: tuple, terms: list[str]) -> pa.RecordBatch:
        t = Transducer.build(x.encode() for x in terms)
        values = [key[0], key[1], t.n_terms, t.root, t.nbytes(), *(getattr(t, a).tobytes() for a in Transducer.ARRAYS)]
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.binary()] * len(Transducer.ARRAYS)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["lang", "shard", "n_terms", "root", "nbytes", *Transducer.ARRAYS])

    def run(batches):
        key, terms = None, []
        for batch in batches:
            for lang, shard, term in zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "term"))):
                if (lang, shard) != key:
                    if terms:
                        yield row(key, terms)
                    key, terms = (lang, shard), []
                terms.append(term)
        if terms:
            yield row(key, terms)

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# recount

def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, with a blank after each, the words'
    starts and lengths in them, and each word's row."""
    data, offset = text_bytes(part.column("text"))
    n = part.num_rows
    out = np.full(len(data) + n, 32, dtype=np.uint8)
    size = np.diff(offset)
    out[np.arange(len(data)) + np.repeat(np.arange(n), size)] = LOWER_TABLE[data]
    inside = np.zeros(len(out) + 1, dtype=np.int8)
    inside[1:] = _IN_TERM[out]
    edge = np.diff(inside, append=np.int8(0))
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return out, start, end - start, np.searchsorted(offset[1:] + np.arange(1, n + 1), start, side="right")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(count, new) if len(new) else count


def recount(docs: DataFrame, shards: list[tuple[str, int, Transducer]], width: int) -> DataFrame:
    """(lang, source, block, at, n): occurrences of the shards' terms, as arrays
    of ordinals and counts; shards are (lang, first ordinal, transducer)."""
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    langs = sorted({lang for lang, _, _ in shards})
    bits = 40

    def rows(groups: list[tuple], key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        group, ordinal = key >> bits, key & ((1 << bits) - 1)
        block = ordinal // width
        start = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (group[1:] != group[:-1])))
        out = [(*groups[int(group[a])], int(block[a]), ordinal[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(start, np.append(start[1:], len(key)))]
        for a in range(0, len(out), 256):
            cols = list(zip(*out[a:a + 256]))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "source", "block", "at", "n"])

    def run(batches):
        code: dict[tuple, int] = {}
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in steps(batch, "text"):
                data, start, length, row = _words(part)
                lang = part.column("lang").to_pylist()
                group = np.array([code.setdefault(g, len(code)) for g in zip(lang, part.column("source").to_pylist())], dtype=np.int64)
                here = np.array(lang, dtype=object)
                for own, first, transducer in sent.value:
                    of = np.flatnonzero((here == own)[row])
                    if not len(of):
                        continue
                    found = transducer.ordinals(data, start[of], length[of])
                    hit = found >= 0
                    key, count = np.unique((group[row[of[hit]]] << bits) + first + found[hit], return_counts=True)
                    keys.append(key)
                    counts.append(count)
                    held += len(key)
                if held > HELD_ENTRIES:
                    key, count = _summed(keys, counts)
                    keys, counts, held = [key], [count], len(key)
                    if held > HELD_ENTRIES // 2:
                        yield from rows(list(code), key, count)
                        keys, counts, held = [], [], 0
        if held:
            yield from rows(list(code), *_summed(keys, counts))

    return docs.where(F.col("lang").isin(langs)).select("lang", "source", "text").mapInArrow(run, "lang string, source string, block long, at binary, n binary")


def _merged(rows: DataFrame) -> DataFrame:
    """One row per (lang, source, block), with what all tasks counted."""
    rows = rows.repartition("lang", "source", "block").sortWithinPartitions("lang", "source", "block")

    def row(key, keys, counts) -> pa.RecordBatch:
        at, n = _summed(keys, counts)
        values = [*key, at.tobytes(), n.tobytes(), int(n.sum())]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["lang", "source", "block", "at", "n", "total"])

    def run(batches):
        last, keys, counts, held = None, [], [], 0
        for batch in batches:
            for *key, at, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "block", "at", "n"))):
                if key != last:
                    if last is not None:
                        yield row(last, keys, counts)
                    last, keys, counts, held = key, [], [], 0
                keys.append(np.frombuffer(at, dtype=np.int64))
                counts.append(np.frombuffer(n, dtype=np.int64))
                held += len(keys[-1])
                if held > HELD_ENTRIES:
                    at, n = _summed(keys, counts)
                    keys, counts, held = [at], [n], 0
        if last is not None:
            yield row(last, keys, counts)

    return rows.mapInArrow(run, "lang string, source string, block long, at binary, n binary, total long")


# ---------------------------------------------------------------------------
# divergence

def _shares(count: np.ndarray, total: int, v: int) -> np.ndarray:
    if int(count.max(initial=0)) + 2 > ((1 << 63) - 1) // SCALE:
        count = count.astype(object)
    return (1 + (SCALE * (count + 2)) // (total + 2 * v)).astype(np.int64)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def block_values(count: np.ndarray, totals: list[int], v: int, top: int = TOP) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Of the counts [group, ordinal] of one block: the pairs' sums [group,
    group], and (group, place in the block, value) of each group's first terms."""
    p = np.stack([_shares(c, t, v) for c, t in zip(count, totals)])
    q = _shares(count.sum(axis=0), sum(totals), v)
    sums = np.zeros((len(p), len(p)), dtype=np.int64)
    for a in range(len(p)):
        sums[a, a + 1:] = _divergence(p[a], p[a + 1:]).sum(axis=1)
    terms = []
    for a in range(len(p)):
        at = np.flatnonzero((count[a] > 0) & (p[a] > q))
        value = _divergence(p[a][at], q[at])
        terms += [(a, int(at[k]), int(value[k])) for k in np.lexsort((at, -value))[:top]]
    return sums + sums.T, terms


def _block_rows(width: int, top: int):
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def values(lang: str, block: int, v: int, rows: list[tuple]) -> Iterator[tuple]:
        count = np.zeros((len(rows), min(width, v - block * width)), dtype=np.int64)
        for k, (_, _, at, n) in enumerate(rows):
            if at is not None:
                count[k, np.frombuffer(at, dtype=np.int64) - block * width] = np.frombuffer(n, dtype=np.int64)
        names = np.array([r[0] for r in rows], dtype=object)
        sums, terms = block_values(count, [r[1] for r in rows], v, top)
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        for x in range(0, len(a), 1 << 16):
            i, j = a[x:x + (1 << 16)], b[x:x + (1 << 16)]
            yield [lang] * len(i), names[i].tolist(), names[j].tolist(), [None] * len(i), sums[i, j].tolist()
        if terms:
            yield [lang] * len(terms), [names[k] for k, _, _ in terms], [None] * len(terms), [block * width + at for _, at, _ in terms], [f for _, _, f in terms]

    def out(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for cols in values(*key, rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "source", "item", "ordinal", "value"])

    def run(batches):
        last, held = None, []
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("lang", "block", "v", "source", "total", "at", "n"))
            for lang, block, v, *row in zip(*cols):
                if (lang, block, v) != last:
                    if held:
                        yield from out(last, held)
                    last, held = (lang, block, v), []
                held.append(tuple(row))
        if held:
            yield from out(last, held)
    return run


def divergence(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP,
               shard_terms: int = SHARD_TERMS, broadcast_bytes: int = BROADCAST_BYTES, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    docs = documents.select(*[F.coalesce(qcol(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    groups = materialize(docs.select("lang", "source").distinct())
    vocab = vocabulary(docs, least)
    sizes = vocab.groupBy("lang").agg(F.count("*").alias("v"))
    built = materialize(transducers(vocab, shard_terms))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(64, block_cells // most)

    # a few numbers per shard; the transducers are fetched group by group
    built = built.withColumn("id", F.monotonically_increasing_id())
    listed = sorted((r.lang, r.shard, r.nbytes, r.id) for r in built.select("lang", "shard", "nbytes", "id").collect())
    counted, at = None, 0
    while at < len(listed):
        to, held = at, 0
        while to < len(listed) and (to == at or held + listed[to][2] <= broadcast_bytes):
            held += listed[to][2]
            to += 1
        shards = [(r.lang, r.shard * shard_terms, Transducer({a: np.frombuffer(r[a], dtype=k) for a, k in Transducer.ARRAYS.items()}, r.root, r.n_terms))
                  for r in built.where(F.col("id").isin([x[3] for x in listed[at:to]])).collect()]
        rows = recount(docs, shards, width)
        if to - at < len(listed):
            rows = materialize(rows)
        counted = rows if counted is None else counted.unionByName(rows)
        at = to

    schema = "lang string, source string, item string, ordinal long, value long"
    if counted is None:
        values = documents.sparkSession.createDataFrame([], schema)
    else:
        counted = materialize(_merged(counted))
        totals = groups.join(counted.groupBy("lang", "source").agg(F.sum("total").alias("total")), ["lang", "source"], "left").join(sizes, "lang")
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("v") / width) - 1))
        rows = totals.select("lang", "source", "v", F.coalesce("total", F.lit(0)).alias("total"), block.alias("block"))
        rows = rows.join(counted.drop("total"), ["lang", "source", "block"], "left")
        rows = rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "source")
        values = materialize(rows.mapInArrow(_block_rows(width, top), schema))
    pairs = values.where("ordinal IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    without = groups.join(sizes, "lang", "left_anti")
    other = without.select("lang", F.col("source").alias("item"))
    pairs = pairs.unionByName(without.join(other, "lang").where("source <> item").withColumn("value", F.lit(0).cast("long")))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    terms = values.where("ordinal IS NOT NULL").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    terms = terms.join(vocab, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
