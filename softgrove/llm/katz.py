"""Katz backoff language model: training and scoring of a corpus at once.

Bigrams over words and the end of the text (before a text's first token
stands a start). Counts are Good-Turing discounted: with n_r bigrams seen r
times, for r up to ``K``
    d_r = ((r+1) n_(r+1) / (r n_r) - m) / (1 - m),  m = (K+1) n_(K+1) / n_1,
and larger counts lose the same amount as ``K`` does, so that every history
keeps mass for unseen words. Seen: P(w|h) = d_c c(h,w) / c(h). Unseen:
a(h) P(w), where a(h) = (1 - sum of the seen P(w|h)) / (1 - sum of their P(w))
makes P(.|h) sum to one exactly. P(w) is discounted alike; its free mass is
that of the unknown word. After an unknown history a = 1.

How it runs. A *unit* is a few thousand documents read together. Each unit's
distinct bigrams, with their counts in training texts, go as packed arrays
to partitions by word, where counts of bigrams and words add up (the n-gram
table). Sums by history go on to partitions by history (the backoff table).
The counts, and the backoff weights of unseen bigrams, return to their unit in
the order in which its bigrams were sent, without keys, and the unit's
documents are scored from them. Shuffles carry each unit's distinct bigrams,
never token rows.

Words are 64-bit hashes (two of 10^7 words share one with a chance of 3 in a
million). Words that a small sample shows to be frequent are spread by their
history too (their counts are added up apart), so that none fills a
partition. Only such words' counts, the counts of counts and totals come to the
driver.

Edge cases: a NULL or empty text is one end token. Rows whose ``train``
condition is NULL don't train. Without training texts every token is
unknown: base log10(1/1), score 0. Repeated rows are trained on and scored
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.llm.common import LOWER_TABLE, steps, text_bytes

K = 5
UNIT_BYTES = 4 << 20
#: Text whose bigrams one partition of the n-gram table takes (about).
PART_BYTES = 8 << 20
#: A word with this share of the sample's tokens is spread by history.
HOT_SHARE = 1 / 400
HOT_SAMPLE = 2_000

START, END = np.uint64(1), np.uint64(2)
_P, _MIX = (0x9E3779B97F4A7C15 | 1), np.uint64(0xFF51AFD7ED558CCD)
_PIECE = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_P, _PIECE), _powers(pow(_P, -1, 1 << 64), _PIECE)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (each text's words and its end), and
    the texts' numbers."""
    data, off = text_bytes(col)
    n, rows = len(data), len(col)
    word = np.concatenate(([False], ~_SPACE[data], [False]))
    first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut], last[cut - 1] = word[cut + 1], word[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = LOWER_TABLE[data]
    h = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(h):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(end, base + _PIECE, side="right")))
        size = int(end[to - 1] - base)
        power, inverse = (_POW, _INV) if size <= _PIECE else (_powers(_P, size), _powers(pow(_P, -1, 1 << 64), size))
        run = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((low[base:base + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=run[1:])
        s, e = start[at:to] - base, end[at:to] - base
        h[at:to] = (run[e] - run[s]) * inverse[s]
        at = to
    h = _mix(h)
    h[h <= END] = END + np.uint64(1)
    row = np.searchsorted(off, start, side="right") - 1
    # an end token after each text's words
    ends = np.searchsorted(row, np.arange(rows), side="right")
    return np.insert(h, ends, END), np.insert(row, ends, np.arange(rows))


def _pack(**arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(blob: bytes) -> dict:
    return pickle.loads(zstandard.decompress(blob, max_output_size=1 << 31))


def _narrow(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


class _Unit:
    """Distinct bigrams of a unit, by part of the n-gram table."""

    def __init__(self, col: pa.Array, train: np.ndarray, hot: np.ndarray, parts: int):
        word, self.row = tokens(col)
        self.n_tokens = np.bincount(self.row, minlength=len(col))
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[np.concatenate(([0], np.cumsum(self.n_tokens)[:-1])).astype(np.int64)[self.n_tokens > 0]] = START
        names, number = np.unique(np.concatenate((word, before)), return_inverse=True)
        w, h = number[:len(word)], number[len(word):]
        part = (names % np.uint64(parts)).astype(np.int64)[w]
        is_hot = np.isin(names, hot)[w]
        part[is_hot] = (_mix(word[is_hot] ^ _mix(before[is_hot])) % np.uint64(parts)).astype(np.int64)
        n = len(names)
        code = (part * n + w) * n + h
        order = np.argsort(code, kind="stable")
        code, row = code[order], self.row[order]
        new = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
        #: one entry per distinct bigram
        at = np.flatnonzero(new)
        self.word, self.before = names[(code[at] // n) % n], names[code[at] % n]
        self.part = code[at] // n // n
        self.trained = np.add.reduceat(train[row].astype(np.int64), at) if len(at) else at
        # postings: texts of each entry
        entry = np.cumsum(new) - 1
        again = np.concatenate(([True], (entry[1:] != entry[:-1]) | (row[1:] != row[:-1]))) if len(row) else new
        here = np.flatnonzero(again)
        self.post_row = row[here]
        self.post_count = np.diff(np.append(here, len(row)))
        self.post_size = np.bincount(entry[here], minlength=len(at))

    def parts(self) -> Iterator[tuple[int, slice]]:
        edge = np.flatnonzero(np.diff(self.part, prepend=-1))
        for a, b in zip(edge, np.append(edge[1:], len(self.part))):
            yield int(self.part[a]), slice(int(a), int(b))


def _cuts(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """A partition's rows in slices of at most ``limit`` bytes of text (a longer
    text is one of its own), wherever the batches begin and end."""
    parts, held = [], 0
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + limit - held, side="right"))
            if to <= at and not parts:
                to = at + 1
            if to > at:
                parts.append(batch.slice(at, to - at))
                held += int(ends[to - 1]) - before
                at = to
            if at < len(size):
                yield pa.Table.from_batches(parts)
                parts, held = [], 0
    if parts:
        yield pa.Table.from_batches(parts)


def _units(batches, train_col: str, hot: np.ndarray, parts: int) -> Iterator[tuple[str, pa.Table, _Unit, np.ndarray]]:
    """The units of a task, named by partition and place: a task that runs
    again, or reads its rows in other batches, makes the same ones."""
    task = TaskContext.get().partitionId()
    for k, step in enumerate(_cuts(batches, UNIT_BYTES)):
        train = np.array([bool(x) for x in step.column(train_col).to_pylist()])
        yield f"{task}-{k}", step, _Unit(step.column("text").combine_chunks(), train, hot, parts), train


def _check(u: _Unit, s: slice) -> int:
    """Digest of a part's bigrams, by which both passes over the texts agree."""
    return int(np.bitwise_xor.reduce(_mix(u.word[s] ^ _mix(u.before[s]))))


# ---------------------------------------------------------------------------
# the n-gram table

@dataclass
class _Counts:
    """Entries of a partition added up: by bigram and by word."""
    units: list
    word: np.ndarray      # of each bigram
    before: np.ndarray
    count: np.ndarray
    of: list              # for each unit: its entries' bigrams
    names: np.ndarray     # words
    total: np.ndarray     # their counts here
    name_of: np.ndarray   # of each bigram


def _added(rows: Iterable) -> _Counts:
    units, arrays = [], []
    for r in rows:
        d = _unpack(r[2])
        units.append((r[0], r[1], d["check"]))
        arrays.append((np.repeat(d["word"], d["size"]), d["before"], d["trained"]))
    none = np.zeros(0, np.uint64)
    word = np.concatenate([a[0] for a in arrays]) if arrays else none
    before = np.concatenate([a[1] for a in arrays]) if arrays else none
    trained = np.concatenate([a[2].astype(np.int64) for a in arrays]) if arrays else none.astype(np.int64)
    order = np.lexsort((before, word))
    w, b = word[order], before[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (b[1:] != b[:-1]))) if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.add.reduceat(trained[order], at) if len(at) else at
    place = np.empty(len(word), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    edges = np.cumsum([0, *(len(a[1]) for a in arrays)])
    w, b = w[at], b[at]
    names, name_of = np.unique(w, return_inverse=True)
    total = np.bincount(name_of, weights=count, minlength=len(names)).astype(np.int64)
    return _Counts(units, w, b, count, [place[x:y] for x, y in zip(edges, edges[1:])], names, total, name_of)


def _stats(hot: np.ndarray):
    def run(rows):
        c = _added(rows)
        is_hot = np.isin(c.names, hot)
        plain = c.total[~is_hot]
        starts = int(c.count[c.before == START].sum())
        yield (np.bincount(np.minimum(c.count, K + 2), minlength=K + 3), np.bincount(np.minimum(plain, K + 2), minlength=K + 3),
               int(plain.sum()), starts, dict(zip(c.names[is_hot].tolist(), c.total[is_hot].tolist())))
    return run


def _join_stats(a, b):
    hot = dict(a[4])
    for k, v in b[4].items():
        hot[k] = hot.get(k, 0) + v
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], hot


def good_turing(n: np.ndarray) -> np.ndarray:
    """Amounts by which counts 0..K+1 are lessened (the last holds for all
    larger ones); n[r] is the number of types seen r times. Uses the largest
    k at which every discount is sound; none: half a count each."""
    n = n.astype(float)
    for k in range(K, 0, -1):
        if (n[1:k + 2] <= 0).any():
            continue
        m = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        if m >= 1:
            continue
        d = ((r + 1) * n[2:k + 2] / (r * n[1:k + 1]) - m) / (1 - m)
        if ((d > 0) & (d < 1)).all():
            off = np.full(K + 2, np.clip(k * (1 - d[-1]), 0.05, 0.95))
            off[0] = 0.0
            off[1:k + 1] = r * (1 - d)
            return off
    off = np.full(K + 2, 0.5)
    off[0] = 0.0
    return off


@dataclass
class Totals:
    tokens: int
    types: int
    starts: int
    less: np.ndarray        # of bigram counts
    less_words: np.ndarray  # of word counts
    unknown: float          # the unknown word's probability
    hot: dict[int, int]

    def lessened(self, count: np.ndarray) -> np.ndarray:
        return count - self.less[np.minimum(count, K + 1)]

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        seen = (count - self.less_words[np.minimum(count, K + 1)]) / max(self.tokens, 1)
        return np.where(count > 0, seen, self.unknown)


def totals(stats) -> Totals:
    bigrams, words, tokens_, starts, hot = stats
    hot = {k: v for k, v in hot.items() if v > 0}
    words = words + np.bincount(np.minimum(list(hot.values()), K + 2).astype(np.int64), minlength=K + 3)
    tokens_ += sum(hot.values())
    less_words = good_turing(words)
    # what all types lose is the unknown word's; types above K + 1 are one class
    lost = float((words[1:K + 2] * less_words[1:K + 2]).sum() + words[K + 2] * less_words[K + 1])
    return Totals(tokens_, int(words[1:].sum()), starts, good_turing(bigrams), less_words,
                  lost / tokens_ if tokens_ else 1.0, hot)


def _with_hot(c: _Counts, t: Totals) -> np.ndarray:
    """Counts of the partition's words in the whole corpus."""
    total = c.total.copy()
    if t.hot:
        keys = np.array(sorted(t.hot), dtype=np.uint64)
        values = np.array([t.hot[int(k)] for k in keys], dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, c.names), len(keys) - 1)
        total = np.where(keys[at] == c.names, values[at], total)
    return total


def _to_histories(t: Totals, parts: int):
    """For the backoff table: sums of the seen bigrams by history, and the
    histories of each unit's unseen bigrams."""
    def run(rows):
        c = _added(rows)
        p = t.word_probability(_with_hot(c, t))[c.name_of]
        seen = np.flatnonzero(c.count > 0)
        h, at = np.unique(c.before[seen], return_inverse=True)
        sums = [np.bincount(at, weights=x[seen], minlength=len(h)) for x in (c.count, t.lessened(c.count), p)]
        where = (h % np.uint64(parts)).astype(np.int64)
        for k in np.unique(where):
            own = where == k
            yield int(k), "sums", _pack(h=h[own], count=_narrow(sums[0][own].astype(np.int64)), kept=sums[1][own], p=sums[2][own])
        # one row for each partition of the backoff table, for all units together
        asked: dict[str, list] = {}
        for (unit, _, _), of in zip(c.units, c.of):
            asked.setdefault(unit, []).append(c.before[of[c.count[of] == 0]])
        asked = {unit: np.unique(np.concatenate(h)) for unit, h in asked.items()}
        who = np.repeat(np.arange(len(asked)), [len(h) for h in asked.values()])
        h = np.concatenate([*asked.values(), np.zeros(0, np.uint64)])
        where = (h % np.uint64(parts)).astype(np.int64)
        for k in np.unique(where):
            own = where == k
            yield int(k), "ask", _pack(units=list(asked), who=_narrow(who[own]), h=h[own])
    return run


def _counts_back(t: Totals):
    """Counts of each unit's bigrams and words, in the order sent."""
    def run(rows):
        c = _added(rows)
        total = _with_hot(c, t)
        for (unit, part, check), of in zip(c.units, c.of):
            name = c.name_of[of]
            first = np.flatnonzero(np.diff(name, prepend=-1))
            yield unit, "counts", part, _pack(check=check, pair=_narrow(c.count[of]), word=_narrow(total[name[first]]))
    return run


def backoff_weights(count: np.ndarray, kept: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a(h): the mass that seen words leave over that of the words unseen."""
    return (1 - kept / count) / (1 - p)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 a(h), and log10 c(h), for the histories asked for."""
    sums, asks = [], []
    for batch in batches:
        for r in batch.to_pylist():
            (sums if r["kind"] == "sums" else asks).append(r)
    tables = [_unpack(r["blob"]) for r in sums]
    names = np.zeros(0, np.uint64)
    if tables:
        names, at = np.unique(np.concatenate([x["h"] for x in tables]), return_inverse=True)
        count, kept, p = (np.bincount(at, weights=np.concatenate([x[c].astype(float) for x in tables]), minlength=len(names))
                          for c in ("count", "kept", "p"))
        weight, size = np.log10(backoff_weights(count, kept, p)), np.log10(count)
    for_unit: dict[str, list] = {}
    for r in asks:
        d = _unpack(r["blob"])
        h = d["h"]
        a = np.zeros(len(h))
        if len(names):
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            # the common sum takes c(h) off every token; here it goes back
            a = np.where(names[at] == h, weight[at] + size[at], 0.0)
        edges = np.searchsorted(d["who"], np.arange(len(d["units"]) + 1))
        for unit, x, y in zip(d["units"], edges, edges[1:]):
            if y > x:
                for_unit.setdefault(unit, []).append((h[x:y], a[x:y]))
    for unit, got in for_unit.items():
        blob = _pack(h=np.concatenate([h for h, _ in got]), a=np.concatenate([a for _, a in got]))
        yield pa.RecordBatch.from_pydict({"unit": [unit], "kind": ["weights"], "part": pa.array([-1], pa.int32()), "blob": [blob]})


def _scored(rows: pd.DataFrame, t: Totals, id_name: str) -> pd.DataFrame:
    """Scores of a unit's documents."""
    by: dict[str, dict[int, list]] = {"texts": {}, "counts": {}, "weights": {}}
    for r in rows.itertuples():
        by[r.kind].setdefault(r.part, []).append(r.blob)
    head = _unpack(by["texts"].pop(-1)[0])
    weights = [_unpack(b) for b in by["weights"].get(-1, [])]
    names = np.concatenate([*(w["h"] for w in weights), np.zeros(0, np.uint64)])
    order = np.argsort(names)
    names, weight = names[order], np.concatenate([*(w["a"] for w in weights), np.zeros(0)])[order]
    n = len(head["train"])
    base, score, known = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    for part in sorted(by["texts"]):
        d = _unpack(by["texts"][part][0])
        c = _unpack(by["counts"][part][0])
        if c["check"] != d["check"]:
            raise RuntimeError("the two passes over the texts read different rows; store the documents before scoring them")
        pair = c["pair"].astype(np.int64)
        word = np.repeat(c["word"].astype(np.int64), d["size"])
        is_end = np.repeat(d["end"], d["size"])
        value_base = np.log10((word + 1) / (t.tokens + t.types + 1))
        value = np.where(pair > 0, np.log10(np.maximum(t.lessened(pair), 1e-300)), np.log10(t.word_probability(word)))
        # a word is the next token's history: its count is taken off here, for all tokens at once
        value = value - np.where((word > 0) & ~is_end, np.log10(np.maximum(word, 1)), 0.0)
        unseen = np.flatnonzero(pair == 0)
        if len(unseen):
            before = np.zeros(len(pair), dtype=np.uint64)
            before[d["maybe"]] = d["before"]
            value[unseen] += weight[np.searchsorted(names, before[unseen])]
        row, many = d["row"].astype(np.int64), d["count"].astype(np.int64)
        entry = np.repeat(np.arange(len(pair)), d["posts"])
        base += np.bincount(row, weights=many * value_base[entry], minlength=n)
        score += np.bincount(row, weights=many * value[entry], minlength=n)
        known += np.bincount(row, weights=many * (word[entry] > 0), minlength=n).astype(np.int64)
    if t.starts:
        score -= np.log10(t.starts)
    return pd.DataFrame({id_name: pd.Series(head["ids"], dtype=object), "train": head["train"], "n_tokens": head["n_tokens"], "n_known": known,
                         "train_tokens": np.full(n, t.tokens, dtype=np.int64), "base_score": base, "score": score})


# ---------------------------------------------------------------------------

def _frequent(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Hashes of words that are frequent in a small sample. They only steer
    which partition adds up what."""
    def run(batches):
        for batch in batches:
            for step in steps(batch, "text", UNIT_BYTES):
                word, _ = tokens(step.column("text"))
                names, count = np.unique(word, return_counts=True)
                top = np.argsort(-count, kind="stable")[:1000]
                yield pa.RecordBatch.from_pydict({"w": names[top].view(np.int64), "n": count[top].astype(np.int64),
                                                  "total": np.where(np.arange(len(top)) == 0, len(word), 0).astype(np.int64)})

    sample = docs.select("text").sample(min(1.0, HOT_SAMPLE / max(n_docs, 1)), seed=0)
    found = sample.mapInArrow(run, "w long, n long, total long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("total").alias("t"))
    rows = found.orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).collect()
    total = sum(r.t for r in rows) or 1
    return np.array([r.w for r in rows if r.n >= HOT_SHARE * total], dtype=np.int64).view(np.uint64)


def score_corpus(documents: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows for which ``train`` holds, and scores all: id,
    train, n_tokens, n_known, train_tokens, base_score (add-one unigrams)
    and score (Katz), both log10."""
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(6, -(-(size.b or 0) // PART_BYTES))
    hot = _frequent(docs, size.n)

    def sent(batches):
        for unit, _, u, _ in _units(batches, "train", hot, parts):
            for part, s in u.parts():
                word, count = np.unique(u.word[s], return_counts=True)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "unit": [unit], "blob": [
                    _pack(check=_check(u, s), word=word, size=_narrow(count), before=u.before[s], trained=_narrow(u.trained[s]))]})

    table = docs.mapInArrow(sent, "part int, unit string, blob binary").repartition(parts, "part").select("unit", "part", "blob").rdd
    zero = (np.zeros(K + 3, np.int64), np.zeros(K + 3, np.int64), 0, 0, {})
    t = totals(table.mapPartitions(_stats(hot)).treeAggregate(zero, _join_stats, _join_stats))

    asked = spark.createDataFrame(table.mapPartitions(_to_histories(t, parts)),
                                  "key int, kind string, blob binary", verifySchema=False)
    reply = "unit string, kind string, part int, blob binary"
    weights = asked.repartition(parts, "key").mapInArrow(_answers, reply)
    counts = spark.createDataFrame(table.mapPartitions(_counts_back(t)), reply, verifySchema=False)

    def texts(batches):
        for unit, step, u, own in _units(batches, "train", hot, parts):
            rows = [(-1, _pack(ids=step.column("id").to_pylist(), train=own, n_tokens=u.n_tokens))]
            post = np.concatenate(([0], np.cumsum(u.post_size)))
            for part, s in u.parts():
                a, b = post[s.start], post[s.stop]
                word, count = np.unique(u.word[s], return_counts=True)
                # histories only where a bigram could be unseen
                new = u.before[s][u.trained[s] == 0]
                rows.append((part, _pack(check=_check(u, s), size=_narrow(count), end=word == END, posts=_narrow(u.post_size[s]), row=_narrow(u.post_row[a:b]),
                                         count=_narrow(u.post_count[a:b]), maybe=np.flatnonzero(u.trained[s] == 0).astype(np.uint32), before=new)))
            for part, blob in rows:
                yield pa.RecordBatch.from_pydict({"unit": [unit], "kind": ["texts"], "part": pa.array([part], pa.int32()), "blob": [blob]})

    units = docs.mapInArrow(texts, reply).unionByName(counts).unionByName(weights)
    out = units.groupBy("unit").applyInPandas(
        lambda rows: _scored(rows, t, "id"), f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
