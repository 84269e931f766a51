"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark
texts (an item with fewer words, but not none, is one window). The alphabet
is the word: a text is the sequence of its words' 64-bit hashes, and a block
is two consecutive words. For each window length

* a *shift table*, indexed by the hash of the block that ends at the current
  word, tells how far the window can move without missing an occurrence
  (positions that no pattern can end at are never looked at);
* where the shift is zero, the *suffix hash* of the block together with the
  hash of the window's first block selects a bucket of patterns;
* the bucket's patterns are *compared directly*, word by word, with the text.

All cursors of a step (one for each stretch of words) advance together in
numpy, so the scan is a plain map over the documents: no shuffle.

The benchmark is the only thing sent to the tasks. Its size is measured
first; beyond ``block_bytes`` of text it is cut into blocks by a hash of the
item, and the documents pass through one map per block (the state of a
document is its merged hit spans and its items), so a broadcast never
exceeds the block size however large the benchmark is.

Edge cases: a NULL or empty text has no words (n_words 0, no items, not
contaminated). An item with NULL text, or without words, has no windows. An
item whose id is NULL marks hits but has no id to list. Repeated items are
listed once; repeated documents give repeated rows. An empty benchmark
leaves every document clean; empty documents give an empty result. Other
columns of either table are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from softgrove.llm.common import LOWER_TABLE, add_fields, steps, text_bytes
from softgrove.session import materialize

WINDOW = 10
#: Words of a block of the shift table.
BLOCK_WORDS = 2
#: Benchmark text that one broadcast pattern set may hold.
BLOCK_BYTES = 16 << 20
#: Words that one cursor walks.
STRETCH = 256
#: Maps over the documents between two checkpoints.
CHAIN = 8

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)
_K1, _K2, _K3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of the rows of a string column: byte ranges, row numbers, hashes."""

    _pow: np.ndarray | None = None
    _inv: np.ndarray | None = None

    def __init__(self, col: pa.Array):
        data, off = text_bytes(col)
        self.n_rows = len(col)
        n = len(data)
        is_word = np.concatenate(([False], _WORD[data], [False]))
        first = is_word[1:-1] & ~is_word[:-2]
        last = is_word[1:-1] & ~is_word[2:]
        if n:
            cut = off[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            first[cut] = is_word[cut + 1]
            last[cut - 1] = is_word[cut]
        self.text = LOWER_TABLE[data]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(off, self.start, side="right") - 1
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self) -> np.ndarray:
        """Polynomial hash of each word's bytes, from running sums over
        stretches of words (memory for about ``_PIECE`` bytes at a time)."""
        out = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(out):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + _PIECE, side="right")))
            size = int(self.end[to - 1] - base)
            if Words._pow is None or len(Words._pow) < size:
                Words._pow, Words._inv = _powers(_P, max(size, _PIECE)), _powers(_P_INV, max(size, _PIECE))
            run = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum((self.text[base:base + size].astype(np.uint64) + np.uint64(1)) * Words._pow[:size], out=run[1:])
            s, e = self.start[at:to] - base, self.end[at:to] - base
            h = (run[e] - run[s]) * Words._inv[s]
            out[at:to] = (h ^ (h >> np.uint64(29))) * _K3
            at = to
        return out

    def window(self, first: int, n: int) -> bytes:
        """The ``n`` words from word ``first``, joined by spaces."""
        t = self.text
        return b" ".join(t[s:e].tobytes() for s, e in zip(self.start[first:first + n], self.end[first:first + n]))


def _blocks(h: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at word ``last``."""
    out = h[last] * _K2
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(31))) * _K1 + h[last - k] * _K2
    return out ^ (out >> np.uint64(33))


class PatternSet:
    """Shift table and suffix-hash buckets of the windows of one length."""

    def __init__(self, length: int, patterns: dict[bytes, set[int]]):
        self.length = length
        self.block = min(BLOCK_WORDS, length)
        texts = list(patterns)
        words = Words(pa.array([t.decode() for t in texts]))
        h = words.hash.reshape(len(texts), length)
        flat, base = h.reshape(-1), np.arange(len(texts)) * length
        bits = int(np.clip(np.ceil(np.log2(16 * length * len(texts))), 12, 24))
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, dtype=np.uint8)
        for j in range(self.block - 1, length):
            at = _blocks(flat, base + j, self.block) >> self.drop
            self.shift[at] = np.minimum(self.shift[at], length - 1 - j)
        key = self._key(flat, base + length - 1)
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.texts = [texts[i] for i in order]
        self.items = [patterns[t] for t in self.texts]

    def _key(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        suffix = _blocks(h, last, self.block)
        prefix = _blocks(h, last - self.length + self.block, self.block)
        return suffix ^ (prefix * _K3)

    def find(self, words: Words) -> Iterator[tuple[int, int]]:
        """(first word, pattern number) of each occurrence."""
        h, n, m = words.hash, len(words), self.length
        at = np.arange(m - 1, n, STRETCH)
        stop = np.minimum(at + STRETCH, n)
        found = []
        while at.size:
            step = self.shift[_blocks(h, at, self.block) >> self.drop]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            keep = at < stop
            at, stop = at[keep], stop[keep]
        if not found:
            return
        last = np.concatenate(found)
        last = last[words.row[last] == words.row[last - m + 1]]
        key = self._key(h, last)
        lo, hi = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
        for k in np.flatnonzero(hi > lo):
            first = int(last[k]) - m + 1
            text = words.window(first, m)
            for p in range(lo[k], hi[k]):
                if self.texts[p] == text:
                    yield first, p


class Matcher:
    """Wu-Manber tables of a set of items, one pattern set per window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        by_length: dict[int, dict[bytes, set[int]]] = {}
        words = Words(pa.array([t for _, t in items], type=pa.string()))
        ends = np.searchsorted(words.row, np.arange(len(items) + 1))
        for k in range(len(items)):
            a, b = int(ends[k]), int(ends[k + 1])
            size = min(window, b - a)
            for first in range(a, b - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(words.window(first, size), set()).add(k)
        self.sets = [PatternSet(n, p) for n, p in sorted(by_length.items())]

    def scan(self, words: Words, spans: list[list[int] | None], items: list[list[str] | None]):
        """Hit words, items and merged hit spans of each row, beside the
        spans and items it had."""
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        row_at = np.searchsorted(words.row, np.arange(words.n_rows + 1))
        for k, had in enumerate(spans):
            if had:
                np.add.at(cover, row_at[k] + np.asarray(had[::2]), 1)
                np.add.at(cover, row_at[k] + np.asarray(had[1::2]), -1)
        found: dict[int, set[str]] = {k: set(had) for k, had in enumerate(items) if had}
        for group in self.sets:
            for first, p in group.find(words):
                cover[first] += 1
                cover[first + group.length] -= 1
                row = int(words.row[first])
                found.setdefault(row, set()).update(self.ids[i] for i in group.items[p] if self.ids[i] is not None)
        hit = np.cumsum(cover[:-1]) > 0
        out: list[list[int] | None] = [None] * words.n_rows
        for row in np.unique(words.row[hit]):
            own = hit[row_at[row]:row_at[row + 1]].astype(np.int8)
            out[row] = np.flatnonzero(np.diff(np.concatenate(([0], own, [0])))).tolist()
        n_hit = np.bincount(words.row[hit], minlength=words.n_rows)
        return n_hit, [sorted(found.get(k, ())) for k in range(words.n_rows)], [x or [] for x in out]


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text, one at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r[0], r[1]) for r in block.distinct().collect()]


def contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  bench_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (default: all) of the documents and, their names
    starting with ``prefix``: n_words, n_hit, items (ids of the items with
    occurring windows, sorted as strings) and spans (start and end word of
    each maximal hit stretch, one after the other). ``prefix`` has to make
    these four names differ from those kept."""
    spark = documents.sparkSession
    keep = documents.columns if keep is None else keep
    need = list(dict.fromkeys([*keep, text_col]))
    new = [f"{prefix}{c}" for c in ("n_words", "n_hit", "items", "spans")]
    if {c.lower() for c in new} & {c.lower() for c in need}:
        raise ValueError(f"the documents have a column named like one of {new}; give a prefix")
    out = documents.select(*[F.col(f"`{c}`") for c in need])
    schema = add_fields(out.schema, list(zip(new, (LongType(), LongType(), ArrayType(StringType()), ArrayType(LongType())))))
    for k, block in enumerate(_blocks_of(benchmark, item_col, bench_text_col, block_bytes)):
        if k and k % CHAIN == 0:
            out = materialize(out)
        sent = spark.sparkContext.broadcast(Matcher(block, window))

        def run(batches, first=k == 0, sent=sent):
            matcher = sent.value
            for batch in batches:
                for part in steps(batch, text_col):
                    words = Words(part.column(text_col))
                    n = part.num_rows
                    had = [[None] * n] * 2 if first else [part.column(c).to_pylist() for c in (new[3], new[2])]
                    n_hit, items, spans = matcher.scan(words, *had)
                    n_words = np.bincount(words.row, minlength=n)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in need), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                         pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], names=[*need, *new])

        out = out.mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in [*keep, *new]])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents (all their columns) without a hit word."""
    mark = "_dc"
    while any(c.lower().startswith(mark) for c in documents.columns):
        mark += "_"
    return (contamination(documents, benchmark, prefix=mark, **options)
            .where(F.col(f"{mark}n_hit") == 0).select(*[F.col(f"`{c}`") for c in documents.columns]))
