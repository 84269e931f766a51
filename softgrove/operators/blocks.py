"""Values of a feature array, feature by feature, in binary blocks.

Values with keyed noise are all different, so counting them first, a row for
each in the JVM, saves nothing and costs most. Here a task turns its rows into
columns, draws the noise with numpy (the bits of ``keyed_gaussian``'s uniforms),
and gives one row per group and feature for some thousand values; a second
task gets the blocks of one group and feature.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

# Bytes of feature values that a task turns into blocks at a time.
HELD_BYTES = 16 * 1024 * 1024
# Values of a group and feature up to which one task may hold them (some 100
# bytes each).
BLOCK_VALUES = 2_000_000
# Stands for a missing label in a block.
NO_LABEL = np.iinfo(np.int64).min

# ---------------------------------------------------------------------------
# keyed noise

# The constants of MD5 (RFC 1321).
_MD5_ADD = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_MD5_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ONE_BLOCK = 55  # bytes of the longest text that is one block of MD5
_TWO52 = float(2 ** 52)
_AT_ONCE = 8192


def _md5_high(words: list, shape: tuple[int, ...]) -> np.ndarray:
    """The first 52 bits of the MD5 of texts of one block, whose 16 words are
    arrays that broadcast to ``shape``, or numbers."""
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in _MD5_START)
    f, tmp = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((_MD5_ADD[i] + words[g]) & 0xFFFFFFFF)
        else:
            f += words[g]
            f += np.uint32(_MD5_ADD[i])
        np.right_shift(f, np.uint32(32 - _MD5_TURN[i]), out=tmp)
        f <<= np.uint32(_MD5_TURN[i])
        f |= tmp
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(_MD5_START[0])
    b += np.uint32(_MD5_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap() >> np.uint32(12))


class KeyTexts:
    """Keys as text, by length, for draws that depend on them."""

    def __init__(self, keys: pa.Array):
        keys = keys.cast(pa.large_string())
        self.n = len(keys)
        self.missing = np.flatnonzero(keys.is_null().to_numpy(zero_copy_only=False))
        at = np.frombuffer(keys.buffers()[1], dtype=np.int64)[keys.offset:keys.offset + self.n + 1]
        data = np.frombuffer(keys.buffers()[2] or b"", dtype=np.uint8)
        size = np.diff(at)
        size[self.missing] = -1
        self.parts = []  # (rows, their bytes [length, rows])
        for length in np.unique(size[size >= 0]):
            rows = np.flatnonzero(size == length)
            for i in range(0, len(rows), _AT_ONCE):
                own = rows[i:i + _AT_ONCE]
                self.parts.append((own, np.ascontiguousarray(data[at[own][:, None] + np.arange(length)].T)))

    def uniform(self, around: list[tuple[list[str], list[str]]]) -> np.ndarray:
        """``[len(around), keys]``: ``keyed_uniform`` of the texts made of the parts
        before and after the key."""
        out = np.empty((len(around), self.n))
        texts = [("".join(f"{x}:" for x in before).encode(), "".join(f":{x}" for x in after).encode()) for before, after in around]
        for i, (before, after) in enumerate(around if len(self.missing) else []):
            # concat_ws leaves a missing key out
            out[i, self.missing] = _digest(":".join([*before, *after]).encode())
        for heads, tails in sorted({(len(h), len(t)) for h, t in texts}):
            which = [i for i, (h, t) in enumerate(texts) if (len(h), len(t)) == (heads, tails)]
            for rows, key in self.parts:
                size, some = heads + len(key) + tails, max(1, _AT_ONCE // len(rows))
                for at in range(0, len(which), some):
                    own = which[at:at + some]
                    if size > _ONE_BLOCK:
                        for i in own:
                            out[i, rows] = [_digest(texts[i][0] + x.tobytes() + texts[i][1]) for x in key.T]
                        continue
                    end = b"\x80" + bytes(_ONE_BLOCK - size) + (8 * size).to_bytes(8, "little")
                    fixed = np.frombuffer(b"".join(texts[i][0] + bytes(len(key)) + texts[i][1] + end for i in own), dtype="<u4").reshape(len(own), 16)
                    words: list = [fixed[:, w:w + 1] if (fixed[:, w] != fixed[0, w]).any() else int(fixed[0, w]) for w in range(16)]
                    for j, column in enumerate(key, heads):
                        word = words[j // 4]
                        words[j // 4] = (column.astype(np.uint32) << np.uint32(8 * (j % 4)))[None] + (np.uint32(word) if isinstance(word, int) else word)
                    out[np.ix_(own, rows)] = _md5_high(words, (len(own), len(rows)))
        out += 0.5
        out /= _TWO52
        return out

    def gaussian(self, around: list[tuple[list[str], list[str], int]]) -> np.ndarray:
        """``keyed_gaussian`` likewise, with the salt of each."""
        u1, u2 = (self.uniform([(before, [*after, str(2 * salt + i)]) for before, after, salt in around]) for i in (0, 1))
        np.log(u1, out=u1)
        u1 *= -2.0
        u2 *= 2.0 * math.pi
        return np.multiply(np.sqrt(u1, out=u1), np.cos(u2, out=u2), out=u1)


def _digest(text: bytes) -> float:
    return float(int(hashlib.md5(text).hexdigest()[:13], 16))


# ---------------------------------------------------------------------------
# blocks

def _matrix(col: pa.Array, n_feat: int) -> np.ndarray:
    """``[n_feat, n]`` of a list column; what is missing is NaN."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # without the values of NULL rows
    if len(size) and (size == n_feat).all():
        return np.ascontiguousarray(flat.reshape(len(size), n_feat).T)
    out = np.full((n_feat, len(size)), np.nan)
    row = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = flat
    return out


def feature_blocks(df: DataFrame, by: list[str], features: str, n_feat: int, key: Column, draw: Callable, seed: Column | None = None,
                   label: Column | None = None) -> DataFrame:
    """(by..., feature, _x, _noise[, _label]): values, noise and labels (64-bit) of a part of a
    group's rows, in the same order; a missing value is NaN. ``draw(texts, seed)``
    gives the noise of all features, ``[n_feat, keys]``, for rows with the keys
    ``texts``; with a ``seed`` (as text) it is drawn for each group."""
    kept, seeded, labelled = [df.schema[c] for c in by], seed is not None, label is not None
    own = [*by, *(["_seed"] if seeded else [])]
    rows = df.select(*by, *([seed.cast("string").alias("_seed")] if seed is not None else []), F.col(features).alias("_f"),
                     key.cast("string").alias("_k"), *([label.cast("long").alias("_y")] if label is not None else []))

    def emit(table: pa.Table):
        code = np.zeros(len(table), dtype=np.int64)
        for c in own:
            d = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        start = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
        groups = list(zip(start.tolist(), [*start[1:].tolist(), len(order)]))
        X = _matrix(table.column("_f").combine_chunks(), n_feat)[:, order]
        keys = table.column("_k").combine_chunks().take(pa.array(order))
        if not seeded:
            # rows of a key in several groups have the same noise
            found = keys.dictionary_encode(null_encoding="encode")
            texts, which = KeyTexts(found.dictionary), found.indices.to_numpy()
            noise = draw(texts, None)[:, which]
        else:
            seeds = table.column("_seed").take(pa.array(order[start])).to_pylist()
            noise = np.empty_like(X)
            for (a, b), s in zip(groups, seeds):
                noise[:, a:b] = draw(KeyTexts(keys.slice(a, b - a)), s)
        cells = [(a, b, j) for a, b in groups for j in range(n_feat)]
        firsts = table.select(by).take(pa.array(np.repeat(order[start], n_feat)))
        arrays = [*(c.combine_chunks() for c in firsts.columns), pa.array([j for *_, j in cells], pa.int32()),
                  pa.array([X[j, a:b].tobytes() for a, b, j in cells], pa.binary()), pa.array([noise[j, a:b].tobytes() for a, b, j in cells], pa.binary())]
        names = [*by, "feature", "_x", "_noise"]
        if labelled:
            y = pc.fill_null(table.column("_y"), NO_LABEL).combine_chunks().to_numpy()[order]
            arrays.append(pa.array([y[a:b].tobytes() for a, b, _ in cells], pa.binary()))
            names.append("_label")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def fn(batches):
        held: list[pa.RecordBatch] = []
        for rb in batches:
            if rb.num_rows:
                held.append(rb)
            if held and sum(x.num_rows for x in held) * n_feat * 8 >= HELD_BYTES:
                yield emit(pa.Table.from_batches(held))
                held = []
        if held:
            yield emit(pa.Table.from_batches(held))

    names = ["_x", "_noise", *(["_label"] if labelled else [])]
    return rows.mapInArrow(fn, StructType([*kept, StructField("feature", IntegerType()), *(StructField(c, BinaryType()) for c in names)]))


def joined(table: pa.Table, column: str, dtype=np.float64) -> np.ndarray:
    """The values of all blocks of a group."""
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype=dtype) for x in table.column(column)])
