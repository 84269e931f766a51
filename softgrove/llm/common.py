"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Table that lower-cases the bytes A-Z and leaves all others.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_TABLE = np.frombuffer(LOWER_BYTES, dtype=np.uint8)

#: Text bytes that one vectorised step works on at a time (a longer text is
#: one step of its own).
STEP_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken`` (case-insensitive)."""
    low = {c.lower() for c in taken}
    name = base
    while name.lower() in low:
        name += "_"
    return name


def held_out(key: Column, mod: int, rest: int) -> Column:
    """True for rows whose crc32(key as text) mod ``mod`` is ``rest``; a NULL
    key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod) == rest


def add_fields(schema: StructType, fields: list[tuple[str, object]]) -> StructType:
    return StructType(list(schema.fields) + [StructField(n, t, True) for n, t in fields])


def steps(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together hold about ``step_bytes``."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(column)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes of a string column and the n + 1 offsets of its rows;
    NULL is the empty text."""
    col = pc.fill_null(col, "").cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]
