"""Delimited and Parquet table scans with explicit schemas.

Columns are read as strings under the given names (no schema inference),
then converted with ``try_cast`` where a type is declared — under ANSI
mode a plain cast of ``"?"`` would fail. PERMISSIVE mode keeps the first
``len(columns)`` fields of longer lines and skips blank lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.operators._util import maybe_broadcast, qcol, with_position
from softgrove.session import materialize


def read_table(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
               sep: str = ",", header: bool = False, null_token: str | None = None,
               comment: str | None = None, types: dict[str, str] | None = None,
               fmt: str = "csv", drop_if: Callable[[], Column] | None = None) -> DataFrame:
    """Read one or more delimited files (stacked in path order) or Parquet.

    * ``columns`` without ``header``: headerless file, names given here;
      lines with more fields keep the first ``len(columns)``.
    * ``columns`` with ``header``: the file's header line is replaced.
    * ``header`` alone: names from the file.
    * ``null_token``: that text becomes NULL (e.g. ``"?"``).
    * ``comment``: lines starting with it are skipped (a preamble).
    * ``types``: column -> Spark type, converted with ``try_cast``.
    * ``drop_if``: gives a condition over the text columns; lines for which it
      holds are skipped (a preamble that no character marks). Lines for
      which it is NULL stay.
    """
    if fmt == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else list(path)))
        return df.select(*[qcol(c) for c in columns]) if columns else df
    reader = spark.read.option("sep", sep).option("mode", "PERMISSIVE").option("header", header)
    if null_token is not None:
        reader = reader.option("nullValue", null_token)
    if comment is not None:
        reader = reader.option("comment", comment)
    if columns:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
        reader = reader.schema(schema)
        if header:
            reader = reader.option("enforceSchema", True)
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.csv(paths)
    if drop_if is not None:
        df = df.where(~F.coalesce(drop_if(), F.lit(False)))
    if types:
        df = df.select(*[(F.trim(qcol(c)).try_cast(types[c]).alias(c) if c in types else qcol(c))
                         for c in df.columns])
    return df


def read_tables(spark: SparkSession, paths: Sequence[str], **kw) -> DataFrame:
    """Several files of the same layout stacked into one table (duplicates kept)."""
    out = None
    for p in paths:
        d = read_table(spark, p, **kw)
        out = d if out is None else out.unionByName(d)
    return out


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A consecutive 0-based position: files in order of their paths, then
    rows in file order.

    Spark packs file splits into partitions by size, so partition numbers say
    nothing about the order of files. Rows are keyed by (file, start of the
    split, place in the split), which doesn't depend on packing; one small job
    counts the rows of each split, and prefix sums give the offsets. Rows that
    aren't a scan of files are stored first and numbered as they lie there."""
    if not _is_scan(df):
        return with_position(materialize(df), name)
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_mid"))
    # within a partition, a split's rows are consecutive
    per = (at.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")))
    splits = sorted(tuple(r) for r in per.collect())  # one row per file split
    rows, offset = [], 0
    for file, block, n, first in splits:
        rows.append((file, block, offset - first))
        offset += n
    schema = "_file string, _block long, _shift long"
    shifts = df.sparkSession.createDataFrame(rows, schema)
    return (at.join(maybe_broadcast(shifts, len(rows)), ["_file", "_block"])
            .withColumn(name, F.col("_mid") + F.col("_shift")).drop("_file", "_block", "_mid", "_shift"))


def _is_scan(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path").schema  # noqa: B018  (resolves the column)
    except AnalysisException:
        return False
    return True


def zip_by_position(x: DataFrame, y: DataFrame, key: str = "row_id") -> DataFrame:
    """Pair a feature table and a label table row by row (1:1, left order).
    Both have to be scans of files. Raises when the row counts differ."""
    nx, ny = x.count(), y.count()
    if nx != ny:
        raise ValueError(f"feature and label files differ in length: {nx} vs {ny}")
    return with_row_id(x, key).join(with_row_id(y, key), key)


def read_xy(spark: SparkSession, x_path: str, y_path: str, **kw) -> DataFrame:
    """Feature file and label file (both with a header line), paired by position."""
    x = read_table(spark, x_path, header=True, **kw)
    y = read_table(spark, y_path, header=True, **kw)
    return zip_by_position(x, y)
