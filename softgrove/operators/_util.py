"""Small shared helpers: safe column references and size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its row count is known to be at most this.
BROADCAST_ROW_LIMIT = 2_000_000


def qcol(name: str) -> Column:
    """Reference a column whose name may hold dots, colons, slashes or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def maybe_broadcast(small: DataFrame, row_bound: int, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``small`` only behind a size check.

    ``row_bound`` is an upper bound on the rows, analytic (e.g. classes x
    trials) or counted by the caller. Above the limit the plain DataFrame is
    returned and Spark picks a shuffle join."""
    return F.broadcast(small) if row_bound <= limit else small


def with_position(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of partitions and rows. ``df`` has
    to give the same partitions each time it is read (a stored table)."""
    mid = F.monotonically_increasing_id()
    d = df.withColumn("_mid", mid)
    part = F.shiftright("_mid", 33).cast("int")
    counts = {r["p"]: r["n"] for r in d.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(at)
        at += counts.get(p, 0)
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    start = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), part + 1)
    return d.withColumn(name, start + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid")


def one_row(df: DataFrame) -> dict:
    """Collect a single aggregate row (bounded by construction)."""
    row = df.first()
    return row.asDict() if row is not None else {}
