"""Column selection, label derivation, token replacement and missing-value
rules. Every fit is one aggregate pass over all the columns it needs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.operators._util import one_row, qcol


def select_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep the listed columns, in list order."""
    return df.select(*[qcol(c) for c in cols])


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*list(cols))


def stack_tables(dfs: Iterable[DataFrame]) -> DataFrame:
    """Tables of the same columns under one another, duplicates kept."""
    return reduce(DataFrame.unionByName, dfs)


def derive_label(df: DataFrame, cond: Column, out: str = "label", null_as: int | None = 0) -> DataFrame:
    """Label from a predicate, ``cond`` cast to 0/1.

    A comparison with a missing value is NULL in Spark; ``null_as`` gives
    the value the row takes then (0 for ``== < >``, 1 for ``!=``)."""
    lab = cond.cast("int")
    if null_as is not None:
        lab = F.coalesce(lab, F.lit(int(null_as)))
    return df.withColumn(out, lab)


def replace_token(df: DataFrame, col: str, token, value) -> DataFrame:
    """Masked assignment ``col[col == token] = value``."""
    c = qcol(col)
    return df.withColumn(col, F.when(c == F.lit(token), F.lit(value)).otherwise(c))


def replace_values(df: DataFrame, col: str, values: list, value) -> DataFrame:
    c = qcol(col)
    return df.withColumn(col, F.when(c.isin(*values), F.lit(value)).otherwise(c))


def to_numeric(df: DataFrame, cols: Iterable[str], strict: bool = False, dtype: str = "double") -> DataFrame:
    """Coerce to numbers: bad values become NULL (``try_cast``) or, with
    ``strict``, raise as a plain cast under ANSI mode does."""
    for c in cols:
        col = qcol(c)
        df = df.withColumn(c, col.cast(dtype) if strict else col.try_cast(dtype))
    return df


def split_positions(df: DataFrame, col: str, n: int, names: list[str] | None = None,
                    drop: bool = True) -> DataFrame:
    """One column per character of the trimmed string; shorter strings leave
    NULLs at the end. A string of more than ``n`` characters is an error:
    nothing is dropped without a word."""
    names = names or [f"{col}_{i}" for i in range(n)]
    s = F.trim(qcol(col))
    ln = F.length(s)
    long = F.raise_error(F.concat(F.lit(f"{col} has more than {n} characters: "), s)).cast("string")
    cols = [F.when(ln > n, long).when(F.lit(i) < ln, F.substring(s, i + 1, 1)).alias(nm) for i, nm in enumerate(names)]
    out = df.select("*", *cols)
    return out.drop(col) if drop else out


def _mode_values(df: DataFrame, cols: list[str], token=None, exclude_token: bool = False) -> dict:
    aggs = []
    for i, c in enumerate(cols):
        v = qcol(c)
        if token is not None and exclude_token:
            v = F.when(v != F.lit(token), v)
        # deterministic=True: NULLs ignored, lowest value wins a tie.
        aggs.append(F.mode(v, deterministic=True).alias(f"m{i}"))
    row = one_row(df.agg(*aggs))
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def fill_mode(df: DataFrame, cols: list[str], token=None, exclude_token: bool = False,
              fit_df: DataFrame | None = None) -> DataFrame:
    """Replace ``token`` (or NULL when no token) by the column's mode.

    With ``exclude_token=False`` the token takes part in the mode, so a
    column where it is the most common value keeps it. All modes come from
    one aggregate over ``fit_df`` (default: the whole table)."""
    modes = _mode_values(fit_df if fit_df is not None else df, cols, token, exclude_token)
    for c in cols:
        m = modes[c]
        if m is None:
            continue
        v = qcol(c)
        if token is None:
            df = df.withColumn(c, F.coalesce(v, F.lit(m)))
        else:
            df = df.withColumn(c, F.when(v == F.lit(token), F.lit(m)).otherwise(v))
    return df


def fill_mode_all(df: DataFrame, cols: list[str] | None = None, fit_df: DataFrame | None = None) -> DataFrame:
    """Fill the NULLs of every column (label included) with its mode."""
    cols = cols or df.columns
    modes = _mode_values(fit_df if fit_df is not None else df, cols)
    return df.fillna({c: m for c, m in modes.items() if m is not None})


def fill_mean(df: DataFrame, cols: list[str], token=None, fit_df: DataFrame | None = None) -> DataFrame:
    """Mean fill. With ``token``, the token cells are replaced by the mean
    of the parsable values and the column becomes numeric."""
    if token is not None:
        def untoken(d: DataFrame) -> DataFrame:
            return d.select(*[
                (F.when(qcol(c) == F.lit(token), F.lit(None)).otherwise(qcol(c)).try_cast("double").alias(c)
                 if c in cols else qcol(c)) for c in d.columns])
        df = untoken(df)
        fit_df = untoken(fit_df) if fit_df is not None else None
    src = fit_df if fit_df is not None else df
    row = one_row(src.agg(*[F.avg(qcol(c).try_cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]))
    means = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    for c in cols:
        if means[c] is not None:
            df = df.withColumn(c, F.coalesce(qcol(c).try_cast("double"), F.lit(float(means[c]))))
    return df


def fill_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))
