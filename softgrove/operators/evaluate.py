"""Accuracy, macro F1 and confusion counts as DataFrame plans.

Everything reduces to one ``groupBy(by, label, prediction).count()`` —
at most groups x K^2 rows — so one action yields both metrics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators.tree import predict


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), label, prediction).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
             by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def f1_macro_from_confusion(conf: DataFrame, label: str = "label", prediction: str = "prediction",
                            by: list[str] | None = None) -> DataFrame:
    """Unweighted mean over the classes present in truth or prediction of
    ``2tp / (2tp + fp + fn)``."""
    by = by or []
    hit = F.col(label) == F.col(prediction)
    per = conf.select(*by, F.explode(F.array(
        F.struct(F.col(label).alias("cls"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col(prediction).alias("cls"), F.lit(0).cast("long").alias("tp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("e"))
    per = per.groupBy(*by, "e.cls").agg(F.sum("e.tp").alias("tp"), F.sum("e.fp").alias("fp"), F.sum("e.fn").alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(den == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / den)
    return per.groupBy(*by).agg(F.avg(f1).alias("f1_macro"))


def f1_macro(df: DataFrame, label: str = "label", prediction: str = "prediction",
             by: list[str] | None = None) -> DataFrame:
    return f1_macro_from_confusion(confusion(df, label, prediction, by), label, prediction, by)


def metrics_from_counts(rows, by_keys: tuple = ()) -> dict:
    """Accuracy and macro F1 from collected confusion rows (driver side,
    groups x K^2 rows)."""
    out: dict = {}
    for r in rows:
        g = tuple(r[k] for k in by_keys)
        out.setdefault(g, []).append((r["label"], r["prediction"], r["n"]))
    res = {}
    for g, cells in out.items():
        total = sum(n for _, _, n in cells)
        correct = sum(n for l, p, n in cells if l == p)
        classes = sorted({l for l, _, _ in cells} | {p for _, p, _ in cells})
        f1s = []
        for c in classes:
            tp = sum(n for l, p, n in cells if l == c and p == c)
            fp = sum(n for l, p, n in cells if l != c and p == c)
            fn = sum(n for l, p, n in cells if l == c and p != c)
            d = 2 * tp + fp + fn
            f1s.append(0.0 if d == 0 else 2 * tp / d)
        res[g] = {"accuracy": correct / total if total else float("nan"),
                  "f1_macro": sum(f1s) / len(f1s) if f1s else float("nan")}
    return res


def evaluate(df: DataFrame, model, by: list[str] | None = None, label: str = "label",
             features: str = "features") -> tuple[dict, float]:
    """Score, predict and reduce to metrics in one action; returns the
    metrics per group and the elapsed seconds of that action."""
    by = by or []
    t = time.time()
    rows = confusion(predict(df.select(*by, features, label) if by else df.select(features, label),
                             model, features), label, "prediction", by).collect()
    return metrics_from_counts(rows, tuple(by)), time.time() - t
