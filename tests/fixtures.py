"""Hand-made fixtures shaped like the experiment's inputs (no data files)."""

from __future__ import annotations

import numpy as np
import pandas as pd


def iris_like(seed: int = 0) -> pd.DataFrame:
    """150 rows, 4 numeric features, 3 string classes of 50 rows, the
    classes partly overlapping like the classic flower measurements."""
    rng = np.random.default_rng(seed)
    centres = {"class-a": [5.0, 3.4, 1.5, 0.25], "class-b": [5.9, 2.8, 4.3, 1.3], "class-c": [6.6, 3.0, 5.5, 2.0]}
    spread = [0.4, 0.35, 0.45, 0.25]
    rows = []
    for cls, c in centres.items():
        x = rng.normal(c, spread, size=(50, 4))
        for r in x:
            rows.append([round(float(v), 1) for v in r] + [cls])
    return pd.DataFrame(rows, columns=["sepal_length", "sepal_width", "petal_length", "petal_width", "class"])


def imbalanced(n: int = 240, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.1).astype(int)
    x = rng.normal(0, 1, size=(n, 2)) + y[:, None] * 1.5
    return pd.DataFrame({"row_id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "label": y})
