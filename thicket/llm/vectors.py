"""Feature vectors of the samples, as the vector operators need them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def usable(samples: DataFrame, subgraph: DataFrame, *keep: str) -> DataFrame:
    """``node_id, d, feat`` of the vectors that are whole: ``nfeats`` finite numbers.

    ``keep`` names further columns of ``subgraph`` to carry. Redelivered rows stay; rows
    without ``node_id`` do not.
    """
    meta = subgraph.select(F.col("subgraph_id").alias("_sid"), F.col("nfeats").alias("d"), *keep).dropDuplicates(["_sid"])
    return (
        samples.select("node_id", "subgraph_id", "feat")
        .join(meta, F.col("subgraph_id") == F.col("_sid"))
        .filter(F.col("node_id").isNotNull() & (F.size("feat") == F.col("d")) & F.forall("feat", finite))
        .select("node_id", "d", "feat", *keep)
    )


def stack(feat: pd.Series) -> np.ndarray:
    """The vectors of a batch, all of one width, as a matrix."""
    return np.stack(feat.to_numpy()).astype(np.float32, copy=False) if len(feat) else np.zeros((0, 0), np.float32)


def by_width(pdf: pd.DataFrame) -> list[tuple[int, pd.DataFrame, np.ndarray]]:
    return [(int(d), part, stack(part.feat)) for d, part in pdf.groupby("d", sort=True)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between two blocks, in doubles."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)
