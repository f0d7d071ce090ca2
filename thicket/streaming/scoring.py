"""Scoring a stream of samples against a fitted model, micro-batch by micro-batch.

The model is static; each batch goes through the batch classifier, so the result is the same
as scoring the rows together. A batch that runs again overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from thicket.operators.supervised import classify


def score_stream(stream: DataFrame, model: DataFrame, checkpoint: str, path: str, metric: str = "euclid_log", score: Callable[..., DataFrame] = classify):
    """Starts a query that writes ``position, label, cost`` of every batch under ``path``."""

    def batch(df: DataFrame, number: int) -> None:
        score(model, df, metric).select("position", "label", "cost").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
