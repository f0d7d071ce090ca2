"""Accuracy, confusion and run statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def confusion(scored: DataFrame) -> DataFrame:
    """``truelabel, label, n`` for every combination that occurs."""
    return scored.groupBy("truelabel", "label").agg(F.count("*").alias("n"))


def balanced_accuracy(scored: DataFrame) -> DataFrame:
    """One row, ``accuracy``: 1 - sum over classes of (FP/(N - n) + FN/n) / (2 C).

    Classes are the labels above 0 that occur as ``truelabel``; predictions of other classes
    count only as misses. One class or none gives null.
    """
    one = confusion(scored.filter("truelabel > 0"))
    right = one.groupBy(F.col("truelabel").alias("c")).agg(F.sum("n").alias("there"), F.sum(F.when(F.coalesce(F.col("label") != F.col("truelabel"), F.lit(True)), F.col("n")).otherwise(0)).alias("missed"))
    false = one.filter("label != truelabel").groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("false"))
    total = one.agg(F.sum("n").alias("total"))
    each = right.join(false, "c", "left").join(F.broadcast(total))  # one row
    part = F.try_divide(F.coalesce("false", F.lit(0)), F.col("total") - F.col("there")) + F.col("missed") / F.col("there")
    return each.agg((1 - F.sum(part) / (2 * F.count("*"))).alias("accuracy")).select(F.when(~F.isnan("accuracy"), F.col("accuracy")).alias("accuracy"))


def accuracy_value(scored: DataFrame) -> float:
    return balanced_accuracy(scored).first()[0] or 0.0


def run_statistics(results: DataFrame, column: str = "value") -> DataFrame:
    """Mean and population deviation of a result column."""
    return results.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("runs"))


def experiment(spark: SparkSession, runs: int, once: Callable[[int], float]) -> DataFrame:
    """``run, value`` of repeated hold-out runs, one for every seed."""
    return spark.createDataFrame([(i, float(once(i))) for i in range(runs)], "run int, value double")
