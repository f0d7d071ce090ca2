"""Samples that match target shares of categories, by the cube method.

Each category of a plan has an expected draw: its share of ``draw_size`` or its minimum,
whichever is larger, capped by what there is. Every record of the category starts with
expected draw / records as its inclusion probability. The balancing variables are the
category indicators, so a flight step moves two records of the same category along the
null vector (+1, -1) until one is decided; the category totals never change. Each partition
flies its own records and leaves at most one undecided record for each category; these are
merged upward, ``FAN_IN`` partitions at a time, and fly on. What is left, at most one record
of each category, lands: flight goes on across the categories of the plan, which keeps the
plan's total, and a last record is decided by a coin.

Nothing gathers a category in one task; a task holds at most ``FAN_IN`` undecided records of
each category. Records are sorted and coins derive from what a task holds, so a task that
runs again decides alike.

Defined cases: redelivered records count once; a null ``node_id`` is no record; null labels
match no target; targets without a plan id form a plan of their own; null ``share``, ``draw_size`` and ``min_rows`` count as 0; a target without
records is reported and draws nothing; repeated target rows are reported once each and drawn
once (from the largest need); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.plans.runtime import cut, parallelism

#: Partitions merged at a time.
FAN_IN = 64
_NEAR = 1e-7
#: Stands for a null plan while plans are told apart.
_NO_PLAN = -(2**62)
_STATE = "plan_id long, truelabel int, node_id long, prob double, part long"


def fly(prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight over the records of one category; at most one probability stays undecided."""
    p = prob.tolist()
    coins = rng.random(len(p)).tolist()
    held = -1
    for i, x in enumerate(p):
        if x <= _NEAR or x >= 1 - _NEAR:
            p[i] = 0.0 if x <= _NEAR else 1.0
            continue
        if held < 0:
            held = i
            continue
        a = p[held]
        s = a + x
        # a step along (+1, -1): its length is a coin between the two ends of the segment
        if s < 1:
            if coins[i] * s < a:
                p[held], p[i] = s, 0.0
            else:
                p[held], p[i], held = 0.0, s, i
        else:
            if coins[i] * (2 - s) < 1 - x:
                p[held], p[i], held = 1.0, s - 1, i
            else:
                p[held], p[i] = s - 1, 1.0
        rest = p[held]
        if rest <= _NEAR or rest >= 1 - _NEAR:
            p[held] = 0.0 if rest <= _NEAR else 1.0
            held = -1
    return np.array(p)


def _flight(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Records sorted by plan and category; decided ones leave, the held one stays."""
        tail = None
        for b in batches:
            if tail is not None:
                b = pd.concat([tail, b])
                tail = None
            edges = np.flatnonzero((b.plan_id.to_numpy()[1:] != b.plan_id.to_numpy()[:-1]) | (b.truelabel.to_numpy()[1:] != b.truelabel.to_numpy()[:-1])) + 1
            bounds = [0, *edges.tolist(), len(b)]
            prob, keep = b.prob.to_numpy(float).copy(), []
            nodes, plans, labels = b.node_id.to_numpy(), b.plan_id.to_numpy(), b.truelabel.to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi > lo:
                    rng = np.random.default_rng([seed, int(plans[lo]) & 0x7FFFFFFF, int(labels[lo]) & 0x7FFFFFFF, int(nodes[lo]) & 0x7FFFFFFF, hi - lo])
                    prob[lo:hi] = fly(prob[lo:hi], rng)
            b = b.assign(prob=prob)
            last = np.zeros(len(b), bool)
            last[bounds[-2] : bounds[-1]] = True
            held = last & (prob > 0) & (prob < 1)
            tail = b[held] if held.any() else None
            yield b[(prob > 0) & ~held]
        if tail is not None:
            yield tail

    return run


def _land(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """At most one undecided record of each category of a plan."""
        pdf = pdf.sort_values(["truelabel", "node_id"])
        rng = np.random.default_rng([seed, int(pdf.plan_id.iloc[0]) & 0x7FFFFFFF])
        prob = fly(pdf.prob.to_numpy(float), rng)
        return pdf.assign(prob=np.where(rng.random(len(prob)) < prob, 1.0, 0.0))

    return run


def targets(plan: DataFrame, records: DataFrame) -> DataFrame:
    """Each target row with what is there, what is needed and the expected draw."""
    there = records.groupBy(F.col("subgraph_id").alias("_s"), F.col("truelabel").alias("_l")).agg(F.count("*").alias("there"))
    goal = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"), F.coalesce(F.col("share") * F.col("draw_size"), F.lit(0.0)))
    need = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("long"), F.floor(F.coalesce(F.col("share") * F.col("draw_size"), F.lit(0.0))))
    return (
        plan.select("plan_id", "subgraph_id", "draw_size", "truelabel", "share", "min_rows")
        .join(there, (F.col("subgraph_id") == F.col("_s")) & (F.col("truelabel") == F.col("_l")), "left")
        .drop("_s", "_l")
        .withColumn("there", F.coalesce("there", F.lit(0)))
        .withColumn("goal", goal)
        .withColumn("need", need)
        .withColumn("expected", F.least(F.col("goal"), F.col("there").cast("double")))
    )


def draw(samples: DataFrame, plan: DataFrame, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """The sample ``plan_id, truelabel, node_id`` and the report, one row per target row.

    Report: ``plan_id, subgraph_id, truelabel, share, there, need, drawn, imbalance, short``;
    ``imbalance`` is drawn minus expected, ``short`` says that fewer than needed were drawn.
    """
    spark = samples.sparkSession
    one = samples.filter("node_id is not null").groupBy("node_id").agg(F.min(F.struct("subgraph_id", "truelabel")).alias("r"))
    records = cut(one.select("node_id", "r.subgraph_id", "r.truelabel").filter("subgraph_id is not null and truelabel is not null"))
    named = plan.withColumn("plan_id", F.coalesce(F.col("plan_id").cast("long"), F.lit(_NO_PLAN)))
    goals = cut(targets(named, records))
    strata = goals.filter("expected > 0").groupBy("plan_id", "subgraph_id", "truelabel").agg((F.max("expected") / F.first("there")).alias("prob"))
    # records already lie hashed by node, so a large category is spread over all partitions
    start = records.join(strata, ["subgraph_id", "truelabel"]).select("plan_id", "truelabel", "node_id", "prob")
    width = parallelism(spark)
    state = start.repartition(width, "node_id").withColumn("part", F.spark_partition_id().cast("long"))
    by = ["plan_id", "truelabel"]
    decided = None
    while True:
        state = cut(state.sortWithinPartitions(*by, F.xxhash64(F.lit(seed), "plan_id", "node_id"), "node_id").mapInPandas(_flight(seed), _STATE))
        done = state.filter("prob = 1").select(*by, "node_id")
        decided = done if decided is None else decided.unionByName(done)
        state = state.filter("prob < 1")
        if width == 1:
            break
        width = -(-width // FAN_IN)
        merged = state.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        state = merged.repartition(parallelism(spark), *by, "part")
    landed = state.groupBy("plan_id").applyInPandas(_land(seed), _STATE).filter("prob = 1")
    sample = cut(decided.unionByName(landed.select(*by, "node_id")))
    drawn = sample.groupBy(F.col("plan_id").alias("_p"), F.col("truelabel").alias("_l")).agg(F.count("*").alias("drawn"))
    report = (
        goals.join(drawn, (F.col("plan_id") == F.col("_p")) & (F.col("truelabel") == F.col("_l")), "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .select("plan_id", "subgraph_id", "truelabel", "share", "there", "need", "drawn", (F.col("drawn") - F.col("expected")).alias("imbalance"), (F.col("drawn") < F.col("need")).alias("short"))
    )
    plan_out = F.nullif(F.col("plan_id"), F.lit(_NO_PLAN)).alias("plan_id")
    return sample.select(plan_out, "truelabel", "node_id"), report.select(plan_out, *report.columns[1:])
