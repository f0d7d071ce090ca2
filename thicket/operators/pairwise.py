"""All-pairs operators: distance matrices, nearest-neighbour graphs, reductions over pairs.

Rows fall into hash blocks of about ``BLOCK`` rows. Each pair of blocks meets in one task as two
matrices, and only what is asked for leaves it (k nearest, least cost, or the distances), so
memory stays bounded by blocks at every size. A right side of at most ``HELD_ROWS`` rows and
``HELD_NUMBERS`` numbers (both counted) is sent to every task instead, and nothing is paired by a
shuffle. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.distances import Distance, distance
from thicket.plans.runtime import parallelism

BLOCK = 1024
#: Rows and feature values of a side that every task may hold.
HELD_ROWS, HELD_NUMBERS = 20_000, 4_000_000


def blocks_of(df: DataFrame, block: int = BLOCK) -> int:
    """Blocks that ``df`` needs; its rows are counted."""
    return max(1, -(-df.count() // block))


def held(df: DataFrame, key: str = "position", rows: int = HELD_ROWS) -> pd.DataFrame | None:
    """``df`` as one frame in order of ``key`` if its counted size allows it to be sent to every task."""
    size = df.limit(rows + 1).agg(F.count("*").alias("n"), F.max(F.size("feat")).alias("d")).first()
    if size.n > rows or size.n * max(size.d or 0, 1) > HELD_NUMBERS:
        return None
    return df.toPandas().sort_values(key)  # bounded by HELD_ROWS and HELD_NUMBERS


def meet(left: DataFrame, right: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK, key: str = "position", rows: int = HELD_ROWS) -> DataFrame:
    """Applies ``kernel`` to every pair of a block of ``left`` and a block of ``right``."""
    small = held(right, key, rows) if block == BLOCK else None
    if small is not None:
        shared = left.sparkSession.sparkContext.broadcast(small)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo in range(0, len(b), BLOCK):
                    if len(shared.value):
                        yield kernel(b.iloc[lo : lo + BLOCK].sort_values(key), shared.value)

        return left.repartition(parallelism(left.sparkSession), key).mapInPandas(each, schema)
    nl, nr = blocks_of(left, block), blocks_of(right, block)
    h = F.xxhash64(key)
    a = left.withColumn("_a", F.pmod(h, F.lit(nl)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    # own names on the right: both sides may stem from the same rows
    right = right.select([F.col(c).alias(f"_r_{c}") for c in right.columns])
    b = right.withColumn("_d", F.pmod(F.xxhash64(f"_r_{key}"), F.lit(nr)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(nl - 1))))

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return empty
        return kernel(one.drop(columns=["_a", "_b"]).sort_values(key), two.drop(columns=["_c", "_d"]).rename(columns=lambda c: c.removeprefix("_r_")).sort_values(key))

    names = [p.strip().split()[0] for p in schema.split(",")]
    empty = pd.DataFrame({n: [] for n in names})
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_c", "_d")).applyInPandas(run, schema)


def matrix(feat: pd.Series) -> np.ndarray:
    return np.stack(feat.to_numpy()).astype(np.float64)


def distance_pairs(samples: DataFrame, metric: str | Distance = "euclidean_standard", ordered: bool = True) -> DataFrame:
    """``i, j, d`` for all pairs; ``ordered`` keeps both directions and the diagonal of zeros."""
    m = distance(metric) if isinstance(metric, str) else metric
    slim = samples.select("position", "feat")

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = m.block(matrix(a.feat), matrix(b.feat))
        i, j = a.position.to_numpy(), b.position.to_numpy()
        d[i[:, None] == j[None]] = 0.0
        keep = np.ones_like(d, bool) if ordered else i[:, None] < j[None]
        r, c = np.nonzero(keep)
        return pd.DataFrame({"i": i[r], "j": j[c], "d": d[r, c]})

    return meet(slim, slim, kernel, "i long, j long, d double")


def distance_matrix(samples: DataFrame, metric: str | Distance = "euclidean_standard", normalize: bool = False) -> DataFrame:
    """Every pair, optionally divided by the greatest distance."""
    pairs = distance_pairs(samples, metric)
    if not normalize:
        return pairs
    top = pairs.agg(F.max("d").alias("top"))
    return pairs.join(F.broadcast(top)).select("i", "j", F.when(F.col("top") > 0, F.col("d") / F.col("top")).otherwise(F.col("d")).alias("d"))  # one row


def symmetric_matrix(samples: DataFrame, metric: str = "euclidean_standard") -> DataFrame:
    """The upper triangle once, mirrored, with a zero diagonal."""
    upper = distance_pairs(samples, metric, ordered=False)
    mirror = upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    diagonal = samples.select(F.col("position").alias("i"), F.col("position").alias("j"), F.lit(0.0).alias("d"))
    return upper.unionByName(mirror).unionByName(diagonal)


def knn_graph(samples: DataFrame, k: int, metric: str | Distance = "euclid_log", distances: DataFrame | None = None) -> DataFrame:
    """Arcs ``i, j, d, rank`` to the k nearest others. ``distances`` may hold given ``i, j, d``."""
    if k < 1:
        raise ValueError("k must be positive")
    order = Window.partitionBy("i").orderBy("d", "j")
    if distances is not None:
        near = distances.filter("i != j").select("i", "j", F.col("d").cast("double"))
    else:
        m = distance(metric) if isinstance(metric, str) else metric

        def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            d = m.block(matrix(a.feat), matrix(b.feat))
            i, j = a.position.to_numpy(), b.position.to_numpy()
            d[i[:, None] == j[None]] = np.inf
            # columns are sorted by id, so a stable sort breaks ties by id
            top = np.argsort(d, axis=1, kind="stable")[:, : min(k, d.shape[1])]
            got = np.take_along_axis(d, top, 1)
            r, c = np.nonzero(np.isfinite(got))
            return pd.DataFrame({"i": i[r], "j": j[top[r, c]], "d": got[r, c]})

        slim = samples.select("position", "feat")
        near = meet(slim, slim, kernel, "i long, j long, d double")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def radius(arcs: DataFrame) -> DataFrame:
    """Distance of every node to its farthest neighbour."""
    return arcs.groupBy(F.col("i").alias("position")).agg(F.max("d").alias("radius"))


def max_per_rank(arcs: DataFrame) -> DataFrame:
    """The greatest distance to a k-th neighbour, for every k."""
    return arcs.groupBy("rank").agg(F.max("d").alias("max_d"))


def plateau_arcs(arcs: DataFrame, dens: DataFrame) -> DataFrame:
    """Reverse arcs j -> i of arcs i -> j between nodes of equal density, where missing."""
    a, b = dens.select(F.col("position").alias("i"), F.col("dens").alias("di")), dens.select(F.col("position").alias("j"), F.col("dens").alias("dj"))
    level = arcs.select("i", "j", "d").join(a, "i").join(b, "j").filter("di = dj").select(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    return level.join(arcs.select("i", "j"), ["i", "j"], "left_anti").distinct()
