"""Connected components of an edge list.

Large-star and small-star rounds over DataFrames (each a minimum per node and a join) until
nothing changes. As soon as at most ``LOCAL_EDGES`` edges are left, counted before, one
task finishes them with union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.plans.runtime import cut

LOCAL_EDGES = 500_000


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of the component of each of n nodes, by hooking and jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b = a[differ], b[differ]
        lo, hi = np.minimum(ra[differ], rb[differ]), np.maximum(ra[differ], rb[differ])
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [x for x in batches if len(x)]
    if got:
        e = pd.concat(got)
        ids, inverse = np.unique(np.concatenate([e.a.to_numpy(), e.b.to_numpy()]), return_inverse=True)
        root = union_find(inverse[: len(e)], inverse[len(e) :], len(ids))
        yield pd.DataFrame({"id": ids, "component": ids[root]})


def components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, component`` for every id in ``edges``; ``component`` is its smallest id.

    Null ends are left out, loops keep their node, repeated edges count once.
    """
    slim = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null")
    live = cut(slim.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = live
    while live.limit(local_edges + 1).count() > local_edges:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = cut(small.filter("a != b").distinct())
        if after.count() == live.count() and after.join(live, ["a", "b"], "left_anti").isEmpty():
            live = after
            break
        live = after
    else:
        done = live.coalesce(1).mapInPandas(_finish, "id long, component long")
        return _with_lone(done, nodes)
    # stars: every node points to the centre, which is the smallest
    done = live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return _with_lone(done, nodes)


def _with_lone(done: DataFrame, nodes: DataFrame) -> DataFrame:
    every = nodes.select(F.col("a").alias("id")).unionByName(nodes.select(F.col("b").alias("id"))).distinct()
    return every.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
