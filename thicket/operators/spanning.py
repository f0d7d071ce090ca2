"""Minimum spanning trees, prototypes and minimax paths.

Every edge has the total order (distance, smaller id, larger id), so the tree is unique even
under equal distances. Up to ``LOCAL_ROWS`` rows (counted) one task grows it; beyond that
Boruvka rounds run over block pairs: every component finds its least outgoing edge, the
components merge, and the number of components at least halves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.distances import Distance, distance
from thicket.operators.pairwise import BLOCK, matrix, meet
from thicket.plans.components import components
from thicket.plans.runtime import cut

LOCAL_ROWS, LOCAL_EDGES = 4000, 1_000_000
_EDGE = "a long, b long, d double"


def all_rows(m: Distance, x: np.ndarray) -> np.ndarray:
    """All distances, in blocks of rows; at most LOCAL_ROWS squared of them."""
    return np.concatenate([m.block(x[lo : lo + 128], x) for lo in range(0, len(x), 128)])


def grow_tree(ids: np.ndarray, row) -> pd.DataFrame:
    """Tree by growing from the first row; ``row(p)`` gives all distances of row p."""
    n = len(ids)
    best, by = np.full(n, np.inf), np.full(n, -1)
    out_a, out_b, out_d = [], [], []
    left = np.ones(n, bool)
    p = 0
    for _ in range(n - 1):
        left[p] = False
        d = row(p)
        tie = left & (d == best) & (by >= 0)
        better = left & (d < best)
        if tie.any():
            q = np.flatnonzero(tie)
            lo, hi = np.minimum(ids[q], ids[p]), np.maximum(ids[q], ids[p])
            lo2, hi2 = np.minimum(ids[q], ids[by[q]]), np.maximum(ids[q], ids[by[q]])
            better[q[(lo < lo2) | ((lo == lo2) & (hi < hi2))]] = True
        best[better], by[better] = d[better], p
        rest = np.flatnonzero(left)
        near = rest[best[rest] == best[rest].min()]
        if len(near) > 1:
            lo, hi = np.minimum(ids[near], ids[by[near]]), np.maximum(ids[near], ids[by[near]])
            near = near[np.lexsort((hi, lo))[:1]]
        p = int(near[0])
        out_a.append(min(ids[p], ids[by[p]]))
        out_b.append(max(ids[p], ids[by[p]]))
        out_d.append(best[p])
    return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64), "d": np.array(out_d, float)})


def spanning_tree(samples: DataFrame, metric: str | Distance = "euclid_log", distances: DataFrame | None = None, local_rows: int = LOCAL_ROWS, block: int = BLOCK) -> DataFrame:
    """``a, b, d`` with a < b. ``distances`` may hold given ``i, j, d`` instead of a metric."""
    m = distance(metric) if isinstance(metric, str) else metric
    if distances is not None:
        arcs = distances.filter("i != j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("d").cast("double")).groupBy("a", "b").agg(F.min("d").alias("d"))
        return _boruvka(samples.select("position"), lambda comp: _least_arc(arcs, comp))
    slim = samples.select("position", "feat")
    if slim.limit(local_rows + 1).count() <= local_rows:

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [b for b in batches if len(b)]
            if got:
                pdf = pd.concat(got).sort_values("position")
                x = matrix(pdf.feat)
                yield grow_tree(pdf.position.to_numpy(np.int64), all_rows(m, x).__getitem__)

        return slim.coalesce(1).mapInPandas(grow, _EDGE)
    return _boruvka(slim, lambda comp: _least_block(slim.join(comp, "position"), m, block))


def _least_arc(arcs: DataFrame, comp: DataFrame) -> DataFrame:
    ca, cb = comp.select(F.col("position").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("position").alias("b"), F.col("comp").alias("cb"))
    out = arcs.join(ca, "a").join(cb, "b").filter("ca != cb")
    return out.select(F.explode(F.array("ca", "cb")).alias("comp"), "d", "a", "b")


def _least_block(rows: DataFrame, m: Distance, block: int) -> DataFrame:
    def kernel(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        d = m.block(matrix(one.feat), matrix(two.feat))
        i, j = one.position.to_numpy(), two.position.to_numpy()
        d[one.comp.to_numpy()[:, None] == two.comp.to_numpy()[None]] = np.inf
        low = d.min(1)
        r, c = np.nonzero((d == low[:, None]) & np.isfinite(d))
        got = pd.DataFrame({"comp": one.comp.to_numpy()[r], "d": d[r, c], "a": np.minimum(i[r], j[c]), "b": np.maximum(i[r], j[c])})
        return got.sort_values(["d", "a", "b"]).drop_duplicates("comp")

    return meet(rows, rows, kernel, "comp long, d double, a long, b long", block)


def _boruvka(nodes: DataFrame, least) -> DataFrame:
    comp = cut(nodes.select("position", F.col("position").alias("comp")))
    tree = None
    while True:
        found = cut(least(comp).groupBy("comp").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.a", "e.b", "e.d").distinct())
        if found.isEmpty():
            break
        tree = found if tree is None else tree.unionByName(found)
        ends = found.join(comp.select(F.col("position").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("position").alias("b"), F.col("comp").alias("cb")), "b")
        named = components(ends, "ca", "cb").withColumnsRenamed({"id": "comp", "component": "new"})
        comp = cut(comp.join(named, "comp", "left").select("position", F.coalesce("new", "comp").alias("comp")))
    return tree if tree is not None else nodes.sparkSession.createDataFrame([], _EDGE)


def prototypes(samples: DataFrame, tree: DataFrame) -> DataFrame:
    """``position`` of the ends of tree edges between different labels."""
    y = samples.select("position", "truelabel")
    ends = tree.join(y.select(F.col("position").alias("a"), F.col("truelabel").alias("ya")), "a").join(y.select(F.col("position").alias("b"), F.col("truelabel").alias("yb")), "b")
    return ends.filter("ya != yb").select(F.explode(F.array("a", "b")).alias("position")).distinct()


def minimax(tree: DataFrame, sources: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Least possible greatest edge from the sources to every node of the tree.

    Returns ``position, pathval, root, pred``; ``pred`` is null at the sources. Ties go to the
    smaller root, then the smaller predecessor.
    """
    both = tree.select("a", "b", "d").unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    start = sources.select("position", F.lit(0.0).alias("pathval"), F.col("position").alias("root"), F.lit(None).cast("long").alias("pred"))
    if both.limit(2 * local_edges + 1).count() <= 2 * local_edges:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [b for b in batches if len(b)]
            if got:
                yield flood(pd.concat(got))

        rows = both.select("a", "b", "d").unionByName(sources.select(F.col("position").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("d")))
        return rows.coalesce(1).mapInPandas(whole, "position long, pathval double, root long, pred long")
    both, state = cut(both), cut(start)
    while True:
        offers = both.join(state.withColumnRenamed("position", "a"), "a").select(F.col("b").alias("position"), F.greatest("pathval", "d").alias("pathval"), "root", F.col("a").alias("pred"))
        best = state.unionByName(offers).groupBy("position").agg(F.min(F.struct("pathval", "root", F.coalesce("pred", F.lit(-(2**62))).alias("o"), "pred")).alias("s")).select("position", "s.pathval", "s.root", "s.pred")
        new = cut(best)
        if new.count() == state.count() and new.select("position", "pathval", "root").exceptAll(state.select("position", "pathval", "root")).isEmpty():
            return new
        state = new


def flood(rows: pd.DataFrame) -> pd.DataFrame:
    """Minimax costs over arcs ``a, b, d``; a row without ``b`` is a source."""
    near: dict[int, list[tuple[int, float]]] = {}
    heap: list[tuple[float, int, int, int | None]] = []
    for a, b, d in zip(rows.a.tolist(), rows.b.tolist(), rows.d.tolist()):
        if b is None or b != b:
            heap.append((0.0, int(a), -1, int(a)))
        else:
            near.setdefault(int(a), []).append((int(b), d))
    heapq.heapify(heap)
    done: dict[int, tuple[float, int, int]] = {}
    while heap:
        cost, root, pred, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = (cost, root, pred)
        for q, d in near.get(node, ()):
            if q not in done:
                heapq.heappush(heap, (max(cost, d), root, node, q))
    return pd.DataFrame({"position": list(done), "pathval": [v[0] for v in done.values()], "root": [v[1] for v in done.values()], "pred": pd.array([None if v[2] < 0 else v[2] for v in done.values()], "Int64")})
