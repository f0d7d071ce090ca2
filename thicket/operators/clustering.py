"""Unsupervised forests: densities on a k-NN graph, best k by normalised cut, clusters.

Distances, k-NN arcs, densities and cuts are DataFrame operators. The order-dependent
propagation from density maxima runs on compact arcs (no features), one task for each
connected component of the k-NN graph, since components do not influence each other.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.distances import Distance, distance
from thicket.operators import maxtree
from thicket.operators.pairwise import BLOCK, knn_graph, matrix, max_per_rank, meet, plateau_arcs, radius
from thicket.plans.components import components
from thicket.plans.runtime import cut, numbered

#: Fixed value: the top of the density scale.
MAX_DENSITY = 1000.0


def density(arcs: DataFrame, width: float | None = None) -> DataFrame:
    """``position, dens, pathval`` from k-NN arcs; dens is scaled to [1, 1000].

    ``width`` is the greatest arc unless given; equal densities everywhere give the top.
    """
    if width is None:
        top = arcs.agg(F.max("d")).first()[0] or 0.0
        width = top if top >= 1e-5 else 1.0
    k = 2.0 * width / 9.0
    raw = arcs.groupBy(F.col("i").alias("position")).agg((F.sum(F.exp(-F.col("d") / k)) / (F.count("*") + 1)).alias("v"))
    ends = raw.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = raw.join(F.broadcast(ends)).withColumn("dens", F.when(F.col("lo") == F.col("hi"), MAX_DENSITY).otherwise((MAX_DENSITY - 1) * (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) + 1))  # one row
    return scaled.select("position", "dens", (F.col("dens") - 1).alias("pathval"))


def normalized_cut(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, ``cut``: sum over clusters of outer / (inner + outer) arc weight 1/d."""
    a, b = labels.select(F.col("position").alias("i"), F.col("label").alias("li")), labels.select(F.col("position").alias("j"), F.col("label").alias("lj"))
    w = arcs.filter("d > 0").join(a, "i").join(b, "j").select("li", (F.col("li") == F.col("lj")).alias("same"), (1 / F.col("d")).alias("w"))
    each = w.groupBy("li").agg(F.sum(F.when(~F.col("same"), F.col("w")).otherwise(0.0)).alias("outer"), F.sum("w").alias("all"))
    return each.agg(F.coalesce(F.sum(F.col("outer") / F.col("all")), F.lit(0.0)).alias("cut"))


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """Propagation within one component: nodes and arcs of it, told apart by a null end."""
    nodes = pdf[pdf.j.isna()].sort_values("i")
    arcs = pdf[pdf.j.notna()]
    dens, value = dict(zip(nodes.i, nodes.dens)), dict(zip(nodes.i, nodes.pathval))
    near: dict[int, list[int]] = {}
    for i, j in sorted(set(zip(arcs.i.tolist(), arcs.j.astype(np.int64).tolist()))):
        near.setdefault(i, []).append(j)
    heap = [(-v, i) for i, v in value.items()]
    heapq.heapify(heap)
    root, pred, done, low = {}, {}, [], math.inf
    seen: set[int] = set()
    while heap:
        v, p = heapq.heappop(heap)
        if p in seen or -v != value[p]:
            continue
        seen.add(p)
        low = min(low, -v)
        if p not in pred:
            root[p], value[p] = p, dens[p]
        for q in near.get(p, ()):
            if q not in seen:
                offer = min(value[p], dens[q])
                if offer > value[q]:
                    value[q], pred[q], root[q] = offer, p, root[p]
                    heapq.heappush(heap, (-offer, q))
        done.append((p, low))
    order = [p for p, _ in done]
    return pd.DataFrame(
        {
            "position": order,
            "dens": [dens[p] for p in order],
            "pathval": [value[p] for p in order],
            "root": [root[p] for p in order],
            "pred": pd.array([pred.get(p) for p in order], "Int64"),
            "level": [x for _, x in done],
            "turn": range(len(order)),
        }
    )


def spread(arcs: DataFrame, dens: DataFrame) -> DataFrame:
    """Clusters from densities: ``position, dens, pathval, root, pred, label, rank``.

    ``label`` counts roots and ``rank`` nodes in the order one common queue would take them.
    """
    every = arcs.select("i", "j", "d").unionByName(plateau_arcs(arcs, dens))
    comp = components(every, "i", "j").withColumnRenamed("component", "c")
    nodes = dens.select(F.col("position").alias("i"), F.lit(None).cast("long").alias("j"), "dens", "pathval")
    rows = nodes.unionByName(every.select("i", "j", F.lit(None).cast("double").alias("dens"), F.lit(None).cast("double").alias("pathval")))
    tagged = rows.join(comp.withColumnRenamed("id", "i"), "i", "left").withColumn("c", F.coalesce("c", "i"))
    schema = "position long, dens double, pathval double, root long, pred long, level double, turn long"
    # a queue takes the component whose head is highest, then the smaller id, as far as its level falls
    grown = cut(tagged.groupBy("c").applyInPandas(lambda pdf: _spread(pdf.drop(columns="c")), schema))
    ranked = numbered(grown, "rank", F.desc("level"), F.col("turn"), F.col("position"))
    roots = numbered(ranked.filter("pred is null").select(F.col("position").alias("root"), "rank"), "label", F.col("rank"), start=0).drop("rank")
    return ranked.drop("level", "turn").join(roots, "root")


def best_k(samples: DataFrame, kmax: int, kmin: int = 1, metric: str | Distance = "euclid_log", distances: DataFrame | None = None) -> tuple[int, DataFrame, DataFrame]:
    """The k of least normalised cut, the cut of every k tried, and the arcs of that k.

    The k_max-NN arcs are built once; each k filters them by rank. The cut counts the arcs added
    between nodes of equal density too. The first least k wins and a cut of 0 ends the search.
    ``distances`` may hold given ``i, j, d``.
    """
    arcs = cut(knn_graph(samples, kmax, metric, distances))
    tops = {r["rank"]: r.max_d for r in max_per_rank(arcs).collect()}  # kmax rows
    best, least, tried = kmin, math.inf, []
    for k in range(kmin, kmax + 1):
        part = arcs.filter(F.col("rank") <= k)
        dens = cut(density(part, tops.get(k) or 1.0))
        full = part.select("i", "j", "d").unionByName(plateau_arcs(part, dens))
        value = normalized_cut(full, spread(part, dens)).first()[0]
        tried.append((k, float(value)))
        if value < least:
            best, least = k, value
        if value == 0:
            break
    return best, samples.sparkSession.createDataFrame(tried, "k int, cut double"), arcs.filter(F.col("rank") <= best)


def drop_height(dens: DataFrame, height: float) -> DataFrame:
    """Lowers maxima by ``height``: pathval = max(dens - height, 0)."""
    return dens.withColumn("pathval", F.greatest(F.col("dens") - height, F.lit(0.0))) if height > 0 else dens


def filter_parameter(dens: DataFrame, kind: str, share: float) -> float:
    """Absolute filter value for a share in (0, 1): of the top density, rows, or mean volume."""
    if not 0 < share < 1:
        return share
    top, total = dens.agg(F.max("dens"), F.sum("dens")).first()
    n = dens.count()
    return {"height": share * (top or 0), "area": math.floor(share * n), "volume": math.floor(share * (total or 0) / max(n, 1))}[kind]


def cluster(samples: DataFrame, kmax: int, kind: str | None = None, value: float = 0.0, metric: str | Distance = "euclid_log", distances: DataFrame | None = None) -> DataFrame:
    """The clustering program: best k, densities, optional maxima filter, clusters.

    ``kind`` is height, area or volume. Returns ``spread`` columns plus ``radius, feat, truelabel``.
    """
    _, _, arcs = best_k(samples, kmax, 1, metric, distances)
    arcs = cut(arcs)
    dens = cut(density(arcs))
    if kind is not None:
        v = filter_parameter(dens, kind, value)
        dens = cut(drop_height(dens, v) if kind == "height" else maxtree.open_maxima(dens, arcs.unionByName(plateau_arcs(arcs, dens).withColumn("rank", F.lit(0))), kind, v))
    found = spread(arcs, dens)
    return found.join(radius(arcs), "position").join(samples.select("position", "truelabel", "feat"), "position")


def root_labels(clustered: DataFrame) -> DataFrame:
    """Adds ``root_label``: the true label of the root, or cluster + 1 where labels are unknown."""
    known = clustered.select(F.col("position").alias("root"), F.col("truelabel").alias("_y"))
    return clustered.join(known, "root").withColumn("root_label", F.when(F.col("_y") > 0, F.col("_y")).otherwise(F.col("label") + 1)).drop("_y")


def knn_classify(model: DataFrame, test: DataFrame, metric: str | Distance = "euclid_log", label: str = "label", block: int = BLOCK, distances: DataFrame | None = None) -> DataFrame:
    """``test`` with the label of the first model node, by rank, whose radius it lies in, else 0.

    ``distances`` may hold given ``i`` (test), ``j`` (model), ``d``.
    """
    m = distance(metric) if isinstance(metric, str) else metric

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rank")
        inside = m.block(matrix(a.feat), matrix(b.feat)) <= b.radius.to_numpy()[None]
        at, hit = inside.argmax(1), inside.any(1)
        return pd.DataFrame({"position": a.position.to_numpy()[hit], "rank": b["rank"].to_numpy()[at[hit]], "label": b.label.to_numpy()[at[hit]]})

    base = test.drop("label")
    slim = model.select("position", "feat", "radius", "rank", F.col(label).cast("int").alias("label"))
    if distances is not None:
        got = distances.join(slim.drop("feat").withColumnRenamed("position", "j"), "j").filter("d <= radius").select(F.col("i").alias("position"), "rank", "label")
    else:
        got = meet(base.select("position", "feat"), slim, kernel, "position long, rank int, label int", block)
    best = got.groupBy("position").agg(F.min(F.struct("rank", "label")).alias("_s")).select("position", F.col("_s.label").alias("label"))
    return base.join(best, "position", "left").withColumn("label", F.coalesce("label", F.lit(0)))
