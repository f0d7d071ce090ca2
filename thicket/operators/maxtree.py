"""Component trees of density maps, and maxima filters on them.

A tree node is a connected set of nodes whose integer density reaches a level. Components of
the arc graph have trees of their own, so each is built in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.plans.components import components


class MaxTree:
    """Nodes by descending level; ``parent`` is -1 at the root; ``of`` maps input to node."""

    def __init__(self, level: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        n = len(level)
        near: list[list[int]] = [[] for _ in range(n)]
        for i, j in zip(a.tolist(), b.tolist()):
            near[i].append(j)
            near[j].append(i)
        up = list(range(n))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        of, top = np.full(n, -1), {}
        self.level: list[int] = []
        self.parent: list[int] = []
        self.size: list[int] = []
        order = np.argsort(-level, kind="stable")
        at = 0
        while at < n:
            v = level[order[at]]
            group = []
            while at < n and level[order[at]] == v:
                group.append(int(order[at]))
                at += 1
            inside = set(group)
            below: list[tuple[int, int]] = []
            for x in group:
                for y in near[x]:
                    if level[y] > v or y in inside:
                        r, s = find(x), find(y)
                        if r != s:
                            for t in (r, s):
                                if t in top:
                                    below.append((top.pop(t), x))
                            up[s] = r
            made: dict[int, int] = {}
            for x in group:
                r = find(x)
                if r not in made:
                    made[r] = len(self.level)
                    self.level.append(int(v))
                    self.parent.append(-1)
                    self.size.append(0)
                of[x] = made[r]
                self.size[made[r]] += 1
            for node, x in below:
                self.parent[node] = made[find(x)]
                self.size[made[find(x)]] += self.size[node]
            for r, node in made.items():
                top[r] = node
        self.of = of

    def leaves(self) -> list[int]:
        inner = {p for p in self.parent if p >= 0}
        return [i for i in range(len(self.level)) if i not in inner]

    def opened(self, kind: str, limit: float) -> np.ndarray:
        """Level of every input after small maxima are cut off by area or volume."""
        out = dict(enumerate(self.level))
        for leaf in self.leaves():
            node, total, way = leaf, 0.0, []
            while self.parent[node] >= 0:
                p = self.parent[node]
                total = self.size[node] if kind == "area" else total + abs(self.level[node] - self.level[p]) * self.size[node]
                if total > limit:
                    break
                way.append(node)
                node = p
            for x in way:
                out[x] = self.level[node] if out[x] == self.level[x] else max(out[x], self.level[node])
        return np.array([out[x] for x in self.of.tolist()], float)


def open_maxima(dens: DataFrame, arcs: DataFrame, kind: str, limit: float) -> DataFrame:
    """``position, dens, pathval``: pathval = max(opened level - 1, 0). Kind is area or volume."""
    if kind not in ("area", "volume"):
        raise ValueError(f"unknown filter {kind!r}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, edges = pdf[pdf.j.isna()].sort_values("i"), pdf[pdf.j.notna()]
        ids = nodes.i.to_numpy()
        tree = MaxTree(nodes.dens.to_numpy().astype(np.int64), np.searchsorted(ids, edges.i), np.searchsorted(ids, edges.j.astype(np.int64)))
        return pd.DataFrame({"position": ids, "dens": nodes.dens.to_numpy(), "pathval": np.maximum(tree.opened(kind, limit) - 1, 0.0)})

    comp = components(arcs, "i", "j").withColumnsRenamed({"id": "i", "component": "c"})
    rows = dens.select(F.col("position").alias("i"), F.lit(None).cast("long").alias("j"), "dens").unionByName(arcs.select("i", "j", F.lit(None).cast("double").alias("dens")))
    tagged = rows.join(comp, "i", "left").withColumn("c", F.coalesce("c", "i"))
    return tagged.groupBy("c").applyInPandas(run, "position long, dens double, pathval double")
