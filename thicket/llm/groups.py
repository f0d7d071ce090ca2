"""Similarity groups by bisecting k-means, and the exact links that they help to find.

Method: bisecting k-means. The node of largest dispersion is split in two again and again
until every leaf has at most ``LEAF_ROWS`` rows, or a root mean square radius of at most
``COMPACT``. Sizes, dispersions and whether the limits hold are taken over all rows.

For groups the splits are fitted on all rows too (``fit_whole``; samples only give starting
points). All rows of a leaf then go to one task, which splits them on until every part is
compact, whatever its number of rows. Groups are reported with size, dispersion, and the
members nearest to the mean.

For linked clusters the tree only decides which rows meet, not what is found, so its splits are
fitted on a bounded sample (``fit``: ``SAMPLE_ROWS`` rows of each width, and at least 200 of each
leaf that is refined, which is done in tasks; only tree nodes, one in ``LEAF_ROWS`` / 2 rows, reach the
driver).

Linked clusters (maximal sets linked by distance <= ``reach``) come from the leaves: within a
leaf, rows within reach/2 of a chosen row form a knot, all of whose members are linked to one
another, so pairs inside a knot are never listed. Knots are then linked: their centres go
down the tree once more, and at every split also to the other side when its plane lies
within reach/2 + the knot's radius, so two knots that can touch meet in a leaf. Centres
within reach are linked; knots whose balls touch but whose centres are too far apart are
compared member by member. A union over knots gives the clusters.

A leaf of many rows that cannot be split (a tight group may hold a third of all rows) is cut
into blocks of about ``BLOCK_ROWS`` rows by hash, so no task or knot exceeds a block.

Defined cases: only usable vectors take part; redelivered rows count once; vectors of
different widths are never compared; copies share a knot; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm import vectors
from thicket.plans.components import components, union_find
from thicket.plans.runtime import cut

LEAF_ROWS, BLOCK_ROWS, SAMPLE_ROWS, COMPACT = 4000, 16_000, 12_000, 1.25
#: Two-means updates of a split, in memory or over all rows.
UPDATES = 8
_KNOT = "d int, node_id long, knot long, far double, vec binary"


@dataclass
class Tree:
    """A bisecting tree: inner nodes hold two centres, leaves a number."""

    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    centre: list[np.ndarray] = field(default_factory=list)

    def add(self, centre: np.ndarray) -> int:
        self.left.append(-1)
        self.right.append(-1)
        self.centre.append(centre)
        return len(self.left) - 1

    def leaves(self) -> list[int]:
        return [i for i, x in enumerate(self.left) if x < 0]

    def walk(self, x: np.ndarray, slack: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the leaves they reach; with slack a row may reach several."""
        rows, at = [], []
        stack = [(0, np.arange(len(x)))] if self.left else []
        x = x.astype(np.float64)
        while stack:
            node, idx = stack.pop()
            if self.left[node] < 0:
                rows.append(idx)
                at.append(np.full(len(idx), node))
                continue
            a, b = self.centre[self.left[node]], self.centre[self.right[node]]
            gap = b - a
            # signed distance to the bisecting plane; negative is the left side
            off = (x[idx] @ gap - (b @ b - a @ a) / 2) / np.sqrt(gap @ gap)
            reach = 0 if slack is None else slack[idx]
            go_left, go_right = (off < 0) | (off <= reach) if slack is not None else off < 0, (off >= 0) | (off >= -reach) if slack is not None else off >= 0
            if go_left.any():
                stack.append((self.left[node], idx[go_left]))
            if go_right.any():
                stack.append((self.right[node], idx[go_right]))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *at])


def _two_means(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Two centres and the side of every row; None if the rows cannot be told apart."""
    a = x[rng.integers(len(x))]
    a = x[((x - a) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    side = None
    for _ in range(UPDATES):
        gap = b - a
        if not gap @ gap > 0:
            return None
        new = x @ gap > (b @ b - a @ a) / 2
        if new.all() or not new.any():
            return None
        if side is not None and (new == side).all():
            break
        side = new
        a, b = x[~side].mean(0), x[side].mean(0)
    gap = b - a
    side = x @ gap >= (b @ b - a @ a) / 2
    return None if side.all() or not side.any() or not gap @ gap > 0 else (a, b, side)


def grow(tree: Tree, start: int, x: np.ndarray, rows_each: float, leaf_rows: int, compact: float, seed: int) -> None:
    """Splits below ``start`` on sampled rows, each standing for ``rows_each`` rows."""
    rng = np.random.default_rng([seed, start])
    heap = []

    def push(node: int, part: np.ndarray) -> None:
        spread = ((part - part.mean(0)) ** 2).sum()
        if len(part) > 1 and len(part) * rows_each > leaf_rows and math.sqrt(spread / len(part)) > compact:
            heapq.heappush(heap, (-spread, node, part))

    push(start, x.astype(np.float64))
    while heap:
        _, node, part = heapq.heappop(heap)
        split = _two_means(part, rng)
        if split is None:
            continue
        a, b, side = split
        tree.left[node], tree.right[node] = tree.add(a), tree.add(b)
        push(tree.left[node], part[~side])
        push(tree.right[node], part[side])


_GROWN = "d int, leaf int, left array<int>, right array<int>, centres array<double>"


def _grow_each(size: dict[tuple[int, int], int], leaf_rows: int, compact: float, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The subtree below one leaf, grown from the rows drawn from it."""
        pdf = pdf.sort_values("node_id")
        d, leaf = int(pdf.d.iloc[0]), int(pdf.leaf.iloc[0])
        x = vectors.stack(pdf.feat)
        tree = Tree()
        tree.add(np.zeros(d))
        grow(tree, 0, x, size[d, leaf] / len(x), leaf_rows, compact, seed + leaf)
        return pd.DataFrame({"d": [d], "leaf": [leaf], "left": [tree.left], "right": [tree.right], "centres": [np.concatenate(tree.centre)]})

    return run


def _graft(trees: dict[int, Tree], grown: DataFrame) -> None:
    """Hangs subtrees below the leaves of the trees; only tree nodes reach the driver, never rows."""
    for r in sorted(grown.collect(), key=lambda r: (r.d, r.leaf)):
        tree, centre = trees[r.d], np.array(r.centres).reshape(-1, r.d)
        at = {0: r.leaf} | {i: tree.add(centre[i]) for i in range(1, len(r.left))}
        for i, (a, b) in enumerate(zip(r.left, r.right)):
            if a >= 0:
                tree.left[at[i]], tree.right[at[i]] = at[a], at[b]


def _leaf_stats(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows, sum and sum of squares of each leaf."""
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for d, part, x in vectors.by_width(b):
                rows, at = shared.value[d].walk(x)
                y = x[rows].astype(np.float64)
                order = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.diff(at[order])) + 1
                for idx in np.split(order, cuts):
                    t = total.setdefault((d, int(at[idx[0]])), [0, 0.0, 0.0])
                    t[0] += len(idx)
                    t[1] = t[1] + y[idx].sum(0)
                    t[2] += float((y[idx] ** 2).sum())
        if total:
            yield pd.DataFrame([(d, leaf, n, s.tolist(), q) for (d, leaf), (n, s, q) in total.items()], columns=["d", "leaf", "n", "total", "squares"])

    return run


def _stats(rows: DataFrame, shared) -> pd.DataFrame:
    """One row a leaf, over all rows."""
    parts = rows.select("d", "feat").mapInPandas(_leaf_stats(shared), "d int, leaf int, n long, total array<double>, squares double")
    sums = parts.select("d", "leaf", "n", "squares", F.posexplode("total").alias("j", "t")).groupBy("d", "leaf", "j").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("squares").alias("q"))
    out = sums.groupBy("d", "leaf").agg(F.first("n").alias("n"), F.first("q").alias("q"), F.sum(F.col("t") * F.col("t")).alias("tt")).toPandas()  # one row a leaf
    out["rms"] = np.sqrt(np.maximum(0, out.q / out.n - out.tt / out.n**2))
    return out


def fit(rows: DataFrame, leaf_rows: int = LEAF_ROWS, compact: float = COMPACT, sample: int = SAMPLE_ROWS, seed: int = 3) -> tuple[dict[int, Tree], pd.DataFrame]:
    """Trees by width whose leaves keep the limits over all rows, and the leaf table."""
    spark = rows.sparkSession
    counts = {r.d: r["count"] for r in rows.groupBy("d").count().collect()}  # one row a width
    u = F.pmod(F.xxhash64(F.lit(seed), "node_id"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.lit(0.0)
    for d, n in counts.items():
        rate = F.when(F.col("d") == d, min(1.0, sample / n)).otherwise(rate)
    drawn = rows.filter(u < rate).select("d", "feat").toPandas()  # bounded by the sample size
    trees: dict[int, Tree] = {}
    parts = {d: x for d, _, x in vectors.by_width(drawn)}
    for d, n in counts.items():
        x = parts.get(d)
        trees[d] = Tree()
        trees[d].add(np.zeros(d) if x is None else x.astype(np.float64).mean(0))
        if x is not None:
            grow(trees[d], 0, x, n / len(x), leaf_rows, compact, seed)
    for turn in range(1, 40):
        shared = spark.sparkContext.broadcast(trees)
        table = _stats(rows, shared)
        over = table[(table.n > 2 * leaf_rows) & (table.rms > compact)]
        if not len(over):
            break
        size = {(int(r.d), int(r.leaf)): int(r.n) for r in over.itertuples()}
        before = sum(len(t.left) for t in trees.values())
        each = max(200, sample // len(size))

        def pick(batches: Iterator[pd.DataFrame], shared=shared, size=size, each=each, turn=turn) -> Iterator[pd.DataFrame]:
            for b in batches:
                for d, part, x in vectors.by_width(b):
                    r, at = shared.value[d].walk(x)
                    chance = np.array([min(1.0, each / size[d, a]) if (d, a) in size else 0.0 for a in at.tolist()])
                    coin = pd.util.hash_array(part.node_id.to_numpy()[r] ^ (turn << 50)).astype(np.float64) / 2.0**64
                    got = np.flatnonzero(coin < chance)
                    if len(got):
                        yield pd.DataFrame({"d": d, "leaf": at[got], "node_id": part.node_id.to_numpy()[r[got]], "feat": part.feat.to_numpy()[r[got]]})

        more = rows.select("node_id", "d", "feat").mapInPandas(pick, "d int, leaf int, node_id long, feat array<float>")
        _graft(trees, more.groupBy("d", "leaf").applyInPandas(_grow_each(size, leaf_rows, compact, seed + turn), _GROWN))
        if sum(len(t.left) for t in trees.values()) == before:
            break
    return trees, table


def _assign(shared, salts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part, x in vectors.by_width(b):
                r, leaf = shared.value[d].walk(x)
                ids = part.node_id.to_numpy()[r]
                many = np.array([salts.get((d, v), 1) for v in leaf.tolist()])
                salt = (pd.util.hash_array(ids) % many.astype(np.uint64)).astype(np.int32)
                yield pd.DataFrame({"d": d, "leaf": leaf, "salt": salt, "node_id": ids, "vec": [v.tobytes() for v in x[r]]})

    return run


def _matrix(vec: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec), np.float32).reshape(-1, d).astype(np.float64)


def _knots(reach: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of one block to knots: each row within reach/2 of the first free row joins it."""
        pdf = pdf.drop_duplicates("node_id").sort_values("node_id").reset_index(drop=True)
        d = int(pdf.d.iloc[0])
        x, ids = _matrix(pdf.vec, d), pdf.node_id.to_numpy()
        knot, far = np.full(len(x), -1, np.int64), np.zeros(len(x))
        free = np.arange(len(x))
        while len(free):
            rest = x[free]
            # the next centre is the free row nearest to the mean of what the first one reaches
            near = ((rest - rest[0]) ** 2).sum(1) <= reach * reach / 4
            c = np.flatnonzero(near)[((rest[near] - rest[near].mean(0)) ** 2).sum(1).argmin()] if near.sum() > 2 else 0
            dist = np.sqrt(((rest - rest[c]) ** 2).sum(1))
            take = dist <= reach / 2
            knot[free[take]], far[free[take]] = ids[free[c]], dist[take]
            free = free[~take]
        return pd.DataFrame({"d": d, "node_id": ids, "knot": knot, "far": far, "vec": pdf.vec})

    return run


def _route(shared, reach: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("d"):
                x = _matrix(part.vec, int(d))
                r, leaf = shared.value[int(d)].walk(x, (reach / 2 + part.radius.to_numpy()) * (1 + 1e-9) + 1e-9)
                yield pd.DataFrame({"d": int(d), "leaf": leaf, "knot": part.knot.to_numpy()[r], "radius": part.radius.to_numpy()[r], "vec": part.vec.to_numpy()[r]})

    return run


def _link(reach: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the knots of a leaf; pairs left open have sure = false."""
        pdf = pdf.sort_values("knot").reset_index(drop=True)
        x, r, ids, n = _matrix(pdf.vec, int(pdf.d.iloc[0])), pdf.radius.to_numpy(), pdf.knot.to_numpy(), len(pdf)
        a, b, sure = [], [], []
        for lo in range(0, n, 512):
            dist = np.sqrt(vectors.squared(x[lo : lo + 512], x))
            i, j = np.nonzero(dist <= reach + r[lo : lo + 512, None] + r[None] + 1e-9)
            keep = j > i + lo
            i, j = i[keep], j[keep]
            a.append(i + lo)
            b.append(j)
            # a centre distance close to the limit is settled by the rows themselves
            sure.append(dist[i, j] <= reach - 1e-6)
        a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
        root = union_find(a[sure], b[sure], n)
        open_ = ~sure & (root[a] != root[b])
        tied = np.flatnonzero(root != np.arange(n))
        return pd.DataFrame({"a": np.concatenate([ids[tied], ids[a[open_]]]), "b": np.concatenate([ids[root[tied]], ids[b[open_]]]), "sure": np.concatenate([np.ones(len(tied), bool), np.zeros(open_.sum(), bool)])})

    return run


def _touch(reach: float):
    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        """Whether any member of one knot is within reach of a member of the other."""
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(one) or not len(two):
            return none
        d = len(one.vec1.iloc[0]) // 4
        x, y = _matrix(one.vec1, d), _matrix(two.vec2, d)
        for lo in range(0, len(x), 512):
            near = vectors.squared(x[lo : lo + 512], y)
            i, j = np.nonzero(near <= (reach + 1e-3) ** 2)
            if len(i) and (((x[lo + i] - y[j]) ** 2).sum(1) <= reach * reach).any():
                return pd.DataFrame({"a": one.a.iloc[:1], "b": one.b.iloc[:1]})
        return none

    return run


def linked(rows: DataFrame, reach: float = 2.5, least: int = 5, leaf_rows: int = LEAF_ROWS, block: int = BLOCK_ROWS, sample: int = SAMPLE_ROWS) -> DataFrame:
    """``cluster_id, node_id`` of the clusters of at least ``least`` rows linked within ``reach``.

    ``rows`` has ``node_id, d, feat``; ``cluster_id`` is the smallest ``node_id``.
    """
    spark = rows.sparkSession
    trees, table = fit(rows, leaf_rows, COMPACT, sample)
    shared = spark.sparkContext.broadcast(trees)
    salts = {(int(r.d), int(r.leaf)): int(-(-r.n // block)) for r in table.itertuples() if r.n > block} if trees else {}
    placed = rows.select("node_id", "d", "feat").mapInPandas(_assign(shared, salts), "d int, leaf int, salt int, node_id long, vec binary")
    members = cut(placed.groupBy("d", "leaf", "salt").applyInPandas(_knots(reach), _KNOT))
    knots = members.groupBy("d", "knot").agg(F.max("far").alias("radius"), F.count("*").alias("size"), F.min("node_id").alias("first"), F.max_by("vec", F.col("node_id") == F.col("knot")).alias("vec"))
    knots = cut(knots)
    routed = knots.mapInPandas(_route(shared, reach), "d int, leaf int, knot long, radius double, vec binary")
    met = cut(routed.groupBy("d", "leaf").applyInPandas(_link(reach), "a long, b long, sure boolean").distinct())
    ties = met.filter("sure").select("a", "b")
    doubtful = met.filter("not sure").select("a", "b").distinct()
    if not doubtful.isEmpty():
        # members are compared only where nothing joins two knots so far, by whatever way
        joined = cut(components(ties))
        sides = [joined.select(F.col("id").alias(x), F.col("component").alias("c" + x)) for x in "ab"]
        apart = ~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))
        doubtful = cut(doubtful.join(sides[0], "a", "left").join(sides[1], "b", "left").filter(apart).select("a", "b"))
        one = doubtful.join(members.select(F.col("knot").alias("a"), "vec"), "a")
        two = doubtful.select(F.col("a").alias("a2"), F.col("b").alias("b2")).join(members.select(F.col("knot").alias("b2"), F.col("vec").alias("vec2")), "b2")
        one, two = one.select("a", "b", F.col("vec").alias("vec1")), two.select("a2", "b2", "vec2")
        ties = ties.unionByName(one.groupBy("a", "b").cogroup(two.groupBy("a2", "b2")).applyInPandas(_touch(reach), "a long, b long"))
    joined = knots.join(components(ties).withColumnsRenamed({"id": "knot"}), "knot", "left").select("knot", "size", "first", F.coalesce("component", "knot").alias("c"))
    large = joined.groupBy("c").agg(F.sum("size").alias("size"), F.min("first").alias("cluster_id")).filter(F.col("size") >= least)
    named = joined.join(large.select("c", "cluster_id"), "c").select("knot", "cluster_id")
    return members.select("node_id", "knot").join(named, "knot").select("cluster_id", "node_id")


def _leaf_means(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of each leaf, and sum and sum of squares of their offsets from its centre."""
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for d, _, x in vectors.by_width(b):
                tree = shared.value[d]
                rows, at = tree.walk(x)
                order = np.argsort(at, kind="stable")
                for idx in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    y = x[rows[idx]] - tree.centre[at[idx[0]]]
                    t = total.setdefault((d, int(at[idx[0]])), [0, 0.0, 0.0])
                    t[0] += len(idx)
                    t[1] = t[1] + y.sum(0)
                    t[2] += float((y**2).sum())
        if total:
            yield pd.DataFrame([(d, leaf, n, s.tolist(), q) for (d, leaf), (n, s, q) in total.items()], columns=["d", "leaf", "n", "total", "squares"])

    return run


def _means(rows: DataFrame, trees: dict[int, Tree]) -> dict[tuple[int, int], tuple[int, np.ndarray, float]]:
    """Rows, mean and root mean square radius of each leaf that has rows, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    parts = rows.select("d", "feat").mapInPandas(_leaf_means(shared), "d int, leaf int, n long, total array<double>, squares double")
    sums = parts.select("d", "leaf", "n", "squares", F.posexplode("total").alias("j", "t")).groupBy("d", "leaf", "j").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("squares").alias("q"))
    table = sums.groupBy("d", "leaf").agg(F.first("n").alias("n"), F.first("q").alias("q"), F.array_sort(F.collect_list(F.struct("j", "t"))).alias("t")).collect()  # one row a leaf
    shared.unpersist()
    out = {}
    for r in table:
        off = np.array([t.t for t in r.t]) / r.n
        out[r.d, r.leaf] = (r.n, trees[r.d].centre[r.leaf] + off, math.sqrt(max(0.0, r.q / r.n - off @ off)))
    return out


def _update(trees: dict[int, Tree], means: dict[tuple[int, int], tuple[int, np.ndarray, float]], since: dict[int, int]) -> bool:
    """Moves centres numbered from ``since`` to the means of the rows that reach them.

    A split with a side that no row reaches gives way to the other side. False if nothing moved.
    """
    moved = False
    for d, tree in trees.items():
        n, total = np.zeros(len(tree.left)), np.zeros((len(tree.left), d))
        for v in range(len(n) - 1, -1, -1):  # children have larger numbers than their parent
            if tree.left[v] >= 0:
                for c in (tree.left[v], tree.right[v]):
                    n[v] += n[c]
                    total[v] += total[c]
            elif (d, v) in means:
                n[v], mean, _ = means[d, v]
                total[v] = n[v] * mean
        for v in np.flatnonzero(n > 0).tolist():
            if v >= since[d]:
                mean = total[v] / n[v]
                moved |= not np.allclose(tree.centre[v], mean, rtol=1e-9, atol=1e-9)
                tree.centre[v] = mean
            while tree.left[v] >= 0 and (n[tree.left[v]] == 0 or n[tree.right[v]] == 0):
                c = tree.left[v] if n[tree.left[v]] else tree.right[v]
                tree.left[v], tree.right[v] = tree.left[c], tree.right[c]
                moved = True
    return moved


def _farthest(shared, means):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The row of a batch farthest from the mean of its leaf, for the leaves in ``means``."""
        for b in batches:
            for d, part, x in vectors.by_width(b):
                r, at = shared.value[d].walk(x)
                for leaf in {v for v in np.unique(at).tolist() if (d, v) in means}:
                    idx = r[at == leaf]
                    away = ((x[idx] - means[d, leaf]) ** 2).sum(1)
                    yield pd.DataFrame({"d": [d], "leaf": [leaf], "away": [away.max()], "feat": [part.feat.to_numpy()[idx[away.argmax()]]]})

    return run


def fit_whole(rows: DataFrame, leaf_rows: int = LEAF_ROWS, compact: float = COMPACT, sample: int = SAMPLE_ROWS, seed: int = 3) -> tuple[dict[int, Tree], dict[tuple[int, int], tuple[int, np.ndarray, float]]]:
    """Trees by width whose splits are fitted on all rows, and rows, mean and radius of the leaves.

    Samples only give the two-means iterations their starting points: the splits of a round are
    then updated together, up to ``UPDATES`` times, to the means of all rows that reach their sides.
    A leaf that its sample cannot split starts from its mean and the row farthest from it. Rounds
    go on until every leaf has at most ``2 * leaf_rows`` rows, is compact, or has come out of
    a round unsplit because its rows cannot be told apart.
    """
    sc = rows.sparkSession.sparkContext
    trees: dict[int, Tree] = {}
    for r in rows.groupBy("d").agg(F.min_by("feat", "node_id").alias("feat")).collect():  # one row a width
        trees[r.d] = Tree()
        trees[r.d].add(np.array(r.feat))
    alike: set[tuple[int, int]] = set()
    turn = 0
    while True:
        means = _means(rows, trees)
        size = {key: n for key, (n, _, rms) in means.items() if n > 2 * leaf_rows and rms > compact and key not in alike}
        if not size:
            return trees, means
        turn += 1
        since = {d: len(t.left) for d, t in trees.items()}
        shared = sc.broadcast(trees)
        each = max(200, sample // len(size)) if turn > 1 else sample

        def pick(batches: Iterator[pd.DataFrame], shared=shared, size=size, each=each, turn=turn) -> Iterator[pd.DataFrame]:
            for b in batches:
                for d, part, x in vectors.by_width(b):
                    r, at = shared.value[d].walk(x)
                    chance = np.array([min(1.0, each / size[d, a]) if (d, a) in size else 0.0 for a in at.tolist()])
                    ids = part.node_id.to_numpy()[r]
                    got = np.flatnonzero(pd.util.hash_array(ids ^ (turn << 50)).astype(np.float64) / 2.0**64 < chance)
                    if len(got):
                        yield pd.DataFrame({"d": d, "leaf": at[got], "node_id": ids[got], "feat": part.feat.to_numpy()[r[got]]})

        drawn = rows.select("node_id", "d", "feat").mapInPandas(pick, "d int, leaf int, node_id long, feat array<float>")
        _graft(trees, drawn.groupBy("d", "leaf").applyInPandas(_grow_each(size, leaf_rows, compact, seed + turn), _GROWN))
        unsplit = {key: means[key][1] for key in size if trees[key[0]].left[key[1]] < 0}
        if unsplit:
            ends = rows.select("d", "feat").mapInPandas(_farthest(shared, unsplit), "d int, leaf int, away double, feat array<float>")
            for r in ends.groupBy("d", "leaf").agg(F.max_by("feat", "away").alias("feat")).collect():  # one row a leaf
                tree = trees[r.d]
                tree.left[r.leaf], tree.right[r.leaf] = tree.add(unsplit[r.d, r.leaf]), tree.add(np.array(r.feat))
        for _ in range(UPDATES):
            if not _update(trees, _means(rows, trees), since):
                break
        alike |= {key for key in size if trees[key[0]].left[key[1]] < 0}


def _apart(y: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """The side of every row in a split in two; None if the rows cannot be told apart."""
    split = _two_means(y, rng)
    if split is not None:
        return split[2]
    a = y[(y**2).sum(1).argmax()]
    away = ((y - a) ** 2).sum(1)
    side = ((y - y[away.argmax()]) ** 2).sum(1) < away
    return side if side.any() else None


def _split_up(compact: float, typical: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The groups of one leaf: its rows are split until every part is compact."""
        pdf = pdf.sort_values("node_id")
        d, ids = int(pdf.d.iloc[0]), pdf.node_id.to_numpy()
        x = _matrix(pdf.vec, d)
        rng = np.random.default_rng([seed, int(pdf.leaf.iloc[0])])
        todo, out = [np.arange(len(x))], []
        while todo:
            at = todo.pop()
            y = x[at] - x[at].mean(0)
            away = (y**2).sum(1)
            rms = math.sqrt(away.mean())
            side = _apart(y, rng) if rms > compact else None
            if side is None:
                out.append((d, ids[at[0]], len(at), rms, rms <= compact, ids[at[np.argsort(away, kind="stable")[:typical]]].tolist()))
            else:
                todo += [at[side], at[~side]]
        return pd.DataFrame(out, columns=["d", "leaf", "size", "rms_radius", "compact", "typical"])

    return run


def describe(rows: DataFrame, typical: int = 3, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The groups: ``d, leaf, size, rms_radius, compact, typical`` (ids of the rows nearest to the mean).

    ``leaf`` is the smallest ``node_id`` of the group. Every group has a root mean square
    radius of at most ``COMPACT``, however few its rows, unless its rows cannot be told apart
    by a split; ``compact`` is false for those. Leaves of the tree of up to
    ``2 * leaf_rows`` rows are split to the end in one task each. Rows count once per
    ``node_id``: redelivered rows are removed before.
    """
    once = cut(rows.dropDuplicates(["node_id"]))
    trees, means = fit_whole(once, leaf_rows, COMPACT, sample)
    shared = once.sparkSession.sparkContext.broadcast(trees)
    # leaves that may be too large for a task are tight, or cannot be split: groups as they are
    sizes = {key: (n, rms, rms <= COMPACT) for key, (n, _, rms) in means.items() if n > 2 * leaf_rows}
    centres = {key: means[key][1] for key in sizes}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _assign(shared, {})(batches):
            yield b[[key not in sizes for key in zip(b.d, b.leaf)]].drop(columns="salt")

    placed = once.select("node_id", "d", "feat").mapInPandas(place, "d int, leaf int, node_id long, vec binary")
    found = placed.groupBy("d", "leaf").applyInPandas(_split_up(COMPACT, typical, 3), "d int, leaf long, size long, rms_radius double, compact boolean, typical array<long>")
    if not sizes:
        return found

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part, x in vectors.by_width(b):
                r, leaf = shared.value[d].walk(x)
                mine = np.array([(d, v) in centres for v in leaf.tolist()], bool)
                if not mine.any():
                    continue
                r, leaf = r[mine], leaf[mine]
                dist = np.sqrt(((x[r] - np.stack([centres[d, v] for v in leaf.tolist()])) ** 2).sum(1))
                got = pd.DataFrame({"d": d, "leaf": leaf, "node_id": part.node_id.to_numpy()[r], "distance": dist})
                first = got.groupby("leaf").node_id.min()
                got = got.sort_values(["distance", "node_id"]).groupby("leaf").head(typical)
                yield got.assign(first=got.leaf.map(first))

    best = Window.partitionBy("d", "leaf").orderBy("distance", "node_id")
    tops = once.select("node_id", "d", "feat").mapInPandas(near, "d int, leaf int, node_id long, distance double, first long")
    tops = tops.withColumns({"r": F.row_number().over(best), "first": F.min("first").over(Window.partitionBy("d", "leaf"))}).filter(F.col("r") <= typical)
    tops = tops.groupBy("d", "leaf").agg(F.min("first").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("distance", "node_id"))), lambda t: t["node_id"]).alias("typical"))
    large = once.sparkSession.createDataFrame([(*key, *of) for key, of in sizes.items()], "d int, leaf int, size long, rms_radius double, compact boolean")
    return found.unionByName(large.join(tops, ["d", "leaf"]).select("d", F.col("first").alias("leaf"), "size", "rms_radius", "compact", "typical"))
