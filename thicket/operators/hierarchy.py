"""Parent links to full hierarchies by tree contraction.

Every node that has a parent is a link ``node -> up``. Rounds alternate *raking* (links of
nodes nobody points to are set aside) and *compression* (a node with exactly one child is
spliced out of its chain; a coin per node and round picks an independent set). Each round
leaves a geometrically smaller set of links, so all rounds together shuffle O(n) rows.
Reversing the recorded contractions gives root, depth, highest cost and path of every node.
What never contracts is a core of loops: compression shrinks each loop to a node that is its
own parent; nodes spliced into it lie on the loop, nodes raked off it lead into it.

A group (model) of at most ``local_rows`` nodes is contracted by the same rounds on numpy
arrays in one task; larger groups go through DataFrame rounds until the links left are at
most ``local_rows``, so no task ever holds an unbounded group.

Defined cases: a null, ``none`` or dangling parent ends a chain; a node may be its own
parent (a loop of one); rows with a null group or node are left out; repeated rows count
once (for differing repeats the smallest row counts); a null cost is passed over; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.plans.runtime import cut, parallelism

#: Nodes that one task may contract in memory, and path entries that it may list.
LOCAL_ROWS, LOCAL_ENTRIES = 200_000, 5_000_000
TREE, CYCLE, ASTRAY = "tree", "cycle", "astray"
_OUT = "g long, v long, root long, depth long, high double, kind string"


def contract(up: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rake and compress one forest held in arrays.

    ``up[i]`` is the index of the parent or -1, ``cost[i]`` what node i costs (NaN: nothing).
    Returns root (-1 in or behind a loop), depth, highest cost above the node (NaN: none) and
    state (0 tree, 1 on a loop, 2 behind one).
    """
    n = len(up)
    to = up.astype(np.int64).copy()
    high = np.full(n, np.nan)
    has = to >= 0
    high[has] = cost[to[has]]
    far = np.ones(n, np.int64)
    live = has.copy()
    steps: list[tuple[bool, np.ndarray, np.ndarray]] = []
    rng = np.random.default_rng(7)
    while True:
        ids = np.flatnonzero(live)
        if not len(ids):
            break
        kids = np.bincount(to[ids], minlength=n)
        leaf = ids[kids[ids] == 0]
        if len(leaf):
            steps.append((True, leaf, to[leaf]))
            live[leaf] = False
            ids = np.flatnonzero(live)
            kids = np.bincount(to[ids], minlength=n)
        # nodes with one live child are spliced, no two neighbours at once
        child = np.full(n, -1, np.int64)
        child[to[ids]] = ids
        heads = rng.random(n) < 0.5
        own = to[ids] == ids
        pick = ids[(kids[ids] == 1) & ~own & heads[ids] & ~heads[to[ids]]]
        if len(pick):
            c = child[pick]
            steps.append((False, pick, c))
            high[c] = np.fmax(high[c], high[pick])
            far[c] += far[pick]
            to[c] = to[pick]
            live[pick] = False
        elif not len(leaf) and own.all():
            break
    root = np.where(has, -1, np.arange(n))
    depth = np.zeros(n, np.int64)
    state = np.zeros(n, np.int8)
    state[live] = 1
    top = np.full(n, np.nan)
    for rake, v, other in reversed(steps):
        if rake:
            root[v], depth[v] = root[other], depth[other] + far[v]
            top[v] = np.fmax(high[v], top[other])
            state[v] = np.where(state[other] > 0, 2, 0)
        else:
            # v was spliced out between its child and its parent; both are resolved by now
            p = to[v]
            root[v], depth[v] = root[p], depth[p] + far[v]
            top[v] = np.fmax(high[v], top[p])
            state[v] = np.where(state[other] == 1, 1, np.where(state[p] > 0, 2, 0))
    return root, depth, top, state


def _parents(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """One whole group, ``g, v, p, cost`` with repeats allowed: each node once, and its parent's place or -1."""
    pdf = pdf.sort_values(["v", "p", "cost"]).drop_duplicates("v")
    v = pdf.v.to_numpy(np.int64)
    p, known = pdf.p.fillna(0).to_numpy(np.int64), pdf.p.notna().to_numpy()
    at = np.minimum(np.searchsorted(v, p), max(len(v) - 1, 0))
    return pdf, v, np.where(known & (v[at] == p), at, -1) if len(v) else p


def _local(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, v, up = _parents(pdf)
    root, depth, top, state = contract(up, pdf.cost.to_numpy(float))
    return _frame(pdf.g.to_numpy(), v, root, depth, top, state)


_PATHS = "g long, v long, root long, depth long, up long, path array<long>"


def _local_paths(entries: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A whole group with its paths; without them if they would be more than ``entries`` long together."""
        pdf, v, up = _parents(pdf)
        root, depth, _, state = contract(up, np.full(len(v), np.nan))
        tree, path = state == 0, np.full(len(v), None, object)
        if depth[tree].sum() + tree.sum() <= entries:
            for i in np.argsort(depth, kind="stable").tolist():
                if tree[i]:
                    path[i] = [*path[up[i]], int(v[i])] if up[i] >= 0 else [int(v[i])]
        out = _frame(pdf.g.to_numpy(), v, root, depth, np.full(len(v), np.nan), state)
        return out.assign(up=pd.arrays.IntegerArray(v[up], (up < 0) | ~tree), path=path)[["g", "v", "root", "depth", "up", "path"]]

    return run


def _frame(g: np.ndarray, v: np.ndarray, root: np.ndarray, depth: np.ndarray, top: np.ndarray, state: np.ndarray) -> pd.DataFrame:
    lost = state > 0
    return pd.DataFrame(
        {
            "g": g,
            "v": v,
            "root": pd.arrays.IntegerArray(v[root], lost) if len(v) else pd.array([], "Int64"),
            "depth": pd.arrays.IntegerArray(depth, lost),
            "high": pd.arrays.FloatingArray(np.nan_to_num(top), np.isnan(top)),
            "kind": np.array([TREE, CYCLE, ASTRAY])[state],
        }
    )


def _links(nodes: DataFrame) -> DataFrame:
    """Links to parents that exist: ``g, v, up, high, far``."""
    parent = nodes.select(F.col("g").alias("pg"), F.col("v").alias("up"), F.col("cost").alias("high"))
    return (
        nodes.filter("p is not null")
        .join(parent, (F.col("g") == F.col("pg")) & (F.col("p") == F.col("up")))
        .select("g", "v", "up", "high", F.lit(1).cast("long").alias("far"))
    )


def _coin(node: str, turn: int) -> F.Column:
    return F.xxhash64(F.lit(turn), F.col("g"), F.col(node)) % 2 == 0


def _merge(links: DataFrame) -> DataFrame:
    """Adds to each live link how many live children its node has, and one of them."""
    kids = links.groupBy("g", F.col("up").alias("v")).agg(F.count("*").alias("kids"), F.min("v").alias("child"))
    return links.join(kids, ["g", "v"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))


def _residual(links: DataFrame) -> DataFrame:
    """The links left, few by count, contracted in one task.

    Returns ``g, v, root, depth, high, kind`` for the nodes of these links and their ends.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        e = pd.concat(got)
        ends = e[["g", "up"]].rename(columns={"up": "v"})
        names = pd.concat([e[["g", "v"]], ends]).drop_duplicates().sort_values(["g", "v"]).reset_index(drop=True)
        at = pd.MultiIndex.from_frame(names)
        src, dst = at.get_indexer(pd.MultiIndex.from_frame(e[["g", "v"]])), at.get_indexer(pd.MultiIndex.from_frame(e[["g", "up"]]))
        root, depth, top, state = _weighted(len(names), src, dst, e.far.to_numpy(np.int64), e.high.to_numpy(float))
        yield _frame(names.g.to_numpy(), names.v.to_numpy(np.int64), root, depth, top, state)

    return links.select("g", "v", "up", "high", "far").coalesce(1).mapInPandas(solve, _OUT)


def _weighted(n: int, src: np.ndarray, dst: np.ndarray, far: np.ndarray, high: np.ndarray) -> tuple:
    """contract() where the link of a node has its own length and cost."""
    up, link_high, link_far = np.full(n, -1, np.int64), np.full(n, np.nan), np.ones(n, np.int64)
    up[src], link_high[src], link_far[src] = dst, high, far
    # a link's cost and length sit on a node put between its two ends
    wide = np.full(2 * n, -1, np.int64)
    linked = np.flatnonzero(up >= 0)
    wide[linked], wide[n + linked] = n + linked, up[linked]
    cost = np.full(2 * n, np.nan)
    cost[n + linked] = link_high[linked]
    root, depth, top, state = contract(wide, cost)
    root, state = root[:n], state[:n]
    # lengths: walk the links once more in order of their unweighted depth
    total, order = np.zeros(n, np.int64), np.argsort(depth[:n], kind="stable")
    for i in order[(up[order] >= 0) & (state[order] == 0)]:
        total[i] = total[up[i]] + link_far[i]
    return root, total, top[:n], state


def _rounds(nodes: DataFrame, local_rows: int) -> DataFrame:
    """Contraction by DataFrame rounds, for groups too large for a task."""
    live, loops = cut(_links(nodes)), None
    steps: list[tuple[str, DataFrame]] = []
    turn = 0
    while live.limit(local_rows + 1).count() > local_rows:
        turn += 1
        # a node that is its own parent is a finished core; what hangs on it goes on contracting
        closed = live.filter("v = up")
        loops = closed if loops is None else loops.unionByName(closed)
        live = live.filter("v != up")
        marked = cut(_merge(live))
        steps.append(("rake", marked.filter("kids = 0").select("g", "v", "up", "high", "far")))
        kept = marked.filter("kids > 0").select("g", "v", "up", "high", "far")
        again = cut(_merge(kept))
        pick = again.filter((F.col("kids") == 1) & _coin("v", turn) & ~_coin("up", turn))
        # a node without live children is raked in the next round
        out = pick.select("g", "v", "up", "high", "far", "child")
        steps.append(("splice", out))
        over = out.select(F.col("g").alias("og"), F.col("child").alias("oc"), F.col("up").alias("ou"), F.col("high").alias("oh"), F.col("far").alias("of"))
        rest = again.join(out.select("g", "v"), ["g", "v"], "left_anti").join(over, (F.col("g") == F.col("og")) & (F.col("v") == F.col("oc")), "left")
        live = cut(
            rest.select(
                "g",
                "v",
                F.coalesce("ou", "up").alias("up"),
                F.greatest("high", "oh").alias("high"),
                (F.col("far") + F.coalesce("of", F.lit(0))).alias("far"),
            )
        )
    ends = nodes.join(_links(nodes).select("g", "v"), ["g", "v"], "left_anti")
    lone = ends.select("g", "v", F.col("v").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("double").alias("high"), F.lit(TREE).alias("kind"))
    done = lone
    if loops is not None:
        ups = live.select("g", F.col("up").alias("v")).distinct()
        live = live.unionByName(loops.join(ups, ["g", "v"], "left_semi"))
        done = done.unionByName(loops.select("g", "v", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("depth"), "high", F.lit(CYCLE).alias("kind")))
    width = parallelism(nodes.sparkSession)
    done = cut(done.unionByName(_residual(live).join(done.select("g", "v"), ["g", "v"], "left_anti")).coalesce(width))
    for kind, step in reversed(steps):
        up = done.select(F.col("g").alias("ug"), F.col("v").alias("uv"), F.col("root"), F.col("depth").alias("udepth"), F.col("high").alias("uhigh"), F.col("kind").alias("ukind"))
        found = step.join(up, (F.col("g") == F.col("ug")) & (F.col("up") == F.col("uv")))
        state = F.when(F.col("ukind") == TREE, TREE).otherwise(ASTRAY)
        if kind == "splice":
            below = done.filter(F.col("kind") == CYCLE).select(F.col("g").alias("bg"), F.col("v").alias("bv"))
            found = found.join(below, (F.col("g") == F.col("bg")) & (F.col("child") == F.col("bv")), "left")
            state = F.when(F.col("bv").isNotNull(), CYCLE).otherwise(state)
        solved = found.select("g", "v", "root", (F.col("udepth") + F.col("far")).alias("depth"), F.greatest("high", "uhigh").alias("high"), state.alias("kind"))
        done = cut(done.unionByName(solved).coalesce(width))
    return done


def resolve(
    nodes: DataFrame,
    group: str = "model_id",
    node: str = "position",
    parent: str = "pred",
    cost: str = "pathval",
    none: int = -1,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Root, depth and highest ancestor cost of every node.

    Returns ``group, node, root, depth, high, kind``: ``kind`` is ``tree``, ``cycle`` or
    ``astray``; ``root`` and ``depth`` are null unless ``tree``; ``high`` is the greatest
    non-null ``cost`` of the strict ancestors (null: none).
    """
    slim = nodes.select(
        F.col(group).cast("long").alias("g"),
        F.col(node).cast("long").alias("v"),
        F.when(F.col(parent) != none, F.col(parent)).cast("long").alias("p"),
        F.col(cost).cast("double").alias("cost"),
    ).filter("g is not null and v is not null")
    sizes = slim.groupBy("g").count()
    large = sizes.filter(F.col("count") > local_rows).select("g")
    if large.isEmpty():
        out = slim.groupBy("g").applyInPandas(_local, _OUT)
    else:
        large = cut(large)
        single = slim.groupBy("g", "v").agg(F.min(F.struct(F.coalesce("p", F.lit(2**62)).alias("o"), "p", "cost")).alias("s")).select("g", "v", "s.p", "s.cost")
        small = slim.join(large, "g", "left_anti").groupBy("g").applyInPandas(_local, _OUT)
        out = small.unionByName(_rounds(cut(single.join(large, "g", "left_semi")), local_rows))
    return out.select(F.col("g").alias(group), F.col("v").alias(node), "root", "depth", "high", "kind")


def contradictions(nodes: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``model_id, position, kind``: loops, what leads into them, wrong roots and costs.

    ``root``: the stored root is null or not the end of the chain. ``cost``: ``pathval`` is
    lower than that of some ancestor. Repeated rows count once.
    """
    stored = nodes.groupBy("model_id", "position").agg(F.min(F.struct(F.coalesce("pred", F.lit(2**62)).alias("o"), "pathval", F.col("root").alias("stored"))).alias("s"))
    stored = stored.select("model_id", "position", "s.pathval", "s.stored")
    solved = resolve(nodes, local_rows=local_rows)
    both = stored.join(solved, ["model_id", "position"])
    tree = F.col("kind") == TREE
    kinds = F.array_compact(
        F.array(
            F.when(~tree, F.col("kind")),
            F.when(tree & ~F.col("stored").eqNullSafe(F.col("root")), F.lit("root")),
            F.when(tree & (F.col("pathval") < F.col("high")), F.lit("cost")),
        )
    )
    return both.select("model_id", "position", F.explode(kinds).alias("kind"))


def paths(nodes: DataFrame, group: str = "model_id", node: str = "position", parent: str = "pred", none: int = -1, local_rows: int = LOCAL_ROWS, entries: int = LOCAL_ENTRIES) -> DataFrame:
    """``group, node, root, depth, path``: the nodes from the root down to the node.

    Nodes in or behind a loop have a null path. A group of at most ``local_rows`` nodes whose paths have
    at most ``entries`` entries lists them in the task that contracts it. Longer paths are
    assembled by doubling: after round i every node knows its nearest 2^i ancestors, so
    log2(depth) joins on (group, node) suffice and no group is gathered in a task.
    """
    slim = nodes.select(
        F.col(group).cast("long").alias("g"),
        F.col(node).cast("long").alias("v"),
        F.when(F.col(parent) != none, F.col(parent)).cast("long").alias("p"),
        F.lit(None).cast("double").alias("cost"),
    ).filter("g is not null and v is not null")
    large = slim.groupBy("g").count().filter(F.col("count") > local_rows).select("g")
    if large.isEmpty():
        known, rest = cut(slim.groupBy("g").applyInPandas(_local_paths(entries), _PATHS)), None
    else:
        large = cut(large)
        known = cut(slim.join(large, "g", "left_anti").groupBy("g").applyInPandas(_local_paths(entries), _PATHS))
        most = slim.join(large, "g", "left_semi")
        solved = cut(resolve(most, "g", "v", "p", "cost", none, local_rows))
        parents = most.groupBy("g", "v").agg(F.min(F.coalesce("p", F.lit(2**62))).alias("up"))
        rest = solved.join(parents, ["g", "v"]).select("g", "v", "root", "depth", F.when(F.col("depth") > 0, F.col("up")).alias("up"), F.lit(None).cast("array<long>").alias("path"))
    open_ = known.filter("depth is not null and path is null")
    if rest is not None:
        open_ = open_.unionByName(rest.filter("depth is not null"))
        known = known.unionByName(rest.filter("depth is null"))
    done = known.filter("depth is null or path is not null")
    if not open_.isEmpty():
        done = done.unionByName(_doubled(open_))
    return done.select(F.col("g").alias(group), F.col("v").alias(node), "root", "depth", "path")


def _doubled(nodes: DataFrame) -> DataFrame:
    """Paths of tree nodes ``g, v, root, depth, up`` by doubling."""
    state = cut(nodes.withColumn("path", F.array("v")))
    while not state.filter("up is not null").isEmpty():
        above = state.select(F.col("g").alias("ag"), F.col("v").alias("av"), F.col("up").alias("aup"), F.col("path").alias("apath"))
        moved = state.join(above, (F.col("g") == F.col("ag")) & (F.col("up") == F.col("av")), "left")
        state = cut(moved.select("g", "v", "root", "depth", F.col("aup").alias("up"), F.when(F.col("apath").isNull(), F.col("path")).otherwise(F.concat("apath", "path")).alias("path")))
    return state


def descendants(with_paths: DataFrame, group: str = "model_id", node: str = "position") -> DataFrame:
    """``group, ancestor, descendant, steps`` for every strict ancestor of every node."""
    at = F.posexplode("path").alias("at", "ancestor")
    return with_paths.filter("depth > 0").select(group, F.col(node).alias("descendant"), "depth", at).filter("at < depth").select(group, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("steps"))
