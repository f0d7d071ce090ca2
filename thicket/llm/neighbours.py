"""Most similar vectors by a permutation index.

Method: a bounded sample of vectors are pivots. Every vector is represented by the order of
its ``PREFIX`` nearest pivots and posted in the inverted files of the first ``FILES`` of them. A query
visits the files of its own first ``VISITS`` pivots, where postings are ranked by the footrule distance
between the two orders; only the best ``CANDIDATES`` for each neighbour wanted, over all files, have
their vectors fetched and are reranked by true distance (``candidates``).

What the footrule missed is then sought with the triangle inequality (``exact``): the k-th
candidate bounds the distance of the k-th neighbour, and a vector is looked at again only
if neither the ball and bisector bounds of the file of its nearest pivot nor its stored distance to
that pivot put it beyond the bound. The better the footrule's candidates, the less is left to
look at; the result is exact for any pivots and any orders.

For the exact part a file is kept in rings of distance to its pivot, each twice as wide as the last, so a
few far postings do not blur the bounds of a tight core; far rings of ``MERGED`` files share a block.

Pivots are ``PIVOTS_PER_ROOT`` times the square root of the number of vectors, ``MAX_PIVOTS``
at most; every vector is indexed. Files over ``FILE_ROWS`` are salted into blocks, so a
hot pivot or a group of copies is shared by many tasks.

Defined cases: only usable vectors are indexed or searched; a query never finds its own
``node_id``; redelivered rows count once; ties go to the smaller ``node_id``; null or
non-positive ``k`` finds nothing; fewer than k others give what there is; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm import vectors
from thicket.plans.runtime import cut, sized_broadcast

PIVOTS_PER_ROOT, MAX_PIVOTS, PREFIX = 0.7, 2048, 20
#: Inverted files that a vector is posted in, and that a query visits.
FILES, VISITS = 2, 12
#: Candidates reranked for each neighbour wanted, and at least.
CANDIDATES, LEAST = 16, 384
#: Stands for a footrule distance beyond all others.
_AWAY = 32767
#: Postings of a block, and the largest k that the file radii serve (larger k visits more).
FILE_ROWS, RADIUS_RANK = 16_000, 32
#: Rings of a file, the first of those that are merged, and the files merged into a block.
RINGS, OUTER, MERGED = 8, 3, 16
_POSTED = "d int, cell int, node_id long, far double, perm binary, vec binary"
_ENTRY = "d int, pivot int, salt int, node_id long, perm binary"
_ASK = "d int, pivot int, salt int, home boolean, probe_id long, self_id long, k int, perm binary"
_RANKED = "probe_id long, d int, k int, node_id long, foot int"
_VISIT = "d int, box int, salt int, probe_id long, self_id long, k int, top double, vec binary"
_FOUND = "probe_id long, k int, node_id long, distance double"


@dataclass
class Index:
    """Pivots by width, and one posting a vector: nearest pivot, distance to it, order and vector."""

    pivots: dict[int, np.ndarray]
    posted: DataFrame
    block: int


def _pivots(rows: DataFrame, counts: dict[int, int], per_root: float, seed: int) -> dict[int, np.ndarray]:
    """Distinct sampled vectors of each width; the sample is bounded by MAX_PIVOTS."""
    want = {d: min(MAX_PIVOTS, max(8, math.ceil(per_root * math.sqrt(n)))) for d, n in counts.items()}
    rate = F.lit(0.0)
    for d, n in counts.items():
        rate = F.when(F.col("d") == d, min(1.0, 2 * want[d] / max(n, 1) + 16 / max(n, 1))).otherwise(rate)
    u = F.pmod(F.xxhash64(F.lit(seed), "node_id"), F.lit(1 << 40)) / float(1 << 40)
    got = rows.filter(u < rate).select("d", "feat").toPandas()  # about twice want: bounded
    out = {}
    for d, _, x in vectors.by_width(got):
        x = np.unique(x, axis=0)
        out[d] = x[np.random.default_rng(seed).permutation(len(x))[: want[d]]]
    return out


def _nearest(x: np.ndarray, piv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the PREFIX nearest pivots and all distances."""
    dist = np.sqrt(vectors.squared(x, piv))
    m = min(PREFIX, len(piv))
    near = np.argpartition(dist, m - 1, axis=1)[:, :m]
    order = np.take_along_axis(near, np.argsort(np.take_along_axis(dist, near, 1), axis=1, kind="stable"), 1)
    return order, dist


def _index(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part, x in vectors.by_width(b):
                piv = shared.value[d]
                for lo in range(0, len(x), 2048):
                    y = x[lo : lo + 2048]
                    order, dist = _nearest(y, piv)
                    far = dist[np.arange(len(y)), order[:, 0]]
                    perm = order.astype(np.int16)
                    yield pd.DataFrame({"d": d, "cell": order[:, 0], "node_id": part.node_id.to_numpy()[lo : lo + 2048], "far": far, "perm": [p.tobytes() for p in perm], "vec": [v.tobytes() for v in y]})

    return run


def _spread_over(salts: dict[tuple[int, int], int], d: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and salts of asks that must reach every salt of their file."""
    many = np.array([salts.get((d, v), 1) for v in key.tolist()], np.int64)
    row = np.repeat(np.arange(len(key)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _entries(salts: dict[tuple[int, int], int], files: int = FILES):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The inverted files: a posting for each of the first pivots of a vector."""
        for b in batches:
            for d, part in b.groupby("d"):
                perm = np.frombuffer(b"".join(part.perm), np.int16).reshape(len(part), -1)[:, :files]
                row, pivot = np.repeat(np.arange(len(part)), perm.shape[1]), perm.ravel().astype(np.int64)
                ids = part.node_id.to_numpy()[row]
                many = np.array([salts.get((int(d), v), 1) for v in pivot.tolist()], np.uint64)
                yield pd.DataFrame({"d": int(d), "pivot": pivot, "salt": (pd.util.hash_array(ids) % many).astype(np.int64), "node_id": ids, "perm": part.perm.to_numpy()[row]})

    return run


def _asks(shared, salts: dict[tuple[int, int], int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every query, once for each file it visits."""
        for b in batches:
            for d, part, x in vectors.by_width(b):
                if d not in shared.value:
                    continue
                order = _nearest(x, shared.value[d])[0].astype(np.int16)
                first = order[:, :VISITS]
                row, pivot = np.repeat(np.arange(len(x)), first.shape[1]), first.ravel().astype(np.int64)
                at, salt = _spread_over(salts, d, pivot)
                row, pivot, home = row[at], pivot[at], (np.arange(len(row)) % first.shape[1] == 0)[at]
                perm = np.array([o.tobytes() for o in order] + [b""], object)[:-1]
                yield pd.DataFrame({"d": d, "pivot": pivot, "salt": salt, "home": home, "probe_id": part.probe_id.to_numpy()[row], "self_id": part.node_id.to_numpy()[row], "k": part.k.to_numpy()[row], "perm": perm[row]})

    return run


def _places(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Where each pivot stands in each order of ``mine``; behind the last if it is missing."""
    width = int(max(mine.max(initial=0), theirs.max(initial=0))) + 1
    place = np.full((len(mine), width), theirs.shape[1], np.int8)
    np.put_along_axis(place, mine.astype(np.int64), np.arange(mine.shape[1], dtype=np.int8)[None], 1)
    return place


def footrule(place: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Footrule distances between orders of pivots, the first given by ``_places``."""
    m = theirs.shape[1]
    foot = np.zeros((len(place), len(theirs)), np.int16)
    for j in range(m):
        foot += np.abs(place[:, theirs[:, j]] - np.int8(j))
    return foot


def _rank(entries: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    """One block of an inverted file: the postings of best footrule for each query."""
    out = []
    if len(entries) and len(asks):
        entries = entries.drop_duplicates("node_id").sort_values("node_id")
        ids, n, pivot = entries.node_id.to_numpy(), len(entries), int(entries["pivot"].iloc[0])
        perm = np.frombuffer(b"".join(entries.perm), np.int16).reshape(n, -1)
        mine = np.frombuffer(b"".join(asks.perm), np.int16).reshape(len(asks), -1)
        selves, probes, k, most = asks.self_id.to_numpy(), asks.probe_id.to_numpy(), asks.k.to_numpy(np.int64), asks.most.to_numpy()
        step = max(1, 4_000_000 // n)
        for lo in range(0, len(asks), step):
            place = _places(mine[lo : lo + step], perm)
            foot = footrule(place, perm)
            away = np.int16(_AWAY)
            foot[ids[None] == selves[lo : lo + step, None]] = away
            for j in range(FILES - 1):
                # a posting that the query also meets in a file of higher order is left to that file
                behind = np.flatnonzero((perm[:, : j + 1] != pivot).all(1)) if j < perm.shape[1] else []
                foot[:, behind] = np.where(place[:, perm[behind, j]] < VISITS, away, foot[:, behind])
            for i, want in enumerate(np.maximum(LEAST, CANDIDATES * k[lo : lo + step]).tolist()):
                best = np.flatnonzero((foot[i] <= most[lo + i]) & (foot[i] < away))
                if len(best) > want:
                    # ids are sorted, so the place breaks ties by id
                    best = best[np.argpartition(foot[i, best].astype(np.int64) * n + best, want - 1)[:want]]
                out.append(pd.DataFrame({"probe_id": probes[lo + i], "d": entries.d.iloc[0], "k": k[lo + i], "node_id": ids[best], "foot": foot[i, best]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("probe_id", "d", "k", "node_id", "foot")})


def _bound(entries: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    """The footrule within which one block alone has as many postings as are wanted."""
    out = []
    if len(entries) and len(asks):
        entries = entries.drop_duplicates("node_id")
        ids, n = entries.node_id.to_numpy(), len(entries)
        perm = np.frombuffer(b"".join(entries.perm), np.int16).reshape(n, -1)
        mine = np.frombuffer(b"".join(asks.perm), np.int16).reshape(len(asks), -1)
        for i, (probe, self_id, k) in enumerate(zip(asks.probe_id.tolist(), asks.self_id.tolist(), asks.k.tolist())):
            want = max(LEAST, CANDIDATES * k)
            if n > want:
                foot = footrule(_places(mine[i : i + 1], perm), perm)[0][ids != self_id]
                out.append((probe, int(np.partition(foot, want - 1)[want - 1])))
    return pd.DataFrame(out, columns=["probe_id", "most"]).astype("int64")


def _rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """True distances of fetched candidates."""
    for b in batches:
        for _, part in b.groupby("d"):
            x, y = (np.frombuffer(b"".join(part[c]), np.float32).reshape(len(part), -1).astype(np.float64) for c in ("vec", "qvec"))
            yield pd.DataFrame({"probe_id": part.probe_id, "k": part.k, "node_id": part.node_id, "distance": np.sqrt(((x - y) ** 2).sum(1))})


def _visits(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks that may hold a vector as near as the k-th candidate."""
        pivots, files = shared.value
        for b in batches:
            for d, part, x in vectors.by_width(b):
                if d not in pivots:
                    continue
                piv, f = pivots[d], files[d]
                between = np.sqrt(vectors.squared(piv, piv))
                for lo in range(0, len(x), 128):
                    y, sub = x[lo : lo + 128], part.iloc[lo : lo + 128]
                    order, dist = _nearest(y, piv)
                    k = sub.k.to_numpy(np.int64)
                    # some file holds k vectors within this distance; one rank more for the query itself
                    top = np.array([(dist[i] + f["near"][:, j]).min() if j <= RADIUS_RANK else np.inf for i, j in enumerate(k.tolist())])
                    top = np.fmin(top, sub.limit.to_numpy(float)) * (1 + 1e-6) + 1e-6
                    own = dist[np.arange(len(y)), order[:, 0]]
                    gap = between[order[:, 0]]
                    bisect = np.where(gap > 1e-9, (dist**2 - own[:, None] ** 2) / (2 * np.maximum(gap, 1e-9)), 0)
                    at = dist[:, f["cell"]]
                    bound = np.maximum(np.maximum(at - f["hi"], f["lo"] - at), bisect[:, f["cell"]])
                    row, file = np.nonzero(bound <= top[:, None])
                    go = np.unique(np.stack([row, f["box"][file]], 1), axis=0)
                    row, box = go[:, 0], go[:, 1]
                    at, salt = _spread_over(f["salts"], d, box)
                    row, box = row[at], box[at]
                    vec = np.array([v.tobytes() for v in y] + [b""], object)[:-1]
                    yield pd.DataFrame({"d": d, "box": box, "salt": salt, "probe_id": sub.probe_id.to_numpy()[row], "self_id": sub.node_id.to_numpy()[row], "k": k[row], "top": top[row], "vec": vec[row]})

    return run


def _search(shared):
    def run(posts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """One block and the queries that visit it: what their bounds cannot exclude."""
        out = []
        if len(posts) and len(asks):
            posts = posts.drop_duplicates("node_id").sort_values("node_id")
            d = int(posts.d.iloc[0])
            x = np.frombuffer(b"".join(posts.vec), np.float32).reshape(len(posts), d).astype(np.float64)
            y = np.frombuffer(b"".join(asks.vec), np.float32).reshape(len(asks), d).astype(np.float64)
            ids, far = posts.node_id.to_numpy(), posts.far.to_numpy()
            cells, cell = np.unique(posts.cell.to_numpy(), return_inverse=True)
            away = np.sqrt(vectors.squared(y, shared.value[0][d][cells]))
            for i, (probe, self_id, k, top) in enumerate(zip(asks.probe_id.tolist(), asks.self_id.tolist(), asks.k.tolist(), asks.top.tolist())):
                # the triangle inequality on the stored distance of a posting to its pivot
                col = np.flatnonzero((np.abs(away[i, cell] - far) <= top + 1e-3) & (ids != self_id))
                true = np.sqrt(((x[col] - y[i]) ** 2).sum(1))
                col, true = col[true <= top], true[true <= top]
                best = np.lexsort((ids[col], true))[:k]
                if len(best):
                    out.append(pd.DataFrame({"probe_id": probe, "k": k, "node_id": ids[col[best]], "distance": true[best]}))
        return pd.concat(out) if out else pd.DataFrame({"probe_id": np.zeros(0, np.int64), "k": np.zeros(0, np.int32), "node_id": np.zeros(0, np.int64), "distance": np.zeros(0)})

    return run


def build(index: DataFrame, per_root: float = PIVOTS_PER_ROOT, block: int = FILE_ROWS, seed: int = 3) -> Index | None:
    """The permutation index of ``node_id, d, feat``; None if there are no rows."""
    counts = {r.d: r["count"] for r in index.groupBy("d").count().collect()}  # one row a width
    pivots = _pivots(index, counts, per_root, seed)
    if not pivots:
        return None
    shared = index.sparkSession.sparkContext.broadcast(pivots)
    return Index(pivots, cut(index.select("node_id", "d", "feat").mapInPandas(_index(shared), _POSTED)), block)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.filter("k > 0").select("probe_id", "node_id", "d", "feat", F.col("k").cast("int").alias("k")).dropDuplicates(["probe_id"])


def candidates(index: Index, asks: DataFrame) -> DataFrame:
    """``probe_id, k, node_id, distance`` of what the footrule puts first, with true distances; redelivered rows repeat.

    ``asks`` are queries as ``_asked`` gives them.
    """
    posted, spark = index.posted, asks.sparkSession
    shared = spark.sparkContext.broadcast(index.pivots)
    sizes = posted.select("d", "node_id", "perm").mapInPandas(_entries({}), _ENTRY).groupBy("d", "pivot").count().collect()  # FILES * MAX_PIVOTS rows a width at most
    salts = {(r.d, r.pivot): -(-r["count"] // index.block) for r in sizes if r["count"] > index.block}
    went = cut(asks.mapInPandas(_asks(shared, salts), _ASK))
    open_files = F.broadcast(went.select("d", "pivot").distinct())  # MAX_PIVOTS rows a width at most
    files = posted.select("d", "node_id", "perm").mapInPandas(_entries(salts), _ENTRY).join(open_files, ["d", "pivot"], "left_semi")
    by = ["d", "pivot", "salt"]
    want = F.greatest(F.lit(LEAST), F.lit(CANDIDATES) * F.col("k"))
    best = Window.partitionBy("probe_id").orderBy("foot", "node_id")
    # the file of the nearest pivot bounds the footrule of postings worth sending on from any file
    home = went.filter("home")
    core = posted.select("d", "node_id", "perm").mapInPandas(_entries(salts, 1), _ENTRY).join(open_files, ["d", "pivot"], "left_semi")
    bound = core.groupBy(by).cogroup(home.groupBy(by)).applyInPandas(_bound, "probe_id long, most long").groupBy("probe_id").agg(F.min("most").cast("int").alias("most"))
    bound = cut(bound)
    bounded = went.join(bound, "probe_id", "left").withColumn("most", F.coalesce("most", F.lit(_AWAY)))
    ranked = files.groupBy(by).cogroup(bounded.groupBy(by)).applyInPandas(_rank, _RANKED)
    chosen = ranked.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= want).select("probe_id", "d", "k", "node_id")
    vec = sized_broadcast(asks.mapInPandas(_packed, "probe_id long, qvec binary"))
    fetched = chosen.join(posted.select("d", "node_id", "vec"), ["d", "node_id"]).join(vec, "probe_id")
    return fetched.mapInPandas(_rerank, _FOUND)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"probe_id": b.probe_id, "qvec": [np.asarray(v, np.float32).tobytes() for v in b.feat]})


def _nearest_k(found: DataFrame) -> DataFrame:
    """The k nearest; rows that repeat through redelivery share a rank and count once."""
    best = Window.partitionBy("probe_id").orderBy("distance", "node_id")
    return found.withColumn("rank", F.dense_rank().over(best)).filter("rank <= k").dropDuplicates(["probe_id", "rank"])


def neighbours(index: DataFrame, queries: DataFrame, per_root: float = PIVOTS_PER_ROOT, block: int = FILE_ROWS, seed: int = 3, exact: bool = True) -> DataFrame:
    """``probe_id, node_id, distance, rank`` of the k nearest vectors of every query.

    ``index`` has ``node_id, d, feat``; ``queries`` has ``probe_id, node_id, d, feat, k``. Without
    ``exact`` the reranked candidates are the result.
    """
    spark = index.sparkSession
    built = build(index, per_root, block, seed)
    if built is None:
        return spark.createDataFrame([], "probe_id long, node_id long, distance double, rank int")
    asks = cut(_asked(queries))
    near = _nearest_k(candidates(built, asks))
    if not exact:
        return near.select("probe_id", "node_id", "distance", "rank")
    near = cut(near)
    files, scale = _file_table(built.posted, built.pivots, block)
    book = spark.sparkContext.broadcast((built.pivots, files))
    # bounds only where k candidates were found
    limits = near.filter("rank = k").select("probe_id", F.col("distance").alias("limit"))
    visits = asks.join(limits, "probe_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))).mapInPandas(_visits(book), _VISIT)
    shared_boxes = [(d, b, n) for d, f in files.items() for (_, b), n in f["salts"].items()]
    salts = spark.createDataFrame(shared_boxes, "d int, box int, salts int")
    boxed = built.posted.withColumn("box", _box(F.col("cell"), _ring(scale)))
    salted = boxed.join(F.broadcast(salts), ["d", "box"], "left").withColumn("salt", F.pmod(F.xxhash64("node_id"), F.coalesce("salts", F.lit(1))).cast("int"))  # at most RINGS * MAX_PIVOTS rows a width
    visits = cut(visits)
    seen = F.broadcast(visits.select("d", "box").distinct())  # at most RINGS * MAX_PIVOTS rows a width
    slim = salted.select("d", "box", "salt", "cell", "far", "node_id", "vec").join(seen, ["d", "box"], "left_semi")
    hits = slim.groupBy("d", "box", "salt").cogroup(visits.groupBy("d", "box", "salt")).applyInPandas(_search(book), _FOUND)
    every = near.select("probe_id", "k", "node_id", "distance").unionByName(hits).groupBy("probe_id", "k", "node_id").agg(F.min("distance").alias("distance"))
    return _nearest_k(every).select("probe_id", "node_id", "distance", "rank")


def _ring(scale: dict[int, float]) -> Column:
    """Ring of a posting: each ring is twice as wide as the one before."""
    unit = F.lit(1.0)
    for d, v in scale.items():
        unit = F.when(F.col("d") == d, v).otherwise(unit)
    return F.least(F.floor(F.log2(F.col("far") / unit + 1)), F.lit(RINGS - 1)).cast("int")


def _box(cell: Column, ring: Column) -> Column:
    return F.when(ring < OUTER, cell * RINGS + ring).otherwise(-1 - F.floor(cell / MERGED)).cast("int")


def _file_table(posted: DataFrame, pivots: dict[int, np.ndarray], block: int) -> tuple[dict[int, dict[str, np.ndarray]], dict[int, float]]:
    """Files by ring with their bounds, the radii of their nearest postings, and blocks."""
    rank = Window.partitionBy("d", "cell").orderBy("far", "node_id")
    # equal (far, node) are redeliveries; dense_rank counts them once
    low = posted.select("d", "cell", "far", "node_id").withColumn("r", F.dense_rank().over(rank)).filter(F.col("r") <= RADIUS_RANK + 1)
    low = low.groupBy("d", "cell", "r").agg(F.first("far").alias("far")).toPandas()  # RADIUS_RANK + 1 rows a pivot
    near, scale = {}, {}
    for d, piv in pivots.items():
        mine = low[low.d == d]
        near[d] = np.full((len(piv), RADIUS_RANK + 1), np.inf)
        near[d][mine.cell, mine.r - 1] = mine.far
        core = near[d][:, RADIUS_RANK // 2]
        core = core[np.isfinite(core) & (core > 0)]
        scale[d] = float(np.median(core)) if len(core) else 1.0
    ring = posted.select("d", "cell", "far").withColumn("ring", _ring(scale))
    table = ring.groupBy("d", "cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).withColumn("box", _box(F.col("cell"), F.col("ring"))).toPandas()  # RINGS rows a pivot
    out = {}
    for d in pivots:
        t = table[table.d == d].sort_values(["cell", "ring"])
        boxes, inverse = np.unique(t.box.to_numpy(), return_inverse=True)
        rows = np.bincount(inverse, t.n, len(boxes))
        out[d] = {"near": near[d], "cell": t.cell.to_numpy(), "lo": t.lo.to_numpy(), "hi": t.hi.to_numpy(), "box": t.box.to_numpy(), "salts": {(d, v): -(-n // block) for v, n in zip(boxes.tolist(), rows.astype(np.int64).tolist()) if n > block}}
    return out, scale
