"""Same or nearly same records across splits.

Method: winnowing fingerprints. A vector is a text of cells (its values on a grid). Every run
of ``k`` cells has a rolling hash, and of every ``w`` hashes in a row the least is kept. Where
at most ``bad`` dimensions differ, at least ``k + w - 1`` dimensions in a row agree, so both
records keep the same least hash of that window: winnowing's guarantee.

A value within the tolerance of a cell's edge may lie in either cell on the other side. The
training side keeps the minima of its one reading. The held-out side posts every reading of a
run that can be the minimum of a window in some reading of the window: its hash is at most the
greatest hash that each other run of the window can have. That is a superset of what any partner
keeps, so no seed is lost.

Joined fingerprints are seeds; a seed carries its place. Dimensions are compared in place, so
all seeds of a pair lie on one diagonal and are collinear: they are chained by place, and
``chained`` counts the dimensions the chain covers. The chain is then extended over all other
dimensions by exact alignment, which decides the pair.

A posting carries a sketch, the cells of up to ``FIELDS`` dimensions modulo 8, and a joined
pair whose sketches differ by two cells or more in more than ``bad`` dimensions is dropped at
once: it cannot match. Vectors are never shuffled, only postings are; those of the classes
that are left are read again for the alignment.

Equal vectors form a class (a 128-bit hash); each partition posts a class once, and members
are put back last, so a group of copies of any size stays small until the result itself lists
its pairs.
A fingerprint held by more than ``hot`` training classes is not joined as it stands: its
classes post it again, together with the minima of the dimensions outside its run, among which
at most ``bad`` differ too, so the guarantee holds again. This is repeated, up to ``DEEPEST``
times, as long as a fingerprint is hot; the rest then agree in the cells of most dimensions.

Defined cases: null vectors and vectors under ``shortest`` are left out; a null, NaN or infinite
element counts as a difference; redelivered rows count once; null or unknown splits take
no part; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm import vectors
from thicket.plans.runtime import cut, sized_broadcast

TOLERANCE, BAD, SHORTEST = 0.02, 2, 16
#: Training classes that may share a fingerprint before it is refined, and the times it may be.
HOT, DEEPEST = 2000, 4
#: Readings of a window that the grid aims at, and the longest run.
READINGS, LONGEST = 3.5, 8
#: The sketch: dimensions and cell width of its 3-bit fields.
FIELDS, FIELD = 21, 0.04
_ONES = sum(1 << (3 * j) for j in range(FIELDS))
_TOP = _ONES << 2
_K = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def shape(d: int, bad: int) -> tuple[int, int]:
    """Run length k and window w: of d dimensions, all but ``bad`` agreeing, k + w - 1 in a row agree."""
    t = max(1, -(-(d - bad) // (bad + 1)))
    k = min(LONGEST, t, (t + 1) // 2 + 1)
    return k, t - k + 1


def _grid(k: int, w: int, tol: float) -> float:
    """Cell width at which a window has about READINGS readings."""
    return 2 * tol / (READINGS ** (1 / (k + w - 1)) - 1)


def _roll(cells: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every run of k cells: (rows, width - k + 1)."""
    c = cells.astype(np.uint64)
    n, d = c.shape
    out = np.zeros((n, d - k + 1), np.uint64)
    out[:, 0] = reduce(lambda h, j: h * _K + c[:, j], range(k), np.zeros(n, np.uint64))
    top = reduce(lambda p, _: p * _K, range(k - 1), np.ones(1, np.uint64))
    for i in range(1, d - k + 1):
        out[:, i] = (out[:, i - 1] - c[:, i - 1] * top) * _K + c[:, i + k - 1]
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places kept in each row: the least of every w hashes in a row, the first of equal ones."""
    n, m = hashes.shape
    kept = np.zeros((n, m), bool)
    for lo in range(max(1, m - w + 1)):
        kept[np.arange(n), lo + hashes[:, lo : lo + w].argmin(1)] = True
    return kept


def _least_rivals(most: np.ndarray, w: int) -> np.ndarray:
    """For each place, the greatest hash with which it can still be the least of some window.

    ``most`` holds the greatest hash that each place can have.
    """
    n, m = most.shape
    out = np.zeros((n, m), np.uint64)
    for lo in range(max(1, m - w + 1)):
        hi = min(lo + w, m)
        for i in range(lo, hi):
            rest = np.delete(most[:, lo:hi], i - lo, 1)
            out[:, i] = np.maximum(out[:, i], rest.min(1) if rest.shape[1] else _LAST)
    return out


def readings(x: np.ndarray, tol: float, g: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all readings of one run: row numbers and hashes."""
    lo, hi = _cells(x - tol, g), _cells(x + tol, g)
    row, h = np.arange(len(x)), np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        both = np.flatnonzero(lo[row, j] != hi[row, j])
        other = h[both] * _K + hi[row[both], j].astype(np.uint64)
        h = np.concatenate([h * _K + lo[row, j].astype(np.uint64), other])
        row = np.concatenate([row, row[both]])
    return row, h


def _cells(x: np.ndarray, g: float) -> np.ndarray:
    return np.clip(np.floor(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) / g), -(2.0**60), 2.0**60).astype(np.int64)


def _mix(h: np.ndarray, *salt: int | np.ndarray) -> np.ndarray:
    for s in salt:
        h = (h ^ (np.asarray(s).astype(np.uint64) + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(31))
    return h


def kept(x: np.ndarray, tol: float, bad: int, wide: bool, *salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, places and fingerprints that the vectors keep; ``wide`` keeps all readings."""
    n, d = x.shape
    k, w = shape(d, bad)
    g, m = _grid(k, w, tol), d - k + 1
    sound = np.stack([np.isfinite(x[:, i : i + k]).all(1) for i in range(m)], 1)
    if not wide:
        h = np.where(sound, _mix(_roll(_cells(x, g), k), d, np.arange(m)[None], *salt), _LAST)
        row, place = np.nonzero(winnow(h, w) & sound)
        return row, place, h[row, place]
    most, found = np.full((n, m), _LAST), []
    for i in range(m):
        ok = np.flatnonzero(sound[:, i])
        row, h = readings(x[ok, i : i + k], tol, g)
        row, h = ok[row], _mix(h, d, i, *salt)
        top = np.zeros(n, np.uint64)
        np.maximum.at(top, row, h)
        most[ok, i] = top[ok]
        found.append((row, h))
    rival = _least_rivals(most, w)
    rows, places, prints = [], [], []
    for i, (row, h) in enumerate(found):
        use = h <= rival[row, i]
        rows.append(row[use])
        places.append(np.full(use.sum(), i))
        prints.append(h[use])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(prints)


def sketch(x: np.ndarray) -> np.ndarray:
    """Cells of the first FIELDS dimensions modulo 8, three bits each."""
    out = np.zeros(len(x), np.int64)
    for j in range(min(FIELDS, x.shape[1])):
        out |= (_cells(x[:, j], FIELD) & 7) << (3 * j)
    return out


def _differing(a: Column, b: Column) -> Column:
    """Fields of two sketches that lie two cells or more apart: surely differing dimensions."""
    top, ones, low = F.lit(_TOP), F.lit(_ONES), F.lit(~_TOP)
    minus = (a.bitwiseOR(top) - b.bitwiseAND(low)).bitwiseXOR(a.bitwiseXOR(F.bitwise_not(b)).bitwiseAND(top))
    plus = (minus.bitwiseAND(low) + ones).bitwiseXOR(minus.bitwiseAND(top))
    far = F.shiftright(plus, 2).bitwiseOR(F.shiftright(plus, 1).bitwiseAND(plus)).bitwiseAND(ones)
    return F.bit_count(far)


def _post(wide: bool, tol: float, bad: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            b = b.drop_duplicates("c1")
            fresh = np.array([c not in seen for c in b.c1.tolist()], bool)
            b = b[fresh]
            seen.update(b.c1.tolist())
            for _, part, x in vectors.by_width(b):
                ids, x = part.c1.to_numpy(), x.astype(np.float64)
                row, place, fp = kept(x, tol + 1e-6, bad, wide, 0)
                yield pd.DataFrame({"fp": fp.view(np.int64), "c": ids[row], "mark": sketch(x)[row], "at": place.astype(np.int16)})

    return run


def _repost(wide: bool, tol: float, bad: int, level: int):
    """Fingerprints hot at every level so far, joined with the minima of the dimensions left."""

    def deeper(x: np.ndarray, who: np.ndarray, dims: np.ndarray, fp: np.ndarray, at: np.ndarray, hot: list[set[int]], depth: int) -> Iterator[tuple]:
        if len(dims) <= bad:
            yield who, fp, at
            return
        row, place, more = kept(x[who][:, dims], tol + 1e-6, bad, wide, depth)
        mine = _mix(fp[row] * _K ^ more, depth) if depth else more
        at = at[row] if depth else place
        if depth == level:
            yield who[row], mine, at
            return
        use = np.array([f in hot[w] for w, f in zip(who[row].tolist(), mine.view(np.int64).tolist())], bool)
        k = shape(len(dims), bad)[0]
        for p in np.unique(place[use]).tolist():
            s = use & (place == p)
            yield from deeper(x, who[row[s]], np.delete(dims, np.s_[p : p + k]), mine[s], at[s], hot, depth + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part, x in vectors.by_width(b):
                ids, x, n = part.c1.to_numpy(), x.astype(np.float64), len(part)
                marks, hot = sketch(x), [set(h) for h in part.hot]
                for who, fp, at in deeper(x, np.arange(n), np.arange(d), np.zeros(n, np.uint64), np.zeros(n, np.int64), hot, 0):
                    yield pd.DataFrame({"fp": fp.view(np.int64), "c": ids[who], "mark": marks[who], "at": at.astype(np.int16)})

    return run


_POSTED = "fp long, c long, mark long, at short"


def _rows(samples: DataFrame, subgraph: DataFrame, shortest: int) -> DataFrame:
    meta = subgraph.select(F.col("subgraph_id").alias("_sid"), "split").dropDuplicates(["_sid"])
    whole = F.transform("feat", lambda v: F.coalesce(v, F.lit(float("nan")).cast("float")))
    return (
        samples.select("node_id", "subgraph_id", "source", whole.alias("feat"))
        .filter(F.col("node_id").isNotNull() & (F.size("feat") >= shortest))
        .join(meta, F.col("subgraph_id") == F.col("_sid"))
        .filter(F.col("split").isin("train", "eval", "test"))
        .select("node_id", "source", "split", "feat", F.size("feat").alias("d"), F.xxhash64("feat").alias("c1"), F.xxhash64(F.lit("second"), "feat").alias("c2"))
    )


def _aligned(a: Column, b: Column, tol: float) -> Column:
    """Dimensions that agree. NaN compares as larger than any number."""
    near = F.zip_with(a, b, lambda x, y: (F.abs(x.cast("double") - y.cast("double")) <= tol).cast("int"))
    return F.aggregate(near, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _chain(places: Column, d: Column, bad: int) -> Column:
    """Dimensions covered by the collinear chain of runs that begin at ``places``."""
    t = F.greatest(F.lit(1), F.ceil((d - bad) / (bad + 1))).cast("int")
    k = F.least(F.lit(LONGEST), t, F.floor((t + 1) / 2).cast("int") + 1)
    start = F.struct(F.lit(-(2**20)).alias("end"), F.lit(0).alias("sum"))
    walk = F.aggregate(F.array_sort(places), start, lambda s, p: F.struct((p + k).alias("end"), (s["sum"] + k - F.greatest(s["end"] - p, F.lit(0))).alias("sum")))
    return walk["sum"]


def overlaps(samples: DataFrame, subgraph: DataFrame, tol: float = TOLERANCE, bad: int = BAD, shortest: int = SHORTEST, hot: int = HOT) -> DataFrame:
    """One row per overlapping pair.

    ``held_id, held_split, held_source, train_id, train_source, seeds, chained, matched, coverage``:
    ``seeds`` counts the places of shared fingerprints, ``chained`` the dimensions their chain
    covers, ``matched`` the agreeing dimensions; ``coverage`` is the share of these.
    """
    rows = _rows(samples, subgraph, shortest)
    sides = {"t": (rows.filter("split = 'train'"), False), "h": (rows.filter("split != 'train'"), True)}
    posts = {s: r.select("c1", "d", "feat").mapInPandas(_post(wide, tol, bad), _POSTED) for s, (r, wide) in sides.items()}

    def met(one: DataFrame, many: DataFrame) -> DataFrame:
        left = one.repartition("fp").dropDuplicates(["fp", "c"]).select("fp", F.col("c").alias("t"), F.col("mark").alias("tm"))
        right = many.repartition("fp").dropDuplicates(["fp", "c"]).select("fp", F.col("c").alias("h"), F.col("mark").alias("hm"), "at")
        return left.join(right, "fp").filter(_differing(F.col("tm"), F.col("hm")) <= bad).select("t", "h", "at")

    seeds, level, hots = None, 0, {}
    while True:
        crowded = cut(posts["t"].groupBy("fp").count().filter(F.col("count") > hot).select("fp")) if level < DEEPEST else None
        if crowded is None or crowded.isEmpty():
            found = met(posts["t"], posts["h"])
            seeds = found if seeds is None else seeds.unionByName(found)
            break
        crowd = sized_broadcast(crowded)
        found = met(posts["t"].join(crowd, "fp", "left_anti"), posts["h"])
        seeds = found if seeds is None else seeds.unionByName(found)
        level += 1
        for s, (r, wide) in sides.items():
            mine = posts[s].join(crowd, "fp").select(F.col("c").alias("c1"), "fp")
            hots[s] = cut((mine.unionByName(hots[s]) if s in hots else mine).distinct())
            lists = hots[s].groupBy("c1").agg(F.collect_list("fp").alias("hot"))  # at most the fingerprints of a class
            once = r.join(lists, "c1").groupBy("c1", "c2").agg(F.first("feat").alias("feat"), F.first("d").alias("d"), F.first("hot").alias("hot"))
            posts[s] = once.mapInPandas(_repost(wide, tol, bad, level), _POSTED)
    chained = cut(seeds.groupBy("t", "h").agg(F.collect_set("at").alias("places")))  # at most one entry a dimension
    # the classes that met, and their members
    names = chained.select(F.col("t").alias("c1")).unionByName(chained.select(F.col("h").alias("c1"))).distinct()
    near = cut(rows.join(sized_broadcast(names), "c1", "left_semi"))
    classes = near.groupBy("c1", "c2").agg(F.first("feat").alias("feat"), F.first("d").alias("d"))
    members = near.groupBy("c1", "c2", "node_id").agg(F.min(F.struct("split", "source")).alias("s")).select("c1", "c2", "node_id", "s.split", "s.source")
    left = classes.select(F.col("c1").alias("t"), F.col("c2").alias("t2"), F.col("d").alias("td"), F.col("feat").alias("tf"))
    right = classes.select(F.col("c1").alias("h"), F.col("c2").alias("h2"), F.col("d").alias("hd"), F.col("feat").alias("hf"))
    pairs = (
        chained.join(left, "t")
        .join(right, "h")
        .filter("td = hd")
        .withColumn("matched", _aligned(F.col("tf"), F.col("hf"), tol))
        .filter(F.col("matched") >= F.col("td") - bad)
        .select("t", "t2", "h", "h2", F.size("places").alias("seeds"), _chain(F.col("places"), F.col("td"), bad).alias("chained"), "matched", (F.col("matched") / F.col("td")).alias("coverage"))
    )
    trained = members.filter("split = 'train'").select(F.col("c1").alias("t"), F.col("c2").alias("t2"), F.col("node_id").alias("train_id"), F.col("source").alias("train_source"))
    held = members.filter("split != 'train'").select(F.col("c1").alias("h"), F.col("c2").alias("h2"), F.col("node_id").alias("held_id"), F.col("split").alias("held_split"), F.col("source").alias("held_source"))
    return pairs.join(trained, ["t", "t2"]).join(held, ["h", "h2"]).select("held_id", "held_split", "held_source", "train_id", "train_source", "seeds", "chained", "matched", "coverage")


def report(found: DataFrame) -> DataFrame:
    """Per held-out split, held-out source and training source: pairs, records, coverage."""
    best = found.groupBy("held_split", "held_source", "train_source", "held_id").agg(F.count("*").alias("pairs"), F.max("coverage").alias("coverage"))
    return best.groupBy("held_split", "held_source", "train_source").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("held_records"), F.avg("coverage").alias("mean_coverage"))
