"""Training and use of path forests: supervised, semi-supervised, learning, pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from thicket.functions.distances import Distance, distance
from thicket.operators import evaluate, hierarchy, prepare
from thicket.operators.pairwise import BLOCK, held, matrix, meet
from thicket.operators.spanning import LOCAL_ROWS, all_rows, flood, grow_tree, minimax, prototypes, spanning_tree
from thicket.plans.runtime import cut, numbered

METRIC = "euclid_log"


def _model(samples: DataFrame, tree: DataFrame, seeds: DataFrame) -> DataFrame:
    grown = minimax(tree, seeds)
    y = samples.select(F.col("position").alias("root"), F.col("truelabel").alias("label"))
    full = samples.select("position", "truelabel", "feat").join(grown, "position").join(y, "root").withColumn("is_prototype", F.col("pred").isNull())
    # the order of conquest; ranks span the whole model, as scoring needs one order
    return numbered(full, "rank", F.col("pathval"), F.col("position"))


_FITTED = "position long, truelabel int, feat array<double>, pathval double, root long, pred long, label int, is_prototype boolean, rank int"


def _train(m: Distance):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The model of a training set that one task can hold: tree, prototypes, flood, order."""
        got = [b for b in batches if len(b)]
        if not got:
            return
        pdf = pd.concat(got).drop_duplicates("position").sort_values("position").reset_index(drop=True)
        x, ids, y = matrix(pdf.feat), pdf.position.to_numpy(np.int64), pdf.truelabel.to_numpy()
        tree = grow_tree(ids, all_rows(m, x).__getitem__)
        a, b = np.searchsorted(ids, tree.a), np.searchsorted(ids, tree.b)
        across = y[a] != y[b]
        seeds = pd.DataFrame({"a": np.unique(np.concatenate([ids[a[across]], ids[b[across]]])), "b": np.nan, "d": 0.0})
        arcs = pd.concat([tree, tree.rename(columns={"a": "b", "b": "a"}), seeds])
        grown = flood(arcs).set_index("position").loc[ids]
        label = y[np.searchsorted(ids, grown.root.to_numpy(np.int64))]
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, grown.pathval))] = np.arange(1, len(ids) + 1)
        yield pdf.assign(pathval=grown.pathval.to_numpy(), root=grown.root.to_numpy(), pred=grown.pred.array, label=label, is_prototype=grown.pred.isna().to_numpy(), rank=rank)

    return run


def fit(samples: DataFrame, metric: str | Distance = METRIC, distances: DataFrame | None = None) -> DataFrame:
    """The model ``position, truelabel, feat, pathval, root, pred, label, is_prototype, rank``.

    Up to ``LOCAL_ROWS`` rows (counted) are trained in one task. Fewer than two classes have no
    prototypes: ValueError.
    """
    m = distance(metric) if isinstance(metric, str) else metric
    base = samples.select("position", F.col("truelabel").cast("int").alias("truelabel"), F.col("feat").cast("array<double>").alias("feat"))
    size = base.agg(F.count("*").alias("n"), F.min("truelabel").alias("lo"), F.max("truelabel").alias("hi")).first()
    if size.lo == size.hi:
        raise ValueError("training needs at least two classes")
    if distances is None and size.n <= LOCAL_ROWS:
        return cut(base.coalesce(1).mapInPandas(_train(m), _FITTED))
    samples = cut(base.dropDuplicates(["position"]))
    tree = cut(spanning_tree(samples, m, _among(distances, samples)))
    seeds = cut(prototypes(samples, tree))
    if seeds.isEmpty():
        raise ValueError("training needs at least two classes")
    return cut(_model(samples, tree, seeds))


def _first_best(m: Distance):
    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rank")
        path, x, y = b.pathval.to_numpy(), matrix(a.feat), matrix(b.feat)
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        # blocks of the model in order of cost: stop when no later one can be better
        for lo in range(0, len(y), 128):
            open_ = best > path[lo]
            if not open_.any():
                break
            cost = np.maximum(m.block(x[open_], y[lo : lo + 128]), path[None, lo : lo + 128])
            c = cost.argmin(1)
            low = cost[np.arange(len(c)), c]
            rows = np.flatnonzero(open_)[low < best[open_]]
            best[rows], at[rows] = low[low < best[open_]], lo + c[low < best[open_]]
        return pd.DataFrame({"position": a.position.to_numpy(), "cost": best, "rank": b["rank"].to_numpy()[at], "conqueror": b.position.to_numpy()[at], "label": b.label.to_numpy()[at]})

    return kernel


def classify(model: DataFrame, test: DataFrame, metric: str | Distance = METRIC, distances: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``test`` with ``label``, ``cost`` and ``conqueror``.

    The conqueror minimises (max(path cost, distance), rank). A model that every task may hold
    is sent to them and ``test`` is not shuffled; a larger one meets it in blocks.
    ``distances`` may hold given ``i`` (test), ``j`` (model), ``d``.
    """
    slim = model.select("position", "feat", "pathval", "rank", "label")
    base = test.drop("label", "cost", "conqueror")
    if distances is not None:
        offers = distances.join(slim.drop("feat").withColumnRenamed("position", "j"), "j").select(F.col("i").alias("position"), F.greatest("pathval", "d").alias("cost"), "rank", F.col("j").alias("conqueror"), "label")
    else:
        kernel = _first_best(distance(metric) if isinstance(metric, str) else metric)
        small = held(slim, "rank") if block == BLOCK else None
        if small is not None and len(small):
            return _scored(base, small, kernel)
        offers = meet(base.select("position", "feat"), slim, kernel, "position long, cost double, rank int, conqueror long, label int", block, rows=0)
    best = offers.groupBy("position").agg(F.min(F.struct("cost", "rank", "conqueror", "label")).alias("_s"))
    return base.join(best.select("position", F.col("_s.label").alias("label"), F.col("_s.cost").alias("cost"), F.col("_s.conqueror").alias("conqueror")), "position")


def _scored(base: DataFrame, model: pd.DataFrame, kernel) -> DataFrame:
    """Rows of ``base`` as they are, with what the kernel finds for each."""
    shared = base.sparkSession.sparkContext.broadcast(model)
    schema = StructType(base.schema.fields + [StructField("label", IntegerType()), StructField("cost", DoubleType()), StructField("conqueror", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                b = batch.slice(lo, BLOCK)
                feat = b.column("feat").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                got = kernel(pd.DataFrame({"position": b.column("position").to_numpy(zero_copy_only=False), "feat": list(feat)}), shared.value)
                new = [pa.array(got.label, pa.int32()), pa.array(got.cost, pa.float64()), pa.array(got.conqueror, pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "label", "cost", "conqueror"])

    return base.mapInArrow(run, schema)


def learn(train: DataFrame, evaluation: DataFrame, metric: str = METRIC, rounds: int = 11, tolerance: float = 1e-4, seed: int = 1, distances: DataFrame | None = None) -> tuple[DataFrame, float, int]:
    """Learns from the errors on an evaluation set: model, its accuracy, rounds done.

    Errors change places with random non-prototypes; the best model is kept; it stops when
    the accuracy changes by at most ``tolerance``. ``distances`` may hold ``i, j, d`` of all pairs.
    """
    best, top, last, done = None, -1.0, 0.0, 0
    for turn in range(rounds):
        model = fit(train, metric, distances)
        scored = cut(classify(model, evaluation, metric, distances))
        acc, done = evaluate.accuracy_value(scored), turn + 1
        if acc > top:
            best, top = model, acc
        if abs(acc - last) <= tolerance:
            break
        last = acc
        train, evaluation = (cut(x) for x in prepare.swap_errors(model, scored, seed + 2 * turn))
    return best, top, done


def agglomerative_learn(train: DataFrame, evaluation: DataFrame, metric: str = METRIC, distances: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Moves evaluation errors into training until there are none: model, rows moved.

    Every round but the last moves at least one row, so it ends.
    """
    base, moved = ["position", "truelabel", "feat"], 0
    train, rest = train.select(base), evaluation.select(base)
    model = fit(train, metric, distances)
    while True:
        scored = cut(classify(model, rest, metric, distances))
        rest, train, n = prepare.move_misclassified(scored, train)
        if not n:
            break
        moved += n
        train, rest = cut(train), cut(rest.select(base))
        model = fit(train, metric, distances)
    return model, moved


def ancestor_closure(model: DataFrame, marked: DataFrame) -> DataFrame:
    """``position`` of the marked nodes and all their ancestors."""
    lines = hierarchy.paths(model.withColumn("_g", F.lit(0)), "_g", "position", "pred")
    return lines.join(marked.select("position").distinct(), "position", "left_semi").select(F.explode("path").alias("position")).distinct()


def keep_relevant(model: DataFrame, relevant: DataFrame) -> DataFrame:
    """The model without irrelevant nodes."""
    return model.join(relevant.select("position"), "position", "left_semi")


def prune(train: DataFrame, evaluation: DataFrame, target: float, metric: str = METRIC, distances: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Removes training rows that classify no evaluation row rightly while accuracy stays at ``target``.

    The conquerors of rightly classified evaluation rows and all their ancestors stay. Returns the
    last model that reaches the target and the share of rows removed. Every round but the last
    removes a row, so it ends.
    """
    base = ["position", "truelabel", "feat"]
    model = fit(train, metric, distances)
    first = left = model.count()
    while True:
        scored = cut(classify(model, evaluation, metric, distances))
        if evaluate.accuracy_value(scored) < target:
            break
        right = scored.filter("label = truelabel").select(F.col("conqueror").alias("position"))
        kept = cut(keep_relevant(model, ancestor_closure(model, right)).select(base))
        now = kept.agg(F.count("*").alias("n"), F.min("truelabel").alias("lo"), F.max("truelabel").alias("hi")).first()
        if now.n == left or now.lo == now.hi:
            break
        smaller = fit(kept, metric, distances)
        if evaluate.accuracy_value(classify(smaller, evaluation, metric, distances)) < target:
            break
        model, left = smaller, now.n
    return model, 1 - left / first


def pruning_rate(initial: int, final: int) -> float:
    return 100.0 * (1 - final / initial) if initial else 0.0


def semi(labeled: DataFrame, unlabeled: DataFrame, evaluation: DataFrame | None = None, metric: str = METRIC, distances: DataFrame | None = None) -> DataFrame:
    """Model over labeled and unlabeled rows, seeded by prototypes of the labeled ones.

    The label propagated to a row becomes its ``truelabel``. With an evaluation set the
    labeled rows are first improved by ``learn``; rows without a label take no part in that, so
    that they can neither change places with errors nor become prototypes.
    """
    base = ["position", "truelabel", "feat"]
    labeled = cut(labeled.select(base))
    if evaluation is not None:
        labeled = cut(learn(labeled, evaluation, metric, distances=distances)[0].select(base))
    seeds = cut(prototypes(labeled, spanning_tree(labeled, metric, _among(distances, labeled))))
    if seeds.isEmpty():
        raise ValueError("training needs at least two labeled classes")
    rows = cut(labeled.unionByName(unlabeled.select("position", F.lit(0).alias("truelabel"), "feat")))
    model = _model(rows, cut(spanning_tree(rows, metric, _among(distances, rows))), seeds)
    return model.withColumn("truelabel", F.when(F.col("truelabel") == 0, F.col("label")).otherwise(F.col("truelabel")))


def _among(distances: DataFrame | None, rows: DataFrame) -> DataFrame | None:
    """Given distances between ``rows`` alone."""
    if distances is None:
        return None
    ids = rows.select(F.col("position").alias("i")).distinct()
    return distances.join(ids, "i", "left_semi").join(ids.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "d")


def semi_retrained(labeled: DataFrame, unlabeled: DataFrame, evaluation: DataFrame | None = None, metric: str = METRIC, distances: DataFrame | None = None) -> DataFrame:
    """The semi-supervised program: ``semi``, then ``fit`` on all rows with their propagated labels."""
    model = cut(semi(labeled, unlabeled, evaluation, metric, distances))
    return fit(model.select("position", "truelabel", "feat"), metric, distances)
