import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions.distances import DISTANCES
from thicket.operators import clustering, evaluate, maxtree, pairwise, prepare, spanning, supervised

SAMPLE = "position long, truelabel int, feat array<double>"


def blobs(n=90, d=3, classes=3, seed=1, spread=1.5):
    rng = np.random.default_rng(seed)
    return [(i, 1 + i % classes, (rng.normal(0, spread, d) + 4 * (i % classes)).tolist()) for i in range(n)]


def arrays(rows):
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def direct_training(rows):
    """Prim, prototypes and the minimax flood over the complete graph."""
    _, y, x = arrays(rows)
    d = DISTANCES["euclid_log"].block(x, x)
    n = len(x)
    best, by, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    best[0] = 0
    proto = np.zeros(n, bool)
    for _ in range(n):
        p = int(np.argmin(np.where(left, best, np.inf)))
        left[p] = False
        if by[p] >= 0 and y[p] != y[by[p]]:
            proto[[p, by[p]]] = True
        closer = left & (d[p] < best)
        best[closer], by[closer] = d[p][closer], p
    cost, label = np.where(proto, 0.0, np.inf), np.where(proto, y, 0)
    heap, done = [(0.0, i) for i in np.flatnonzero(proto)], np.zeros(n, bool)
    while heap:
        c, p = heapq.heappop(heap)
        if done[p]:
            continue
        done[p] = True
        for q in range(n):
            t = max(cost[p], d[p, q])
            if not done[q] and t < cost[q]:
                cost[q], label[q] = t, label[p]
                heapq.heappush(heap, (t, q))
    return proto, cost, label


def test_training_equals_direct_flood_and_boruvka_equals_prim(spark):
    rows = blobs()
    s = spark.createDataFrame(rows, SAMPLE)
    proto, cost, label = direct_training(rows)
    model = supervised.fit(s).toPandas().sort_values("position")
    assert (model.is_prototype.to_numpy() == proto).all()
    assert np.allclose(model.pathval, cost) and (model.label.to_numpy() == label).all()
    assert (model.label == model.truelabel).all()
    one = {tuple(r) for r in spanning.spanning_tree(s).collect()}
    two = {tuple(r) for r in spanning.spanning_tree(s, local_rows=10, block=32).collect()}
    given = {tuple(r) for r in spanning.spanning_tree(s, distances=pairwise.distance_pairs(s, "euclid_log")).collect()}
    assert one == two == given and len(one) == len(rows) - 1
    tree, seeds = spanning.spanning_tree(s), s.filter(F.col("position").isin(model.position[proto].tolist()))
    a = {(r.position, r.pathval, r.root) for r in spanning.minimax(tree, seeds).collect()}
    b = {(r.position, r.pathval, r.root) for r in spanning.minimax(tree, seeds, local_edges=5).collect()}
    assert a == b


def test_equal_distances_and_one_class(spark):
    grid = [(i, 1 + (i % 5 > 2), [float(i % 5), float(i // 5)]) for i in range(25)]
    s = spark.createDataFrame(grid, SAMPLE)
    one = {tuple(r) for r in spanning.spanning_tree(s).collect()}
    assert one == {tuple(r) for r in spanning.spanning_tree(s, local_rows=3, block=4).collect()}
    with pytest.raises(ValueError):
        supervised.fit(s.withColumn("truelabel", F.lit(1)))


def test_classify_equals_direct_and_blocks_do_not_matter(spark):
    rows, other = blobs(80), blobs(50, seed=7)
    model, test = supervised.fit(spark.createDataFrame(rows, SAMPLE)), spark.createDataFrame(other, SAMPLE)
    m = model.toPandas().sort_values("rank")
    d = np.maximum(DISTANCES["euclid_log"].block(arrays(other)[2], np.stack(m.feat)), m.pathval.to_numpy()[None])
    want = m.label.to_numpy()[d.argmin(1)]
    for block in (1024, 16):
        got = supervised.classify(model, test, block=block).orderBy("position").toPandas()
        assert (got.label.to_numpy() == want).all() and np.allclose(got.cost, d.min(1))
    pre = supervised.classify(model, test, distances=_cross(spark, other, rows)).orderBy("position").toPandas()
    assert (pre.label.to_numpy() == want).all()


def _cross(spark, test, model):
    d = DISTANCES["euclid_log"].block(arrays(test)[2], arrays(model)[2])
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(test)) for j in range(len(model))], "i long, j long, d double")


def test_learning_agglomeration_pruning_semi(spark):
    rows = blobs(150, spread=2.5)
    parts = prepare.split3(spark.createDataFrame(rows, SAMPLE), 0.4, 0.3, 0.3).cache()
    train, evaluation = (parts.filter(F.col("part") == p).drop("part") for p in ("train", "eval"))
    base = evaluate.accuracy_value(supervised.classify(supervised.fit(train), evaluation))
    model, acc, rounds = supervised.learn(train, evaluation, rounds=2)
    assert acc >= base and rounds >= 1 and model.count() == train.count()
    model, moved = supervised.agglomerative_learn(train, evaluation)
    assert model.count() == train.count() + moved
    small, rate = supervised.prune(train, evaluation, base - 0.05)
    assert evaluate.accuracy_value(supervised.classify(small, evaluation)) >= base - 0.05 and 0 <= rate < 1
    semi = supervised.semi(train, evaluation.withColumn("truelabel", F.lit(0)))
    assert semi.filter("truelabel = 0").count() == 0 and semi.count() == train.count() + evaluation.count()


def test_closure_swap_and_moves(spark):
    model = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "position long, pred long")
    assert {r[0] for r in supervised.ancestor_closure(model, model.filter("position = 3")).collect()} == {1, 2, 3}
    tr = spark.createDataFrame([(i, 1, [0.0], i < 2) for i in range(6)], SAMPLE + ", is_prototype boolean")
    ev = spark.createDataFrame([(10 + i, 1, [0.0], 1 + i % 2) for i in range(4)], SAMPLE + ", label int")
    a, b = prepare.swap_errors(tr, ev)
    got = {r.position for r in a.collect()}
    assert len(got) == 6 and {11, 13} <= got and {0, 1} <= got and b.count() == 4
    kept, target, n = prepare.move_misclassified(ev, tr)
    assert n == 2 and kept.count() == 2 and target.count() == 8
    left, moved = prepare.move_irrelevant(ev.withColumn("relevant", F.col("position") < 12), tr)
    assert left.count() == 2 and moved.count() == 8
    with pytest.raises(ValueError):
        prepare.merge(tr.select("feat"), tr.select(F.array(F.lit(1.0), F.lit(2.0)).alias("feat")))


def direct_clusters(dens, start, near):
    heap, value, root, pred, seen, out = [(-v, i) for i, v in start.items()], dict(start), {}, {}, set(), []
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        if p in seen or -v != value[p]:
            continue
        seen.add(p)
        if p not in pred:
            root[p], value[p] = p, dens[p]
        out.append(p)
        for q in sorted(near.get(p, ())):
            if q not in seen and min(value[p], dens[q]) > value[q]:
                value[q], pred[q], root[q] = min(value[p], dens[q]), p, root[p]
                heapq.heappush(heap, (-value[q], q))
    return root, out


def test_clusters_equal_one_common_queue(spark):
    rows = blobs(120, spread=1.0)
    s = spark.createDataFrame(rows, SAMPLE)
    arcs = pairwise.knn_graph(s, 5).cache()
    dens = clustering.density(arcs).cache()
    full = arcs.select("i", "j").union(pairwise.plateau_arcs(arcs, dens).select("i", "j")).collect()
    near = {}
    for i, j in full:
        near.setdefault(i, set()).add(j)
    d = dens.toPandas()
    root, order = direct_clusters(dict(zip(d.position, d.dens)), dict(zip(d.position, d.pathval)), near)
    got = clustering.spread(arcs, dens).toPandas()
    assert dict(zip(got.position, got.root)) == root
    assert sorted(got["rank"]) == list(range(1, 121)) and got.label.nunique() == len(set(root.values()))
    assert got.sort_values("rank").position.tolist() == order


def test_cluster_program_filters_and_radius_classifier(spark):
    rows = blobs(90, spread=0.4)
    s = spark.createDataFrame(rows, SAMPLE)
    k, tried, _ = clustering.best_k(s, 4)
    assert 1 <= k <= 4 and tried.count() >= 1
    for kind, v in (("height", 0.2), ("area", 0.1), ("volume", 0.05)):
        model = clustering.cluster(s, 3, kind, v)
        assert model.count() == 90
    named = clustering.root_labels(model)
    assert (named.toPandas().root_label == named.toPandas().truelabel).mean() > 0.9
    scored = clustering.knn_classify(named, s, label="root_label")
    far = clustering.knn_classify(named, spark.createDataFrame([(1, 1, [1e6] * 3)], SAMPLE))
    assert scored.count() == 90 and far.first().label == 0


def test_max_tree_area_and_volume():
    level, a, b = np.array([1, 5, 2, 7, 1]), np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4])
    tree = maxtree.MaxTree(level, a, b)
    assert sorted(tree.size) == [1, 1, 3, 5] and tree.parent.count(-1) == 1
    assert tree.opened("area", 1).tolist() == [1, 2, 2, 2, 1]
    assert tree.opened("area", 0).tolist() == level.tolist()
    assert tree.opened("volume", 3).tolist() == [1, 2, 2, 7, 1]
    assert tree.opened("area", 100).tolist() == [1] * 5


def test_accuracy_statistics_and_preparation(spark):
    scored = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (0, 1)], "truelabel int, label int")
    assert abs(evaluate.accuracy_value(scored) - 0.75) < 1e-9
    r = evaluate.run_statistics(evaluate.experiment(spark, 4, lambda i: i)).first()
    assert (r["mean"], r.runs) == (1.5, 4) and supervised.pruning_rate(10, 4) == 60.0
    s = spark.createDataFrame(blobs(31), SAMPLE)
    z = np.stack(prepare.normalize(s.withColumn("feat", F.concat("feat", F.array(F.lit(2.0))))).toPandas().feat)
    assert np.allclose(z.mean(0), 0) and np.allclose(z[:, :3].std(0), 1) and (z[:, 3] == 0).all()
    a, b = prepare.split(s, 0.5)
    assert a.count() + b.count() == 31 and a.groupBy("truelabel").count().count() == 3
    with pytest.raises(ValueError):
        prepare.split(s, 1.5)
    with pytest.raises(ValueError):
        prepare.kfold(s, 0)
    with pytest.raises(ValueError):
        prepare.split3(s, 0.5, 0.2, 0.2)


def test_agglomerative_learning_goes_on_while_rows_move(spark, monkeypatch):
    left = [55]

    def move(scored, train):
        left[0] -= 1
        return scored, train, int(left[0] >= 0)

    monkeypatch.setattr(supervised, "cut", lambda df: df)
    monkeypatch.setattr(supervised, "fit", lambda train, metric, distances: train)
    monkeypatch.setattr(supervised, "classify", lambda model, rest, metric, distances: rest)
    monkeypatch.setattr(supervised.prepare, "move_misclassified", move)
    s = spark.createDataFrame(blobs(4), SAMPLE)
    assert supervised.agglomerative_learn(s, s)[1] == 55


def test_programs_on_given_distances_equal_those_on_features(spark):
    s = spark.createDataFrame(blobs(80, spread=2.5), SAMPLE)
    parts = prepare.split3(s, 0.4, 0.3, 0.3).cache()
    train, evaluation = (parts.filter(F.col("part") == p).drop("part") for p in ("train", "eval"))
    given = pairwise.distance_pairs(s, "euclid_log").cache()

    def brief(df, *cols):
        return sorted(tuple(r) for r in df.select("position", "label", *cols).collect())

    assert brief(supervised.learn(train, evaluation, rounds=2)[0]) == brief(supervised.learn(train, evaluation, rounds=2, distances=given)[0])
    assert brief(supervised.agglomerative_learn(train, evaluation)[0]) == brief(supervised.agglomerative_learn(train, evaluation, distances=given)[0])
    assert brief(supervised.prune(train, evaluation, 0.5)[0]) == brief(supervised.prune(train, evaluation, 0.5, distances=given)[0])
    assert brief(supervised.semi(train, evaluation), "truelabel") == brief(supervised.semi(train, evaluation, distances=given), "truelabel")
    one, two = clustering.cluster(s, 3), clustering.cluster(s, 3, distances=given)
    assert brief(one, "root") == brief(two, "root")
    assert brief(clustering.knn_classify(one, s)) == brief(clustering.knn_classify(two, s, distances=given))


def test_semi_learning_improves_the_labeled_rows_and_retrains(spark):
    parts = prepare.split3(spark.createDataFrame(blobs(60, spread=2.5), SAMPLE), 0.4, 0.3, 0.3).cache()
    train, evaluation, other = (parts.filter(F.col("part") == p).drop("part") for p in ("train", "eval", "test"))
    model = supervised.semi_retrained(train, other, evaluation)
    assert model.count() == train.count() + other.count() and model.filter("truelabel = 0 or label != truelabel").count() == 0


def test_blocks_equal_a_side_sent_to_every_task(spark):
    s = spark.createDataFrame(blobs(90), SAMPLE)
    one = {tuple(r) for r in pairwise.knn_graph(s, 4).collect()}
    kernel_rows = pairwise.HELD_ROWS
    pairwise.HELD_ROWS = 0
    try:
        small = pairwise.meet.__defaults__
        pairwise.meet.__defaults__ = (*small[:-1], 0)
        two = {tuple(r) for r in pairwise.knn_graph(s, 4).collect()}
    finally:
        pairwise.HELD_ROWS, pairwise.meet.__defaults__ = kernel_rows, small
    assert one == two
