import numpy as np
import pytest

from thicket.llm import neighbours, vectors

ROW, ASK = "node_id long, d int, feat array<float>", "probe_id long, node_id long, d int, feat array<float>, k int"


def brute(rows, asks):
    out = set()
    vec = dict((n, np.array(f, np.float32).astype(float)) for n, _, f in rows)
    for p, n, d, f, k in asks:
        if k and k > 0:
            q = np.array(f, np.float32).astype(float)
            near = sorted((((v - q) ** 2).sum(), m) for m, v in vec.items() if len(v) == d and m != n)
            out |= {(p, m) for _, m in near[:k]}
    return out


@pytest.mark.parametrize("per_root,block", [(0.7, 16000), (0.2, 7), (5.0, 50)])
def test_equals_brute_force(spark, per_root, block):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        d = (4, 6)[i % 2]
        c = rng.integers(0, 5)
        rows.append((i, d, (rng.normal(0, 1 if i % 9 else 20, d) + 10 * c).tolist()))
    rows += rows[:30]
    asks = [(1000 + i, rows[i][0], rows[i][1], rows[i][2], [1, 3, 40, None, 0][i % 5]) for i in range(0, 500, 7)]
    got = neighbours.neighbours(spark.createDataFrame(rows, ROW), spark.createDataFrame(asks, ASK), per_root, block).collect()
    assert {(r.probe_id, r.node_id) for r in got} == brute(rows, asks)
    assert len(got) == len({(r.probe_id, r["rank"]) for r in got})


def test_ties_copies_few_rows_and_empty(spark):
    rows = [(i, 2, [1.0, 1.0]) for i in range(50)] + [(99, 2, [5.0, 5.0])]
    i, a = spark.createDataFrame(rows, ROW), spark.createDataFrame([(1, 3, 2, [1.0, 1.0], 4), (2, 99, 2, [5.0, 5.0], 100), (3, 7, 8, [0.0] * 8, 2)], ASK)
    got = neighbours.neighbours(i, a, block=5).collect()
    assert sorted(r.node_id for r in got if r.probe_id == 1) == [0, 1, 2, 4]
    assert len([r for r in got if r.probe_id == 2]) == 50 and not [r for r in got if r.probe_id == 3]
    assert neighbours.neighbours(i.limit(0), a).count() == 0 and neighbours.neighbours(i, a.limit(0)).count() == 0


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [1.0, None]), (3, 1, [nan, 1.0]), (4, 1, [inf, 1.0]), (5, 1, [1.0]), (6, 1, None), (7, 2, [1.0]), (None, 1, [1.0, 2.0]), (8, None, [1.0, 2.0])]
    s = spark.createDataFrame(rows, "node_id long, subgraph_id long, feat array<float>").selectExpr("*", "1 as d", "2 as nfeats", "3 as _sid")
    m = spark.createDataFrame([(1, 2, 7), (2, None, 7)], "subgraph_id long, nfeats int, node_id int")
    assert [(r.node_id, r.d) for r in vectors.usable(s, m).collect()] == [(1, 2)]


def clustered(n=1500, d=8):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 20, (n // 15, d))
    return [(i, d, (centres[i % len(centres)] + rng.normal(0, 0.5, d)).tolist()) for i in range(n)]


def recall(got, want):
    return len({(r.probe_id, r.node_id) for r in got} & want) / len(want)


def test_footrule_alone_finds_nearly_all_and_random_orders_do_not(spark, monkeypatch):
    rows = clustered()
    asks = [(i, *rows[i], 10) for i in range(0, 1500, 50)]
    i, a, want = spark.createDataFrame(rows, ROW), spark.createDataFrame(asks, ASK), brute(rows, asks)
    good = neighbours.neighbours(i, a, exact=False).collect()
    assert recall(good, want) >= 0.9
    right = neighbours._index

    def shuffled(shared):
        def run(batches):
            rng = np.random.default_rng(0)
            for b in right(shared)(batches):
                many = max(len(p) for p in shared.value.values())
                yield b.assign(perm=[rng.permutation(many)[: min(many, len(p) // 2)].astype(np.int16).tobytes() for p in b.perm])

        return run

    monkeypatch.setattr(neighbours, "_index", shuffled)
    assert recall(neighbours.neighbours(i, a, exact=False).collect(), want) < 0.5
    assert recall(neighbours.neighbours(i, a).collect(), want) == 1.0


def test_footrule():
    a, b = np.array([[0, 1, 2], [3, 4, 5]], np.int16), np.array([[0, 1, 2], [2, 1, 0], [0, 7, 8]], np.int16)
    assert neighbours.footrule(neighbours._places(a, b), b).tolist() == [[0, 4, 3], [6, 6, 6]]
