import numpy as np
import pytest

from thicket.llm import groups

ROW = "node_id long, d int, feat array<float>"


def brute(rows, reach, least):
    vec = {n: (d, np.array(f, np.float32).astype(float)) for n, d, f in rows}
    ids, up = sorted(vec), {n: n for n in vec}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if vec[a][0] == vec[b][0] and ((vec[a][1] - vec[b][1]) ** 2).sum() <= reach * reach:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    size = {}
    for n in ids:
        size[find(n)] = size.get(find(n), 0) + 1
    return {(find(n), n) for n in ids if size[find(n)] >= least}


def cloud(seed, n=500):
    """Tight clusters, chains whose links are near the limit, and noise, in two widths."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        d = (3, 5)[i % 2]
        kind = i % 4
        if kind == 0:
            x = rng.normal(0, 0.3, d) + 8 * rng.integers(0, 3)
        elif kind == 1:
            x = np.zeros(d)
            x[0] = 2.45 * rng.integers(0, 60)
        elif kind == 2:
            x = rng.uniform(-4, 4, d)
        else:
            x = rng.normal(0, 30, d)
        rows.append((1000 - i, d, x.tolist()))
    return rows + rows[:20]


@pytest.mark.parametrize("seed,leaf,block", [(1, 4000, 16000), (2, 20, 15), (3, 8, 5)])
def test_linked_equals_brute_force(spark, seed, leaf, block):
    rows = cloud(seed)
    got = groups.linked(spark.createDataFrame(rows, ROW), leaf_rows=leaf, block=block, sample=300).collect()
    want = brute(rows, 2.5, 5)
    assert len(got) == len(want) and {(r.cluster_id, r.node_id) for r in got} == want


def test_copies_and_empty(spark):
    rows = [(i, 2, [1.0, 2.0]) for i in range(60)] + [(100, 2, [90.0, 0.0])]
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "1 as leaf", "2 as vec", "3 as knot")
    got = groups.linked(df, leaf_rows=5, block=7).collect()
    assert {(r.cluster_id, r.node_id) for r in got} == {(0, i) for i in range(60)}
    assert groups.linked(df.limit(0)).count() == 0
    assert groups.describe(df.limit(0)).count() == 0


def test_leaves_keep_the_limits_over_all_rows(spark):
    rows = cloud(4, 900)
    out = groups.describe(spark.createDataFrame(rows, ROW), leaf_rows=40, sample=150).toPandas()
    assert out["size"].sum() == 900
    assert ((out["size"] <= 80) | (out.rms_radius <= groups.COMPACT)).all()
    vec = {n: np.array(f) for n, _, f in rows}
    assert all(len(t) == min(3, s) and all(v in vec for v in t) for t, s in zip(out.typical, out["size"]))


def test_groups_are_compact_however_few_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 40, (12, 4))
    rows = [(i, 4, (centres[i % 12] + rng.normal(0, 0.2, 4)).tolist()) for i in range(240)] + [(900, 4, [500.0, 0.0, 0.0, 0.0])]
    out = groups.describe(spark.createDataFrame(rows, ROW)).toPandas()
    assert (out.rms_radius <= groups.COMPACT).all()
    assert sorted(zip(out.leaf, out["size"])) == [(i, 20) for i in range(12)] + [(900, 1)]
    vec = {n: np.array(f) for n, _, f in rows}
    for leaf, typical in zip(out.leaf, out.typical):
        mine = [n for n in vec if n < 900 and n % 12 == leaf] or [900]
        mid = np.mean([vec[n] for n in mine], axis=0)
        assert list(typical) == sorted(mine, key=lambda n: ((vec[n] - mid) ** 2).sum())[:3]


def test_large_tight_leaves_are_groups_as_they_are(spark):
    rows = [(i, 2, [1.0 + i % 3 / 8, 2.0]) for i in range(60)] + [(100, 2, [90.0, 0.0])]
    out = groups.describe(spark.createDataFrame(rows, ROW), leaf_rows=5).toPandas()
    assert sorted(zip(out.leaf, out["size"])) == [(0, 60), (100, 1)]
    assert {r.leaf: list(r.typical) for r in out.itertuples()} == {0: [1, 4, 7], 100: [100]}


def test_splits_are_fitted_on_all_rows(spark):
    rng = np.random.default_rng(6)
    at = [(0.0, 0.0)] * 400 + [(60.0, 0.0)] * 200 + [(0.0, 90.0)] * 3
    rows = [(i, 2, (np.array(c) + rng.normal(0, 3, 2)).tolist()) for i, c in enumerate(at)]
    trees, means = groups.fit_whole(spark.createDataFrame(rows, ROW), leaf_rows=150, sample=6)
    x = np.array([f for _, _, f in rows], np.float32)
    r, leaf = trees[2].walk(x)
    assert sorted(r) == list(range(603)) and set(leaf) == {v for _, v in means}
    for (_, v), (n, mean, rms) in means.items():
        mine = x[r[leaf == v]].astype(float)
        assert n == len(mine) and np.allclose(mean, mine.mean(0)) and np.isclose(rms, np.sqrt(((mine - mine.mean(0)) ** 2).sum(1).mean()))
        assert n <= 300 or rms <= groups.COMPACT
    a, b = (trees[2].centre[v] for v in (trees[2].left[0], trees[2].right[0]))
    near = ((x - a) ** 2).sum(1) < ((x - b) ** 2).sum(1)
    assert np.allclose(a, x[near].astype(float).mean(0)) and np.allclose(b, x[~near].astype(float).mean(0))


def test_rows_that_no_sample_meets_are_split_off(spark):
    rows = [(i, 2, [1.0, 2.0]) for i in range(3000)] + [(5000, 2, [9000.0, 0.0])]
    trees, means = groups.fit_whole(spark.createDataFrame(rows, ROW), leaf_rows=10, sample=5)
    assert sorted(n for n, _, _ in means.values()) == [1, 3000] and max(rms for _, _, rms in means.values()) < 1e-6
    out = groups.describe(spark.createDataFrame(rows, ROW), leaf_rows=10, sample=5).toPandas()
    assert sorted(zip(out.leaf, out["size"], out.compact)) == [(0, 3000, True), (5000, 1, True)]


def test_typical_members_are_nearest_to_the_mean_of_all_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 3, rng.normal(0, 0.5, 3).astype(np.float32).tolist()) for i in range(500)]
    out = groups.describe(spark.createDataFrame(rows, ROW), leaf_rows=20, sample=10).toPandas()
    x = np.array([f for _, _, f in rows])
    assert len(out) == 1 and list(out.typical[0]) == np.argsort(((x - x.mean(0)) ** 2).sum(1))[:3].tolist()
