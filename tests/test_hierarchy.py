import numpy as np
import pytest

from thicket.operators import hierarchy

COLS = "model_id long, position long, pred long, root long, pathval double"


def brute(rows):
    """One walk per node."""
    up = {(m, v): (p if p is not None and p != -1 and (m, p) in {(r[0], r[1]) for r in rows} else None) for m, v, p, *_ in rows}
    cost = {(r[0], r[1]): r[4] for r in rows}
    out = {}
    for m, v in up:
        seen, cur, high = [v], v, None
        while True:
            nxt = up[m, cur]
            if nxt is None:
                out[m, v] = (cur, len(seen) - 1, high, "tree")
                break
            if nxt == v:
                out[m, v] = (None, None, None, "cycle")
                break
            if nxt in seen:
                out[m, v] = (None, None, None, "astray")
                break
            seen.append(nxt)
            cur = nxt
            if cost[m, cur] is not None:
                high = cost[m, cur] if high is None else max(high, cost[m, cur])
    return out


def forest(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for m in (1, 2):
        for v in range(n):
            p = int(rng.integers(max(0, v - 4), v + 1)) if v and rng.random() > 0.06 else [None, -1, 10_000][rng.integers(3)]
            if rng.random() < 0.02:
                p = int(rng.integers(n))
            rows.append((m, v * 3, p if p in (None, -1, 10_000) else p * 3, None, None if rng.random() < 0.1 else float(rng.integers(20))))
    return rows + rows[:7]


@pytest.mark.parametrize("seed,limit", [(1, 10_000), (2, 10_000), (3, 20)])
def test_resolve_equals_walks(spark, seed, limit):
    rows = forest(seed)
    got = hierarchy.resolve(spark.createDataFrame(rows, COLS), local_rows=limit).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        w = want[r.model_id, r.position]
        assert (r.root, r.depth, r.kind) == (w[0], w[1], w[3])
        if r.kind == "tree":
            assert r.high == w[2]


def test_long_chain_and_loops_by_rounds(spark):
    chain = [(1, i, i - 1, 0, float(i % 7)) for i in range(300)]
    loop = [(2, i, (i + 1) % 50, 0, 1.0) for i in range(50)] + [(2, 100 + i, i, 0, 1.0) for i in range(50)] + [(2, 200, 200, 0, 1.0)]
    got = hierarchy.resolve(spark.createDataFrame(chain + loop, COLS), local_rows=60).toPandas()
    one = got[got.model_id == 1].sort_values("position")
    assert (one.depth == np.arange(300)).all() and (one.root == 0).all()
    kinds = got[got.model_id == 2].kind.value_counts().to_dict()
    assert kinds == {"cycle": 51, "astray": 50}


def test_star_on_one_parent(spark):
    rows = [(1, 0, None, 0, 0.0)] + [(1, i, 0, 0, 1.0) for i in range(1, 400)]
    got = hierarchy.resolve(spark.createDataFrame(rows, COLS), local_rows=50).toPandas()
    assert (got.root == 0).all() and got.depth.sum() == 399


def test_contradictions(spark):
    rows = [(1, 0, -1, 0, 0.0), (1, 1, 0, 0, 5.0), (1, 2, 1, 9, 3.0), (1, 3, 2, None, None), (1, 4, 5, 0, 1.0), (1, 5, 4, 0, 1.0), (1, 6, 5, 0, 1.0)]
    got = {tuple(r) for r in hierarchy.contradictions(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {(1, 2, "root"), (1, 2, "cost"), (1, 3, "root"), (1, 4, "cycle"), (1, 5, "cycle"), (1, 6, "astray")}


def test_paths_and_descendants(spark):
    rows = [(1, 0, None, 0, 0.0)] + [(1, i, i - 1, 0, 0.0) for i in range(1, 9)] + [(2, 7, 8, 0, 0.0), (2, 8, 7, 0, 0.0)]
    p = hierarchy.paths(spark.createDataFrame(rows, COLS))
    by = {(r.model_id, r.position): r for r in p.collect()}
    assert by[1, 8].path == list(range(9)) and by[1, 0].path == [0] and by[2, 7].path is None
    assert hierarchy.descendants(p).filter("ancestor = 0").count() == 8


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, 0, None, None, None), (None, 1, 0, 0, 0.0), (1, None, 0, 0, 0.0)]
    df = spark.createDataFrame(rows, COLS).selectExpr("*", "1 as g", "2 as v", "3 as kind", "4 as high", "5 as depth")
    assert [r.position for r in hierarchy.resolve(df).collect()] == [0]
    assert hierarchy.resolve(df.limit(0)).count() == 0
    assert hierarchy.contradictions(df.limit(0)).count() == 0


def test_contract_array_identities():
    up = np.array([-1, 0, 1, 2, 2])
    root, depth, high, state = hierarchy.contract(up, np.array([1.0, 9.0, np.nan, 0.0, 0.0]))
    assert root.tolist() == [0] * 5 and depth.tolist() == [0, 1, 2, 3, 3] and high[3] == 9.0 and state.sum() == 0
    assert hierarchy.contract(np.array([], int), np.array([]))[0].tolist() == []


@pytest.mark.parametrize("loop", [False, True])
def test_long_chain_contracts_in_few_rounds(monkeypatch, loop):
    n, rounds, count = 5000, [], np.bincount
    monkeypatch.setattr(hierarchy.np, "bincount", lambda *a, **k: rounds.append(1) or count(*a, **k))
    up = np.arange(n) - 1
    up[0] = 9 if loop else -1
    cost = np.arange(n, dtype=float)[::-1].copy()
    root, depth, top, state = hierarchy.contract(up, cost)
    assert len(rounds) < 200
    if loop:
        assert (state[:10] == 1).all() and (state[10:] == 2).all() and (root == -1).all()
    else:
        assert (state == 0).all() and (root == 0).all() and (depth == np.arange(n)).all()
        assert np.isnan(top[0]) and (top[1:] == n - 1).all()


def test_paths_do_not_depend_on_where_they_are_listed(spark):
    rng = np.random.default_rng(3)
    rows = [(m, i, int(rng.integers(-1, i + 2)) if i else -1, None, None) for m in range(4) for i in range(60)] + [(9, i, i - 1, None, None) for i in range(150)] + [(8, 1, 2, None, None), (8, 2, 1, None, None), (8, 3, 1, None, None)]
    df = spark.createDataFrame(rows, COLS)
    ways = [hierarchy.paths(df), hierarchy.paths(df, entries=100), hierarchy.paths(df, local_rows=100)]
    one, *others = [sorted(((r.model_id, r.position, r.root, r.depth, r.path) for r in w.collect()), key=repr) for w in ways]
    assert len(one) == len(rows) and all(one == o for o in others)
    assert [p for m, i, _, _, p in one if (m, i) == (9, 149)] == [list(range(150))]
