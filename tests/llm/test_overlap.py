import numpy as np
import pytest

from thicket.llm import overlap

NODE = "node_id long, subgraph_id long, source string, position long, feat array<float>"
SUB = "subgraph_id long, split string, nfeats int"
SUBS = [(1, "train", 16), (2, "eval", 16), (3, "test", 16), (4, None, 16)]


def brute(rows, tol=0.02, bad=2):
    split = {s: p for s, p, _ in SUBS}
    out = set()
    vec = {n: (split.get(s), np.array([np.nan if v is None else v for v in f], np.float32).astype(float)) for n, s, _, _, f in rows if f is not None and len(f) >= 16}
    for a, (p, x) in vec.items():
        for b, (q, y) in vec.items():
            if p == "train" and q in ("eval", "test") and len(x) == len(y):
                with np.errstate(invalid="ignore"):
                    if (np.abs(x - y) <= tol).sum() >= len(x) - bad:
                        out.add((min(a, b), max(a, b)))
    return out


def pairs(spark, rows, **kw):
    got = overlap.overlaps(spark.createDataFrame(rows, NODE), spark.createDataFrame(SUBS, SUB), **kw).collect()
    out = {(min(r.held_id, r.train_id), max(r.held_id, r.train_id)) for r in got}
    assert len(out) == len(got)
    return out


def crowd(seed):
    rng = np.random.default_rng(seed)
    rows, nid = [], 0
    for d in (16, 17, 20, 24):
        base = rng.normal(0, 8, (6, d))
        for i in range(60):
            x = base[i % 6] + rng.normal(0, 0.05, d)
            rows.append((nid, 1, "a", nid, x.tolist()))
            nid += 1
            for s in (2, 3):
                y = x + rng.uniform(-0.019, 0.019, d)
                bad = rng.choice(d, rng.integers(0, 4), replace=False)
                y[bad] += rng.normal(0, 3, len(bad))
                if i % 5 == 0 and len(bad):
                    y[bad[0]] = [np.nan, np.inf, -np.inf][i % 3]
                rows.append((nid, s, "b", 5, y.tolist() if i % 7 else [None if j in bad else v for j, v in enumerate(y.tolist())]))
                nid += 1
    return rows


def test_equals_brute_force(spark):
    rows = crowd(1)
    want = brute(rows)
    assert len(want) > 200
    assert pairs(spark, rows) == want


def test_hot_fingerprints_are_refined_exactly(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        x = np.concatenate([np.zeros(11), rng.normal(0, 9, 9)])
        rows.append((2 * i, 1, "a", i, x.tolist()))
        y = x + rng.uniform(-0.019, 0.019, 20)
        y[rng.choice(20, 2, replace=False)] += 5
        rows.append((2 * i + 1, 2 + i % 2, "b", i, y.tolist()))
    want = brute(rows)
    assert len(want) >= 120 and pairs(spark, rows, hot=10) == want


def test_copies_redelivery_nulls_and_short(spark):
    x = [float(i) for i in range(16)]
    rows = [(1, 1, "a", 1, x), (1, 1, "a", 1, x), (2, 2, "b", 2, x), (3, 3, "c", 3, x), (4, 4, "d", 4, x), (5, 2, "b", 1, None), (6, 2, "b", 1, x[:15]), (7, 9, "b", 1, x), (None, 2, "b", 1, x), (8, 2, None, 1, x + [1.0])]
    assert pairs(spark, rows) == {(1, 2), (1, 3)}
    three = [None] * 3 + x[3:]
    assert pairs(spark, [(1, 1, "a", 1, three), (2, 2, "a", 1, three)]) == set()
    assert pairs(spark, [(1, 1, "a", 1, [None, None] + x[2:]), (2, 2, "a", 1, [None, None] + x[2:])]) == {(1, 2)}
    s = spark.createDataFrame(rows, NODE).selectExpr("*", "1 as d", "2 as c1", "3 as split", "4 as fp")
    m = spark.createDataFrame(SUBS, SUB).selectExpr("*", "1 as feat", "2 as source")
    found = overlap.overlaps(s, m)
    r = {(x.held_split, x.train_source): x.pairs for x in overlap.report(found).collect()}
    assert r == {("eval", "a"): 1, ("test", "a"): 1}
    assert overlap.overlaps(s.limit(0), m).count() == 0 and overlap.overlaps(s, m.limit(0)).count() == 0


def test_deep_refinement_is_exact(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(80):
        x = np.concatenate([np.zeros(13), rng.normal(0, 9, 7)])
        rows.append((2 * i, 1, "a", i, x.tolist()))
        y = x + rng.uniform(-0.019, 0.019, 20)
        y[rng.choice(20, 2, replace=False)] += 5
        rows.append((2 * i + 1, 2 + i % 2, "b", i, y.tolist()))
    assert pairs(spark, rows, hot=3) == brute(rows)


def test_winnow_keeps_the_least_hash_of_every_window():
    h = np.random.default_rng(1).integers(0, 1 << 60, (50, 13)).astype(np.uint64)
    got = overlap.winnow(h, 3)
    want = np.array([[any(r[i] == r[lo : lo + 3].min() for lo in range(max(0, i - 2), min(i, 10) + 1)) for i in range(13)] for r in h])
    assert (got == want).all()
    # the hashes decide: rows keep different places, and other hashes keep others
    assert len({r.tobytes() for r in got}) > 20 and (overlap.winnow(h[::-1], 3) != got).any()


def test_rolling_hash_equals_the_hash_of_each_run():
    c = np.random.default_rng(2).integers(-1000, 1000, (20, 16))
    for k in (1, 4, 8):
        roll = overlap._roll(c, k)
        for i in range(16 - k + 1):
            assert (roll[:, i] == overlap._roll(c[:, i : i + k], k)[:, 0]).all()


@pytest.mark.parametrize("d", [16, 17, 20, 24, 60])
def test_a_clean_window_always_shares_a_kept_fingerprint(d):
    rng = np.random.default_rng(d)
    x = rng.normal(0, 3, (400, d))
    y = x + rng.uniform(-0.02, 0.02, x.shape)
    for r in y:
        r[rng.choice(d, 2, replace=False)] += rng.normal(0, 5, 2)
    one, many = overlap.kept(x, 0.020001, 2, False), overlap.kept(y, 0.020001, 2, True)
    mine, theirs = set(zip(one[0].tolist(), one[2].tolist())), set(zip(many[0].tolist(), many[2].tolist()))
    assert {r for r, _ in mine & theirs} == set(range(400))


def test_chain_counts_covered_dimensions(spark):
    x = [float(i) for i in range(16)]
    found = overlap.overlaps(spark.createDataFrame([(1, 1, "a", 1, x), (2, 2, "b", 2, x)], NODE), spark.createDataFrame(SUBS, SUB)).first()
    assert found.matched == 16 and found.coverage == 1.0 and found.seeds >= 5 and found.chained >= 15
