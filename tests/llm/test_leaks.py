import random

from thicket.llm import leaks

DOC, ITEM = "doc_id long, text string", "item_id int, suite string, held_out string, passage string"


def brute(docs, items, run=12):
    out = set()
    for i, p in items:
        w = leaks.words(p)
        runs = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, t in docs:
            v = leaks.words(t)
            if any(tuple(v[k : k + run]) in runs for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def pairs(spark, docs, items, **kw):
    got = leaks.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(i, "s", "test", p) for i, p in items], ITEM), **kw)
    return {(r.doc_id, r.item_id): r for r in got.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dd", "ee1", "Ümlaut", "x9"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for i in range(25)]
    docs = []
    for d in range(120):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(w) - 13))
            t[len(t) // 2 : len(t) // 2] = w[a : a + rng.randint(10, 14)]
        docs.append((d, rng.choice([" ", "_", ",\r\n", " (- "]).join(t).upper() if d % 2 else " ".join(t)))
    want = brute(docs, items)
    assert want and set(pairs(spark, docs, items)) == want
    assert set(pairs(spark, docs, items, chars=200)) == want


def test_runs_over_lane_ends_and_long_texts(spark):
    item = [(1, " ".join(f"w{i}" for i in range(30)))]
    docs = [(n, "z " * n + item[0][1] + " z" * 5) for n in range(leaks.LANE - 35, leaks.LANE + 35, 3)] + [(99_999, "q " * 300_000 + item[0][1])]
    got = pairs(spark, docs, item)
    assert len(got) == len(docs)
    r = got[99_999, 1]
    assert (r.windows, r.first_word, r.longest_run, r.covered) == (19, 300_000, 30, 1.0)


def test_partial_cover(spark):
    w = [f"w{i}" for i in range(40)]
    got = pairs(spark, [(1, " ".join(w[:12] + ["zz"] + w[20:35]))], [(5, " ".join(w))])[1, 5]
    assert (got.windows, got.longest_run) == (5, 15) and abs(got.covered - 27 / 40) < 1e-9


def test_nulls_empty_copies_and_report(spark):
    p = " ".join(f"k{i}" for i in range(12))
    items = [(1, p), (2, p), (3, None), (4, ""), (5, "too short")]
    docs = [(1, p), (1, p), (2, None), (3, ""), (4, p[:-1])]
    assert set(pairs(spark, docs, items)) == {(1, 1), (1, 2)}
    d = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as item_id", "2 as at", "3 as windows")
    i = spark.createDataFrame([(a, "s", None, b) for a, b in items], ITEM).selectExpr("*", "'x' as text", "5 as doc_id")
    found = leaks.leaks(d, i)
    r = leaks.report(found, i).collect()
    assert [(x["items"], x.leaked, x.hits) for x in r] == [(5, 2, 2)]
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0
