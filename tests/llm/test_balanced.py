import numpy as np
import pytest

from thicket.llm import balanced

SAMPLE = "node_id long, subgraph_id long, truelabel int, feat string"
PLAN = "plan_id long, subgraph_id long, draw_size int, truelabel int, share double, min_rows int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flight_keeps_the_total_and_decides_all_but_one(seed):
    rng = np.random.default_rng(seed)
    p = rng.random(500)
    out = balanced.fly(p, rng)
    assert abs(out.sum() - p.sum()) < 1e-6
    assert ((out > 0) & (out < 1)).sum() <= 1


def test_flight_is_unbiased():
    p = np.array([0.2, 0.5, 0.9, 0.4])
    got = np.mean([balanced.fly(p, np.random.default_rng(i)) for i in range(6000)], axis=0)
    assert np.abs(got - p).max() < 0.03


def test_shares_minimum_and_shortage(spark):
    rows = [(i, 1, 1 + (i % 10 == 0) + (i % 50 == 0), None) for i in range(1000)] + [(i, 1, 1, None) for i in range(1, 9)]
    plan = [(7, 1, 100, 1, 0.75, None), (7, 1, 100, 2, 0.125, 20), (7, 1, 100, 3, 0.125, 40), (7, 1, 100, 9, 0.0, 1), (7, 1, 100, None, 0.0, 1), (8, 5, 10, 1, 1.0, None)]
    sample, report = balanced.draw(spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(plan, PLAN))
    r = {(x.plan_id, x.truelabel): x for x in report.collect()}
    assert [r[7, k].drawn for k in (1, 2, 3, 9)] == [75, 20, 20, 0]
    assert [r[7, k].short for k in (1, 2, 3, 9, None)] == [False, False, True, True, True]
    assert r[8, 1].short and r[8, 1].there == 0
    got = sample.toPandas()
    assert len(got) == 115 and not got.duplicated(["plan_id", "node_id"]).any()


def test_fractional_targets_keep_the_plan_total(spark):
    rows = [(i, 1, 1 + i % 3, None) for i in range(300)]
    plan = [(1, 1, 50, 1, 0.34375, None), (1, 1, 50, 2, 0.328125, None), (1, 1, 50, 3, 0.328125, None)]
    sample, report = balanced.draw(spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(plan, PLAN))
    assert sample.count() == 50
    assert all(abs(x.imbalance) < 1 and not x.short for x in report.collect())


def test_empty_nulls_and_clashing_columns(spark):
    rows = [(None, 1, 1, None), (1, None, 1, None), (2, 1, None, None), (3, 1, 1, None)]
    plan = [(1, 1, None, 1, None, None), (1, 1, 4, 1, 1.0, None), (None, 1, 1, 1, 1.0, None), (None, 1, 9, 1, 1.0, None)]
    s = spark.createDataFrame(rows, SAMPLE).selectExpr("*", "1 as prob", "2 as part", "3 as there")
    p = spark.createDataFrame(plan, PLAN).selectExpr("*", "1 as need", "2 as node_id")
    sample, report = balanced.draw(s, p)
    assert {(x.plan_id, x.node_id) for x in sample.collect()} == {(1, 3), (None, 3)} and report.count() == 4
    assert {(x.plan_id, x.need) for x in report.filter("short").collect()} == {(1, 4), (None, 9)}
    sample, report = balanced.draw(s.limit(0), p)
    assert sample.count() == 0 and report.count() == 4
    assert balanced.draw(s, p.limit(0))[1].count() == 0
