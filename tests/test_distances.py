import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions.distances import DISTANCES, distance

PAIR = "x array<double>, y array<double>"


def value(spark, name, x, y):
    return spark.createDataFrame([(x, y)], PAIR).select(DISTANCES[name].column(F.col("x"), F.col("y"))).first()[0]


def test_known_values(spark):
    assert value(spark, "euclidean_standard", [0.0, 0.0], [3.0, 4.0]) == 5.0
    assert value(spark, "euclidean_classic", [0.0, 0.0], [3.0, 4.0]) == 25.0
    assert abs(value(spark, "chi_square_standard", [2.0, 2.0], [4.0, 6.0]) - 2.666666) < 1e-5
    assert abs(value(spark, "euclidean_standard", [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]) - 5.196152) < 1e-5
    assert value(spark, "manhattan", [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]) == 9.0
    assert abs(value(spark, "euclid_log", [0.0], [1.0]) - 100_000 * math.log(2)) < 1e-6


@pytest.mark.parametrize("name", sorted(DISTANCES))
def test_columns_equal_kernels_and_identity_symmetry(spark, name):
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(6, 5)))
    x[0, 0] = x[1, 0] = 0.0
    d = DISTANCES[name].block(x, x)
    rows = [(x[i].tolist(), x[j].tolist()) for i in range(6) for j in range(6)]
    got = [r[0] for r in spark.createDataFrame(rows, PAIR).select(DISTANCES[name].column(F.col("x"), F.col("y"))).collect()]
    assert np.allclose(np.array(got).reshape(6, 6), d)
    assert np.allclose(d, d.T)
    assert np.allclose(np.diag(d), 1.0 if name.startswith("gauss") else 0.0)
    empty = value(spark, name, [], [])
    assert empty == (1.0 if name.startswith("gauss") else 0.0)


def test_negative_and_zero_denominators_do_not_raise(spark):
    for name in DISTANCES:
        value(spark, name, [1.0, -1.0, 0.0], [-1.0, -2.0, 0.0])
    assert value(spark, "squared_chord", [-1.0], [4.0]) == 0.0
    with pytest.raises(ValueError):
        distance("nonsense")
