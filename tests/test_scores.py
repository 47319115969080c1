import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packwright.functions.vectors import cross_entropy, last_token, mask_positions, rms_scale
from packwright.operators.scores import loss_kind, mean_binary_cross_entropy, mean_cross_entropy, score_loss


def plain_cross_entropy(v, label):
    v = np.asarray(v, dtype=float)
    return float(np.log(np.sum(np.exp(v - v.max()))) + v.max() - v[label])


def test_cross_entropy(spark):
    rows = [([1.0, 2.0, 3.0], 0), ([1000.0, 0.0], 1), ([-1000.0, -1001.0], 0), ([0.5], 0)]
    df = spark.createDataFrame(rows, "s array<double>, y int")
    got = [r.v for r in df.select(cross_entropy(F.col("s"), F.col("y")).alias("v")).collect()]
    assert got == pytest.approx([plain_cross_entropy(s, y) for s, y in rows])


def test_ignored_label_and_outside_label(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([5.0, 0.0], -100)], "s array<double>, y int")
    assert df.agg(mean_cross_entropy(F.col("s"), F.col("y"))).first()[0] == pytest.approx(
        plain_cross_entropy([1.0, 2.0], 1)
    )
    outside = spark.createDataFrame([([1.0], 3), ([1.0], -1)], "s array<double>, y int")
    assert [r[0] for r in outside.select(cross_entropy(F.col("s"), F.col("y"))).collect()] == [None, None]


def test_binary_cross_entropy(spark):
    rows = [(0.3, 1), (-2.0, 0), (800.0, 0), (-800.0, 1)]
    df = spark.createDataFrame(rows, "x double, y int")
    plain = [max(x, 0) - x * y + math.log1p(math.exp(-abs(x))) for x, y in rows]
    got = df.agg(mean_binary_cross_entropy(F.col("x"), F.col("y"))).first()[0]
    assert got == pytest.approx(sum(plain) / 4)


def test_loss_follows_the_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1, 0.5, [1.0, 0.0])], "s array<double>, y int, z double, t array<double>")
    assert loss_kind(df, "z", 1) == loss_kind(df, "y", 1) == "regression"
    assert loss_kind(df, "y", 2) == "single_label"
    assert loss_kind(df, "t", 2) == "multi_label"
    assert score_loss(df, "s", "z", 1).first()[0] == pytest.approx(0.25)
    assert score_loss(df, "s", "y", 2).first()[0] == pytest.approx(plain_cross_entropy([1.0, 2.0], 1))
    want = (math.log1p(math.exp(-1)) + 2 + math.log1p(math.exp(-2))) / 2
    assert score_loss(df, "s", "t", 2).first()[0] == pytest.approx(want)


def test_last_token(spark):
    rows = [[1, 2, 0, 0], [0, 0, 0], [1, 0, 2, 0], [4, 5]]
    df = spark.createDataFrame([(r,) for r in rows], "ids array<int>")
    ids = F.col("ids")
    got = [r.v for r in df.select(last_token(ids, ids, 0).alias("v")).collect()]
    assert got == [2, 0, 0, 5]
    assert [r.v for r in df.select(last_token(ids, ids, None).alias("v")).collect()] == [0, 0, 0, 5]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 500])
def test_mask_positions(spark, n):
    mask = [(i * i + i // 3) % 3 % 2 for i in range(n)]
    seen, want = 0, []
    for m in mask:
        seen += m
        want.append(seen - 1 if m else 1)
    df = spark.createDataFrame([(mask,)], "m array<int>")
    assert df.select(mask_positions(F.col("m")).alias("p")).first().p == want


def test_mask_of_the_fixture(spark):
    df = spark.createDataFrame([([0, 0, 1, 1],)], "m array<int>")
    assert df.select(mask_positions(F.col("m")).alias("p")).first().p == [1, 1, 0, 1]


def test_rms(spark):
    v = np.array([1.0, -2.0, 3.0])
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    weights = F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5))
    got = df.select(rms_scale(F.col("v")).alias("a"), rms_scale(F.col("v"), weights).alias("b")).first()
    want = v / np.sqrt(np.mean(v**2) + 1e-6)
    np.testing.assert_allclose(got.a, want)
    np.testing.assert_allclose(got.b, want * np.array([1.0, 2.0, 0.5]))
