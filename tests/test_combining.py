import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packwright.functions.keys import has_prefix, key_ordinal, with_ordinal
from packwright.operators.aggregates import clip_by_norm, group_extent, macro_mean, masked_mean, ragged_mean
from packwright.operators.ordinals import combine, compare_keys, last_writer
from packwright.functions.vectors import masked_mean as masked_mean_of_arrays


def test_masked_mean_keeps_its_epsilon(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 9.0, 0), ("b", 5.0, 0)], "g string, x double, m int")
    got = {r.g: r.v for r in df.groupBy("g").agg(masked_mean(F.col("x"), F.col("m")).alias("v")).collect()}
    assert got == {"a": 2.0 / (1 + 1e-5), "b": 0.0}
    arrays = spark.createDataFrame([([2.0, 9.0], [1, 0])], "x array<double>, m array<int>")
    assert arrays.select(masked_mean_of_arrays(F.col("x"), F.col("m"))).first()[0] == 2.0 / (1 + 1e-5)


def test_clip(spark):
    rows = [("big", [3.0, 0.0]), ("big", [0.0, 4.0]), ("small", [0.1, 0.2])]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    got = {}
    for r in clip_by_norm(df, ["g"], "v").collect():
        got.setdefault(r.g, []).extend(r.v)
    assert math.sqrt(sum(x * x for x in got["big"])) == pytest.approx(1.0, abs=1e-6)
    assert got["small"] == [0.1, 0.2]


def test_macro_mean_counts_tasks_alike(spark):
    df = spark.createDataFrame([("s", "x", 1.0)] * 9 + [("s", "y", 0.0)], "suite string, task string, v double")
    row = macro_mean(df, "suite", "task", F.col("v")).first()
    assert (row.n_tasks, row.metric_value) == (2, 0.5)


def test_extent_of_nothing(spark):
    empty = spark.createDataFrame([], "o int")
    assert empty.agg(group_extent(F.col("o"))).first()[0] == 1
    assert empty.agg(group_extent(F.col("o"), when_empty=0)).first()[0] == 0


def padded_mean(matrices):
    height, width = max(m.shape[0] for m in matrices), max(m.shape[1] for m in matrices)
    total, count = np.zeros((height, width)), np.zeros((height, width))
    for m in matrices:
        total[: m.shape[0], : m.shape[1]] += m
        count[: m.shape[0], : m.shape[1]] += 1
    return np.divide(total, count, out=np.full((height, width), np.nan), where=count > 0)


@pytest.mark.parametrize("shapes", [[(4, 2), (2, 4)], [(3, 3)] * 3, [(1, 5), (6, 1), (2, 2)], [(1, 7), (1, 3)]])
def test_ragged_mean(spark, shapes):
    draw = np.random.default_rng(4)
    matrices = [draw.normal(size=s) for s in shapes]
    rows = [("k", i, r, m[r].tolist()) for i, m in enumerate(matrices) for r in range(m.shape[0])]
    df = spark.createDataFrame(rows, "key string, model_idx int, row_idx int, vals array<double>")
    got = sorted(ragged_mean(df, ["key"]).collect(), key=lambda r: r.row_idx)
    np.testing.assert_allclose(np.array([r.vals for r in got]), padded_mean(matrices))


def test_row_without_cells_is_all_nan(spark):
    df = spark.createDataFrame([("k", 0, [1.0, 2.0]), ("k", 1, [])], "key string, row_idx int, vals array<double>")
    got = {r.row_idx: r.vals for r in ragged_mean(df, ["key"]).collect()}
    assert got[0] == [1.0, 2.0] and len(got[1]) == 2 and all(math.isnan(x) for x in got[1])


def depths(spark, *sizes):
    rows = [(s, o) for s, size in enumerate(sizes) for o in range(size)]
    return spark.createDataFrame(rows, "source_idx int, ordinal int")


def by_source(df):
    return {(r.source_idx, r.ordinal): r.new_ordinal for r in df.collect()}


def test_stack(spark):
    got = by_source(combine(depths(spark, 2, 3), "stack", "source_idx", "ordinal"))
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 3, (1, 2): 4}


def test_interleave(spark):
    rows = depths(spark, 2, 3)
    gaps = by_source(combine(rows, "interleave", "source_idx", "ordinal", 2))
    assert gaps == {(0, 0): 0, (1, 0): 1, (0, 1): 2, (1, 1): 3, (1, 2): 5}
    closed = by_source(combine(rows, "interleave", "source_idx", "ordinal", 2, compact=True))
    assert closed == {**gaps, (1, 2): 4}


def test_unknown_method(spark):
    with pytest.raises(NotImplementedError):
        combine(depths(spark, 1), "braid", "source_idx", "ordinal")


def test_key_lists(spark):
    left = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "key string, p int")
    right = spark.createDataFrame([("a", 0), ("c", 1), ("d", 2)], "key string, p int")
    got = {r.key: r.status for r in compare_keys(left, right, "key", "p").collect()}
    assert got == {"a": "same", "b": "missing_right", "c": "moved", "d": "missing_left"}


def test_last_writer(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, None), ("k", 2, "mid"), ("j", 0, "x")],
                               "key string, src int, v string")
    got = {r.key: (r.src, r.v) for r in last_writer(df, ["key"], ["src"]).collect()}
    assert got == {"k": (3, None), "j": (0, "x")}


def test_dotted_keys(spark):
    df = spark.createDataFrame([("model.layers.7.mlp.weight",), ("model.layers.12",), ("lm_head.weight",)], "k string")
    k = F.col("k")
    rows = df.where(has_prefix(k)).select(key_ordinal(k), with_ordinal(k, key_ordinal(k) + 3)).collect()
    assert [tuple(r) for r in rows] == [(7, "model.layers.10.mlp.weight"), (12, "model.layers.15")]
