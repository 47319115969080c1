"""Masked and ragged means, norms, macro means, extents."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.vectors import (
    CLIP_EPSILON,
    MASKED_MEAN_EPSILON,
    MAX_NORM,
    doubles,
    scale,
    sum_of_squares,
)
from packwright.operators.joins import join_groups


def masked_mean(value: Column, mask: Column, epsilon: float = MASKED_MEAN_EPSILON) -> Column:
    """Aggregate form: the epsilon stays in the answer, and no mask at all gives zero."""
    x, m = value.cast("double"), mask.cast("double")
    weighted = F.coalesce(F.sum(x * m), F.lit(0.0))
    return weighted / (F.coalesce(F.sum(m), F.lit(0.0)) + F.lit(epsilon))


def global_norm(vectors: Column) -> Column:
    """Euclidean norm over all vectors of the group; null vectors are left out."""
    return F.sqrt(F.coalesce(F.sum(sum_of_squares(vectors)), F.lit(0.0)))


def clip_by_norm(
    rows: DataFrame, groups: Sequence[str], vector: str, max_norm: float = MAX_NORM
) -> DataFrame:
    """Scale each group's vectors so that their common norm is at most ``max_norm``.

    The norms are added up before they are exchanged.
    """
    norms = rows.groupBy(*groups).agg(global_norm(F.col(vector)).alias("group_norm"))
    factor = F.least(F.lit(1.0), F.lit(float(max_norm)) / (F.col("group_norm") + F.lit(CLIP_EPSILON)))
    joined = join_groups(rows, norms.withColumn("_factor", factor), groups)
    return joined.withColumn(vector, scale(F.col(vector), F.col("_factor"))).drop("_factor")


def macro_mean(rows: DataFrame, suite: str, task: str, metric: Column) -> DataFrame:
    """Plain mean over a suite's tasks of each task's mean."""
    tasks = rows.groupBy(suite, task).agg(F.avg(metric).alias("task_value"))
    return tasks.groupBy(suite).agg(
        F.count("*").alias("n_tasks"), F.avg("task_value").alias("metric_value")
    )


def group_extent(ordinal: Column, when_empty: int = 1) -> Column:
    """Largest ordinal plus one. A group without ordinals counts as one layer in a
    summary (``when_empty=1``) and as none when groups are stacked (``0``)."""
    return F.coalesce(F.max(ordinal).cast("bigint") + 1, F.lit(when_empty).cast("bigint"))


def ragged_mean(
    rows: DataFrame, keys: Sequence[str], row: str = "row_idx", values: str = "vals"
) -> DataFrame:
    """Mean of matrices of unlike shape, cell by cell, over the inputs that have the cell.

    ``rows`` is the long form, one row of one input's matrix per record. The result
    has the largest height and width among the inputs; a cell that no input has is
    NaN. Rows are added up as they are: only the same row of all inputs meets, so a key
    may be any share of the data.
    """
    keys = list(keys)
    same_row = rows.groupBy(*keys, row).agg(F.sort_array(F.collect_list(doubles(F.col(values)))).alias("_rows"))
    nothing = F.struct(F.array().cast("array<double>").alias("sums"), F.array().cast("array<bigint>").alias("n"))

    def add(acc: Column, one: Column) -> Column:
        sums = F.zip_with(acc["sums"], one, lambda a, x: F.coalesce(a + x, a, x))
        counts = F.zip_with(acc["n"], one, lambda n, x: F.coalesce(n, F.lit(0)) + x.isNotNull().cast("bigint"))
        return F.struct(sums.alias("sums"), counts.alias("n"))

    added = F.aggregate("_rows", nothing, add, lambda acc: F.zip_with(acc["sums"], acc["n"], lambda s, n: F.when(n > 0, s / n)))
    lines = same_row.select(*keys, row, added.alias("cells"))
    widths = rows.groupBy(*keys).agg(F.max(F.size(values)).alias("width"))
    # Inputs start at column zero, so the cells of a row are its first ones.
    fill = F.array_repeat(F.lit(float("nan")), F.col("width") - F.size("cells"))
    return join_groups(lines, widths, keys).select(
        *keys, row, F.concat("cells", fill).alias(values)
    )


def shape_summary(
    rows: DataFrame, groups: Sequence[str], ordinal: Column, row: Column
) -> DataFrame:
    """Layers and rows of the merged result."""
    return rows.groupBy(*groups).agg(
        group_extent(ordinal).alias("num_layers"), (F.max(row).cast("bigint") + 1).alias("num_rows")
    )
