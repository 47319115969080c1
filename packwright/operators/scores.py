"""Losses over tables of scores that were computed elsewhere."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.functions.vectors import IGNORED_LABEL, binary_cross_entropy, cross_entropy
from packwright.operators.aggregates import masked_mean


def mean_cross_entropy(scores: Column, label: Column, ignored: int = IGNORED_LABEL) -> Column:
    """Aggregate: mean over rows whose label is not the ignored one."""
    return F.avg(F.when(label != ignored, cross_entropy(scores, label)))


def masked_cross_entropy(scores: Column, label: Column, mask: Column) -> Column:
    return masked_mean(cross_entropy(scores, label), mask)


def mean_squared_error(predicted: Column, target: Column) -> Column:
    gap = predicted.cast("double") - target.cast("double")
    return F.avg(gap * gap)


def mean_binary_cross_entropy(score: Column, target: Column) -> Column:
    return F.avg(binary_cross_entropy(score, target))


def loss_kind(df: DataFrame, label: str, n_outputs: int) -> str:
    """One output is a regression; whole-number labels a choice of one; else many labels."""
    if n_outputs == 1:
        return "regression"
    whole = isinstance(df.schema[label].dataType, (T.IntegerType, T.LongType))
    return "single_label" if whole else "multi_label"


def score_loss(
    df: DataFrame, scores: str, label: str, n_outputs: int, groups: Sequence[str] = ()
) -> DataFrame:
    """Mean loss per group, the loss chosen by the columns.

    ``scores`` is an array of ``n_outputs`` numbers; with many labels ``label`` is an
    array of the same length, with one output it is a number.
    """
    kind = loss_kind(df, label, n_outputs)
    s, y = F.col(scores), F.col(label)
    if kind == "single_label":
        return df.groupBy(*groups).agg(mean_cross_entropy(s, y).alias("loss"))
    if kind == "regression":
        return df.groupBy(*groups).agg(mean_squared_error(F.get(s, F.lit(0)), y).alias("loss"))
    losses = F.zip_with(s, y, binary_cross_entropy)
    per_row = F.aggregate(losses, F.lit(0.0), lambda a, x: a + x)
    return df.groupBy(*groups).agg((F.sum(per_row) / F.sum(F.size(losses))).alias("loss"))
