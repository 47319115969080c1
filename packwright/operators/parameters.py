"""Several keyed tables of matrix rows into one: layers put in order, the rest averaged."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.functions.keys import LAYER_PREFIX, has_prefix, key_ordinal, with_ordinal
from packwright.operators.aggregates import ragged_mean
from packwright.operators.ordinals import combine


def combine_models(
    rows: DataFrame, method: str, n_models: int, compact: bool = False, prefix: str = LAYER_PREFIX
) -> DataFrame:
    """``rows`` has ``model_idx, key, row_idx, vals``; the result ``key, row_idx, vals``.

    Keys with the prefix get a new ordinal by ``method``; each other key becomes the
    ragged mean over the models that have it.
    """
    is_layer = has_prefix(F.col("key"), prefix)
    layers = rows.where(is_layer).withColumn("ordinal", key_ordinal(F.col("key")))
    options = {"n_sources": n_models, "compact": compact} if method == "interleave" else {}
    placed = combine(layers, method, "model_idx", "ordinal", **options)
    renamed = placed.select(
        with_ordinal(F.col("key"), F.col("new_ordinal")).alias("key"),
        "row_idx",
        F.col("vals").cast("array<double>").alias("vals"),
    )
    return renamed.unionByName(ragged_mean(rows.where(~is_layer), ["key"]))


def missing_keys(rows: DataFrame, n_models: int, prefix: str = LAYER_PREFIX) -> DataFrame:
    """Keys outside the layers that not every model has, with the number of models that do."""
    others = rows.where(~has_prefix(F.col("key"), prefix)).select("key", "model_idx").distinct()
    held = others.groupBy("key").agg(F.count("*").alias("n_models"))
    return held.where(F.col("n_models") < n_models)
