"""Combining groups of ordered rows: stacked, interleaved, compared, overwritten."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.operators.aggregates import group_extent
from packwright.operators.joins import join_groups
from packwright.operators.offsets import dense_positions, running_offsets


def stack(
    rows: DataFrame, source: str, ordinal: str, groups: Sequence[str] = (), result: str = "new_ordinal"
) -> DataFrame:
    """Put sources one after the other: each ordinal moves up by the extents before it."""
    groups = list(groups)
    extents = rows.groupBy(*groups, source).agg(
        group_extent(F.col(ordinal), when_empty=0).alias("extent")
    )
    starts = running_offsets(extents, groups, [source], "extent")
    return (
        join_groups(rows, starts.select(*groups, source, "start"), groups + [source])
        .withColumn(result, F.col("start") + F.col(ordinal))
        .drop("start")
    )


def interleave(
    rows: DataFrame,
    source: str,
    ordinal: str,
    n_sources: Column | int,
    groups: Sequence[str] = (),
    compact: bool = False,
    result: str = "new_ordinal",
) -> DataFrame:
    """Take ordinal 0 of every source, then ordinal 1, and so on.

    Sources of unlike depth leave gaps, because a source that has run out still
    counts; ``compact`` closes them. ``source`` is the zero-based place of a source.
    """
    groups = list(groups)
    n_sources = n_sources if isinstance(n_sources, Column) else F.lit(n_sources)
    spread = rows.withColumn(
        result, (F.col(ordinal).cast("bigint") * n_sources + F.col(source)).cast("bigint")
    )
    if not compact:
        return spread
    used = spread.select(*groups, result).distinct()
    ranks = dense_positions(used, groups, [result], "_rank").drop("total")
    joined = join_groups(spread, ranks, groups + [result])
    return joined.withColumn(result, F.col("_rank")).drop("_rank")


def combine(rows: DataFrame, method: str, source: str, ordinal: str, n_sources=None, **options) -> DataFrame:
    """``stack`` or ``interleave`` by name."""
    if method == "stack":
        return stack(rows, source, ordinal, **options)
    if method == "interleave":
        return interleave(rows, source, ordinal, n_sources, **options)
    raise NotImplementedError(f"unknown method {method!r}")


def compare_keys(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """Every key of either list, and whether both have it at the same place."""
    sides = left.select(key, F.col(position).alias("left_position")).join(
        right.select(key, F.col(position).alias("right_position")), key, "full_outer"
    )
    status = (
        F.when(F.col("left_position").isNull(), "missing_left")
        .when(F.col("right_position").isNull(), "missing_right")
        .when(F.col("left_position") != F.col("right_position"), "moved")
        .otherwise("same")
    )
    return sides.withColumn("status", status)


def last_writer(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key; reduced before it is exchanged."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    winner = F.max(F.struct(*order, F.struct(*rest).alias("rest"))).alias("w")
    picked = rows.groupBy(*keys).agg(winner)
    return picked.select(*keys, *[F.col(f"w.{c}") for c in order], "w.rest.*")
