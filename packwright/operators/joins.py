"""Bringing per-group values back to rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with one row of ``values`` per group; null is a group like any other.

    One plain join: the engine broadcasts values that are small by its own count, and
    splits the rows of a large group over tasks where it exchanges them.
    """
    named = values.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    theirs = [f"_of_{k}" for k in keys]
    same = [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs)]
    return rows.join(named, same).drop(*theirs)
