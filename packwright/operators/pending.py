"""What is left to do, from a listing of what is there."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.keys import checkpoint_ordinal

RUNNING_SUFFIX = ".running"


def last_checkpoint(path: Column) -> Column:
    """Aggregate: largest N among ``ckpt_N`` paths, -1 where there is none."""
    return F.coalesce(F.max(checkpoint_ordinal(path)), F.lit(-1).cast("bigint"))


def resume_seed(base_seed: int, last: Column) -> Column:
    """Seed after a resume: it moves with the last finished chunk."""
    return (F.lit(base_seed) + last + 1).cast("bigint")


def remaining_chunks(
    planned: DataFrame, manifest: DataFrame, groups: Sequence[str], chunk: str = "chunk_idx", path: str = "path"
) -> DataFrame:
    """Planned chunks past the last checkpoint of their group, with the resume point."""
    groups = list(groups)
    done = manifest.groupBy(*groups).agg(last_checkpoint(F.col(path)).alias("last_checkpoint"))
    joined = planned.join(done, groups, "left").withColumn(
        "last_checkpoint", F.coalesce("last_checkpoint", F.lit(-1).cast("bigint"))
    )
    return joined.where(F.col(chunk) > F.col("last_checkpoint"))


def pending_results(planned: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Planned results with neither a result file nor a marker that one is being made.

    A marker goes away even when its run failed, so a failed result is planned again.
    """
    plain = F.regexp_replace(F.col(path), r"\.running$", "")
    taken = manifest.select(plain.alias(path))
    return planned.join(taken, path, "left_anti")
