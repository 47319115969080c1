"""Running offsets and dense positions that no single task has to compute.

A running sum over a group of any size is built from totals of nested key ranges:
rows add up inside a narrow range of the key, ranges add up inside wider ranges,
and only the widest ranges of a group meet in one window. The ranges are pure
functions of the key, so a retried task gives the same answer, and the number of
rows or totals any one window sees is bounded by the width of a range, whatever
the share of its group. Only keys and lengths pass through here, never arrays.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A 64-bit key is cut into 2**22 wide ranges of 2**21 narrow ranges of 2**21 keys.
RANGE_SHIFTS = (42, 21)
# Further keys are ordinals inside the first (turns, parts): below 2**42, ranges of
# 2**21 keys keep every window as small.
INNER_SHIFTS = (21,)


def required(name: str, is_text: bool = False) -> Column:
    """The column, or an error where it is null: a null key would drop out of a join.

    The last value is never reached. It tells the planner that no null is left, which
    keeps null filters out of the plans and so lets equal exchanges be reused.
    """
    col = F.col(name)
    failure = F.raise_error(F.lit(f"null in key column {name}"))
    return F.coalesce(col, failure, F.lit("" if is_text else 0)).alias(name)


def nested_running_sum(
    df: DataFrame,
    groups: Sequence[str],
    ranges: Sequence[str],
    order: Sequence[str],
    length: str,
) -> DataFrame:
    """Add ``start`` (sum of ``length`` before the row) and ``total`` (of its group).

    ``ranges`` name the range columns from widest to narrowest; rows follow each
    other by ``ranges`` and then ``order`` within their group.
    """
    groups, ranges = list(groups), list(ranges)
    # One struct stands for all key columns of a level: joins and windows on a single
    # key keep planning fast however many levels there are.
    rows = df.withColumn("_path", F.struct(*groups, *ranges))

    def path(depth: int) -> Column:
        """The first ``depth`` ranges of a path, under its groups."""
        return F.struct(*[F.col(f"_path.{name}") for name in (*groups, *ranges[:depth])])

    def siblings(depth: int) -> Window:
        return Window.partitionBy(path(depth)) if groups or depth else Window.partitionBy()

    totals = []
    below, below_length = rows.select("_path", length), length
    for depth in range(len(ranges), 0, -1):
        below = below.groupBy(path(depth).alias("_path")).agg(F.sum(below_length).alias("_sum"))
        below_length = "_sum"
        totals.insert(0, below)

    to_here = (Window.unboundedPreceding, Window.currentRow)
    base = None
    for depth, level in enumerate(totals):
        in_order = siblings(depth).orderBy(F.col(f"_path.{ranges[depth]}")).rowsBetween(*to_here)
        before = F.sum("_sum").over(in_order) - F.col("_sum")
        if base is None:
            base = level.select("_path", before.alias("_base"), F.sum("_sum").over(siblings(0)).alias("total"))
        else:
            parents = base.withColumnRenamed("_path", "_parent")
            joined = level.withColumn("_parent", path(depth)).join(parents, "_parent")
            base = joined.select("_path", (F.col("_base") + before).alias("_base"), "total")

    in_order = Window.partitionBy("_path").orderBy(*order).rowsBetween(*to_here)
    running = F.sum(length).over(in_order) - F.col(length)
    return (
        rows.join(base, "_path")
        .withColumn("start", (F.col("_base") + running).cast("bigint"))
        .withColumn("total", F.col("total").cast("bigint"))
        .drop("_base", "_path")
    )


def running_offsets(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    length: str,
    shifts: dict[str, Sequence[int]] | None = None,
) -> DataFrame:
    """Offsets of rows laid end to end by ``keys`` inside each of ``groups``.

    The first key gets the nested ranges. Each further key (the turn of a
    conversation, the part of a text) adds its parent key as a level of its own and
    then its own ranges, so one conversation may hold any share of the rows. The
    keys together must be unique in the group and integral. ``shifts`` replaces the
    ranges of a key, with none for a key that has few values under its parent.
    ``df`` is read twice: write it first if that is costly.
    """
    kinds = dict(df.dtypes)
    for key in keys:
        if kinds[key] not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"key {key!r} must be integral, got {kinds[key]}")
    rows = df.select(
        *[required(c, kinds[c] == "string") if c in (*groups, *keys) else F.col(c) for c in df.columns]
    )
    ranges = []
    for place, key in enumerate(keys):
        whole = F.col(key).cast("bigint")
        usual = INNER_SHIFTS if place else RANGE_SHIFTS
        for shift in (shifts or {}).get(key, usual):
            name = f"_r{place}_{shift}"
            rows = rows.withColumn(name, F.shiftright(whole, shift))
            ranges.append(name)
        if place < len(keys) - 1:
            ranges.append(key)
    placed = nested_running_sum(rows, groups, ranges, [keys[-1]], length)
    return placed.select(*df.columns, "start", "total")


def dense_positions(
    df: DataFrame, groups: Sequence[str], keys: Sequence[str], position: str = "position"
) -> DataFrame:
    """Zero-based place of each row by ``keys`` in its group, and the group's row count."""
    counted = running_offsets(df.withColumn("_one", F.lit(1).cast("bigint")), groups, keys, "_one")
    return counted.withColumnRenamed("start", position).drop("_one")
