"""Sums of doubles that do not depend on the order of the rows.

A double is split without error into three whole numbers, each of at most 32 bits, at fixed
powers of two (its bins). Whole numbers add up the same in any order and any partitioning,
partly before the exchange and partly after it. Only at the end, once per group, the bins
become one double again, rounded once: the double nearest to the true sum.
"""

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bin is 32 binary digits wide; these reach from the smallest double to the greatest.
WIDTH, LOWEST, HIGHEST = 32, -34, 31
# The lowest bin begins at the smallest double there is, not at a multiple of its width.
SMALLEST = -1074
# Bins of what is no number.
NAN, PLUS, MINUS = 100, 101, 102


def _exponent(number: int) -> int:
    return SMALLEST if number == LOWEST else number * WIDTH


def _unit(number: Column) -> Column:
    """The power of two a bin begins at."""
    units = F.array(*[F.lit(2.0 ** _exponent(n)) for n in range(LOWEST, HIGHEST + 1)])
    return F.element_at(units, (number - LOWEST + 1).cast("int"))


def limbs(value: Column) -> Column:
    """``array<struct<bin, part>>`` whose parts, each times the unit of its bin, are the value.

    Null has none. The binary logarithm only chooses the bins: should it be off at a border,
    the first part has a digit more.
    """
    size = F.abs(value)
    top = F.greatest(F.lit(LOWEST + 2), F.least(F.lit(HIGHEST), F.floor(F.log2(size) / WIDTH))).cast("int")
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))

    def split(bin_no: Column, rest: Column) -> Column:
        return whole(rest / _unit(bin_no)).cast("long")

    def struct(bin_no: Column, part: Column) -> Column:
        return F.struct(bin_no.cast("int").alias("bin"), part.cast("long").alias("part"))

    first = split(top, value)
    rest = value - first * _unit(top)
    second = split(top - 1, rest)
    rest = rest - second * _unit(top - 1)
    numbers = F.array(struct(top, first), struct(top - 1, second), struct(top - 2, split(top - 2, rest)))
    odd = F.when(F.isnan(value), NAN).when(value > 0, PLUS).otherwise(MINUS)
    # Zero is in a bin too: a sum over zeros is zero and not null.
    zero = F.array(struct(F.lit(0), F.lit(0)))
    return (
        F.when(value.isNull(), F.array().cast("array<struct<bin:int,part:bigint>>"))
        .when(F.isnan(value) | (size == float("inf")), F.array(struct(odd, F.lit(1))))
        .when(value == 0, zero)
        .otherwise(F.filter(numbers, lambda p: p["part"] != 0))
    )


def _nearest(bins: list[dict]) -> float:
    """The double nearest to the sum of parts at their bins; ties to even, as always."""
    found = {b["bin"] for b in bins}
    if NAN in found or {PLUS, MINUS} <= found:
        return float("nan")
    if found & {PLUS, MINUS}:
        return float("inf") if PLUS in found else float("-inf")
    total = sum(int(b["part"]) << (_exponent(b["bin"]) - SMALLEST) for b in bins)
    try:
        return total / (1 << -SMALLEST)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def _join_bins() -> Column:
    nearest = _nearest

    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa

        for batch in batches:
            yield pa.array([None if not row else nearest(row) for row in batch.to_pylist()], pa.float64())

    return F.arrow_udf(join, "double")


def exact_sums(df: DataFrame, groups: Sequence[str], sums: dict[str, Column], counts: dict[str, Column] | None = None) -> DataFrame:
    """One row per group: for each name the sum of its doubles, rounded once; null without any.

    ``counts`` are aggregates of whole numbers beside them, which are exact anyway. Rows are
    reduced to a few bins per group and task before they are exchanged, so one group may hold
    all rows. Infinities and NaN come out as they would from adding.
    """
    import sys

    from pyspark.cloudpickle import register_pickle_by_value

    register_pickle_by_value(sys.modules[__name__])
    groups, names = list(groups), list(sums)

    def numbered(i: int, value: Column) -> Column:
        return F.transform(limbs(value.cast("double")), lambda p: F.struct(F.lit(i).alias("no"), p["bin"].alias("bin"), p["part"].alias("part")))

    parts = F.concat(*[numbered(i, value) for i, value in enumerate(sums.values())])
    # Every row has one part at least, so that groups without any number are there as well.
    none = F.array(F.struct(F.lit(-1).alias("no"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("part")))
    rows = df.select(*groups, F.explode(F.concat(none, parts)).alias("p"))
    binned = rows.groupBy(*groups, F.col("p.no").alias("no"), F.col("p.bin").alias("bin")).agg(
        F.sum(F.col("p.part").cast("decimal(38,0)")).alias("part")
    )
    of = lambda i: F.collect_list(F.when(F.col("no") == i, F.struct("bin", F.col("part").cast("string").alias("part"))))
    gathered = binned.groupBy(*groups).agg(*[of(i).alias(name) for i, name in enumerate(names)])
    joined = gathered.select(*groups, *[_join_bins()(F.col(name)).alias(name) for name in names])
    if not counts:
        return joined
    counted = df.groupBy(*groups).agg(*[c.alias(name) for name, c in counts.items()])
    if not groups:
        return joined.join(F.broadcast(counted))  # one row each
    keys = [f"_g{i}" for i in range(len(groups))]
    renamed = counted.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], *counts)
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys)]
    condition = same[0]
    for more in same[1:]:
        condition &= more
    return joined.join(renamed, condition).drop(*keys)


def exact_mean(df: DataFrame, groups: Sequence[str], value: Column, mask: Column | None = None, name: str = "mean") -> DataFrame:
    """Mean of a column over the rows whose 0/1 mask is 1; 0 where the mask leaves none."""
    kept = value if mask is None else F.when(mask == 1, value)
    found = exact_sums(df, groups, {"_sum": kept}, {"_n": F.count(kept)})
    return found.select(*groups, F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("_sum") / F.col("_n")).alias(name))


def exact_norm(df: DataFrame, groups: Sequence[str], vector: str, name: str = "norm") -> DataFrame:
    """Length of all vectors of a group taken as one: the root of the sum of all squares."""
    squares = df.select(*groups, F.explode_outer(vector).alias("_x")).withColumn("_x", F.col("_x").cast("double"))
    found = exact_sums(squares, groups, {"_sum": F.col("_x") * F.col("_x")})
    return found.select(*groups, F.sqrt(F.coalesce("_sum", F.lit(0.0))).alias(name))
