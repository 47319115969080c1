"""Seeded global order, epochs and chunks.

The order is that of a hash over (seed, epoch, key): any partitioning of the input
gives the same one, and no row is drawn from a generator. Keys must be unique in
their group; then hash prefixes are even however the input is skewed, and they
serve as the nested ranges of ``nested_running_sum``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.integers import div
from packwright.operators.offsets import nested_running_sum, required

# Seed of every order, examples in a chunk.
SEED = 11111
CHUNK_SIZE = 50000

# 60 bits of the hash; 2**12 wide prefixes of 2**12 narrow prefixes each.
HASH_DIGITS = 15
PREFIX_SHIFTS = (48, 36)


def order_key(seed: Column | int, epoch: Column | int, keys: Sequence[str]) -> Column:
    seed, epoch = (c if isinstance(c, Column) else F.lit(c) for c in (seed, epoch))
    parts = [seed, epoch, *[F.col(k) for k in keys]]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def seeded_positions(
    rows: DataFrame,
    keys: Sequence[str],
    seed: Column | int = SEED,
    epochs: Sequence[int] = (0,),
    groups: Sequence[str] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per epoch and group: ``position`` of each key in the shuffled order, and ``total`` rows.

    ``carry`` names further narrow columns to keep. ``rows`` is read twice.
    """
    names = [*groups, *keys]
    kinds = dict(rows.dtypes)
    rows = rows.select(*[required(c, kinds[c] == "string") for c in names], *carry)
    rows = rows.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    rows = rows.withColumn("order_key", order_key(seed, F.col("epoch"), keys))
    bits = F.conv(F.substring("order_key", 1, HASH_DIGITS), 16, 10).cast("bigint")
    bits = F.coalesce(bits, F.lit(0))  # never null; said so that no null filter is added
    rows = rows.withColumn("_one", F.lit(1).cast("bigint"))
    ranges = []
    for shift in PREFIX_SHIFTS:
        ranges.append(f"_p{shift}")
        rows = rows.withColumn(f"_p{shift}", F.shiftright(bits, shift))
    placed = nested_running_sum(rows, ["epoch", *groups], ranges, ["order_key", *keys], "_one")
    return placed.select(*names, *carry, "epoch", F.col("start").alias("position"), "total")


def chunk_count(total: Column, chunk_size: int = CHUNK_SIZE) -> Column:
    """An exact multiple of the chunk size still gets one chunk more."""
    return div(total, chunk_size) + 1


def shard(position: Column, total: Column, n_shards: Column, mode: str = "strided") -> tuple[Column, Column]:
    """Shard of a position, and its place inside the shard."""
    if mode == "strided":
        return F.pmod(position, n_shards), div(position, n_shards)
    if mode != "contiguous":
        raise ValueError(f"unknown mode {mode!r}")
    size = div(total, n_shards)
    longer = total - size * n_shards  # this many leading shards hold one row more
    border = longer * (size + 1)
    before = div(position, size + 1)
    rest = position - border
    after = longer + div(rest, F.greatest(size, F.lit(1)))
    in_longer = position < border
    place = F.when(in_longer, position - before * (size + 1)).otherwise(
        rest - (after - longer) * size
    )
    return F.when(in_longer, before).otherwise(after), place


def epochs_kept(n_epochs: int, keep: str = "all") -> list[int]:
    """``last`` is what is left when each epoch overwrites the files of the one before."""
    if keep == "all":
        return list(range(n_epochs))
    if keep == "last":
        return [n_epochs - 1]
    raise ValueError(f"unknown keep {keep!r}")


def assign_chunks(
    rows: DataFrame,
    keys: Sequence[str],
    chunk_size: int = CHUNK_SIZE,
    n_epochs: int = 1,
    keep: str = "all",
    mode: str = "strided",
    seed: int = SEED,
) -> DataFrame:
    """Keys with ``epoch, position, total, n_chunks, chunk_idx, chunk_position``."""
    placed = seeded_positions(rows, keys, seed, epochs_kept(n_epochs, keep))
    placed = placed.withColumn("n_chunks", chunk_count(F.col("total"), chunk_size))
    chunk_idx, place = shard(F.col("position"), F.col("total"), F.col("n_chunks"), mode)
    return placed.withColumn("chunk_idx", chunk_idx).withColumn("chunk_position", place)


def shuffle_into_chunks(rows: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """``rows`` with their chunk; only keys are ordered, the rest joins once."""
    chunks = assign_chunks(rows.select(*keys), keys, **options)
    return rows.join(chunks, list(keys))
