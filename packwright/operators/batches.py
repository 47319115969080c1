"""Sampling from chunks, ranks, micro-batches and the plan of training steps."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.integers import div
from packwright.functions.schedule import cosine_rate, warmup_steps
from packwright.functions.text import array_total, n_tokens
from packwright.operators.offsets import dense_positions
from packwright.operators.shuffling import SEED, seeded_positions

# Examples in a device's batch, devices of a node.
PER_DEVICE_BATCH = 10
DEVICES_PER_NODE = 4


def sample_positions(
    rows: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    n_examples: int | None,
    shuffle: bool = True,
    seed: Column | int = SEED,
    groups: Sequence[str] = (),
) -> DataFrame:
    """The first ``n_examples`` ordinals (None: all) with their place, permuted or as they are.

    ``sample_position`` is dense over the rows that exist; ``n_sampled`` says how many
    there are, so ``n_examples - n_sampled`` is the shortfall.
    """
    chosen = rows.select(*groups, *keys, ordinal)
    if n_examples is not None:
        chosen = chosen.where(F.col(ordinal) < n_examples)
    if shuffle:
        placed = seeded_positions(chosen, keys, seed, (0,), groups, carry=[ordinal])
        placed = placed.withColumnRenamed("position", "sample_position").drop("epoch")
    else:
        placed = dense_positions(chosen, groups, [ordinal], "sample_position")
    return placed.withColumnRenamed("total", "n_sampled")


def truncate_to_batches(sampled: DataFrame, global_batch: int) -> DataFrame:
    """Drop what does not fill a global batch, after permuting: a random rest goes."""
    return sampled.where(
        F.col("sample_position") < div(F.col("n_sampled"), global_batch) * global_batch
    )


def assign_ranks(sampled: DataFrame, world_size: int, per_device_batch: int = PER_DEVICE_BATCH) -> DataFrame:
    """Strided ranks, the place within the rank, and the micro-batch of that place."""
    truncated = truncate_to_batches(sampled, world_size * per_device_batch)
    return truncated.select(
        "*",
        F.pmod("sample_position", F.lit(world_size)).cast("int").alias("rank"),
        div(F.col("sample_position"), world_size).alias("rank_position"),
        div(F.col("sample_position"), world_size * per_device_batch).alias("batch_idx"),
    )


def load_examples(payload: DataFrame, assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payloads of the assigned keys. The write by rank sorts by ``rank_position``."""
    return payload.join(assigned, list(keys))


def collate(token_ids: Column, tgt_mask: Column) -> dict[str, Column]:
    """Inputs without the last token; labels and mask without the first."""
    shorter = F.size(token_ids) - 1
    return {
        "input_ids": F.slice(token_ids, F.lit(1), shorter),
        "labels": F.slice(token_ids, F.lit(2), shorter),
        "loss_mask": F.slice(tgt_mask, F.lit(2), shorter),
    }


def collated(examples: DataFrame, keep: Sequence[str]) -> DataFrame:
    columns = collate(F.col("token_ids"), F.col("tgt_mask"))
    return examples.select(*keep, *[c.alias(name) for name, c in columns.items()])


def total_steps(n_examples: int, global_batch: int, n_chunks: int) -> int:
    return n_examples // global_batch * n_chunks


def batch_plan(
    assigned: DataFrame,
    n_chunks: int,
    n_examples: int,
    world_size: int,
    per_device_batch: int = PER_DEVICE_BATCH,
    accumulate: int = 1,
    chunk: str = "chunk_idx",
) -> DataFrame:
    """One row per chunk, rank and batch: its step and the rate that step runs at.

    Steps count micro-batches. The rate is that of the step before it is counted up,
    and each chunk starts at its index times the batches of ``n_examples``, so steps of
    chunks never meet: a chunk with fewer rows leaves out the steps it lacks. With collated
    arrays in ``assigned`` the row also counts tokens and targets of the batch.
    """
    global_batch = world_size * per_device_batch
    sizes = [F.count("*").alias("n_examples")]
    if "loss_mask" in assigned.columns:
        sizes += [
            F.sum(n_tokens(F.col("input_ids"))).alias("n_tokens"),
            F.sum(array_total(F.col("loss_mask"))).alias("n_targets"),
        ]
    batches = assigned.groupBy(chunk, "rank", "batch_idx").agg(*sizes)
    before = F.col(chunk) * F.lit(n_examples // global_batch) + F.col("batch_idx")
    steps = total_steps(n_examples, global_batch, n_chunks)
    step = before + 1
    return batches.select(
        chunk,
        "rank",
        "batch_idx",
        "n_examples",
        *[c for c in ("n_tokens", "n_targets") if c in batches.columns],
        step.cast("bigint").alias("step"),
        (F.pmod(step, F.lit(accumulate)) != 0).alias("is_accumulating"),
        cosine_rate(before, steps, warmup_steps(steps)).alias("learning_rate"),
    )
