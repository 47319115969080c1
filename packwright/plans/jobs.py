"""The stages end to end, each from one folder to the next.

A stage reads what the stage before has written, so it can be run again by itself: it
replaces what it wrote before.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.keys import LAYER_PREFIX, data_type_of, has_prefix, key_ordinal, path_part
from packwright.functions.text import affix, array_total, eos_array, n_tokens
from packwright.functions.tokenizers import start_in_part, tokenizer
from packwright.operators.batches import (
    DEVICES_PER_NODE,
    PER_DEVICE_BATCH,
    assign_ranks,
    batch_plan,
    collate,
    load_examples,
    sample_positions,
)
from packwright.operators.evals import look_up_metrics, parse_results, suite_scores
from packwright.operators.examples import target_flag
from packwright.operators.aggregates import group_extent
from packwright.operators.packing import CONTEXT_LENGTH, pack_parts
from packwright.operators.parameters import combine_models, missing_keys
from packwright.operators.pending import last_checkpoint
from packwright.operators.shuffling import CHUNK_SIZE, SEED, shuffle_into_chunks
from packwright.session import stage, staging
from packwright.sources.counters import block_counts, counted, span_counts
from packwright.sources.records import CHAT_SCHEMA, TEXT_SCHEMA, path_below, read_result_files
from packwright.sources.sinks import read_blocks, read_chunks, write_batch_log, write_blocks, write_chunks, write_rank_batches

# Where a record stands: its file, where the split starts, the row in the split, the turn. A
# file is told by its path below the folder that was read, so the same files elsewhere are the
# same; their order is that of these paths.
FILE_ORDER = ("file_id", "part_start", "row_in_part", "turn")
PART = ("file_id", "part_start")
SPAN_SCHEMA = (
    "file_id bigint, part_start bigint, row_in_part bigint, turn int, is_target int, role string, text string, "
    "reason string, token_ids array<int>, n bigint, start_in_part bigint, status string, data_type string, "
    "subset_name string, file string"
)
BLOCK_KEYS = ("data_type", "subset_name", "block_idx")
BLOCK_SCHEMA = "token_ids array<int>, tgt_mask array<int>, data_type string, subset_name string, block_idx bigint"


def read_turns(spark: SparkSession, paths: str, subset_from_end: int = 1) -> DataFrame:
    """Texts of chat and plain records in file order, with the speaker's flag and a ``reason``
    where a line or turn cannot be used.

    One scan serves both kinds: the file name says which a record is. The order does
    not depend on how the files are split, and a plain text counts as one target turn.
    ``subset_from_end`` is 2 where a subset is a folder of files.
    """
    schema = f"{CHAT_SCHEMA}, {TEXT_SCHEMA}, _corrupt string"
    records = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(paths).select(
        path_part(F.col("_metadata.file_path"), subset_from_end).alias("subset_name"),
        path_below(spark, paths).alias("file"),
        F.col("_metadata.file_block_start").alias("part_start"),
        F.monotonically_increasing_id().alias("row_in_part"),
        "conversations",
        "markdown",
        "_corrupt",
    )
    records = records.withColumns({"data_type": data_type_of(F.col("subset_name")), "file_id": F.xxhash64("file")})

    def turn(is_target: Column, role: Column, text: Column, reason: Column) -> Column:
        return F.struct(
            is_target.cast("int").alias("is_target"), role.alias("role"), text.alias("text"), reason.alias("reason")
        )

    def spoken(t: Column) -> Column:
        flag = target_flag(t["from"])
        unknown = F.concat(F.lit("unknown speaker "), F.coalesce(t["from"], F.lit("null")))
        reason = F.when(t["value"].isNull(), F.lit("no text")).when(flag.isNull(), unknown)
        return turn(flag, t["from"], t["value"], reason)

    no_text = F.lit(None).cast("string")
    is_chat = F.col("data_type") == "chat"
    wrong = (
        F.when(F.col("_corrupt").isNotNull(), "malformed line")
        .when(is_chat & F.col("conversations").isNull(), "no conversations")
        .when(~is_chat & F.col("markdown").isNull(), "no text")
    )
    turns = (
        F.when(wrong.isNotNull(), F.array(turn(F.lit(None), no_text, F.col("_corrupt"), wrong)))
        .when(is_chat, F.transform("conversations", spoken))
        .otherwise(F.array(turn(F.lit(1), no_text, F.col("markdown"), no_text)))
    )
    return records.select(
        "data_type", "subset_name", "file", *FILE_ORDER[:-1], F.posexplode(turns).alias("turn", "t")
    ).select("data_type", "subset_name", "file", *FILE_ORDER, "t.*")


def tokenize_files(
    spark: SparkSession,
    paths: str,
    out: str,
    tokenizer_name: str = "piece_bpe_32k",
    window: int | None = None,
    mode: str = "quarantine",
    subset_from_end: int = 1,
) -> dict[str, int]:
    """Raw line files to ``out/spans``, in one pass; a second run replaces the first.

    Its folder ``status=ok`` has the ids, ``status=rejected`` lines and turns that cannot
    be used: malformed lines, fields that are missing or null, unknown speakers, each with
    its ``reason``. In ``fail`` mode the first of them stops the job instead. Returns what the
    write counted: turns, tokens, target tokens, and what was set aside, by kind of reason.
    """
    tok = tokenizer(spark, tokenizer_name, window)
    turns = read_turns(spark, paths, subset_from_end)
    if mode == "fail":
        stop = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.col("subset_name"), F.lit(": "), F.col("reason"))))
        turns = turns.withColumn("reason", stop.cast("string"))
    elif mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    fine = F.col("reason").isNull()
    mark = F.when(F.col("is_target") == 1, eos_array(tok.eos_id)).otherwise(F.array().cast("array<int>"))
    ids = affix(tok.encode(F.coalesce("text", F.lit(""))), suffix=mark)
    spans = turns.select(
        *FILE_ORDER,
        "file",
        "is_target",
        "role",
        F.when(~fine, F.col("text")).alias("text"),
        "reason",
        F.when(fine, ids).alias("token_ids"),
        F.when(fine, "ok").otherwise("rejected").alias("status"),
        "data_type",
        "subset_name",
    )
    spans = spans.withColumn("n", F.coalesce(n_tokens(F.col("token_ids")), F.lit(0)).cast("bigint"))
    spans = spans.withColumn("start_in_part", start_in_part()("file_id", "part_start", "n"))
    by = ("status", "data_type", "subset_name")
    with counted(spans.hint("rebalance", *by), span_counts()) as c:
        c.rows.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/spans")
    return c.counts


def tokenized_counts(spark: SparkSession, tokenized: str) -> DataFrame:
    """Turns that were taken, and those set aside by reason."""
    spans = spark.read.schema(SPAN_SCHEMA).parquet(f"{tokenized}/spans")
    return spans.groupBy("data_type", "subset_name", "status", "reason").agg(F.count("*").alias("n_turns"))


# An example is a line: a text, or all turns of a chat.
EXAMPLE = ("file_id", "part_start", "row_in_part")
EXAMPLE_KEYS = "file_id bigint, part_start bigint, row_in_part bigint"


def pack_spans(
    spark: SparkSession, tokenized: str, out: str, context_length: int = CONTEXT_LENGTH, bounded: bool = False
) -> dict[str, int]:
    """``tokenize_files`` output to blocks. Lengths and starts are columns of their own there,
    so offsets are worked out without reading an id. ``bounded`` blocks tell which line each
    of their tokens comes from (``EXAMPLE_KEYS``). Returns the blocks, tokens and target tokens
    that the write counted."""
    spans = spark.read.schema(SPAN_SCHEMA).parquet(f"{tokenized}/spans").where(F.col("status") == "ok")
    with staging(spark):
        files = spans.select("file_id", "file").distinct().orderBy("file")
        numbers = stage(files.select("file_id", F.monotonically_increasing_id().alias("file_no")), "file-numbers")
        example = EXAMPLE if bounded else ()
        blocks = pack_parts(spans, context_length, parts=PART, example=example, numbers=numbers)
        with counted(blocks, block_counts(array_total)) as c:
            write_blocks(c.rows, out, context_length, replace=True)
    return c.counts


def chunk_blocks(
    spark: SparkSession,
    blocks: str,
    out: str,
    context_length: int = CONTEXT_LENGTH,
    chunk_size: int = CHUNK_SIZE,
    n_epochs: int = 1,
    keep: str = "all",
    mode: str = "strided",
    seed: int = SEED,
    fmt: str = "parquet",
) -> None:
    """Blocks of one length to shuffled chunk files. Small chunks share files."""
    rows = read_blocks(spark, blocks, context_length)
    chunked = shuffle_into_chunks(
        rows, BLOCK_KEYS, chunk_size=chunk_size, n_epochs=n_epochs, keep=keep, mode=mode, seed=seed
    )
    columns = ["token_ids", "tgt_mask", *BLOCK_KEYS, "chunk_position", "epoch", "chunk_idx"]
    write_chunks(chunked.select(*columns), out, fmt, "overwrite", chunk_rows=chunk_size)


def batch_chunks(
    spark: SparkSession,
    chunks: str,
    out: str,
    n_chunks: int,
    n_examples: int,
    world_size: int = DEVICES_PER_NODE,
    per_device_batch: int = PER_DEVICE_BATCH,
    accumulate: int = 1,
    epoch: int = 0,
    finished: DataFrame | None = None,
    seed: int = SEED,
    fmt: str = "parquet",
) -> None:
    """Chunk files to collated examples by chunk and rank (``out/batches``) and the step log
    of rank 0 (``out/log``).

    ``finished`` lists paths (column ``path``); chunks up to its last checkpoint are left
    out, and the seed moves with it.
    """
    last = -1 if finished is None else finished.agg(last_checkpoint(F.col("path"))).first()[0]
    read = read_chunks(spark, chunks, BLOCK_SCHEMA, fmt)
    rows = read.where((F.col("epoch") == epoch) & (F.col("chunk_idx") > last) & (F.col("chunk_idx") < n_chunks))
    keys = ["chunk_idx", *BLOCK_KEYS]
    # Past the seed the chunks were cut by: that one would leave a chunk as it is.
    chunk_seed = F.lit(seed + last + 2) + F.col("chunk_idx")
    sampled = sample_positions(
        rows, list(BLOCK_KEYS), "chunk_position", n_examples, seed=chunk_seed, groups=["chunk_idx"]
    )
    assigned = assign_ranks(sampled, world_size, per_device_batch).drop("chunk_position")
    loaded = load_examples(rows.select(*keys, "token_ids", "tgt_mask"), assigned, keys)
    batches = loaded.select(
        "chunk_idx",
        "rank",
        "rank_position",
        "batch_idx",
        "n_sampled",
        *[c.alias(name) for name, c in collate(F.col("token_ids"), F.col("tgt_mask")).items()],
    )
    write_rank_batches(batches, f"{out}/batches", mode="overwrite", rank_rows=-(-n_examples // world_size))
    written = spark.read.schema(batches.schema).parquet(f"{out}/batches")
    plan = batch_plan(written, n_chunks, n_examples, world_size, per_device_batch, accumulate)
    write_batch_log(plan, f"{out}/log", mode="overwrite")


def report_results(spark: SparkSession, folder: str | Sequence[str], digits: int | None = None) -> DataFrame:
    """Suite scores of the result files in a folder and below, or in several models' folders,
    by model (null where neither name nor folder has one)."""
    documents = read_result_files(spark, folder)
    parsed = documents.select("model", "suite", parse_results(F.col("document")).alias("results"))
    return suite_scores(look_up_metrics(parsed, ["model"]), ["model"], digits)


def combine_tables(
    spark: SparkSession,
    models: Sequence[str],
    out: str,
    method: str = "stack",
    compact: bool = False,
    vocabulary_key: str = "model.embed_tokens.weight",
) -> None:
    """Parameter tables (``key, row_idx, vals``), one folder per model, to one.

    ``out/rows`` has the combined rows, ``out/missing`` the plain keys that some model lacks
    and how many have them, ``out/shape`` the number of layers and of rows of the vocabulary.
    """
    tables = [spark.read.parquet(path).withColumn("model_idx", F.lit(i)) for i, path in enumerate(models)]
    rows = reduce(DataFrame.unionByName, [t.select("model_idx", "key", "row_idx", "vals") for t in tables])
    combined = combine_models(rows, method, len(models), compact)
    combined.write.mode("overwrite").parquet(f"{out}/rows")
    missing_keys(rows, len(models)).write.mode("overwrite").parquet(f"{out}/missing")
    written = spark.read.parquet(f"{out}/rows")
    ordinal = F.when(has_prefix(F.col("key"), LAYER_PREFIX), key_ordinal(F.col("key")))
    vocabulary = F.when(F.col("key") == vocabulary_key, F.col("row_idx"))
    shape = written.agg(
        group_extent(ordinal, when_empty=0).alias("num_layers"), group_extent(vocabulary, when_empty=0).alias("vocabulary_rows")
    )
    shape.write.mode("overwrite").parquet(f"{out}/shape")
