"""Writing and reading back tokenized examples, blocks, chunks and batch logs.

``json`` writes one object per line; Parquet is the default. Folders are by
partition column, and the partition columns come from the data, so a read of one
chunk or one context length touches only its files. Chunks too small for a file of their own
share one; it is the only one that a read of such a chunk touches.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.integers import div

ARRAYS = "token_ids array<int>, tgt_mask array<int>"


def _write(df: DataFrame, path: str, by: Sequence[str], fmt: str, mode: str, **options: str) -> None:
    df.write.mode(mode).format(fmt).options(**options).partitionBy(*by).save(path)


def write_tokenized(examples: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """By type and subset. The rebalance splits a large subset over several files."""
    by = ("data_type", "subset_name")
    _write(examples.hint("rebalance", *by), path, by, fmt, mode)


def read_tokenized(spark: SparkSession, path: str, keys: str, fmt: str = "parquet") -> DataFrame:
    """``keys`` is the DDL of the key columns."""
    schema = f"{keys}, {ARRAYS}, data_type string, subset_name string"
    return spark.read.schema(schema).format(fmt).load(path)


def write_blocks(
    blocks: DataFrame, path: str, context_length: int, fmt: str = "parquet", replace: bool = False
) -> None:
    """By length, type and subset. ``pack`` has put runs of blocks together already.

    Subsets that were written before are replaced, with ``replace`` all blocks of the length,
    so a second run leaves no block twice.
    """
    by = ("data_type", "subset_name")
    if replace:
        _write(blocks, f"{path}/context_length={context_length}", by, fmt, "overwrite")
        return
    lengths = blocks.withColumn("context_length", F.lit(context_length))
    writer = lengths.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    writer.partitionBy("context_length", *by).save(path)


def read_blocks(
    spark: SparkSession, path: str, context_length: int, fmt: str = "parquet", example: str | None = None
) -> DataFrame:
    """All subsets of one context length. ``example`` is the DDL of the keys in their boundaries;
    without it, boundaries are left unread."""
    bounds = f", boundaries array<struct<start: int, length: int, {_fields(example)}>>" if example else ""
    schema = f"block_idx bigint, {ARRAYS}{bounds}, context_length int, data_type string, subset_name string"
    read = spark.read.schema(schema).format(fmt).load(path)
    return read.where(F.col("context_length") == context_length).drop("context_length")


def _fields(ddl: str) -> str:
    """Columns of a DDL as fields of a struct."""
    return ", ".join(f"{name}: {kind}" for name, kind in (c.strip().split(None, 1) for c in ddl.split(",")))


CHUNK_BY = ("epoch", "chunk_idx")
# Which run of places of its chunk a file holds.
PIECE = "piece"
# First and last chunk of a folder that holds several.
RUN = ("chunk_from", "chunk_to")
# 4,096 blocks of 8,192 tokens are 268 MB of ids and masks.
ROWS_PER_FILE = 4096


def _chunk_folders(chunk_rows: int | None, rows_per_file: int) -> tuple[tuple[str, ...], dict[str, Column]]:
    """Folder columns for chunks of at most ``chunk_rows`` rows, and how they are worked out.

    Chunks of which several fit a file share a folder, named after its first and last possible
    chunk; they keep their ``chunk_idx`` inside. Else files, folders and their listing would
    grow with the number of chunks and not with the bytes.
    """
    together = rows_per_file // max(1, chunk_rows or rows_per_file)
    if together < 2:
        return ("chunk_idx",), {}
    first = div(F.col("chunk_idx"), together) * together
    return RUN, dict(zip(RUN, (first, first + together - 1)))


def write_chunks(
    chunked: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    rows_per_file: int = ROWS_PER_FILE,
    compression: str | None = None,
    chunk_rows: int | None = None,
) -> None:
    """One folder per chunk, or per run of following chunks if ``chunk_rows``, the most rows a
    chunk has, says that several fit a file. A task writes runs of ``rows_per_file`` places, in
    order; a chunk of long blocks is gigabytes, so it is not one task's. ``compression`` is a
    codec of the format: ids as lines of JSON take more than twice the room without one, and a
    file of bounded rows need not be cut for reading."""
    folders, worked_out = _chunk_folders(chunk_rows, rows_per_file)
    by = ("epoch", *folders, PIECE)
    placed = chunked.withColumns({PIECE: div(F.col("chunk_position"), rows_per_file), **worked_out}).repartition(*by)
    placed = placed.sortWithinPartitions(*by, *CHUNK_BY[1:], "chunk_position")
    # The level is gzip's: digits come out little smaller for three times the work.
    options = {"compression": compression, "zlib.compress.level": "BEST_SPEED"} if compression else {}
    _write(placed, path, by, fmt, mode, **options)


def _chunk_pieces(
    spark: SparkSession, path: str, payload: str, fmt: str, chunk_idx: int | None = None
) -> DataFrame:
    """All chunks or one. A chunk that shares its folder is found by the folder's name."""
    columns = f"{payload}, chunk_position bigint, epoch int, chunk_idx bigint, {PIECE} bigint"
    pieces = spark.read.schema(f"{columns}, {', '.join(f'{c} bigint' for c in RUN)}").format(fmt).load(path)
    if chunk_idx is not None:
        first, last = (F.col(c) for c in RUN)
        pieces = pieces.where((first.isNull() | (first <= chunk_idx)) & (last.isNull() | (last >= chunk_idx)))
        pieces = pieces.where(F.col("chunk_idx") == chunk_idx)
    names = [c for c in pieces.columns if c not in (*CHUNK_BY, PIECE, *RUN)]
    return pieces.select(*names, *CHUNK_BY, PIECE)


def read_chunks(spark: SparkSession, path: str, payload: str, fmt: str = "parquet") -> DataFrame:
    return _chunk_pieces(spark, path, payload, fmt).drop(PIECE)


def read_first(
    spark: SparkSession,
    path: str,
    n_examples: int,
    payload: str,
    chunk_idx: int | None = None,
    epoch: int = 0,
    fmt: str = "parquet",
    rows_per_file: int = ROWS_PER_FILE,
) -> DataFrame:
    """Examples at the first ``n_examples`` places of one chunk, or of each; other files are not
    opened. ``rows_per_file`` is that of the write."""
    pieces = _chunk_pieces(spark, path, payload, fmt, chunk_idx).where(F.col("epoch") == epoch)
    last = (n_examples - 1) // rows_per_file
    return pieces.where((F.col(PIECE) <= last) & (F.col("chunk_position") < n_examples)).drop(PIECE)


def read_places(
    spark: SparkSession, path: str, chosen: DataFrame, payload: str, fmt: str = "parquet", rows_per_file: int = ROWS_PER_FILE
) -> DataFrame:
    """Examples at the chosen places (``epoch, chunk_idx, chunk_position``, and what else is to
    come along). The join prunes files by piece at run time, if the engine finds the chosen
    places small enough to broadcast; otherwise it reads the chunks and joins."""
    at = chosen.withColumn(PIECE, div(F.col("chunk_position"), rows_per_file))
    keys = [*CHUNK_BY, PIECE, "chunk_position"]
    return _chunk_pieces(spark, path, payload, fmt).join(at, keys).drop(PIECE)


def read_chunk(
    spark: SparkSession, path: str, chunk_idx: int, payload: str, epoch: int = 0, fmt: str = "parquet"
) -> DataFrame:
    return _chunk_pieces(spark, path, payload, fmt, chunk_idx).where(F.col("epoch") == epoch).drop(PIECE)


def write_rank_batches(
    batches: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    rows_per_file: int = ROWS_PER_FILE,
    rank_rows: int | None = None,
) -> None:
    """One folder per chunk and rank, or per run of chunks and rank, as with chunks (``rank_rows``:
    the most rows a rank has of a chunk). A task writes a run of places: a rank's share of a
    chunk can be gigabytes."""
    folders, worked_out = _chunk_folders(rank_rows, rows_per_file)
    by = (*folders, "rank")
    piece = div(F.col("rank_position"), rows_per_file)
    placed = batches.withColumns({"_piece": piece, **worked_out}).repartition(*by, "_piece")
    placed = placed.sortWithinPartitions(*by, "chunk_idx", "rank_position").drop("_piece")
    _write(placed, path, by, fmt, mode)


def write_named_texts(rows: DataFrame, folder: str) -> None:
    """A file of its own for each row of ``name, text``: result files and markers, of which
    there are a few per model. They go through the driver one by one."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name, text in rows.select("name", "text").toLocalIterator():
        path = hadoop.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(text.encode())
        finally:
            out.close()


# The log of so many chunks that follow each other goes to one task.
CHUNKS_PER_LOG_RUN = 64


def write_batch_log(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The steps of rank 0, one line each, in order of chunk and step. Lines are short: a file
    per chunk would cost more than what it holds, and one task would open them all."""
    run = div(F.col("chunk_idx"), CHUNKS_PER_LOG_RUN)
    steps = plan.where(F.col("rank") == 0).repartition(run).sortWithinPartitions("chunk_idx", "step")
    _write(steps, path, (), "json", mode)


def read_batch_log(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "rank int, batch_idx bigint, n_examples bigint, n_tokens bigint, n_targets bigint, step bigint, "
        "is_accumulating boolean, learning_rate double, chunk_idx bigint"
    )
    return spark.read.schema(schema).json(path)
