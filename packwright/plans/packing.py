"""Queries: offsets, blocks, and what packing loses."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.integers import div
from packwright.functions.text import array_total, ids_digest, n_tokens
from packwright.functions.tokenizers import tokenizer
from packwright.operators.checks import check_rules, same_length, targets_end_at
from packwright.operators.examples import text_spans, with_mask
from packwright.operators.offsets import running_offsets
from packwright.operators.packing import (
    SUBSET,
    example_positions,
    examples_in_blocks,
    pack,
    packing_report,
    token_offsets as place_examples,
    unpack,
)
from packwright.plans.inputs import (
    BLOCK,
    BLOCK_ROWS_SQL,
    CHAT_BLOCK,
    CHAT_TOKENS,
    DOC_TOKENS,
    chat_blocks_sql,
    conversation_spans,
    doc_blocks_sql,
    document_examples,
    document_spans,
    documents,
)
from packwright.plans.registry import query
from packwright.session import fresh_path, stage
from packwright.sources.records import PLACE, read_tokenized_files
from packwright.sources.sinks import read_blocks, write_blocks
from packwright.sources.tables import spread
from packwright.streaming.packing import StreamPacker
from packwright.streaming.stateful import Packing, start as start_stream

ARRIVALS = 3
# Small, so that tables of this size spread over the tasks; jobs on large ones raise it.
TOKENS_PER_RUN = 1 << 18


def block_rows(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        "data_type",
        "subset_name",
        "block_idx",
        ids_digest(F.col("token_ids")).alias("ids_md5"),
        array_total(F.col("tgt_mask")).alias("n_targets"),
    )


@query(f"""
WITH {DOC_TOKENS},
sized AS (SELECT subset_name, doc_id, count(*) AS n FROM doc_tokens GROUP BY ALL)
SELECT subset_name, doc_id, n::BIGINT AS n,
       (sum(n) OVER (PARTITION BY subset_name ORDER BY doc_id) - n)::BIGINT AS start,
       (sum(n) OVER (PARTITION BY subset_name))::BIGINT AS total
FROM sized
""")
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    placed = place_examples(document_spans(spark, sf))
    return placed.select("subset_name", "doc_id", "n", "start", "total")


@query(f"WITH {doc_blocks_sql()} SELECT {BLOCK_ROWS_SQL} FROM doc_blocks")
def pack_documents(spark: SparkSession, sf: str) -> DataFrame:
    return block_rows(pack(document_spans(spark, sf), BLOCK, tokens_per_run=TOKENS_PER_RUN))


@query(f"WITH {chat_blocks_sql()} SELECT {BLOCK_ROWS_SQL} FROM chat_blocks")
def pack_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks straight from turns: no task ever holds a whole conversation."""
    return block_rows(pack(conversation_spans(spark, sf), CHAT_BLOCK, keys=("conv_id", "turn")))


@query(f"""
WITH {chat_blocks_sql()},
checked AS (
  SELECT len(ids) = {CHAT_BLOCK} AS block_is_full, len(mask) = len(ids) AS mask_as_long_as_ids,
    len(list_filter(mask, lambda x: x <> 0 AND x <> 1)) = 0 AS mask_is_zero_or_one,
    list_sum(mask) > 0 AS has_target, 2 * list_sum(mask) >= len(mask) AS half_is_target,
    mask[1] = 0 AS starts_outside_target,
    len(list_filter(range(1, len(mask)), lambda i: mask[i] = 1 AND mask[i + 1] = 0 AND ids[i] <> 268435456)) = 0
      AS targets_end_marked
  FROM chat_blocks
)
SELECT rule, count(*)::BIGINT AS n_checked, sum((NOT ok)::INT)::BIGINT AS n_violations
FROM (UNPIVOT checked ON block_is_full, mask_as_long_as_ids, mask_is_zero_or_one, has_target, half_is_target,
      starts_outside_target, targets_end_marked INTO NAME rule VALUE ok)
GROUP BY rule
""")
def block_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on the masks of blocks, as they are read back from the files."""
    path = fresh_path(spark, "ruled-blocks")
    write_blocks(pack(conversation_spans(spark, sf), CHAT_BLOCK, keys=("conv_id", "turn")), path, CHAT_BLOCK)
    ids, mask = F.col("token_ids"), F.col("tgt_mask")
    return check_rules(
        read_blocks(spark, path, CHAT_BLOCK),
        {
            "block_is_full": F.size(ids) == CHAT_BLOCK,
            "mask_as_long_as_ids": same_length(ids, mask),
            "mask_is_zero_or_one": F.forall(mask, lambda x: x.isin(0, 1)),
            "has_target": array_total(mask) > 0,
            "half_is_target": 2 * array_total(mask) >= F.size(mask),
            "starts_outside_target": F.element_at(mask, 1) == 0,
            "targets_end_marked": targets_end_at(ids, mask, tokenizer(spark, "word_md5").eos_id),
        },
    )


def _packed_and_back(spans: DataFrame, keys: list[str], length: int, name: str) -> DataFrame:
    """Pack, cut every example out of the blocks again and decode it."""
    tok = tokenizer(spans.sparkSession, name)
    tokens = stage(spans.withColumn("n", n_tokens(F.col("token_ids"))), "tokens")
    offsets = stage(running_offsets(tokens.where("n > 0").select(*SUBSET, *keys, "n"), SUBSET, keys, "n"), "offsets")
    blocks = stage(pack(tokens, length, keys=keys, staged=False, tokens_per_run=TOKENS_PER_RUN, offsets=offsets), "blocks")
    found = unpack(blocks, tokens, offsets, keys, length)
    ids = F.col("token_ids")
    marked = F.element_at(ids, -1) == tok.eos_id
    text = tok.decode(F.when(marked, F.slice(ids, 1, F.size(ids) - 1)).otherwise(ids))
    return found.select(*keys, marked.alias("has_mark"), text.alias("text")).select(
        *keys, "has_mark", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars")
    )


@query("SELECT doc_id, true AS has_mark, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM documents")
def bpe_pack_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _packed_and_back(document_spans(spark, sf, "piece_bpe_32k"), ["doc_id"], BLOCK, "piece_bpe_32k")


# A turn without text and without an end mark takes no place in the blocks.
@query("""
SELECT conv_id, turn, role = 'assistant' AS has_mark, md5(text) AS text_md5, length(text)::BIGINT AS n_chars
FROM conversations WHERE text <> '' OR role = 'assistant'
""")
def bpe_pack_chat(spark: SparkSession, sf: str) -> DataFrame:
    spans = conversation_spans(spark, sf, "piece_bpe_32k")
    return _packed_and_back(spans, ["conv_id", "turn"], CHAT_BLOCK, "piece_bpe_32k")


DOC_PLACES = f"""{DOC_TOKENS},
places AS (
  SELECT subset_name, doc_id, row_number() OVER (PARTITION BY subset_name ORDER BY doc_id, i) - 1 AS p,
         count(*) OVER (PARTITION BY subset_name) // {BLOCK} * {BLOCK} AS kept
  FROM doc_tokens
),
held AS (SELECT subset_name, doc_id, p // {BLOCK} AS block_idx, p % {BLOCK} AS spot FROM places WHERE p < kept)"""


@query(f"""
WITH {DOC_PLACES}
SELECT subset_name, block_idx::BIGINT AS block_idx, doc_id, min(spot)::INT AS start, count(*)::INT AS length
FROM held GROUP BY subset_name, block_idx, doc_id
""")
def block_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Whose tokens stand where in a block."""
    blocks = pack(document_spans(spark, sf), BLOCK, tokens_per_run=TOKENS_PER_RUN, example=["doc_id"])
    return examples_in_blocks(blocks, ["subset_name", "block_idx"]).select(
        "subset_name", "block_idx", "doc_id", "start", "length"
    )


# A conversation is one example, though its turns are packed as rows of their own.
@query(f"""
WITH {CHAT_TOKENS},
places AS (
  SELECT conv_id, m, row_number() OVER (ORDER BY conv_id, turn, i) - 1 AS p, count(*) OVER () // {CHAT_BLOCK} * {CHAT_BLOCK} AS kept
  FROM chat_tokens
),
held AS (SELECT conv_id, m, p // {CHAT_BLOCK} AS block_idx, p % {CHAT_BLOCK} AS spot FROM places WHERE p < kept),
numbered AS (SELECT *, spot - min(spot) OVER (PARTITION BY block_idx, conv_id) AS place FROM held)
SELECT block_idx::BIGINT AS block_idx, count(DISTINCT conv_id)::BIGINT AS n_examples,
       md5(array_to_string(list(place ORDER BY spot), ',')) AS positions_md5,
       md5(array_to_string(list(conv_id ORDER BY spot), ',')) AS owners_md5
FROM numbered GROUP BY block_idx
""")
def block_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions that begin again at each conversation, written with the blocks and read back."""
    path = fresh_path(spark, "bounded-blocks")
    blocks = pack(conversation_spans(spark, sf), CHAT_BLOCK, keys=("conv_id", "turn"), example=["conv_id"])
    write_blocks(blocks, path, CHAT_BLOCK)
    back = read_blocks(spark, path, CHAT_BLOCK, example="conv_id bigint")
    owners = F.flatten(F.transform("boundaries", lambda b: F.array_repeat(b["conv_id"], b["length"])))
    return back.select(
        "block_idx",
        F.size("boundaries").cast("bigint").alias("n_examples"),
        ids_digest(example_positions(F.col("boundaries"))).alias("positions_md5"),
        ids_digest(owners).alias("owners_md5"),
    )


@query(f"WITH {doc_blocks_sql()} SELECT {BLOCK_ROWS_SQL} FROM doc_blocks")
def pack_tokenized_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' ids as lines in a folder per subset, read with their place and packed."""
    root = fresh_path(spark, "lines")
    examples = stage(document_examples(spark, sf), "examples")
    lines = examples.repartitionByRange("subset_name", "doc_id").sortWithinPartitions("subset_name", "doc_id")
    lines.select("token_ids", "tgt_mask", "subset_name").write.partitionBy("subset_name").json(f"{root}/text")
    known, _ = read_tokenized_files(spark, f"{root}/*/*", subset_from_end=2)
    known = known.withColumn("subset_name", F.regexp_replace("subset_name", "^subset_name=", ""))
    return block_rows(pack(known, BLOCK, keys=PLACE))


@query(f"""
WITH {DOC_TOKENS},
t AS (SELECT subset_name, count(DISTINCT doc_id) AS n_examples, count(*) AS n FROM doc_tokens GROUP BY ALL)
SELECT subset_name, n_examples::BIGINT AS n_examples, n::BIGINT AS n_tokens, (n // {BLOCK})::BIGINT AS n_blocks,
       (n // {BLOCK} * {BLOCK})::BIGINT AS kept_tokens, (n % {BLOCK})::BIGINT AS dropped_tokens
FROM t
""")
def packing_loss(spark: SparkSession, sf: str) -> DataFrame:
    return packing_report(document_spans(spark, sf), BLOCK).drop("data_type")


@query(f"WITH {doc_blocks_sql()} SELECT {BLOCK_ROWS_SQL} FROM doc_blocks")
def pack_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents arrive in three goes, in order of their id; after each the stream
    is started again and goes on from its checkpoint."""
    root = fresh_path(spark, "stream")
    docs = spread(documents(spark, sf), "doc_id")
    tok = tokenizer(spark, "word_md5")
    last = docs.agg(F.max("doc_id")).first()[0]
    arrival = div(F.col("doc_id") * ARRIVALS, last + 1)
    packer = StreamPacker(f"{root}/packed", BLOCK)
    for number in range(ARRIVALS):
        docs.where(arrival == number).write.mode("append").parquet(f"{root}/arrived")
        arriving = spark.readStream.schema(docs.schema).parquet(f"{root}/arrived")
        examples = with_mask(text_spans(arriving, tok, ["data_type", "subset_name", "doc_id"]))
        packer.start(examples, f"{root}/checkpoint").awaitTermination()
    return block_rows(packer.read(spark, docs))


@query(f"WITH {doc_blocks_sql()} SELECT {BLOCK_ROWS_SQL} FROM doc_blocks")
def pack_stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """The documents arrive in three goes that are mixed up throughout; each waits in the state
    for those before it. Their ids stand for seconds of event time."""
    root = fresh_path(spark, "late-stream")
    docs = documents(spark, sf)
    moment = F.timestamp_seconds(F.col("doc_id") + 1_000_000_000)  # well after the first watermark, 1970
    end = docs.agg(F.max("doc_id").alias("doc_id")).select(
        "doc_id", F.lit("").alias("text"), F.lit("end").alias("data_type"), F.lit("end").alias("subset_name"),
        F.timestamp_seconds(F.col("doc_id") * 2 + 1_000_100_000).alias("ts"),
    )
    docs = docs.select("*", moment.alias("ts"))
    tok = tokenizer(spark, "word_md5")
    span = docs.agg(F.max("doc_id") - F.min("doc_id")).first()[0]
    packing = Packing(BLOCK, delay=f"{span + 1} seconds")
    for number in range(ARRIVALS):
        arrived = docs.where(F.pmod("doc_id", F.lit(ARRIVALS)) == ARRIVALS - 1 - number)
        last = number == ARRIVALS - 1
        (arrived.unionByName(end) if last else arrived).write.mode("append").parquet(f"{root}/arrived")
        arriving = spark.readStream.schema(docs.schema).parquet(f"{root}/arrived")
        spans = text_spans(arriving, tok, ["data_type", "subset_name", "doc_id", "ts"])
        start_stream(with_mask(spans), f"{root}/blocks", f"{root}/checkpoint", packing).awaitTermination()
    blocks = spark.read.parquet(f"{root}/blocks")
    return block_rows(blocks.where(F.col("block_idx").isNotNull() & (F.col("data_type") == "text")))
