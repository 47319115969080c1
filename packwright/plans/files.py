"""Queries: record files, routing, blocks and chunks written and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import array_total, n_tokens
from packwright.operators.batches import assign_ranks, batch_plan, collated, load_examples, sample_positions
from packwright.operators.packing import pack
from packwright.operators.shuffling import SEED, shuffle_into_chunks
from packwright.plans.inputs import (
    BLOCK,
    CHAT_BLOCK,
    DOC_TOKENS,
    chat_blocks_sql,
    conversation_spans,
    doc_blocks_sql,
    document_examples,
    document_spans,
)
from packwright.plans import jobs
from packwright.plans.registry import query
from packwright.session import fresh_path, stage
from packwright.sources.records import chat_turns, count_records, read_chat_records, route
from packwright.sources.sinks import (
    read_batch_log,
    read_blocks,
    read_chunk,
    read_chunks,
    read_tokenized,
    write_batch_log,
    write_blocks,
    write_chunks,
    write_tokenized,
)
from packwright.sources.tables import table

TEXT_SOURCES = ("src0.jsonl", "src1.jsonl")
CHUNK_SIZE = 100
WORLD, PER_DEVICE, ACCUMULATE = 2, 5, 3
BLOCK_KEYS = ["data_type", "subset_name", "block_idx"]
BLOCK_PAYLOAD = (
    "data_type string, subset_name string, block_idx bigint, token_ids array<int>, tgt_mask array<int>"
)


@query("""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn,
       role, md5(text) AS text_md5, length(text)::BIGINT AS n_chars
FROM conversations
""")
def chat_nested_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns nested into one record per conversation, written as lines, read back and taken apart."""
    turn = F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))
    nested = (
        table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    records = nested.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["from"], t["value"])).alias("conversations"),
    )
    path = fresh_path(spark, "records")
    records.write.json(path)
    turns = chat_turns(read_chat_records(spark, path, "conv_id bigint"), ["conv_id"])
    return turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        F.md5("text").alias("text_md5"),
        F.length("text").cast("bigint").alias("n_chars"),
    )


@query("""
SELECT CASE WHEN source || '.jsonl' IN ('src0.jsonl', 'src1.jsonl') THEN 'text' ELSE 'chat' END AS data_type,
       source || '.jsonl' AS file_name, count(*)::BIGINT AS n_records, sum(n_chars)::BIGINT AS n_chars
FROM documents GROUP BY ALL
""")
def route_by_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.concat("source", F.lit(".jsonl")).alias("file_name"), "n_chars"
    )
    routed = route(docs, "file_name", TEXT_SOURCES)
    return routed.groupBy("data_type", "file_name").agg(
        F.count("*").alias("n_records"), F.sum("n_chars").alias("n_chars")
    )


@query("SELECT source, count(*)::BIGINT AS n_records FROM documents GROUP BY source")
def count_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return count_records(table(spark, sf, "documents"), ["source"])


@query(f"""
WITH {DOC_TOKENS}
SELECT 'text' AS data_type, subset_name, count(DISTINCT doc_id)::BIGINT AS n_examples, count(*)::BIGINT AS n_tokens,
       sum(id)::BIGINT AS id_sum, sum(m)::BIGINT AS n_targets
FROM doc_tokens GROUP BY subset_name
""")
def tokenized_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "tokenized")
    write_tokenized(document_examples(spark, sf), path)
    back = read_tokenized(spark, path, "doc_id bigint")
    return back.groupBy("data_type", "subset_name").agg(
        F.count("*").alias("n_examples"),
        F.sum(n_tokens(F.col("token_ids"))).alias("n_tokens"),
        F.sum(array_total(F.col("token_ids"))).alias("id_sum"),
        F.sum(array_total(F.col("tgt_mask"))).alias("n_targets"),
    )


@query(f"""
WITH {doc_blocks_sql(CHAT_BLOCK)}, {chat_blocks_sql(CHAT_BLOCK)},
both_types AS (SELECT * FROM doc_blocks UNION ALL SELECT * FROM chat_blocks)
SELECT data_type, subset_name, count(*)::BIGINT AS n_blocks, sum(list_sum(ids))::BIGINT AS id_sum,
       sum(list_sum(mask))::BIGINT AS n_targets
FROM both_types GROUP BY ALL
""")
def blocks_union(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of both types written to one place and read as one data set. Blocks of
    another length lie beside them and must not come along."""
    path = fresh_path(spark, "blocks")
    texts = stage(document_spans(spark, sf), "tokens")
    write_blocks(pack(texts, CHAT_BLOCK, staged=False), path, CHAT_BLOCK)
    write_blocks(pack(conversation_spans(spark, sf), CHAT_BLOCK, keys=("conv_id", "turn")), path, CHAT_BLOCK)
    write_blocks(pack(texts, BLOCK, staged=False), path, BLOCK)
    return read_blocks(spark, path, CHAT_BLOCK).groupBy("data_type", "subset_name").agg(
        F.count("*").alias("n_blocks"),
        F.sum(array_total(F.col("token_ids"))).alias("id_sum"),
        F.sum(array_total(F.col("tgt_mask"))).alias("n_targets"),
    )


def _write_chunked_blocks(spark: SparkSession, sf: str, n_epochs: int = 1, fmt: str = "parquet") -> str:
    path = fresh_path(spark, "blocks")
    write_blocks(pack(document_spans(spark, sf), BLOCK), path, BLOCK)
    blocks = read_blocks(spark, path, BLOCK)
    chunked = shuffle_into_chunks(blocks, BLOCK_KEYS, chunk_size=CHUNK_SIZE, n_epochs=n_epochs)
    path = fresh_path(spark, "chunks")
    columns = [c.split()[0] for c in BLOCK_PAYLOAD.split(", ")]
    compression = "gzip" if fmt == "json" else None
    rows = chunked.select(*columns, "chunk_position", "epoch", "chunk_idx")
    write_chunks(rows, path, fmt, compression=compression, chunk_rows=CHUNK_SIZE)
    return path


def chunked_blocks_sql(epochs: str = "(0)") -> str:
    """CTEs up to `chunked`: blocks with their chunk and their place in it."""
    return f"""{doc_blocks_sql()},
shuffled AS (
  SELECT b.*, e.epoch, count(*) OVER (PARTITION BY e.epoch) AS total,
         row_number() OVER (
           PARTITION BY e.epoch
           ORDER BY md5('11111:' || e.epoch || ':' || data_type || ':' || subset_name || ':' || block_idx)
         ) - 1 AS pos
  FROM doc_blocks b CROSS JOIN (VALUES {epochs}) e(epoch)
),
chunked AS (
  SELECT *, total // {CHUNK_SIZE} + 1 AS n_chunks, pos % (total // {CHUNK_SIZE} + 1) AS chunk_idx,
         pos // (total // {CHUNK_SIZE} + 1) AS chunk_pos
  FROM shuffled
)"""


@query(f"""
WITH {chunked_blocks_sql("(0), (1)")}
SELECT epoch::INT AS epoch, chunk_idx::BIGINT AS chunk_idx, count(*)::BIGINT AS n_blocks,
       sum(len(ids))::BIGINT AS n_tokens, sum(list_sum(ids))::BIGINT AS id_sum
FROM chunked GROUP BY ALL
""")
def chunk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What the written chunk files hold, as lines of JSON, over two epochs."""
    chunks = read_chunks(spark, _write_chunked_blocks(spark, sf, 2, "json"), BLOCK_PAYLOAD, "json")
    return chunks.groupBy("epoch", "chunk_idx").agg(
        F.count("*").alias("n_blocks"),
        F.sum(n_tokens(F.col("token_ids"))).alias("n_tokens"),
        F.sum(array_total(F.col("token_ids"))).alias("id_sum"),
    )


@query(f"""
WITH {chunked_blocks_sql()}
SELECT data_type, subset_name, block_idx::BIGINT AS block_idx, chunk_pos::BIGINT AS chunk_position,
       list_sum(ids)::BIGINT AS id_sum
FROM chunked WHERE chunk_idx = 0
""")
def read_one_chunk(spark: SparkSession, sf: str) -> DataFrame:
    chunk = read_chunk(spark, _write_chunked_blocks(spark, sf), 0, BLOCK_PAYLOAD)
    return chunk.select(
        "data_type", "subset_name", "block_idx", "chunk_position", array_total(F.col("token_ids")).alias("id_sum")
    )


@query(f"""
WITH {chunked_blocks_sql()},
chosen AS (
  SELECT *, row_number() OVER (
           PARTITION BY chunk_idx
           ORDER BY md5(({SEED + 1} + chunk_idx) || ':0:' || data_type || ':' || subset_name || ':' || block_idx)
         ) - 1 AS place,
         count(*) OVER (PARTITION BY chunk_idx) AS n_sampled
  FROM chunked
),
ranked AS (
  SELECT *, place % {WORLD} AS rank, place // {WORLD * PER_DEVICE} AS batch_idx
  FROM chosen WHERE place < n_sampled // {WORLD * PER_DEVICE} * {WORLD * PER_DEVICE}
),
steps AS (
  SELECT chunk_idx, batch_idx, count(*) AS n_examples, sum(len(ids) - 1) AS n_tokens,
         sum(list_sum(mask) - mask[1]) AS n_targets,
         chunk_idx * (any_value(largest) // {WORLD * PER_DEVICE}) + batch_idx AS before,
         any_value(n_chunks) * (any_value(largest) // {WORLD * PER_DEVICE}) AS total_steps
  FROM ranked, (SELECT max(n_sampled) AS largest FROM chosen) WHERE rank = 0 GROUP BY chunk_idx, batch_idx
),
warm AS (SELECT *, floor(total_steps * 0.1::DOUBLE) AS w FROM steps)
SELECT chunk_idx::BIGINT AS chunk_idx, batch_idx::BIGINT AS batch_idx, n_examples::BIGINT AS n_examples,
       n_tokens::BIGINT AS n_tokens, n_targets::BIGINT AS n_targets, (before + 1)::BIGINT AS step,
       (before + 1) % {ACCUMULATE} <> 0 AS is_accumulating,
       round(CASE WHEN before < w THEN 3e-5::DOUBLE * before / w
            WHEN before > total_steps THEN 0.0
            ELSE 0.5 * (1 + cos(pi() * (before - w) / (total_steps - w))) * 3e-5::DOUBLE END, 12)::DOUBLE AS learning_rate
FROM warm
""")
def batch_log(spark: SparkSession, sf: str) -> DataFrame:
    """From chunk files to the written log of rank 0."""
    chunks = read_chunks(spark, _write_chunked_blocks(spark, sf), BLOCK_PAYLOAD)
    seed = F.col("chunk_idx") + F.lit(SEED + 1)
    sampled = sample_positions(chunks, BLOCK_KEYS, "chunk_position", None, seed=seed, groups=["chunk_idx"])
    assigned = assign_ranks(sampled, WORLD, PER_DEVICE)
    payload = chunks.select("chunk_idx", *BLOCK_KEYS, "token_ids", "tgt_mask")
    loaded = load_examples(payload, assigned, ["chunk_idx", *BLOCK_KEYS])
    loaded = collated(loaded, ["chunk_idx", "rank", "batch_idx", "n_sampled"])
    n_chunks, largest = (x + 1 for x in chunks.agg(F.max("chunk_idx"), F.max("chunk_position")).first())
    plan = batch_plan(loaded, n_chunks, largest, WORLD, PER_DEVICE, ACCUMULATE)
    path = fresh_path(spark, "log")
    write_batch_log(plan, path)
    log = read_batch_log(spark, path)
    return log.select(
        "chunk_idx", "batch_idx", "n_examples", "n_tokens", "n_targets", "step", "is_accumulating",
        F.round("learning_rate", 12).alias("learning_rate"),
    )


JOB_CHUNK = 150


@query(f"""
WITH n AS (
  SELECT (SELECT sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END + 1) FROM documents) // {CHAT_BLOCK} AS texts,
    (SELECT sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END
                + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) FROM conversations) // {CHAT_BLOCK} AS chats
),
t AS (SELECT texts + chats AS total, (texts + chats) // {JOB_CHUNK} + 1 AS n_chunks FROM n),
c AS (
  SELECT chunk_idx, total // n_chunks + (chunk_idx < total % n_chunks)::INT AS size,
    (total + n_chunks - 1) // n_chunks // {WORLD * PER_DEVICE} AS per_chunk
  FROM (SELECT *, unnest(range(0, n_chunks::BIGINT)) AS chunk_idx FROM t)
)
SELECT chunk_idx::BIGINT AS chunk_idx, b::BIGINT AS batch_idx, {PER_DEVICE}::BIGINT AS n_examples,
  {PER_DEVICE * (CHAT_BLOCK - 1)}::BIGINT AS n_tokens, (chunk_idx * per_chunk + b + 1)::BIGINT AS step
FROM (SELECT *, unnest(range(0, (size // {WORLD * PER_DEVICE})::BIGINT)) AS b FROM c)
""")
def jobs_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables as line files through all stages: tokenize, pack, chunk, batch; the log of rank 0."""
    root = fresh_path(spark, "jobs")
    said = F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))
    chats = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    chats.select(F.transform("turns", lambda t: F.struct(t["from"], t["value"])).alias("conversations")).write.json(f"{root}/raw/chats.jsonl")
    table(spark, sf, "documents").select(F.col("text").alias("markdown")).write.json(f"{root}/raw/textbooks.jsonl")
    jobs.tokenize_files(spark, f"{root}/raw/*", f"{root}/tokens", "word_md5", subset_from_end=2)
    jobs.pack_spans(spark, f"{root}/tokens", f"{root}/blocks", CHAT_BLOCK)
    jobs.chunk_blocks(spark, f"{root}/blocks", f"{root}/chunks", CHAT_BLOCK, chunk_size=JOB_CHUNK)
    places = read_chunks(spark, f"{root}/chunks", BLOCK_PAYLOAD).agg(F.max("chunk_idx"), F.max("chunk_position"))
    n_chunks, largest = (x + 1 for x in places.first())
    jobs.batch_chunks(spark, f"{root}/chunks", f"{root}/out", n_chunks, largest, WORLD, PER_DEVICE)
    return read_batch_log(spark, f"{root}/out/log").select("chunk_idx", "batch_idx", "n_examples", "n_tokens", "step")
