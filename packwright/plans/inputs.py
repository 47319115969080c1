"""Inputs the queries share, and the same inputs in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.tokenizers import tokenizer
from packwright.operators.examples import chat_spans, split_turns, text_spans, with_mask
from packwright.sources.tables import spread, table

BLOCK = 1024
CHAT_BLOCK = 256


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as texts of one subset per language."""
    return table(spark, sf, "documents").select(
        "doc_id", "text", F.lit("text").alias("data_type"), F.col("lang").alias("subset_name")
    )


def document_spans(spark: SparkSession, sf: str, name: str = "word_md5") -> DataFrame:
    docs = spread(documents(spark, sf), "doc_id")
    return text_spans(docs, tokenizer(spark, name), ["data_type", "subset_name", "doc_id"])


def document_examples(spark: SparkSession, sf: str, name: str = "word_md5") -> DataFrame:
    return with_mask(document_spans(spark, sf, name))


def conversation_spans(spark: SparkSession, sf: str, name: str = "word_md5") -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        "*", F.lit("chat").alias("data_type"), F.lit("conversations").alias("subset_name")
    )
    known, _ = split_turns(spread(turns, "conv_id", "turn"))
    return chat_spans(known, tokenizer(spark, name), ["data_type", "subset_name", "conv_id", "turn"])


# The same in SQL. `doc_tokens` and `chat_tokens` have one row per token with the
# subset, the order inside it and the target flag.
DOC_TOKENS = """
doc_words AS (
  SELECT doc_id, lang AS subset_name, unnest(string_split(text, ' ')) AS w,
         generate_subscripts(string_split(text, ' '), 1) AS i
  FROM documents WHERE text <> ''
),
doc_tokens AS (
  SELECT doc_id, subset_name, i, ('0x' || substr(md5(w), 1, 7))::INT AS id, 1 AS m FROM doc_words
  UNION ALL
  SELECT doc_id, lang, 2147483647, 268435456, 1 FROM documents
)"""

CHAT_TOKENS = """
turn_words AS (
  SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS w,
         generate_subscripts(string_split(text, ' '), 1) AS i
  FROM conversations WHERE text <> ''
),
chat_tokens AS (
  SELECT conv_id, turn, i, ('0x' || substr(md5(w), 1, 7))::INT AS id,
         CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS m
  FROM turn_words
  UNION ALL
  SELECT conv_id, turn, 2147483647, 268435456, 1 FROM conversations WHERE role = 'assistant'
)"""


def doc_blocks_sql(length: int = BLOCK) -> str:
    """CTEs up to `doc_blocks`: full blocks of the documents with ids and mask as lists."""
    return f"""{DOC_TOKENS},
doc_stream AS (
  SELECT subset_name, id, m,
         row_number() OVER (PARTITION BY subset_name ORDER BY doc_id, i) - 1 AS p
  FROM doc_tokens
),
doc_blocks AS (
  SELECT 'text' AS data_type, subset_name, p // {length} AS block_idx,
         list(id ORDER BY p) AS ids, list(m ORDER BY p) AS mask
  FROM doc_stream GROUP BY ALL HAVING count(*) = {length}
)"""


def chat_blocks_sql(length: int = CHAT_BLOCK) -> str:
    return f"""{CHAT_TOKENS},
chat_stream AS (
  SELECT id, m, row_number() OVER (ORDER BY conv_id, turn, i) - 1 AS p FROM chat_tokens
),
chat_blocks AS (
  SELECT 'chat' AS data_type, 'conversations' AS subset_name, p // {length} AS block_idx,
         list(id ORDER BY p) AS ids, list(m ORDER BY p) AS mask
  FROM chat_stream GROUP BY p // {length} HAVING count(*) = {length}
)"""


# Block rows as the packing queries show them.
BLOCK_ROWS_SQL = """data_type, subset_name, block_idx::BIGINT AS block_idx,
  md5(array_to_string(ids, ',')) AS ids_md5, list_sum(mask)::BIGINT AS n_targets"""
