"""Queries: speakers, tokens, examples."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import affix, array_total, constant_mask, ids_digest, n_tokens, word_ids, words
from packwright.functions.tokenizers import register_tokenizer, tokenizer
from packwright.operators.checks import check_rules as count_violations, same_length
from packwright.operators.examples import (
    chat_examples as gather_examples,
    chat_spans,
    example_from_json,
    example_to_json,
    flag_turns,
    target_flag,
    text_spans,
    token_stats as count_tokens,
    token_sums,
    with_mask,
)
from packwright.plans.inputs import CHAT_TOKENS, DOC_TOKENS, conversation_spans, document_examples
from packwright.plans.registry import query
from packwright.session import fresh_path
from packwright.sources.tables import spread, table


@query("""
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS is_target
FROM conversations
""")
def role_target_flag(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return flag_turns(turns).select("conv_id", "turn", "role", "is_target")


@query("""
WITH t AS (
  SELECT doc_id, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ' '),
         lambda w: ('0x' || substr(md5(w), 1, 7))::INT) END AS ids
  FROM documents
)
SELECT doc_id, len(ids)::BIGINT AS n_tokens, coalesce(list_sum(ids), 0)::BIGINT AS id_sum,
       md5(array_to_string(ids, ',')) AS ids_md5
FROM t
""")
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    ids = F.col("ids")
    return docs.select("doc_id", word_ids(F.col("text")).alias("ids")).select(
        "doc_id",
        n_tokens(ids).alias("n_tokens"),
        array_total(ids).alias("id_sum"),
        ids_digest(ids).alias("ids_md5"),
    )


# Ids below this are in the vocabulary.
VOCABULARY_SIZES = {"piece_bpe_32k": 32000, "byte_bpe_50k": 50256}
# Bytes of rare letters can be more ids than a very short text has characters.
ENOUGH_CHARS = 100


def _roundtrip(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Text by way of its ids; all of them in the vocabulary, and fewer than the characters
    wherever there are enough of those."""
    tok = tokenizer(rows.sparkSession, name)
    encoded = rows.select(*keys, F.length("text").alias("chars"), tok.encode(F.col("text")).alias("ids"))
    known = F.forall("ids", lambda i: (i >= 0) & (i < VOCABULARY_SIZES[name]))
    fewer = (F.size("ids") < F.col("chars")) | (F.col("chars") < ENOUGH_CHARS)
    # All ids, as a slice: a decode right on the encode would be merged with it into one step,
    # and every text encoded a second time for the other columns.
    ids = F.slice("ids", F.lit(1), F.size("ids"))
    return encoded.select(
        *keys, F.md5(tok.decode(ids)).alias("text_md5"), known.alias("known_ids"), fewer.alias("fewer_ids")
    )


OWN_WINDOW = 200


@query(f"""
WITH w AS (
  SELECT doc_id, lang, string_split(text, ' ') AS p FROM documents
),
said AS (
  SELECT doc_id, lang, encode(array_to_string(list_transform(range(0, len(p), {OWN_WINDOW}),
         lambda i: array_to_string(p[i + 1 : i + {OWN_WINDOW}], ' ')), '')) AS bytes
  FROM w
)
SELECT doc_id, lang, octet_length(bytes)::BIGINT AS n_tokens, md5(hex(bytes)) AS ids_md5, true AS same_by_name
FROM said
""")
def registered_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary file of single bytes, written here, registered, and used from SQL.

    Its ids are the bytes of the text, without the blanks between windows.
    """
    path, name = fresh_path(spark, "vocabulary"), "single_bytes"
    line = F.concat(F.base64(F.unhex(F.lpad(F.hex("id"), 2, "0"))), F.lit(" "), F.col("id"))
    spark.range(256).select(line).coalesce(1).write.text(path)
    tok = register_tokenizer(spark, name, path, eos_id=256, window=OWN_WINDOW)
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    coded = spark.sql(
        f"SELECT doc_id, lang, text, {name}_encode(text) AS ids, {name}_count(text) AS n FROM {{docs}}", docs=docs
    )
    spelled = F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2, "0")), "")
    return coded.select(
        "doc_id",
        "lang",
        F.col("n").alias("n_tokens"),
        F.md5(spelled).alias("ids_md5"),
        tok.encode(F.col("text")).eqNullSafe(F.col("ids")).alias("same_by_name"),
    )


@query("SELECT doc_id, md5(text) AS text_md5, true AS known_ids, true AS fewer_ids FROM documents")
def byte_bpe_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return _roundtrip(docs, ["doc_id"], "byte_bpe_50k")


@query("SELECT doc_id, md5(text) AS text_md5, true AS known_ids, true AS fewer_ids FROM documents")
def bpe_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return _roundtrip(docs, ["doc_id"], "piece_bpe_32k")


@query("SELECT conv_id, turn, md5(text) AS text_md5, true AS known_ids, true AS fewer_ids FROM conversations")
def bpe_roundtrip_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return _roundtrip(turns, ["conv_id", "turn"], "piece_bpe_32k")


@query("""
SELECT lang AS subset_name, count(*)::BIGINT AS n_examples, sum(length(text))::BIGINT AS n_chars,
       true AS all_targets, true AS fewer_ids
FROM documents GROUP BY lang
""")
def bpe_token_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Subword tokens per language. SQL has no vocabulary, so it sees the characters that the
    ids decode to, and that they are fewer and all targets."""
    examples = document_examples(spark, sf, "piece_bpe_32k")
    tok = tokenizer(spark, "piece_bpe_32k")
    text = tok.decode(F.slice("token_ids", 1, F.size("token_ids") - 1))
    decoded = examples.select("subset_name", "token_ids", "tgt_mask", F.length(text).alias("chars"))
    chars = decoded.groupBy("subset_name").agg(F.sum("chars").alias("n_chars"), *token_sums())
    return chars.select(
        "subset_name",
        "n_examples",
        "n_chars",
        (F.col("n_tokens") == F.col("n_target_tokens")).alias("all_targets"),
        (F.col("n_tokens") < F.col("n_chars")).alias("fewer_ids"),
    )


@query("""
WITH t AS (
  SELECT conv_id, turn, role, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ' '),
         lambda w: ('0x' || substr(md5(w), 1, 7))::INT) END AS ids
  FROM conversations
),
a AS (
  SELECT conv_id, turn, list_concat([1::INT], list_concat(ids,
         CASE WHEN role = 'assistant' THEN [268435456::INT] ELSE [] END)) AS ids
  FROM t
)
SELECT conv_id, turn, len(ids)::BIGINT AS n_tokens, ids[1]::INT AS first_id, ids[len(ids)]::INT AS last_id,
       md5(array_to_string(ids, ',')) AS ids_md5
FROM a
""")
def token_affixes(spark: SparkSession, sf: str) -> DataFrame:
    """A start id before every turn, the end mark after target turns."""
    tok = tokenizer(spark, "word_md5")
    mark = F.when(target_flag(F.col("role")) == 1, F.array(F.lit(tok.eos_id))).otherwise(
        F.array().cast("array<int>")
    )
    ids = affix(tok.encode(F.col("text")), prefix=F.array(F.lit(1)), suffix=mark)
    turns = table(spark, sf, "conversations").select("conv_id", "turn", ids.alias("ids"))
    ids = F.col("ids")
    return turns.select(
        "conv_id",
        "turn",
        n_tokens(ids).alias("n_tokens"),
        F.element_at(ids, 1).alias("first_id"),
        F.element_at(ids, -1).alias("last_id"),
        ids_digest(ids).alias("ids_md5"),
    )


@query()
def bpe_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Subword tokens and target tokens per language; SQL has no vocabulary to count them with."""
    return count_tokens(document_examples(spark, sf, "piece_bpe_32k"), ["subset_name"])


@query(f"""
WITH {CHAT_TOKENS}
SELECT conv_id, count(*)::BIGINT AS n_tokens,
       sum(m)::BIGINT AS n_targets,
       md5(array_to_string(list(id ORDER BY turn, i), ',')) AS ids_md5,
       md5(array_to_string(list(m ORDER BY turn, i), ',')) AS mask_md5
FROM chat_tokens GROUP BY ALL
""")
def chat_examples(spark: SparkSession, sf: str) -> DataFrame:
    examples = gather_examples(conversation_spans(spark, sf), [])
    return examples.select(
        "conv_id",
        n_tokens(F.col("token_ids")).alias("n_tokens"),
        array_total(F.col("tgt_mask")).alias("n_targets"),
        ids_digest(F.col("token_ids")).alias("ids_md5"),
        ids_digest(F.col("tgt_mask")).alias("mask_md5"),
    )


@query(f"""
WITH {DOC_TOKENS}
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(m)::BIGINT AS n_targets,
       md5(array_to_string(list(id ORDER BY i), ',')) AS ids_md5
FROM doc_tokens GROUP BY doc_id
""")
def text_examples(spark: SparkSession, sf: str) -> DataFrame:
    return document_examples(spark, sf).select(
        "doc_id",
        n_tokens(F.col("token_ids")).alias("n_tokens"),
        array_total(F.col("tgt_mask")).alias("n_targets"),
        ids_digest(F.col("token_ids")).alias("ids_md5"),
    )


@query(f"""
WITH {DOC_TOKENS}
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(id)::BIGINT AS id_sum, sum(m)::BIGINT AS n_targets
FROM doc_tokens GROUP BY doc_id
""")
def example_json(spark: SparkSession, sf: str) -> DataFrame:
    """Examples as JSON text and back."""
    examples = document_examples(spark, sf)
    lines = examples.select("doc_id", example_to_json(F.col("token_ids"), F.col("tgt_mask")).alias("line"))
    back = lines.select("doc_id", example_from_json(F.col("line")).alias("e"))
    return back.select(
        "doc_id",
        n_tokens(F.col("e.token_ids")).alias("n_tokens"),
        array_total(F.col("e.token_ids")).alias("id_sum"),
        array_total(F.col("e.tgt_mask")).alias("n_targets"),
    )


@query("""
WITH t AS (
  SELECT lang, source, role_target, n FROM (
    SELECT lang, source, 1 AS role_target,
           (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END) + 1 AS n
    FROM documents)
)
SELECT lang, source, count(*)::BIGINT AS n_examples, sum(n)::BIGINT AS n_tokens,
       sum(n * role_target)::BIGINT AS n_target_tokens
FROM t GROUP BY ALL
""")
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    spans = text_spans(docs, tokenizer(spark, "word_md5"), ["lang", "source"])
    return count_tokens(with_mask(spans), ["lang", "source"])


@query("""
SELECT rule, count(*)::BIGINT AS n_checked, sum(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS n_violations
FROM (
  SELECT 'known_speaker' AS rule, role IN ('human', 'system', 'gpt', 'user', 'assistant') AS ok FROM conversations
  UNION ALL
  SELECT 'speaker_is_no_system', role <> 'system' FROM conversations
  UNION ALL
  SELECT 'mask_as_long_as_ids', true FROM conversations
  UNION ALL
  SELECT 'text_not_short', len(string_split(text, ' ')) >= 8 FROM conversations
)
GROUP BY rule
""")
def check_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The mask is the one the examples get; an unknown speaker has none."""
    turns = flag_turns(table(spark, sf, "conversations"))
    spans = chat_spans(turns, tokenizer(spark, "word_md5"), ["role", "text"])
    rows = spans.withColumn("tgt_mask", constant_mask(F.col("is_target"), F.col("token_ids")))
    return count_violations(
        rows,
        {
            "known_speaker": F.col("is_target").isNotNull(),
            "speaker_is_no_system": F.col("role") != "system",
            "mask_as_long_as_ids": same_length(F.col("token_ids"), F.col("tgt_mask")),
            "text_not_short": F.size(words(F.col("text"))) >= 8,
        },
    )
