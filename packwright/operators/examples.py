"""Tokenized examples from chats and plain texts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.functions.text import affix, array_total, constant_mask, eos_array, n_tokens
from packwright.functions.tokenizers import Tokenizer

# Speakers and whether their words are a target. The last two are the
# same speakers under the names the chat table uses.
SPEAKER_IS_TARGET = {
    "human": 0,
    "system": 0,
    "gpt": 1,
    "user": 0,
    "assistant": 1,
}

EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("tgt_mask", T.ArrayType(T.IntegerType())),
    ]
)


def target_flag(role: Column) -> Column:
    """0 or 1 by speaker; null for a speaker that is not known."""
    flag = F.lit(None).cast("int")
    for speaker, is_target in SPEAKER_IS_TARGET.items():
        flag = F.when(role == speaker, F.lit(is_target)).otherwise(flag)
    return flag


def flag_turns(turns: DataFrame, mode: str = "quarantine", role: str = "role") -> DataFrame:
    """Add ``is_target``. Unknown speakers keep a null flag, or stop the job in ``fail`` mode."""
    flag = target_flag(F.col(role))
    if mode == "fail":
        problem = F.concat(F.lit("unknown speaker "), F.coalesce(F.col(role), F.lit("null")))
        flag = F.coalesce(flag, F.raise_error(problem).cast("int"))
    elif mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    return turns.withColumn("is_target", flag)


def split_turns(turns: DataFrame, role: str = "role") -> tuple[DataFrame, DataFrame]:
    """Turns of known speakers with their flag, and the turns set aside."""
    flagged = flag_turns(turns, "quarantine", role)
    known = flagged.where(F.col("is_target").isNotNull())
    return known, flagged.where(F.col("is_target").isNull()).drop("is_target")


def chat_spans(
    turns: DataFrame, tok: Tokenizer, keep: Sequence[str], text: str = "text"
) -> DataFrame:
    """One row of ids per flagged turn; the end mark follows target turns only."""
    ids = tok.encode(F.col(text))
    mark = F.when(F.col("is_target") == 1, eos_array(tok.eos_id)).otherwise(
        F.array().cast("array<int>")
    )
    return turns.select(*keep, "is_target", affix(ids, suffix=mark).alias("token_ids"))


def chat_examples(
    spans: DataFrame,
    groups: Sequence[str],
    conversation: str = "conv_id",
    turn: str = "turn",
) -> DataFrame:
    """Ids and mask of whole conversations, turns in order.

    An example is one row, so it has to fit one. Packing has no need of it: it takes the
    turns as they are, ordered by (conversation, turn).
    """
    span = F.struct(F.col(turn).alias("turn"), "token_ids", "is_target")
    gathered = spans.groupBy(*groups, conversation).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return gathered.select(
        *groups,
        conversation,
        F.flatten(F.transform("spans", lambda s: s["token_ids"])).alias("token_ids"),
        F.flatten(
            F.transform("spans", lambda s: constant_mask(s["is_target"], s["token_ids"]))
        ).alias("tgt_mask"),
    )


def text_spans(
    documents: DataFrame, tok: Tokenizer, keep: Sequence[str], text: str = "text"
) -> DataFrame:
    """Ids and end mark of plain texts, all of them targets."""
    ids = affix(tok.encode(F.col(text)), suffix=eos_array(tok.eos_id))
    return documents.select(*keep, F.lit(1).alias("is_target"), ids.alias("token_ids"))


def with_mask(spans: DataFrame) -> DataFrame:
    """Replace the row's flag by its mask."""
    mask = constant_mask(F.col("is_target"), F.col("token_ids")).alias("tgt_mask")
    rest = [c for c in spans.columns if c != "is_target"]
    return spans.select(*rest, mask)


def example_to_json(ids: Column, mask: Column) -> Column:
    return F.to_json(F.struct(ids.alias("token_ids"), mask.alias("tgt_mask")))


def example_from_json(text: Column) -> Column:
    return F.from_json(text, EXAMPLE_SCHEMA)


def token_sums() -> list[Column]:
    return [
        F.count("*").alias("n_examples"),
        F.sum(n_tokens(F.col("token_ids"))).alias("n_tokens"),
        F.sum(array_total(F.col("tgt_mask"))).alias("n_target_tokens"),
    ]


def token_stats(examples: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Examples, tokens and target tokens per group."""
    return examples.groupBy(*groups).agg(*token_sums())
