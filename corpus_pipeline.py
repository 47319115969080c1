"""From raw documents to token ids: five stages, each a table that the next one reads."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm import decontam, langid, linedup, neardup, pieces
from packwright.llm.queries import vocabulary
from packwright.session import drop, stage_alone
from packwright.sources.tables import table

# A document is rejected if no language is at least this likely.
LEAST_LIKELY = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters (null and empty ones too), and those of no likely language.

    Learned from the labelled rows that are not held out; if there are none, every text
    with letters stays.
    """
    model = langid.train(docs)
    readable = docs.where(langid.readable(F.col("text")))
    if not model.languages:
        return readable
    found = readable.select(F.struct(*_columns(docs)).alias("row"), langid.language(spark, F.col("text"), model).alias("found"))
    return found.where(F.col("found.score") >= LEAST_LIKELY).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; documents of nothing else go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("rest"))
    cut = linedup.dedup_lines(packed).where((F.col("n_removed") == 0) | (F.col("text") != ""))
    value = {
        "doc_id": F.col("doc_id"),
        "text": F.col("text"),
        **{c: F.col("rest")[f"c{i}"] for i, c in enumerate(others)},
    }
    if "n_chars" in others:
        value["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(value[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``token_ids, n_tokens, parity, round_trip``.

    Columns of those names in ``docs`` are replaced.
    """
    added = ("token_ids", "n_tokens", "parity", "round_trip")
    encoded = docs.select(F.struct(*_columns(docs)).alias("row"), pieces.tokenized(spark, F.col("text"), vocabulary()).alias("t"))
    return encoded.select(
        *(F.col("row")[c].alias(c) for c in docs.columns if c not in added),
        F.col("t.ids").alias("token_ids"),
        F.coalesce(F.size("t.ids"), F.lit(0)).cast("long").alias("n_tokens"),
        "t.parity",
        F.col("t.decoded").eqNullSafe(F.col("row.text")).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("tokens", tokens),
]

# Neither a trained classifier nor a vocabulary can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again.

    What a stage staged for itself goes when it is written, and its input when the next is.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs, written = stage_alone(spark, lambda: step(spark, docs, sf_dir), f"pipeline-{name}")
        if read is not None:
            drop(spark, read)
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)
