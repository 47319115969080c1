"""The queries of this package, and the SQL that gives the same rows where SQL can."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm import alignment, ann, blob_ledger, chat, decontam, hardneg, langid, licenses, linedup, neardup, oracles, pieces, simhash, warc
from packwright.session import fresh_path
from packwright.sources.tables import table

VOCABULARY = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(oracles.NEAR_DUPLICATES)
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(neardup.find_near_duplicates(table(spark, sf_dir, "documents")))


@query(oracles.CHATS)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_chats(chat.format_chats(turns.unionByName(odd)))


@query(oracles.LINES)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.dedup_lines(docs)


@query()
def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query(oracles.SECRETS)
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blob_ledger.scan_secrets(table(spark, sf_dir, "documents"), fresh_path(spark, "secret-ledger"))
    return blob_ledger.report(found)


def vocabulary(name: str = VOCABULARY) -> bytes:
    import public_tokenizers

    return pieces.model_bytes(public_tokenizers.path(name))


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, agreement with the original library, and the way back."""
    docs = table(spark, sf_dir, "documents")
    encoded = docs.select("doc_id", "text", pieces.tokenized(spark, F.col("text"), vocabulary()).alias("t"))
    return encoded.select(
        "doc_id",
        F.coalesce(F.size("t.ids"), F.lit(0)).cast("long").alias("n_tokens"),
        "t.ids",
        "t.parity",
        F.col("t.decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query(oracles.ARCHIVES)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.report(warc.convert(pages, fresh_path(spark, "arc"), fresh_path(spark, "warc")))


@query(oracles.LICENSES)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@query(oracles.DECONTAMINATION)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.report(found)


@query(oracles.HARD_NEGATIVES)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are moved by one first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved))


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), vocabulary())


@query()
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.find_near_duplicates(table(spark, sf_dir, "documents")))
