"""Packing a stream of examples: what does not fill a block waits for the next batch.

The state between two micro-batches is small: per subset the number of tokens seen
and the unfinished block, shorter than one block. Each micro-batch is packed by the
distributed operators, starting at the tokens seen, so a subset that holds most of
a batch still spreads over all tasks. Everything a micro-batch writes is named after
its number, and it reads only the state of the number before: a batch that is run
again after a failure writes the same again.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packwright.functions.integers import div
from packwright.functions.text import n_tokens
from packwright.operators.offsets import running_offsets
from packwright.operators.packing import CONTEXT_LENGTH, SUBSET, cut_pieces, join_pieces
from packwright.session import drop


class StreamPacker:
    def __init__(
        self,
        path: str,
        context_length: int = CONTEXT_LENGTH,
        groups: Sequence[str] = SUBSET,
        keys: Sequence[str] = ("doc_id",),
    ):
        self.path = path.rstrip("/")
        self.context_length = context_length
        self.groups = list(groups)
        self.keys = list(keys)

    def _tokens(self, batch_id: int) -> str:
        return f"{self.path}/tokens/batch={batch_id}"

    def _seen(self, batch_id: int) -> str:
        return f"{self.path}/seen/batch={batch_id}"

    def _blocks(self, batch_id: int) -> str:
        return f"{self.path}/blocks/batch={batch_id}"

    def start(self, examples: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a streaming DataFrame of ``groups, keys, token_ids, tgt_mask``."""
        writer = examples.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark, groups, keys = batch.sparkSession, self.groups, self.keys
        mask = "tgt_mask"
        tokens = batch.select(*groups, *keys, "token_ids", mask, n_tokens(F.col("token_ids")).alias("n"))
        tokens.write.mode("overwrite").parquet(self._tokens(batch_id))
        tokens = spark.read.schema(tokens.schema).parquet(self._tokens(batch_id)).where("n > 0")

        lengths = tokens.select(*groups, *keys, "n")
        offsets = running_offsets(lengths, groups, keys, "n").drop("n")
        added = lengths.groupBy(*groups).agg(F.sum("n").alias("n"))
        before = self._read_seen(spark, batch_id - 1, tokens)
        if before is None:
            seen = added
            placed = tokens.join(offsets, groups + keys)
        else:
            seen = added.unionByName(before).groupBy(*groups).agg(F.sum("n").alias("n"))
            moved = offsets.join(before.withColumnRenamed("n", "_seen"), groups, "left").withColumn(
                "start", F.col("start") + F.coalesce(F.col("_seen"), F.lit(0))
            )
            placed = tokens.join(moved.drop("_seen"), groups + keys)
            waiting = self._read_waiting(spark, batch_id - 1, tokens)
            placed = placed.select(*waiting.columns).unionByName(waiting)
        seen.write.mode("overwrite").parquet(self._seen(batch_id))

        last = div(F.col("start") + F.col("n") - 1, self.context_length)
        pieces = cut_pieces(placed, groups, self.context_length, last)
        blocks = join_pieces(pieces, groups, self.context_length, whole=False)
        full = F.size("token_ids") == self.context_length
        (
            blocks.withColumn("is_full", full)
            .write.mode("overwrite")
            .partitionBy("is_full")
            .parquet(self._blocks(batch_id))
        )
        drop(spark, self._tokens(batch_id))  # a run of this batch again writes it anew
        # Only the batch before is read again; what was carried over to it is done with.
        drop(spark, self._seen(batch_id - 2))
        drop(spark, f"{self._blocks(batch_id - 2)}/is_full=false")

    def _read_seen(self, spark: SparkSession, batch_id: int, tokens: DataFrame) -> DataFrame | None:
        if batch_id < 0:
            return None
        fields = [f"{g} {tokens.schema[g].dataType.simpleString()}" for g in self.groups]
        return spark.read.schema(", ".join([*fields, "n bigint"])).parquet(self._seen(batch_id))

    def _read_waiting(self, spark: SparkSession, batch_id: int, tokens: DataFrame) -> DataFrame:
        """Unfinished blocks of the batch before, as pieces that start where their block starts."""
        blocks = spark.read.schema(self._block_schema(tokens)).parquet(self._blocks(batch_id))
        return blocks.where(~F.col("is_full")).select(
            *self.groups,
            "token_ids",
            "tgt_mask",
            (F.col("block_idx") * self.context_length).alias("start"),
            n_tokens(F.col("token_ids")).alias("n"),
        )

    def _block_schema(self, like: DataFrame) -> str:
        fields = [f"{g} {like.schema[g].dataType.simpleString()}" for g in self.groups]
        return ", ".join(
            [*fields, "block_idx bigint", "token_ids array<int>", "tgt_mask array<int>", "is_full boolean"]
        )

    def read(self, spark: SparkSession, like: DataFrame) -> DataFrame:
        """All full blocks written so far. ``like`` has the group columns."""
        schema = self._block_schema(like) + ", batch bigint"
        blocks = spark.read.schema(schema).parquet(f"{self.path}/blocks")
        return blocks.where("is_full").drop("is_full", "batch")
