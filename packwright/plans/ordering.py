"""Queries: seeded order, epochs, shards, samples, ranks, batches, schedule."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.schedule import cosine_rate, warmup_steps
from packwright.functions.text import array_total, ids_digest, n_tokens
from packwright.operators.batches import (
    assign_ranks as rank_samples,
    batch_plan as plan_batches,
    collated,
    load_examples as join_payload,
    sample_positions,
    truncate_to_batches,
)
from packwright.operators.offsets import dense_positions
from packwright.operators.packing import pack
from packwright.operators.shuffling import SEED, assign_chunks, seeded_positions
from packwright.plans.inputs import BLOCK, doc_blocks_sql, document_spans
from packwright.plans.registry import query
from packwright.session import stage
from packwright.sources.tables import table

KEY = ["o_orderkey"]
CHUNK_SIZE = 4000
N_EXAMPLES = 12001
WORLD, PER_DEVICE, ACCUMULATE = 4, 10, 4

ORDER_SQL = "md5('11111:' || epoch || ':' || o_orderkey), o_orderkey"

SHUFFLED_SQL = f"""
shuffled AS (
  SELECT o_orderkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {ORDER_SQL}) - 1 AS pos,
         count(*) OVER (PARTITION BY epoch) AS total
  FROM orders CROSS JOIN (VALUES (0), (1), (2)) e(epoch)
)"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


@query(f"WITH {SHUFFLED_SQL} SELECT o_orderkey, pos AS position, total FROM shuffled WHERE epoch = 0")
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return seeded_positions(orders(spark, sf), KEY).drop("epoch")


@query(f"""
WITH {SHUFFLED_SQL}
SELECT o_orderkey, epoch::INT AS epoch, pos AS position, pos % (total // {CHUNK_SIZE} + 1) AS chunk_idx
FROM shuffled
""")
def multi_epoch(spark: SparkSession, sf: str) -> DataFrame:
    chunks = assign_chunks(orders(spark, sf), KEY, CHUNK_SIZE, n_epochs=3, keep="all")
    return chunks.select("o_orderkey", "epoch", "position", "chunk_idx")


@query(f"""
WITH {SHUFFLED_SQL}
SELECT o_orderkey, epoch::INT AS epoch, pos AS position, pos % (total // {CHUNK_SIZE} + 1) AS chunk_idx
FROM shuffled WHERE epoch = 2
""")
def last_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """What is left when every epoch overwrites the one before."""
    chunks = assign_chunks(orders(spark, sf), KEY, CHUNK_SIZE, n_epochs=3, keep="last")
    return chunks.select("o_orderkey", "epoch", "position", "chunk_idx")


@query(f"""
WITH {SHUFFLED_SQL},
c AS (SELECT *, total // {CHUNK_SIZE} + 1 AS n FROM shuffled WHERE epoch = 0)
SELECT o_orderkey, n AS n_chunks, pos % n AS chunk_idx, pos // n AS chunk_position FROM c
""")
def shard_strided(spark: SparkSession, sf: str) -> DataFrame:
    chunks = assign_chunks(orders(spark, sf), KEY, CHUNK_SIZE, mode="strided")
    return chunks.select("o_orderkey", "n_chunks", "chunk_idx", "chunk_position")


@query(f"""
WITH {SHUFFLED_SQL},
c AS (SELECT *, total // {CHUNK_SIZE} + 1 AS n FROM shuffled WHERE epoch = 0),
q AS (SELECT *, total // n AS size, total % n AS longer FROM c),
s AS (
  SELECT o_orderkey, n, pos, CASE WHEN pos < longer * (size + 1) THEN pos // (size + 1)
         ELSE longer + (pos - longer * (size + 1)) // size END AS chunk_idx
  FROM q
)
SELECT o_orderkey, n AS n_chunks, chunk_idx,
       row_number() OVER (PARTITION BY chunk_idx ORDER BY pos) - 1 AS chunk_position
FROM s
""")
def shard_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    chunks = assign_chunks(orders(spark, sf), KEY, CHUNK_SIZE, mode="contiguous")
    return chunks.select("o_orderkey", "n_chunks", "chunk_idx", "chunk_position")


# Orders as the rows of one chunk file: their row number is the ordinal.
def sampled_sql(where: str = "") -> str:
    return f"""
numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders),
chosen AS (
  SELECT o_orderkey, ordinal, count(*) OVER () AS n_sampled,
         row_number() OVER (ORDER BY md5('11111:0:' || o_orderkey), o_orderkey) - 1 AS place
  FROM numbered {where}
),
kept AS (
  SELECT *, place % {WORLD} AS rank, place // {WORLD} AS rank_position,
         place // {WORLD * PER_DEVICE} AS batch_idx
  FROM chosen WHERE place < n_sampled // {WORLD * PER_DEVICE} * {WORLD * PER_DEVICE}
)"""


# The two sampling queries show the limit; the others run over all rows.
FIRST_SQL, SAMPLED_SQL = sampled_sql(f"WHERE ordinal < {N_EXAMPLES}"), sampled_sql()


def _sampled(spark: SparkSession, sf: str, n_examples: int | None = None, shuffle: bool = True) -> DataFrame:
    numbered = dense_positions(orders(spark, sf).select(*KEY), [], KEY, "ordinal")
    return sample_positions(numbered, KEY, "ordinal", n_examples, shuffle)


@query(f"WITH {FIRST_SQL} SELECT o_orderkey, place AS sample_position, n_sampled FROM chosen")
def sample_permuted(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf, N_EXAMPLES).select("o_orderkey", "sample_position", "n_sampled")


@query(f"WITH {FIRST_SQL} SELECT o_orderkey, ordinal AS sample_position, n_sampled FROM chosen")
def sample_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf, N_EXAMPLES, shuffle=False).select("o_orderkey", "sample_position", "n_sampled")


@query(f"WITH {SAMPLED_SQL} SELECT o_orderkey, place AS sample_position FROM kept")
def truncate_to_batch(spark: SparkSession, sf: str) -> DataFrame:
    return truncate_to_batches(_sampled(spark, sf), WORLD * PER_DEVICE).select("o_orderkey", "sample_position")


@query(f"WITH {SAMPLED_SQL} SELECT o_orderkey, rank::INT AS rank, rank_position FROM kept")
def assign_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return rank_samples(_sampled(spark, sf), WORLD, PER_DEVICE).select("o_orderkey", "rank", "rank_position")


@query(f"""
WITH {SAMPLED_SQL}
SELECT rank::INT AS rank, rank_position, o_orderkey, o_custkey, o_totalprice, o_orderpriority
FROM kept JOIN orders USING (o_orderkey)
""")
def load_examples(spark: SparkSession, sf: str) -> DataFrame:
    assigned = rank_samples(_sampled(spark, sf), WORLD, PER_DEVICE)
    loaded = join_payload(orders(spark, sf), assigned, KEY)
    return loaded.select("rank", "rank_position", *KEY, "o_custkey", "o_totalprice", "o_orderpriority")


@query(f"""
WITH {SAMPLED_SQL}
SELECT rank::INT AS rank, batch_idx, count(*)::BIGINT AS n_examples, sum(o_orderkey)::BIGINT AS key_sum,
       min(rank_position) AS first_position
FROM kept GROUP BY rank, batch_idx
""")
def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    assigned = rank_samples(_sampled(spark, sf), WORLD, PER_DEVICE)
    return assigned.groupBy("rank", "batch_idx").agg(
        F.count("*").alias("n_examples"),
        F.sum("o_orderkey").alias("key_sum"),
        F.min("rank_position").alias("first_position"),
    )


def rate_sql(before: str, total: str, warm: str) -> str:
    return f"""round(CASE WHEN {before} < {warm} THEN 3e-5::DOUBLE * {before} / {warm}
     WHEN {before} > {total} THEN 0.0
     ELSE 0.5 * (1 + cos(pi() * ({before} - {warm}) / ({total} - {warm}))) * 3e-5::DOUBLE END, 12)::DOUBLE"""


@query(f"""
WITH {SHUFFLED_SQL},
c AS (SELECT *, total // {CHUNK_SIZE} + 1 AS n FROM shuffled WHERE epoch = 0),
p AS (SELECT o_orderkey, n, pos % n AS chunk_idx, pos // n AS chunk_pos FROM c),
chosen AS (
  SELECT *, count(*) OVER (PARTITION BY chunk_idx) AS n_sampled, row_number() OVER (PARTITION BY chunk_idx
           ORDER BY md5(({SEED + 1} + chunk_idx) || ':0:' || o_orderkey), o_orderkey) - 1 AS place
  FROM p
),
kept AS (SELECT *, place % {WORLD} AS rank, place // {WORLD * PER_DEVICE} AS batch_idx FROM chosen
         WHERE place < n_sampled // {WORLD * PER_DEVICE} * {WORLD * PER_DEVICE}),
steps AS (
  SELECT chunk_idx, rank, batch_idx, count(*) AS n_examples,
         chunk_idx * (any_value(largest) // {WORLD * PER_DEVICE}) + batch_idx AS before,
         any_value(n) * (any_value(largest) // {WORLD * PER_DEVICE}) AS total
  FROM kept, (SELECT max(n_sampled) AS largest FROM chosen) GROUP BY chunk_idx, rank, batch_idx
),
warm AS (SELECT *, floor(total * 0.1::DOUBLE) AS w FROM steps)
SELECT chunk_idx, rank::INT AS rank, batch_idx, n_examples::BIGINT AS n_examples, (before + 1)::BIGINT AS step,
       (before + 1) % {ACCUMULATE} <> 0 AS is_accumulating, {rate_sql('before', 'total', 'w')} AS learning_rate
FROM warm
""")
def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of every rank over all chunks. Each chunk is permuted by a seed of its own:
    the same seed would repeat the order the chunks were cut in."""
    chunks = stage(assign_chunks(orders(spark, sf), KEY, CHUNK_SIZE), "chunks")
    seed = F.col("chunk_idx") + F.lit(SEED + 1)
    sampled = sample_positions(chunks, KEY, "chunk_position", None, seed=seed, groups=["chunk_idx"])
    assigned = rank_samples(sampled, WORLD, PER_DEVICE)
    n_chunks, last = chunks.agg(F.max("n_chunks"), F.max("chunk_position")).first()
    plan = plan_batches(assigned, n_chunks, last + 1, WORLD, PER_DEVICE, ACCUMULATE)
    return plan.withColumn("learning_rate", F.round("learning_rate", 12))


@query(f"""
WITH n AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS step, count(*) OVER () * 9 // 10 AS total
  FROM orders
),
w AS (SELECT *, floor(total * 0.1::DOUBLE) AS warm FROM n)
SELECT o_orderkey, step, total AS total_steps, {rate_sql('step', 'total', 'warm')} AS learning_rate FROM w
""")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """A step per order; the last tenth lies past the schedule's end."""
    steps = dense_positions(orders(spark, sf).select(*KEY), [], KEY, "step")
    steps = steps.withColumn("total_steps", F.expr("total * 9 div 10"))
    rate = cosine_rate(F.col("step"), F.col("total_steps"), warmup_steps(F.col("total_steps")))
    return steps.select(*KEY, "step", "total_steps", F.round(rate, 12).alias("learning_rate"))


@query(f"""
WITH {doc_blocks_sql()}
SELECT subset_name, block_idx::BIGINT AS block_idx, {BLOCK - 1}::BIGINT AS n_inputs,
       md5(array_to_string(ids[1:{BLOCK - 1}], ',')) AS inputs_md5,
       md5(array_to_string(ids[2:{BLOCK}], ',')) AS labels_md5,
       list_sum(mask[2:{BLOCK}])::BIGINT AS n_targets
FROM doc_blocks
""")
def collate_shift(spark: SparkSession, sf: str) -> DataFrame:
    rows = collated(pack(document_spans(spark, sf), BLOCK), ["subset_name", "block_idx"])
    return rows.select(
        "subset_name",
        "block_idx",
        n_tokens(F.col("input_ids")).alias("n_inputs"),
        ids_digest(F.col("input_ids")).alias("inputs_md5"),
        ids_digest(F.col("labels")).alias("labels_md5"),
        array_total(F.col("loss_mask")).alias("n_targets"),
    )
