"""Queries: losses over score tables, vector columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import ids_digest, word_ids, words
from packwright.functions.vectors import (
    cross_entropy,
    last_token as token_at_end,
    last_token_index,
    mask_positions as positions_of,
    rms_scale as scale_rms,
    total,
)
from packwright.operators.scores import (
    masked_cross_entropy as masked_loss,
    mean_binary_cross_entropy,
    mean_cross_entropy as mean_loss,
    mean_squared_error,
    score_loss,
)
from packwright.plans.registry import query
from packwright.sources.tables import spread, table

# Per row: log of the summed exponentials, less the score of the label.
XENT_SQL = """
x AS (
  SELECT *, list_max(v) + ln(list_sum(list_transform(v, lambda s: exp(s - list_max(v))))) - v[label + 1] AS loss
  FROM (SELECT *, embedding::DOUBLE[] AS v FROM embeddings)
)"""


@query(f"WITH {XENT_SQL} SELECT vec_id, label, round(loss, 6) AS loss FROM x")
def score_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    loss = cross_entropy(F.col("embedding"), F.col("label"))
    return table(spark, sf, "embeddings").select("vec_id", "label", F.round(loss, 6).alias("loss"))


@query(f"""
WITH {XENT_SQL}
SELECT label, count(*)::BIGINT AS n_rows, round(avg(CASE WHEN v[1] >= 0 THEN loss END), 6) AS loss
FROM x GROUP BY label
""")
def mean_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a negative first score carry the ignored label."""
    scored = table(spark, sf, "embeddings").withColumn(
        "target", F.when(F.get("embedding", F.lit(0)) >= 0, F.col("label")).otherwise(F.lit(-100))
    )
    return scored.groupBy("label").agg(
        F.count("*").alias("n_rows"),
        F.round(mean_loss(F.col("embedding"), F.col("target")), 6).alias("loss"),
    )


@query(f"""
WITH {XENT_SQL}
SELECT label, round(sum(CASE WHEN v[2] > 0 THEN loss ELSE 0 END)
             / (count(*) FILTER (v[2] > 0) + 1e-5::DOUBLE), 6) AS loss
FROM x GROUP BY label
""")
def masked_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.when(F.get("embedding", F.lit(1)) > 0, 1).otherwise(0)
    return table(spark, sf, "embeddings").groupBy("label").agg(
        F.round(masked_loss(F.col("embedding"), F.col("label"), mask), 6).alias("loss")
    )


LABELLED_SQL = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, quality, toxic FROM embeddings JOIN labels ON doc_id = vec_id)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id")
    return table(spark, sf, "embeddings").join(labels, "vec_id")


@query(f"""
WITH {LABELLED_SQL}
SELECT label, count(*)::BIGINT AS n_rows, round(avg((v[1] - quality) * (v[1] - quality)), 6) AS loss
FROM e GROUP BY label
""")
def mse_by_group(spark: SparkSession, sf: str) -> DataFrame:
    score = F.get("embedding", F.lit(0))
    return _labelled(spark, sf).groupBy("label").agg(
        F.count("*").alias("n_rows"),
        F.round(mean_squared_error(score, F.col("quality")), 6).alias("loss"),
    )


@query(f"""
WITH {LABELLED_SQL}
SELECT label, count(*)::BIGINT AS n_rows,
       round(avg(greatest(v[1], 0) - v[1] * quality + ln(1 + exp(-abs(v[1])))), 6) AS loss
FROM e GROUP BY label
""")
def bce_by_group(spark: SparkSession, sf: str) -> DataFrame:
    score = F.get("embedding", F.lit(0))
    return _labelled(spark, sf).groupBy("label").agg(
        F.count("*").alias("n_rows"),
        F.round(mean_binary_cross_entropy(score, F.col("quality")), 6).alias("loss"),
    )


@query(f"""
WITH {LABELLED_SQL},
x AS (SELECT *, list_max(v) + ln(list_sum(list_transform(v, lambda s: exp(s - list_max(v))))) - v[label + 1] AS xent
      FROM e)
SELECT 'regression' AS kind, quality, round(avg((v[1] - label) * (v[1] - label)), 6) AS loss FROM x GROUP BY quality
UNION ALL
SELECT 'single_label', quality, round(avg(xent), 6) FROM x GROUP BY quality
UNION ALL
SELECT 'multi_label', quality, round((sum(greatest(v[1], 0) - v[1] * quality + ln(1 + exp(-abs(v[1]))))
       + sum(greatest(v[2], 0) - v[2] * toxic + ln(1 + exp(-abs(v[2]))))) / (2 * count(*)), 6) FROM x GROUP BY quality
""")
def loss_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores under the three losses; which one follows from the columns."""
    rows = _labelled(spark, sf).withColumn(
        "targets", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    )
    rows = rows.withColumn("pair", F.slice("embedding", 1, 2))
    losses = [
        ("regression", score_loss(rows, "embedding", "label", 1, ["quality"])),
        ("single_label", score_loss(rows, "embedding", "label", 64, ["quality"])),
        ("multi_label", score_loss(rows, "pair", "targets", 2, ["quality"])),
    ]
    named = [df.select(F.lit(kind).alias("kind"), "quality", F.round("loss", 6).alias("loss")) for kind, df in losses]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""
WITH t AS (
  SELECT doc_id, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ' '),
         lambda w: ('0x' || substr(md5(w), 1, 7))::INT) END AS ids
  FROM documents
),
c AS (SELECT doc_id, ids, len(list_filter(ids, lambda x: x <> ids[1])) AS n FROM t),
p AS (SELECT doc_id, ids, CASE WHEN n = 0 THEN len(ids) - 1 ELSE n - 1 END AS place FROM c)
SELECT doc_id, place::BIGINT AS place, ids[place + 1]::INT AS token FROM p
""")
def last_token(spark: SparkSession, sf: str) -> DataFrame:
    """Documents padded, as it were, with their own first word."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", word_ids(F.col("text")).alias("ids"))
    rows = rows.withColumn("pad", F.get("ids", F.lit(0)))
    ids, pad = F.col("ids"), F.col("pad")
    return rows.select(
        "doc_id",
        last_token_index(ids, pad).cast("bigint").alias("place"),
        token_at_end(ids, ids, pad).alias("token"),
    )


@query("""
WITH w AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i
  FROM documents
),
m AS (SELECT doc_id, i, CASE WHEN length(w) > 3 THEN 1 ELSE 0 END AS m FROM w),
p AS (SELECT doc_id, i, CASE WHEN m = 0 THEN 1
             ELSE sum(m) OVER (PARTITION BY doc_id ORDER BY i) - 1 END AS p FROM m)
SELECT doc_id, count(*)::BIGINT AS n_places, md5(array_to_string(list(p::BIGINT ORDER BY i), ',')) AS positions_md5
FROM p GROUP BY doc_id
""")
def mask_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the words longer than three letters."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    mask = F.transform(words(F.col("text")), lambda w: F.when(F.length(w) > 3, 1).otherwise(0))
    rows = docs.select("doc_id", mask.alias("mask"))
    rows = rows.select("doc_id", positions_of(F.col("mask")).alias("positions"))
    return rows.select(
        "doc_id",
        F.size("positions").cast("bigint").alias("n_places"),
        ids_digest(F.col("positions")).alias("positions_md5"),
    )


@query("""
WITH s AS (
  SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))
         / len(embedding) + 1e-6::DOUBLE) AS rms
  FROM embeddings
)
SELECT vec_id, round(embedding[1]::DOUBLE / rms, 6) AS first_value,
       round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE / rms))), 5) AS abs_sum
FROM s
""")
def rms_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", scale_rms(F.col("embedding")).alias("v"))
    v = F.col("v")
    return rows.select(
        "vec_id",
        F.round(F.get(v, F.lit(0)), 6).alias("first_value"),
        F.round(total(F.transform(v, F.abs)), 5).alias("abs_sum"),
    )
