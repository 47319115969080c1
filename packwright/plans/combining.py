"""Queries: means, norms, extents, stacked and interleaved groups, key lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.keys import has_prefix, key_ordinal, with_ordinal
from packwright.functions.vectors import total
from packwright.operators.exact import exact_mean, exact_sums
from packwright.operators.aggregates import (
    clip_by_norm as clip_group,
    global_norm,
    group_extent as extent_of,
    macro_mean as mean_of_means,
    masked_mean as mean_where,
    ragged_mean as mean_of_cells,
    shape_summary as summarise_shape,
)
from packwright.operators.offsets import dense_positions
from packwright.operators.ordinals import combine, compare_keys, last_writer as keep_last
from packwright.operators.parameters import combine_models
from packwright.plans.jobs import combine_tables
from packwright.plans.registry import query
from packwright.session import fresh_path, stage
from packwright.sources.tables import table

MODELS = 5
SOURCES = 10
MAX_NORM = 2.5


@query("""
SELECT concat('model.layers.', l_linenumber, '.', l_returnflag) AS key,
       concat('model.layers.', l_linenumber + 12, '.', l_returnflag) AS new_key,
       l_linenumber::BIGINT AS ordinal, true AS is_layer, count(*)::BIGINT AS n_rows
FROM lineitem GROUP BY l_linenumber, l_returnflag
""")
def rekey_dotted(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("model.layers."), F.col("l_linenumber"), F.lit("."), F.col("l_returnflag"))
    rows = table(spark, sf, "lineitem").select(key.alias("key"))
    ordinal = key_ordinal(F.col("key"))
    keyed = rows.select(
        "key",
        with_ordinal(F.col("key"), ordinal + 12).alias("new_key"),
        ordinal.alias("ordinal"),
        has_prefix(F.col("key")).alias("is_layer"),
    )
    return keyed.groupBy("key", "new_key", "ordinal", "is_layer").agg(F.count("*").alias("n_rows"))


@query("""
WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders)
SELECT o_orderkey, o_totalprice, ordinal FROM n SEMI JOIN customer ON c_custkey * 7 = ordinal
""")
def select_by_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose row number is in a chosen set, here seven times a customer's key."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    numbered = dense_positions(rows, [], ["o_orderkey"], "ordinal").drop("total")
    chosen = table(spark, sf, "customer").select((F.col("c_custkey") * 7).alias("ordinal"))
    return numbered.join(chosen, "ordinal", "left_semi")


@query("""
SELECT user_id, count(*)::BIGINT AS n_events,
       round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END)
             / (count(*) FILTER (event_type = 'purchase') + 1e-5::DOUBLE), 6) AS masked_mean
FROM events GROUP BY user_id
""")
def masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean value of a user's purchases."""
    mask = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n_events"),
        F.round(mean_where(F.col("value"), mask), 6).alias("masked_mean"),
    )


@query("""
SELECT label, count(*)::BIGINT AS n_vectors,
       round(sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm
FROM embeddings GROUP BY label
""")
def l2_norm_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(
        F.count("*").alias("n_vectors"), F.round(global_norm(F.col("embedding")), 6).alias("norm")
    )


@query(f"""
WITH n AS (
  SELECT label, sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS norm
  FROM embeddings GROUP BY label
),
f AS (SELECT label, least(1.0::DOUBLE, {MAX_NORM}::DOUBLE / (norm + 1e-6::DOUBLE)) AS factor FROM n)
SELECT vec_id, label,
       round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE * factor))), 6) AS abs_sum,
       round(embedding[1]::DOUBLE * factor, 6) AS first_value
FROM embeddings JOIN f USING (label)
""")
def clip_by_norm(spark: SparkSession, sf: str) -> DataFrame:
    clipped = clip_group(table(spark, sf, "embeddings"), ["label"], "embedding", MAX_NORM)
    v = F.col("embedding")
    return clipped.select(
        "vec_id",
        "label",
        F.round(total(F.transform(v, F.abs)), 6).alias("abs_sum"),
        F.round(F.get(v, F.lit(0)), 6).alias("first_value"),
    )


@query("""
WITH t AS (
  SELECT lang, source, avg(quality) AS v FROM documents JOIN labels USING (doc_id) GROUP BY lang, source
)
SELECT lang AS suite, count(*)::BIGINT AS n_tasks, round(avg(v), 9) AS metric_value FROM t GROUP BY lang
""")
def macro_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as suites, sources as tasks: every source counts the same."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("suite"), "source")
    labelled = docs.join(table(spark, sf, "labels"), "doc_id")
    means = mean_of_means(labelled, "suite", "source", F.col("quality"))
    return means.withColumn("metric_value", F.round("metric_value", 9))


@query("""
SELECT o_orderkey, (coalesce(max(l_linenumber), 0) + 1)::BIGINT AS extent,
       (CASE WHEN max(l_linenumber) IS NULL THEN 0 ELSE max(l_linenumber) + 1 END)::BIGINT AS stacked_extent
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def group_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per order; reduced per order before the join, so nothing is multiplied."""
    top = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_linenumber").alias("last_line")
    )
    joined = table(spark, sf, "orders").select("o_orderkey").join(top, "o_orderkey", "left")
    return joined.groupBy("o_orderkey").agg(
        extent_of(F.col("last_line")).alias("extent"),
        extent_of(F.col("last_line"), when_empty=0).alias("stacked_extent"),
    )


@query(f"""
WITH r AS (
  SELECT label, vec_id % {MODELS} AS model_idx,
         row_number() OVER (PARTITION BY label, vec_id % {MODELS} ORDER BY vec_id) - 1 AS row_idx,
         embedding[1:16 + 8 * (vec_id % {MODELS})] AS vals
  FROM embeddings
),
c AS (SELECT label, row_idx, unnest(vals)::DOUBLE AS x, generate_subscripts(vals, 1) AS col FROM r),
m AS (SELECT label, row_idx, col, avg(x) AS x FROM c GROUP BY ALL),
w AS (SELECT label, max(len(vals)) AS width FROM r GROUP BY label)
SELECT label, row_idx, any_value(width)::BIGINT AS width, (any_value(width) - count(*))::BIGINT AS n_empty,
       round(sum(x), 6) AS cell_sum, round(max_by(x, col), 6) AS last_cell
FROM m JOIN w USING (label) GROUP BY label, row_idx
""")
def ragged_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Five matrices of unlike width and height per label, averaged cell by cell."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.pmod("vec_id", F.lit(MODELS)).alias("model_idx"), "embedding"
    )
    placed = dense_positions(rows.select("vec_id", "label", "model_idx"), ["label", "model_idx"], ["vec_id"], "row_idx")
    width = (F.lit(16) + 8 * F.col("model_idx")).cast("int")
    matrices = rows.join(placed.select("vec_id", "row_idx"), "vec_id").select(
        "label", "model_idx", "row_idx", F.slice("embedding", F.lit(1), width).alias("vals")
    )
    merged = mean_of_cells(matrices, ["label"])
    v = F.col("vals")
    present = F.filter(v, lambda x: ~F.isnan(x))
    return merged.select(
        "label",
        "row_idx",
        F.size(v).cast("bigint").alias("width"),
        (F.size(v) - F.size(present)).cast("bigint").alias("n_empty"),
        F.round(total(present), 6).alias("cell_sum"),
        F.round(F.element_at(present, -1), 6).alias("last_cell"),
    )


@query("""
SELECT l_returnflag, (max(l_linenumber) + 1)::BIGINT AS num_layers, (max(l_suppkey) + 1)::BIGINT AS num_rows
FROM lineitem GROUP BY l_returnflag
""")
def shape_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return summarise_shape(rows, ["l_returnflag"], F.col("l_linenumber"), F.col("l_suppkey"))


# Three models whose layers are the labels below eight; the other labels are plain keys.
PARAMETERS_SQL = """
p AS (
  SELECT vec_id % 3 AS model_idx, CASE WHEN label < 8 THEN 'model.layers.' || label || '.w' ELSE 'head.' || label END AS key,
         row_number() OVER (PARTITION BY vec_id % 3, label ORDER BY vec_id) - 1 AS row_idx, label,
         embedding::DOUBLE[] AS vals
  FROM embeddings
),
n AS (
  SELECT key, row_idx, avg(x) AS x, col FROM (
    SELECT key, row_idx, unnest(vals) AS x, generate_subscripts(vals, 1) AS col FROM p WHERE key LIKE 'head.%')
  GROUP BY key, row_idx, col
),
h AS (SELECT key, row_idx, list(x ORDER BY col) AS vals FROM n GROUP BY key, row_idx)"""

PARAMETER_ROW_SQL = """row_idx, len(vals)::BIGINT AS width, round(vals[1], 6) AS first_value,
       round(list_sum(vals), 5) AS value_sum"""


def _parameters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.pmod("vec_id", F.lit(3)).alias("model_idx"), "embedding"
    )
    places = dense_positions(rows.select("vec_id", "label", "model_idx"), ["label", "model_idx"], ["vec_id"], "row_idx")
    key = F.when(F.col("label") < 8, F.concat(F.lit("model.layers."), "label", F.lit(".w"))).otherwise(
        F.concat(F.lit("head."), "label")
    )
    return rows.join(places.select("vec_id", "row_idx"), "vec_id").select(
        "model_idx", key.alias("key"), "row_idx", F.col("embedding").alias("vals")
    )


def _combined(spark: SparkSession, sf: str, method: str) -> DataFrame:
    v = F.col("vals")
    return combine_models(stage(_parameters(spark, sf), "parameters"), method, 3).select(
        "key",
        "row_idx",
        F.size(v).cast("bigint").alias("width"),
        F.round(F.get(v, F.lit(0)), 6).alias("first_value"),
        F.round(total(v), 5).alias("value_sum"),
    )


@query(f"""
WITH {PARAMETERS_SQL},
e AS (SELECT model_idx, max(label) + 1 AS extent FROM p WHERE label < 8 GROUP BY model_idx),
s AS (SELECT model_idx, sum(extent) OVER (ORDER BY model_idx) - extent AS start FROM e)
SELECT 'model.layers.' || (start + label)::BIGINT || '.w' AS key, {PARAMETER_ROW_SQL}
FROM p JOIN s USING (model_idx) WHERE label < 8
UNION ALL
SELECT key, {PARAMETER_ROW_SQL} FROM h
""")
def stacked_models(spark: SparkSession, sf: str) -> DataFrame:
    return _combined(spark, sf, "stack")


@query(f"""
WITH {PARAMETERS_SQL}
SELECT 'model.layers.' || (label * 3 + model_idx) || '.w' AS key, {PARAMETER_ROW_SQL} FROM p WHERE label < 8
UNION ALL
SELECT key, {PARAMETER_ROW_SQL} FROM h
""")
def interleaved_models(spark: SparkSession, sf: str) -> DataFrame:
    return _combined(spark, sf, "interleave")


@query(f"""
WITH {PARAMETERS_SQL},
kept AS (SELECT * FROM p WHERE NOT (key = 'head.9' AND model_idx = 2)),
heights AS (SELECT max(row_idx) + 1 AS n FROM kept WHERE key = 'head.8')
SELECT 'layers' AS what, '' AS key, sum(n)::BIGINT AS n FROM (SELECT max(label) + 1 AS n FROM p WHERE label < 8 GROUP BY model_idx)
UNION ALL SELECT 'vocabulary', 'head.8', n::BIGINT FROM heights
UNION ALL SELECT 'missing', key, count(DISTINCT model_idx) FROM kept WHERE key LIKE 'head.%' GROUP BY key HAVING count(DISTINCT model_idx) < 3
UNION ALL SELECT 'rows', key, count(DISTINCT row_idx) FROM kept WHERE key LIKE 'head.%' GROUP BY key
""")
def combine_job(spark: SparkSession, sf: str) -> DataFrame:
    """A table per model, the third without one of its keys, through the stacking job."""
    rows = stage(_parameters(spark, sf).where("NOT (key = 'head.9' AND model_idx = 2)"), "parameters")
    root = fresh_path(spark, "combine")
    models = [f"{root}/{i}" for i in range(3)]
    for i, path in enumerate(models):
        rows.where(F.col("model_idx") == i).drop("model_idx").write.parquet(path)
    combine_tables(spark, models, f"{root}/out", vocabulary_key="head.8")
    shape = spark.read.parquet(f"{root}/out/shape")
    missing = spark.read.parquet(f"{root}/out/missing")
    combined = spark.read.parquet(f"{root}/out/rows").where(~has_prefix(F.col("key")))
    line = lambda what, key, n: [F.lit(what).alias("what"), key.alias("key"), n.cast("bigint").alias("n")]
    return (
        shape.select(*line("layers", F.lit(""), F.col("num_layers")))
        .unionByName(shape.select(*line("vocabulary", F.lit("head.8"), F.col("vocabulary_rows"))))
        .unionByName(missing.select(*line("missing", F.col("key"), F.col("n_models"))))
        .unionByName(combined.groupBy("key").agg(F.count("*").alias("n_rows")).select(*line("rows", F.col("key"), F.col("n_rows"))))
    )


# Conversations are the sources and turns the ordinals, in sets of ten conversations.
TURNS_SQL = f"""
t AS (SELECT conv_id // {SOURCES} AS set_idx, conv_id % {SOURCES} AS source_idx, turn AS ordinal FROM conversations)"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.expr(f"conv_id div {SOURCES}").alias("set_idx"),
        F.pmod("conv_id", F.lit(SOURCES)).alias("source_idx"),
        F.col("turn").alias("ordinal"),
    )


@query(f"""
WITH {TURNS_SQL},
e AS (SELECT set_idx, source_idx, max(ordinal) + 1 AS extent FROM t GROUP BY ALL),
s AS (SELECT set_idx, source_idx, sum(extent) OVER (PARTITION BY set_idx ORDER BY source_idx) - extent AS start FROM e)
SELECT set_idx, source_idx, ordinal, (start + ordinal)::BIGINT AS new_ordinal
FROM t JOIN s USING (set_idx, source_idx)
""")
def stack_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return combine(_turns(spark, sf), "stack", "source_idx", "ordinal", groups=["set_idx"])


@query(f"WITH {TURNS_SQL} SELECT *, (ordinal * {SOURCES} + source_idx)::BIGINT AS new_ordinal FROM t")
def interleave_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return combine(_turns(spark, sf), "interleave", "source_idx", "ordinal", SOURCES, groups=["set_idx"])


@query(f"""
WITH {TURNS_SQL}
SELECT *, dense_rank() OVER (PARTITION BY set_idx ORDER BY ordinal * {SOURCES} + source_idx) - 1 AS new_ordinal FROM t
""")
def interleave_compact(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    return combine(
        turns, "interleave", "source_idx", "ordinal", SOURCES, groups=["set_idx"], compact=True
    )


@query("""
WITH l AS (SELECT concat(c_nationkey, '.', c_custkey) AS key,
                  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p FROM customer),
r AS (SELECT concat(s_nationkey, '.', s_suppkey) AS key,
             row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS p FROM supplier)
SELECT key, l.p AS left_position, r.p AS right_position,
       CASE WHEN l.p IS NULL THEN 'missing_left' WHEN r.p IS NULL THEN 'missing_right'
            WHEN l.p <> r.p THEN 'moved' ELSE 'same' END AS status
FROM l FULL JOIN r USING (key)
""")
def key_compat(spark: SparkSession, sf: str) -> DataFrame:
    """Customer keys against supplier keys, each at its place within the nation."""

    def listed(name: str, nation: str, key: str) -> DataFrame:
        placed = dense_positions(table(spark, sf, name).select(nation, key), [nation], [key], "position")
        return placed.select(F.concat_ws(".", nation, key).alias("key"), "position")

    left = listed("customer", "c_nationkey", "c_custkey")
    right = listed("supplier", "s_nationkey", "s_suppkey")
    return compare_keys(left, right, "key", "position")


@query("""
SELECT p_brand, p_type, max(p_partkey) AS p_partkey, max_by(p_name, p_partkey) AS p_name,
       max_by(p_size, p_partkey) AS p_size
FROM part GROUP BY p_brand, p_type
""")
def last_writer(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", "p_name", "p_size")
    return keep_last(parts, ["p_brand", "p_type"], ["p_partkey"])


# Whole numbers of 2**-60, added without rounding; the fraction comes back beside the whole part.
UNIT = 1 << 60


@query(f"""
WITH s AS (
  SELECT l_returnflag, l_linestatus, count(*) AS n, sum((l_extendedprice * {float(UNIT)!r}::DOUBLE)::HUGEINT) AS h FROM lineitem GROUP BY ALL
)
SELECT l_returnflag, l_linestatus, n::BIGINT AS n_rows,
       (h // {UNIT}::HUGEINT)::DOUBLE + (h % {UNIT}::HUGEINT)::DOUBLE / {float(UNIT)!r}::DOUBLE AS price
FROM s
""")
def exact_price_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of doubles to the last bit, however the rows are dealt out."""
    rows = table(spark, sf, "lineitem")
    return exact_sums(rows, ["l_returnflag", "l_linestatus"], {"price": F.col("l_extendedprice")}, {"n_rows": F.count("*")})


@query(f"""
WITH s AS (
  SELECT event_type, count(*) AS n, sum((value * {float(UNIT)!r}::DOUBLE)::HUGEINT) AS h
  FROM events WHERE event_id % 3 <> 0 AND value >= 0.01 GROUP BY ALL
)
SELECT event_type, ((h // {UNIT}::HUGEINT)::DOUBLE + (h % {UNIT}::HUGEINT)::DOUBLE / {float(UNIT)!r}::DOUBLE) / n AS mean FROM s
""")
def exact_masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The masked mean without rounding its sum by the order of the rows."""
    rows = table(spark, sf, "events")
    mask = ((F.col("event_id") % 3 != 0) & (F.col("value") >= 0.01)).cast("int")
    return exact_mean(rows.withColumn("m", mask).where("m = 1"), ["event_type"], F.col("value"), F.col("m"))
