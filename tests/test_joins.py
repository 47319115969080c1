"""Values of groups brought back to rows: an inner join, null-safe, without forced broadcasts."""

import pytest
from pyspark.sql import functions as F

from packwright.operators import joins
from packwright.operators.aggregates import clip_by_norm, ragged_mean
from packwright.operators.ordinals import interleave, stack


@pytest.fixture()
def rows(spark):
    """Half of the rows in one group."""
    group = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    return spark.range(400).select("id", group.alias("g"))


def sums(rows):
    return rows.groupBy("g").agg(F.sum("id").alias("s"))


def test_is_an_inner_join(rows):
    want = rows.join(sums(rows), "g").select("g", "id", "s").collect()
    got = joins.join_groups(rows, sums(rows), ["g"]).select("g", "id", "s").collect()
    assert sorted(got) == sorted(want)


def test_null_is_a_group(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    got = joins.join_groups(rows, sums(rows), ["g"]).collect()
    assert sorted((r.id, r.g, r.s) for r in got) == [(1, None, 3), (2, None, 3), (3, "a", 3)]


def test_broadcasts_only_by_the_engines_count(spark, rows):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = joins.join_groups(rows, sums(rows), ["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and plan.count("Join") == 1


@pytest.fixture()
def vectors(spark):
    return spark.range(60).select(
        (F.col("id") % 3).alias("m"),
        F.expr("id div 3").alias("o"),
        F.array(*[(F.col("id") + i).cast("float") for i in range(4)]).alias("v"),
    )


def test_operators_that_use_it_on_a_large_group(spark, vectors):
    one = vectors.withColumn("k", F.lit("all"))
    clipped = clip_by_norm(one, ["k"], "v", 1.0).agg(F.sum(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("s")).first().s
    assert clipped == pytest.approx(1.0, abs=1e-3)
    mean = ragged_mean(one, ["k"], "o", "v").collect()
    assert len(mean) == 20 and all(len(r.v) == 4 for r in mean)
    assert sorted(r.new_ordinal for r in stack(vectors, "m", "o").collect()) == list(range(60))
    assert sorted(r.new_ordinal for r in interleave(vectors, "m", "o", 3, compact=True).collect()) == list(range(60))
