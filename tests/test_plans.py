"""What no plan of a registered query may hold."""

import re

import pytest
from pyspark.sql import functions as F

from packwright.operators.packing import pack
from packwright.plans.catalog import QUERIES
from packwright.plans.inputs import document_spans
from packwright.session import stage
from packwright.sources.tables import table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_and_no_row_udfs(spark, sf_small, name):
    plan = plan_of(QUERIES[name](spark, sf_small))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit"):
        assert forbidden not in plan
    # One task only ever sees a single total, or totals of wide key ranges.
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[at + 1]
            assert "HashAggregate" in below and ("_sum" in below or "keys=[]" in below), below


def test_offsets_read_no_token_arrays(spark, sf_small):
    spans = stage(document_spans(spark, sf_small).withColumn("n", F.size("token_ids").cast("bigint")), "spans")
    plan = plan_of(pack(spans, 64, staged=False))
    scans = re.findall(r"ReadSchema: struct<([^>]*)", plan)
    with_arrays = [s for s in scans if "token_ids" in s]
    assert len(with_arrays) == 1 and len(scans) >= 2
    assert plan.count("REPARTITION_BY_COL") == 1  # the run of blocks, and no exchange after it


def test_filters_reach_the_scan(spark, sf_small):
    plan = plan_of(table(spark, sf_small, "orders").where("o_custkey < 3").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_custkey), LessThan(o_custkey,3)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_no_join_where_columns_can_come_along(spark, sf_small):
    plan = plan_of(QUERIES["token_stats"](spark, sf_small))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_chunks_are_written_by_several_tasks(spark, tmp_path):
    from packwright.sources.sinks import read_chunk, write_chunks

    rows = spark.range(1000).selectExpr("id AS k", "id AS chunk_position", "0 AS epoch", "0L AS chunk_idx")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would be put together again
    before = spark.conf.get(merging)
    try:
        spark.conf.set(merging, "false")
        write_chunks(rows, str(tmp_path / "c"), rows_per_file=100)
    finally:
        spark.conf.set(merging, before)
    files = [p for p in (tmp_path / "c").rglob("*.parquet")]
    assert len(files) > 1
    for path in files:
        places = [r.chunk_position for r in spark.read.parquet(str(path)).collect()]
        assert places == sorted(places) and len(places) < 1000
    assert read_chunk(spark, str(tmp_path / "c"), 0, "k bigint").count() == 1000


def test_a_wrong_mask_or_key_stops_packing(spark):
    schema = "doc_id bigint, token_ids array<int>, tgt_mask array<int>, data_type string, subset_name string"
    short = spark.createDataFrame([(1, [1, 2, 3, 4], [1, 1, 1], "text", "a")], schema)
    with pytest.raises(Exception, match="not as long as its ids"):
        pack(short, 2).collect()
    twice = spark.createDataFrame([(1, [1, 2, 3, 4], [1] * 4, "text", "a")] * 2, schema)
    with pytest.raises(Exception, match="keys are not unique"):
        pack(twice, 4).collect()
