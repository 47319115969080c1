import glob
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from packwright.operators.batches import batch_plan
from packwright.plans import files
from packwright.plans.files import BLOCK_PAYLOAD
from packwright.sources.sinks import (
    read_batch_log,
    read_chunk,
    read_chunks,
    read_first,
    read_places,
    write_batch_log,
    write_chunks,
    write_rank_batches,
)


def test_chunks_as_lines_are_written_compressed_and_read_back(spark, sf_small):
    """Ids as digits take more than twice the room without it."""
    packed = Path(files._write_chunked_blocks(spark, sf_small, 2, "json"))
    plain = Path(files._write_chunked_blocks(spark, sf_small, 2))
    written = [p for p in packed.rglob("part-*") if not p.name.endswith(".crc")]
    assert written and all(p.name.endswith(".json.gz") for p in written)
    told = read_chunks(spark, str(packed), BLOCK_PAYLOAD, "json")
    lines = told.select(F.sum(F.length(F.to_json(F.struct("token_ids", "tgt_mask"))))).first()[0]
    assert sum(p.stat().st_size for p in written) < lines / 2
    want = read_chunks(spark, str(plain), BLOCK_PAYLOAD)
    same = [*want.columns]
    assert told.count() == want.count() > 0
    assert told.select(same).exceptAll(want.select(same)).isEmpty()


def small_chunks(spark, n_chunks=300, rows=7):
    """Rows by chunk and place; one chunk is shorter and one is missing."""
    return spark.range(n_chunks * rows).select(
        F.col("id").alias("key"), F.expr(f"id % {rows}").alias("chunk_position"), F.lit(0).alias("epoch"),
        F.expr(f"id div {rows}").alias("chunk_idx"),
    ).where("chunk_idx <> 60 AND NOT (chunk_idx = 8 AND chunk_position > 2)")


def parts(path):
    return [p for p in Path(path).rglob("part-*") if not p.name.endswith(".crc")]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_files_grow_with_the_rows_and_not_with_the_chunks(spark, tmp_path, fmt):
    rows, path = small_chunks(spark), str(tmp_path / "c")
    write_chunks(rows, path, fmt, rows_per_file=100, chunk_rows=7)
    assert len(parts(path)) == len(glob.glob(f"{path}/epoch=0/chunk_from=*/chunk_to=*/piece=0")) == 22  # by 14 chunks
    back = read_chunks(spark, path, "key bigint", fmt)
    assert back.columns == ["key", "chunk_position", "epoch", "chunk_idx"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.select(back.columns).collect()))
    for idx, n in ((0, 7), (8, 3), (13, 7), (14, 7), (60, 0), (299, 7), (300, 0)):
        one = read_chunk(spark, path, idx, "key bigint", fmt=fmt)
        assert sorted(r.key for r in one.collect()) == [idx * 7 + i for i in range(n)]
    first = read_first(spark, path, 2, "key bigint", chunk_idx=20, fmt=fmt, rows_per_file=100)
    assert sorted(r.key for r in first.collect()) == [140, 141]
    chosen = spark.createDataFrame([(0, 3, 5), (0, 8, 5), (0, 299, 0)], "epoch int, chunk_idx bigint, chunk_position bigint")
    assert sorted(r.key for r in read_places(spark, path, chosen, "key bigint", fmt, rows_per_file=100).collect()) == [26, 2093]


def test_one_of_the_chunks_that_share_files_touches_one(spark, tmp_path):
    path = str(tmp_path / "c")
    write_chunks(small_chunks(spark), path, rows_per_file=100, chunk_rows=7)
    plan = read_chunk(spark, path, 20, "key bigint")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "chunk_from" in filters and "chunk_to" in filters
    (scan,) = {Path(r[0]).parent.parent.name for r in read_chunk(spark, path, 20, "key bigint").select(F.input_file_name()).collect()}
    assert scan == "chunk_to=27"


def test_batches_and_log_of_small_chunks(spark, tmp_path):
    rows = small_chunks(spark).select(
        "chunk_idx", (F.col("chunk_position") % 2).cast("int").alias("rank"), F.expr("chunk_position div 2").alias("rank_position"),
        F.expr("chunk_position div 2").alias("batch_idx"), "key",
    )
    write_rank_batches(rows, str(tmp_path / "b"), rows_per_file=100, rank_rows=4)
    assert len(parts(tmp_path / "b")) == 24  # 12 runs of 25 chunks, 2 ranks
    back = spark.read.schema(rows.schema).parquet(str(tmp_path / "b")).select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    for file in parts(tmp_path / "b")[:3]:
        places = [(r.chunk_idx, r.rank_position) for r in spark.read.parquet(str(file)).collect()]
        assert places == sorted(places)
    plan = batch_plan(rows, 300, 7, 2, 1)
    write_batch_log(plan, str(tmp_path / "log"))
    assert len(parts(tmp_path / "log")) <= 8
    log = read_batch_log(spark, str(tmp_path / "log"))
    want = plan.where("rank = 0").select("chunk_idx", "batch_idx", "n_examples", "step")
    assert sorted(map(tuple, log.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
