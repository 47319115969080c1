import glob

from pyspark.sql import functions as F

from packwright.sources.sinks import read_chunk, read_chunks, read_first, read_places, write_chunks, write_rank_batches

PAYLOAD = "key bigint, token_ids array<int>"


def chunked(spark, n=400, chunks=2):
    rows = spark.range(n).select(
        F.col("id").alias("key"), F.array(F.col("id").cast("int")).alias("token_ids"),
        F.expr(f"id div {chunks}").alias("chunk_position"), F.lit(0).alias("epoch"), F.expr(f"id % {chunks}").alias("chunk_idx"),
    )
    return rows


def scanned(df):
    """The partition filters of the scan, as the plan spells them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters") :].split("]")[0]


def test_first_places_open_only_their_files(spark, tmp_path):
    path = str(tmp_path / "chunks")
    write_chunks(chunked(spark), path, rows_per_file=10)
    assert len(glob.glob(f"{path}/epoch=0/chunk_idx=1/piece=*")) == 20
    first = read_first(spark, path, 15, PAYLOAD, chunk_idx=1, rows_per_file=10)
    assert sorted(r.key for r in first.collect()) == [2 * i + 1 for i in range(15)]
    assert "piece" in scanned(first) and first.columns == ["key", "token_ids", "chunk_position", "epoch", "chunk_idx"]
    both = read_first(spark, path, 1, PAYLOAD, rows_per_file=10)
    assert sorted(r.key for r in both.collect()) == [0, 1]
    assert read_first(spark, path, 0, PAYLOAD, rows_per_file=10).count() == 0


def test_chosen_places_prune_files_while_running(spark, tmp_path):
    path = str(tmp_path / "chunks")
    write_chunks(chunked(spark), path, rows_per_file=10)
    chosen = spark.createDataFrame([(0, 0, 3, "a"), (0, 0, 7, "b"), (0, 1, 105, "c"), (0, 1, 999, "gone")], "epoch int, chunk_idx bigint, chunk_position bigint, tag string")
    chosen.write.parquet(str(tmp_path / "chosen"))
    some = spark.read.parquet(str(tmp_path / "chosen")).where("tag <> ''")
    found = read_places(spark, path, some, PAYLOAD, rows_per_file=10)
    assert sorted((r.key, r.tag) for r in found.collect()) == [(6, "a"), (14, "b"), (211, "c")]
    assert "dynamicpruning" in scanned(found)


def test_whole_chunks_are_read_as_before(spark, tmp_path):
    path = str(tmp_path / "chunks")
    write_chunks(chunked(spark), path, rows_per_file=64)
    assert read_chunks(spark, path, PAYLOAD).count() == 400 and "piece" not in read_chunks(spark, path, PAYLOAD).columns
    assert sorted(r.key for r in read_chunk(spark, path, 1, PAYLOAD).collect()) == list(range(1, 400, 2))


def test_a_ranks_share_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(100).select(F.lit(0).alias("chunk_idx"), F.lit(0).alias("rank"), F.col("id").alias("rank_position"))
    joining = "spark.sql.adaptive.coalescePartitions.enabled"  # of small tasks, as these are
    before = spark.conf.get(joining)
    try:
        spark.conf.set(joining, "false")
        write_rank_batches(rows, str(tmp_path / "out"), rows_per_file=10)
    finally:
        spark.conf.set(joining, before)
    files = glob.glob(f"{tmp_path}/out/chunk_idx=0/rank=0/*.parquet")
    assert len(files) > 1
    for file in files:
        places = [r.rank_position for r in spark.read.parquet(file).collect()]
        assert places == sorted(places)
