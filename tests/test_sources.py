import json

import pytest
from pyspark.sql import functions as F

from packwright.operators.batches import assign_ranks, sample_positions
from packwright.operators.pending import last_checkpoint
from packwright.operators.shuffling import shuffle_into_chunks
from packwright.session import fresh_path, stage, work_dir
from packwright.sources.records import (
    chat_turns,
    count_records,
    list_files,
    read_chat_records,
    read_text_records,
    read_tokenized_files,
)
from packwright.sources.sinks import (
    read_blocks,
    read_chunk,
    read_chunks,
    read_tokenized,
    write_blocks,
    write_chunks,
    write_rank_batches,
    write_tokenized,
)


def lines(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in records))


def test_chat_and_text_records(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a\n"}]}])
    lines(tmp_path / "b.jsonl", [{"conversations": []}, {"conversations": [{"from": "system", "value": ""}]}])
    turns = chat_turns(read_chat_records(spark, str(tmp_path / "*.jsonl"))).collect()
    assert sorted((r.turn, r.role, r.text) for r in turns) == [(0, "human", "q"), (0, "system", ""), (1, "gpt", "a\n")]
    lines(tmp_path / "t" / "c.jsonl", [{"markdown": "# x", "other": 1}])
    assert read_text_records(spark, str(tmp_path / "t")).first().text == "# x"


def test_tokenized_files_by_folder(spark, tmp_path):
    one = {"token_ids": [1, 2], "tgt_mask": [0, 1]}
    lines(tmp_path / "chat" / "x.jsonl", [one, one])
    lines(tmp_path / "text" / "y.jsonl", [one])
    lines(tmp_path / "video" / "z.jsonl", [one] * 3)
    good, rejected = read_tokenized_files(spark, str(tmp_path / "*" / "*.jsonl"))
    assert sorted((r.data_type, r.subset_name) for r in good.collect()) == [("chat", "x.jsonl")] * 2 + [("text", "y.jsonl")]
    assert [tuple(r) for r in rejected.collect()] == [("video", 3)]
    assert {r.subset_name: r.n_records for r in count_records(good, ["subset_name"]).collect()} == {"x.jsonl": 2, "y.jsonl": 1}


def test_tokenized_lines_keep_their_place(spark, tmp_path):
    for name, first in (("b.jsonl", 100), ("a.jsonl", 0)):
        lines(tmp_path / "chat" / name, [{"token_ids": [first + i], "tgt_mask": [1]} for i in range(30)])
    good, _ = read_tokenized_files(spark, str(tmp_path / "*" / "*.jsonl"))
    rows = sorted(good.collect(), key=lambda r: (r.file_no, r.part_start, r.row_in_part))
    assert [r.token_ids[0] for r in rows] == [*range(30), *range(100, 130)]


@pytest.mark.parametrize("line", ['{"token_ids": [1, 2], "tgt_mask": [1]}', '{"token_ids": [1', '{"tgt_mask": [1]}'])
def test_tokenized_lines_that_are_no_examples(spark, tmp_path, line):
    (tmp_path / "chat").mkdir()
    (tmp_path / "chat" / "x.jsonl").write_text(line + "\n")
    good, _ = read_tokenized_files(spark, str(tmp_path / "chat" / "x.jsonl"))
    with pytest.raises(Exception, match="not an example"):
        good.collect()


def test_listing(spark, tmp_path):
    assert list_files(spark, str(tmp_path / "none")).collect() == []
    for name in ("run/ckpt_3/a/w", "run/ckpt_10/w", "run/eval_x.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    paths = list_files(spark, str(tmp_path / "run"))
    assert {r.path.rsplit("run/", 1)[1] for r in paths.collect()} == {
        "ckpt_3", "ckpt_3/a", "ckpt_3/a/w", "ckpt_10", "ckpt_10/w", "eval_x.json"
    }
    assert paths.agg(last_checkpoint(paths.path)).first()[0] == 10


def test_tokenized_both_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, [1], [1], "chat", "a"), (2, [2, 3], [0, 1], "text", "b")],
                               "doc_id bigint, token_ids array<int>, tgt_mask array<int>, data_type string, subset_name string")
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        write_tokenized(df, path, fmt)
        assert sorted(read_tokenized(spark, path, "doc_id bigint", fmt).collect()) == sorted(df.collect())


def test_blocks_of_one_length_only(spark, tmp_path):
    schema = "block_idx bigint, token_ids array<int>, tgt_mask array<int>, data_type string, subset_name string"
    two = spark.createDataFrame([(0, [1, 2], [1, 1], "text", "a")], schema)
    three = spark.createDataFrame([(0, [1, 2, 3], [1, 1, 1], "text", "a")], schema)
    write_blocks(two, str(tmp_path / "b"), 2)
    write_blocks(three, str(tmp_path / "b"), 3)
    got = read_blocks(spark, str(tmp_path / "b"), 3)
    assert [r.token_ids for r in got.collect()] == [[1, 2, 3]]
    assert "PartitionFilters: [isnotnull(context_length" in got._jdf.queryExecution().executedPlan().toString()


def test_chunks_in_order_and_pruned(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "k")
    chunked = shuffle_into_chunks(rows, ["k"], chunk_size=30, n_epochs=2)
    path = str(tmp_path / "chunks")
    write_chunks(chunked.select("k", "chunk_position", "epoch", "chunk_idx"), path)
    every = read_chunks(spark, path, "k bigint")
    assert every.count() == 200
    files = every.select("epoch", "chunk_idx", F.col("_metadata.file_path").alias("f")).distinct().count()
    assert files == 8  # one file a chunk
    one = read_chunk(spark, path, 2, "k bigint", epoch=1)
    assert [r.chunk_position for r in one.collect()] == list(range(25))
    want = chunked.where("chunk_idx = 2 and epoch = 1").orderBy("chunk_position").collect()
    assert [r.k for r in one.collect()] == [r.k for r in want]


def test_rank_files_are_in_rank_order(spark, tmp_path):
    rows = spark.range(64).select(F.col("id").alias("k"), F.col("id").alias("o"), F.lit(0).alias("chunk_idx"))
    assigned = assign_ranks(sample_positions(rows, ["k"], "o", 64, groups=["chunk_idx"]), 4, 2)
    path = str(tmp_path / "ranks")
    write_rank_batches(assigned, path)
    one = spark.read.parquet(path).where("rank = 3").collect()
    assert [r.rank_position for r in one] == list(range(16))


def test_own_folder_only_where_none_is_set(spark):
    assert work_dir(spark) == work_dir(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    df = spark.range(5)
    assert sorted(stage(df, "s").collect()) == sorted(df.collect())
