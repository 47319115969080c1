import json

from pyspark.sql import functions as F

from packwright.plans import jobs
from packwright.sources.counters import counted, rows_where, total

LENGTH = 8


def write_raw(folder):
    folder.mkdir()
    turns = [("human", "a b c"), ("gpt", "d e"), ("robot", "x"), ("gpt", None)]
    lines = [json.dumps({"conversations": [{"from": f, "value": v} for f, v in turns]}), "{broken", json.dumps({"other": 1})]
    lines += [json.dumps({"conversations": []})]
    (folder / "chats.jsonl").write_text("\n".join(lines) + "\n")
    texts = ["one two three four five six seven", "", None]
    (folder / "textbooks.jsonl").write_text("".join(json.dumps({"markdown": t}) + "\n" for t in texts))


def test_jobs_count_while_they_write(spark, tmp_path):
    write_raw(tmp_path / "raw")
    got = jobs.tokenize_files(spark, f"{tmp_path}/raw/*", f"{tmp_path}/tokens", "word_md5")
    assert got == {
        "turns": 4, "tokens": 3 + 3 + 8 + 1, "target_tokens": 3 + 8 + 1, "rejected": 5, "rejected: malformed line": 1,
        "rejected: no conversations": 1, "rejected: no text": 2, "rejected: unknown speaker": 1,
    }
    spans = spark.read.schema(jobs.SPAN_SCHEMA).parquet(f"{tmp_path}/tokens/spans")
    assert spans.where("status = 'ok'").agg(F.sum("n")).first()[0] == got["tokens"]
    packed = jobs.pack_spans(spark, f"{tmp_path}/tokens", f"{tmp_path}/blocks", LENGTH)
    blocks = jobs.read_blocks(spark, f"{tmp_path}/blocks", LENGTH)
    assert packed == {"blocks": blocks.count(), "tokens": LENGTH * blocks.count(), "target_tokens": LENGTH}


def test_counters_need_no_scan_of_what_was_written(spark, tmp_path):
    """One job reads the raw files and writes; nothing reads the spans again."""
    write_raw(tmp_path / "raw")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counting", "counting")
    try:
        jobs.tokenize_files(spark, f"{tmp_path}/raw/*", f"{tmp_path}/tokens", "word_md5")
        # The exchange before the write is a job of its own under adaptive execution.
        assert len(tracker.getJobIdsForGroup("counting")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_plan_counts_right_before_the_write(spark):
    rows = spark.range(100).hint("rebalance", "id")
    with counted(rows, {"rows": rows_where(F.col("id") > 9), "sum": total(F.col("id"))}) as c:
        plan = c.rows._jdf.queryExecution().executedPlan().toString()
        assert plan.index("CollectMetrics") < plan.index("Exchange")
        c.rows.write.format("noop").mode("overwrite").save()
    assert c.counts == {"rows": 90, "sum": 4950}


def test_nothing_to_count(spark):
    with counted(spark.range(0), {"rows": rows_where(F.lit(True)), "sum": total(F.col("id"))}) as c:
        c.rows.write.format("noop").mode("overwrite").save()
    assert c.counts == {"rows": 0, "sum": 0}
