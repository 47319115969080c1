"""The stages from raw files to batches and their log, against plain Python."""

import itertools
import json
import random

import pytest

from packwright.plans import jobs

LENGTH, EOS = 16, 268435456


def plain_ids(text):
    from hashlib import md5

    return [int(md5(w.encode()).hexdigest()[:7], 16) for w in text.split(" ")] if text else []


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Files of line records and what they tokenize to, in file order."""
    draw = random.Random(21)
    folder = tmp_path_factory.mktemp("raw")

    def words():
        return " ".join(draw.choice("ab cd e  fgh ijk".split(" ")) for _ in range(draw.randrange(9)))

    streams = {}
    for name, n in (("chats.jsonl", 120), ("more.jsonl", 9)):
        ids, mask, lines = [], [], []
        for _ in range(n):
            turns = [(draw.choice(["human", "gpt", "system"]), words()) for _ in range(draw.randrange(5))]
            lines.append(json.dumps({"conversations": [{"from": f, "value": v} for f, v in turns]}))
            for speaker, text in turns:
                new = plain_ids(text) + ([EOS] if speaker == "gpt" else [])
                ids += new
                mask += [int(speaker == "gpt")] * len(new)
        (folder / name).write_text("\n".join(lines) + "\n")
        streams["chat", name] = (ids, mask)
    texts = [words() for _ in range(60)]
    (folder / "textbooks.jsonl").write_text("".join(json.dumps({"markdown": t}) + "\n" for t in texts))
    ids = list(itertools.chain.from_iterable(plain_ids(t) + [EOS] for t in texts))
    streams["text", "textbooks.jsonl"] = (ids, [1] * len(ids))
    return folder, streams


def blocks_of(streams):
    return {
        (kind, name, b): (ids[b * LENGTH : (b + 1) * LENGTH], mask[b * LENGTH : (b + 1) * LENGTH])
        for (kind, name), (ids, mask) in streams.items()
        for b in range(len(ids) // LENGTH)
    }


@pytest.mark.parametrize("split", ["128m", "600b"])
def test_files_to_blocks_however_split(spark, raw, tmp_path, split):
    folder, streams = raw
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        jobs.tokenize_files(spark, f"{folder}/*.jsonl", f"{tmp_path}/tokenized", "word_md5")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    jobs.pack_spans(spark, f"{tmp_path}/tokenized", f"{tmp_path}/blocks", LENGTH)
    got = {
        (r.data_type, r.subset_name, r.block_idx): (r.token_ids, r.tgt_mask)
        for r in jobs.read_blocks(spark, f"{tmp_path}/blocks", LENGTH).collect()
    }
    assert got == blocks_of(streams)


def test_unknown_speakers(spark, tmp_path):
    turns = [{"from": "robot", "value": "x"}, {"from": "gpt", "value": "y"}]
    (tmp_path / "a.jsonl").write_text(json.dumps({"conversations": turns}) + "\n")
    jobs.tokenize_files(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/out", "word_md5")
    spans = spark.read.parquet(f"{tmp_path}/out/spans").collect()
    assert [(r.status, r.turn, r.role, r.reason) for r in sorted(spans, key=lambda r: r.turn)] == [
        ("rejected", 0, "robot", "unknown speaker robot"), ("ok", 1, "gpt", None)
    ]
    with pytest.raises(Exception, match="unknown speaker robot"):
        jobs.tokenize_files(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/other", "word_md5", mode="fail")


def test_blocks_to_batches(spark, raw, tmp_path):
    folder, streams = raw
    jobs.tokenize_files(spark, f"{folder}/*.jsonl", f"{tmp_path}/tokenized", "word_md5")
    jobs.pack_spans(spark, f"{tmp_path}/tokenized", f"{tmp_path}/blocks", LENGTH)
    jobs.chunk_blocks(spark, f"{tmp_path}/blocks", f"{tmp_path}/chunks", LENGTH, chunk_size=30)
    blocks = blocks_of(streams)
    n_chunks = len(blocks) // 30 + 1
    finished = spark.createDataFrame([("run/ckpt_0",), ("run/log_chunk_0.jsonl",)], "path string")
    jobs.batch_chunks(
        spark, f"{tmp_path}/chunks", f"{tmp_path}/out", n_chunks, 20, 2, 3, accumulate=2, finished=finished
    )
    rows = spark.read.parquet(f"{tmp_path}/out/batches").collect()
    assert {r.chunk_idx for r in rows} == set(range(1, n_chunks))
    inputs = [tuple(r.input_ids) for r in rows]
    firsts = {tuple(ids[:-1]): (ids[1:], mask[1:]) for ids, mask in blocks.values()}
    assert len(rows) == (n_chunks - 1) * 18 and set(inputs) <= set(firsts)
    assert all((r.labels, r.loss_mask) == firsts[tuple(r.input_ids)] for r in rows)
    log = sorted(spark.read.json(f"{tmp_path}/out/log").collect(), key=lambda r: r.step)
    assert [r.step for r in log] == list(range(4, 3 * n_chunks + 1))
    assert all(r.n_examples == 3 and r.n_tokens == 3 * (LENGTH - 1) for r in log)
    by_batch = {}
    for r in rows:
        if r["rank"] == 0:
            key = (r.chunk_idx, r.batch_idx)
            by_batch[key] = by_batch.get(key, 0) + sum(r.loss_mask)
    assert [r.n_targets for r in log] == [by_batch[r.chunk_idx, r.batch_idx] for r in log]


def test_report(spark, tmp_path):
    result = {"results": {"gsm8k": {"acc,none": 0.25}}}
    (tmp_path / "eval_gsm8k.json").write_text(json.dumps(result))
    for model, value in (("m1", 0.2), ("m_2", 0.8)):
        (tmp_path / f"eval_{model}_gsm8k.json").write_text(json.dumps({"results": {"gsm8k": {"acc,none": value}}}))
    rows = jobs.report_results(spark, str(tmp_path)).collect()
    assert {r.model: r.report_line for r in rows} == {
        None: "gsm8k: acc = 0.25", "m1": "gsm8k: acc = 0.2", "m_2": "gsm8k: acc = 0.8"
    }


BAD_CHATS = ['{"conversations": [', '{"other": 1}', '{"conversations": [{"from": "gpt", "value": null}]}', '{"conversations": 5}']
BAD_TEXTS = ['{"markdown": ', '{"text": "x"}', '{"markdown": null}']


def test_unusable_lines_are_set_aside_with_a_reason(spark, tmp_path):
    good = json.dumps({"conversations": [{"from": "gpt", "value": "y"}]})
    (tmp_path / "a.jsonl").write_text("\n".join([*BAD_CHATS, good]) + "\n")
    (tmp_path / "textbooks.jsonl").write_text("\n".join([*BAD_TEXTS, '{"markdown": "z"}']) + "\n")
    jobs.tokenize_files(spark, f"{tmp_path}/*.jsonl", f"{tmp_path}/out", "word_md5")
    counts = {(r.data_type, r.status, r.reason): r.n_turns for r in jobs.tokenized_counts(spark, f"{tmp_path}/out").collect()}
    assert counts == {
        ("chat", "ok", None): 1, ("chat", "rejected", "malformed line"): 2, ("chat", "rejected", "no conversations"): 1,
        ("chat", "rejected", "no text"): 1, ("text", "ok", None): 1, ("text", "rejected", "malformed line"): 1,
        ("text", "rejected", "no text"): 2,
    }
    for name in ("a.jsonl", "textbooks.jsonl"):
        with pytest.raises(Exception, match="malformed line|no conversations|no text"):
            jobs.tokenize_files(spark, f"{tmp_path}/{name}", f"{tmp_path}/other", "word_md5", mode="fail")


def test_equal_names_in_two_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.jsonl").write_text(
            "".join(json.dumps({"conversations": [{"from": "user", "value": f"{folder}{i} c"}]}) + "\n" for i in range(20))
        )
    jobs.tokenize_files(spark, f"{tmp_path}/*/x.jsonl", f"{tmp_path}/out", "word_md5")
    jobs.pack_spans(spark, f"{tmp_path}/out", f"{tmp_path}/blocks", LENGTH)
    blocks = sorted(jobs.read_blocks(spark, f"{tmp_path}/blocks", LENGTH).collect(), key=lambda r: r.block_idx)
    assert [len(r.token_ids) for r in blocks] == [LENGTH] * 5
    ids = list(itertools.chain.from_iterable(r.token_ids for r in blocks))
    one = {f: list(itertools.chain.from_iterable(plain_ids(f"{f}{i} c") for i in range(20))) for f in "ab"}
    assert ids in (one["a"] + one["b"], one["b"] + one["a"])


def test_a_second_run_changes_nothing(spark, raw, tmp_path):
    folder, streams = raw

    def run():
        jobs.tokenize_files(spark, f"{folder}/*.jsonl", f"{tmp_path}/t", "word_md5")
        jobs.pack_spans(spark, f"{tmp_path}/t", f"{tmp_path}/b", LENGTH)
        jobs.chunk_blocks(spark, f"{tmp_path}/b", f"{tmp_path}/c", LENGTH, chunk_size=30)
        jobs.batch_chunks(spark, f"{tmp_path}/c", f"{tmp_path}/o", 2, 20, 2, 3)
        return [
            sorted(map(str, spark.read.parquet(f"{tmp_path}/{p}").collect())) for p in ("t/spans", "b", "c", "o/batches")
        ] + [sorted(map(str, spark.read.json(f"{tmp_path}/o/log").collect()))]

    assert run() == run()


def test_every_chunk_is_permuted(spark, tmp_path):
    rows = spark.range(2000).selectExpr(
        "array(int(id)) AS token_ids", "array(1) AS tgt_mask", "'text' AS data_type", "'s' AS subset_name", "id AS block_idx"
    )
    jobs.write_blocks(rows, f"{tmp_path}/b", 1, replace=True)
    jobs.chunk_blocks(spark, f"{tmp_path}/b", f"{tmp_path}/c", 1, chunk_size=500)
    chunks = jobs.read_chunks(spark, f"{tmp_path}/c", jobs.BLOCK_SCHEMA)
    place = {r.block_idx: (r.chunk_idx, r.chunk_position) for r in chunks.collect()}
    seed = jobs.F.lit(jobs.SEED + 1) + jobs.F.col("chunk_idx")
    sampled = jobs.sample_positions(chunks, list(jobs.BLOCK_KEYS), "chunk_position", None, seed=seed, groups=["chunk_idx"])
    stayed = [r.sample_position == place[r.block_idx][1] for r in sampled.collect() if r.chunk_idx == 0]
    assert len(stayed) == 400 and sum(stayed) < 20


def test_both_ways_to_pack_agree(spark, raw, tmp_path):
    """Starts counted along the scan, starts worked out from the keys, and parts too many to broadcast."""
    from packwright.operators import packing

    folder, streams = raw
    jobs.tokenize_files(spark, f"{folder}/*.jsonl", f"{tmp_path}/tokenized", "word_md5")
    spans = spark.read.schema(jobs.SPAN_SCHEMA).parquet(f"{tmp_path}/tokenized/spans").where("status = 'ok'")
    few = {key: () for key in jobs.FILE_ORDER}

    def collected(df):
        return {(r.data_type, r.subset_name, r.block_idx): (r.token_ids, r.tgt_mask) for r in df.collect()}

    want = blocks_of(streams)
    by_keys = packing.pack(spans, LENGTH, keys=jobs.FILE_ORDER, staged=False, shifts=few)
    by_parts = packing.pack_parts(spans, LENGTH, parts=jobs.PART)
    plan = by_parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 1
    assert collected(by_keys) == collected(by_parts) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert collected(packing.pack_parts(spans, LENGTH, parts=jobs.PART)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_same_files_elsewhere_give_the_same_blocks_in_path_order(spark, tmp_path):
    """A subset that is a folder of files: they follow each other by path, wherever the folder lies."""
    draw = random.Random(2)
    texts = {f"part-{i:02d}": [" ".join(f"w{draw.randrange(50)}" for _ in range(draw.randrange(9))) for _ in range(7)] for i in range(12)}
    found = []
    for place in ("here", "some where/else"):
        folder = tmp_path / place / "raw" / "textbooks.jsonl"
        folder.mkdir(parents=True)
        for name, lines in texts.items():
            (folder / name).write_text("".join(json.dumps({"markdown": t}) + "\n" for t in lines))
        raw, out = tmp_path / place / "raw", tmp_path / place / "out"
        jobs.tokenize_files(spark, f"{raw}/*", str(out), "word_md5", subset_from_end=2)
        jobs.pack_spans(spark, str(out), f"{out}/blocks", LENGTH, bounded=True)
        blocks = jobs.read_blocks(spark, f"{out}/blocks", LENGTH, example=jobs.EXAMPLE_KEYS)
        found.append([(r.token_ids, r.boundaries) for r in blocks.orderBy("block_idx").collect()])
    stream = [x for name in sorted(texts) for t in texts[name] for x in [*plain_ids(t), EOS]]
    assert [ids for ids, _ in found[0]] == [stream[i : i + LENGTH] for i in range(0, len(stream) - LENGTH + 1, LENGTH)]
    assert found[0] == found[1]
    begins = [b * LENGTH + e.start for b, (_, bounds) in enumerate(found[0]) for e in bounds]
    ends = [0, *itertools.accumulate(len(plain_ids(t)) + 1 for name in sorted(texts) for t in texts[name])]
    kept = len(stream) // LENGTH * LENGTH
    assert begins == sorted({*[x for x in ends if x < kept], *range(0, kept, LENGTH)})
