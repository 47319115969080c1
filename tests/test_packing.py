import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from packwright.operators.offsets import running_offsets
from packwright.operators.packing import example_positions, examples_in_blocks, pack, packing_report, unpack

SCHEMA = "data_type string, subset_name string, doc_id bigint, token_ids array<int>, tgt_mask array<int>"
QUIET = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def blocks_of(examples, length):
    """{(subset, block): (ids, mask)} by joining everything and cutting it up."""
    found = {}
    for subset in {s for s, *_ in examples}:
        mine = sorted(e for e in examples if e[0] == subset)
        ids = list(itertools.chain.from_iterable(e[2] for e in mine))
        mask = list(itertools.chain.from_iterable(e[3] for e in mine))
        for b in range(len(ids) // length):
            cut = slice(b * length, (b + 1) * length)
            found[subset, b] = (ids[cut], mask[cut])
    return found


def frame(spark, examples):
    return spark.createDataFrame([("text", s, d, i, m) for s, d, i, m in examples], SCHEMA)


def collected(df):
    return {(r.subset_name, r.block_idx): (r.token_ids, r.tgt_mask) for r in df.collect()}


def example(draw, subset, doc, n):
    return (subset, doc, [draw.randrange(1000) for _ in range(n)], [draw.randrange(2) for _ in range(n)])


def test_edges(spark):
    draw = random.Random(1)
    sizes = {
        "short": [3, 4],  # shorter than a block
        "exact": [5, 11],  # two whole blocks
        "long": [25],  # one example over three blocks and one token
        "empty": [0, 8, 0, 1],
        "hot": [draw.randrange(30) for _ in range(200)],
    }
    examples = [example(draw, s, d * 5, n) for s, ns in sizes.items() for d, n in enumerate(ns)]
    want = blocks_of(examples, 8)
    assert not any(s == "short" for s, _ in want)
    assert sum(s == "exact" for s, _ in want) == 2
    assert sum(s == "long" for s, _ in want) == 3
    for parts, staged in ((1, True), (7, False)):
        assert collected(pack(frame(spark, examples).repartition(parts), 8, staged=staged)) == want


@QUIET
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), min_size=1, max_size=25), st.integers(1, 12))
def test_blocks_are_a_prefix_of_the_stream(spark, sizes, length):
    draw = random.Random(3)
    examples = [example(draw, s, d, n) for d, (s, n) in enumerate(sizes)]
    assert collected(pack(frame(spark, examples), length, staged=False)) == blocks_of(examples, length)


def test_flag_and_mask_give_the_same_blocks(spark):
    draw = random.Random(5)
    rows = [(s, d, [draw.randrange(99) for _ in range(d % 7)], d % 2) for d, s in enumerate("aab" * 30)]
    flagged = spark.createDataFrame(
        [("chat", s, d, i, f) for s, d, i, f in rows],
        "data_type string, subset_name string, doc_id bigint, token_ids array<int>, is_target int",
    )
    masked = [(s, d, i, [f] * len(i)) for s, d, i, f in rows]
    assert collected(pack(flagged, 10)) == blocks_of(masked, 10)


def test_other_shuffle_partitions_give_the_same(spark):
    draw = random.Random(9)
    examples = [example(draw, draw.choice("ab"), d, draw.randrange(20)) for d in range(100)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert collected(pack(frame(spark, examples), 16)) == blocks_of(examples, 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_report(spark):
    draw = random.Random(2)
    df = frame(spark, [example(draw, "a", 1, 9), example(draw, "a", 2, 8), example(draw, "b", 3, 2)])
    got = {r.subset_name: (r.n_examples, r.n_tokens, r.n_blocks, r.kept_tokens, r.dropped_tokens)
           for r in packing_report(df, 8).collect()}
    assert got == {"a": (2, 17, 2, 16, 1), "b": (1, 2, 0, 0, 2)}


@pytest.mark.parametrize("name", ["piece_bpe_32k", "byte_bpe_50k"])
def test_subword_blocks_of_whole_documents(spark, sf_small, name):
    """Blocks of the real tokenizers against tokenizing and cutting in plain Python."""
    import pyarrow.parquet as pq

    from packwright.functions.tokenizers import EOS_IDS
    from packwright.plans.inputs import document_spans
    from test_tokenizers import plain_encoder

    encode = plain_encoder(name)
    docs = pq.read_table(f"{sf_small}/documents.parquet").to_pylist()
    examples = []
    for d in docs:
        ids = encode(d["text"]) + [EOS_IDS[name]]
        examples.append((d["lang"], d["doc_id"], ids, [1] * len(ids)))
    assert collected(pack(document_spans(spark, sf_small, name), 512)) == blocks_of(examples, 512)


def test_boundaries_tell_whose_tokens_a_block_holds(spark):
    """Turns of one conversation are one interval, also where it goes on in the next block."""
    draw = random.Random(4)
    rows, stream = [], {"a": [], "b": []}
    for conv in range(40):
        for turn in range(draw.randrange(1, 4)):
            subset, n = "ab"[conv % 2], draw.choice([0, 1, 3, 7, 25])
            ids = [draw.randrange(99) for _ in range(n)]
            rows.append(("chat", subset, conv, turn, ids, turn % 2))
            stream[subset] += [(conv, turn, x) for x in ids]
    df = spark.createDataFrame(rows, "data_type string, subset_name string, conv bigint, turn int, token_ids array<int>, is_target int")
    for keys in (["conv"], ["conv", "turn"]):
        blocks = pack(df, 10, keys=("conv", "turn"), example=keys)
        got = {(r.subset_name, r.block_idx): r for r in blocks.withColumn("positions", example_positions(F.col("boundaries"))).collect()}
        assert set(got) == {(s, i) for s in stream for i in range(len(stream[s]) // 10)}
        for (subset, i), r in got.items():
            part = stream[subset][10 * i : 10 * i + 10]
            want, positions = [], []
            for at, token in enumerate(part):
                key = token[: len(keys)]
                if not want or want[-1][2:] != key:
                    want.append((at, 0, *key))
                want[-1] = (want[-1][0], want[-1][1] + 1, *key)
                positions.append(want[-1][1] - 1)
            assert [tuple(b) for b in r.boundaries] == want and r.positions == positions
        cut = examples_in_blocks(blocks).collect()
        assert sum(len(r.token_ids) for r in cut) == 10 * len(got)
        for r in cut:
            whole = got[r.subset_name, r.block_idx]
            assert r.token_ids == whole.token_ids[r.start : r.start + r.length] and len(r.tgt_mask) == r.length


def test_blocks_without_examples_have_no_boundaries(spark):
    draw = random.Random(6)
    df = frame(spark, [example(draw, "a", d, 9) for d in range(10)])
    assert "boundaries" not in pack(df, 8).columns


def test_unpacking_moves_each_block_once(spark):
    """The join that meets blocks has one row per block, not one per example in it."""
    draw = random.Random(7)
    examples = [example(draw, draw.choice("ab"), d, draw.randrange(6)) for d in range(200)]
    tokens = frame(spark, examples).withColumn("n", F.size("token_ids").cast("bigint"))
    offsets = running_offsets(tokens.where("n > 0").select("data_type", "subset_name", "doc_id", "n"), ["data_type", "subset_name"], ["doc_id"], "n")
    blocks = pack(tokens, 16, staged=False, offsets=offsets)
    back = unpack(blocks, tokens, offsets, ["doc_id"], 16)
    assert {r.doc_id: list(r.token_ids) for r in back.collect()} == {d: list(ids) for _, d, ids, _ in examples if len(ids)}
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(cuts") == 1
