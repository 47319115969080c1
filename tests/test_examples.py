import pytest
from pyspark.sql import functions as F

from packwright.functions.tokenizers import tokenizer
from packwright.operators.checks import check_rules, same_length, targets_end_at
from packwright.operators.examples import (
    chat_examples,
    chat_spans,
    example_from_json,
    example_to_json,
    flag_turns,
    split_turns,
    text_spans,
    with_mask,
)

TURNS = [
    (1, 0, "system", "be kind"),
    (1, 1, "human", "hello there"),
    (1, 2, "gpt", "hi"),
    (1, 3, "user", "more"),
    (1, 4, "assistant", ""),
    (2, 0, "human", "no reply"),
    (3, 0, "robot", "who"),
]


@pytest.fixture()
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")


def examples(spark, turns):
    tok = tokenizer(spark, "piece_bpe_32k")
    spans = chat_spans(split_turns(turns)[0], tok, ["conv_id", "turn"])
    rows = chat_examples(spans, []).orderBy("conv_id").collect()
    found = {}
    for r in rows:
        ids, mask = found.setdefault(r.conv_id, ([], []))
        ids.extend(r.token_ids)
        mask.extend(r.tgt_mask)
    return found


def test_end_mark_and_mask(spark, turns):
    from test_tokenizers import plain_encoder

    encode = plain_encoder("piece_bpe_32k")
    got = examples(spark, turns)
    user = encode("be kind") + encode("hello there")
    reply, more = encode("hi") + [2], encode("more")
    assert got[1][0] == user + reply + more + [2]
    assert got[1][1] == [0] * len(user) + [1] * len(reply) + [0] * len(more) + [1]
    assert got[2][1] == [0] * len(encode("no reply")) and 2 not in got[2][0]
    assert 3 not in got


def test_a_long_conversation_is_one_example(spark):
    turns = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "'gpt' AS role", "concat('w', id) AS text")
    tok = tokenizer(spark, "word_md5")
    row = chat_examples(chat_spans(split_turns(turns)[0], tok, ["conv_id", "turn"]), []).collect()
    assert [len(r.token_ids) for r in row] == [10000] and sum(row[0].tgt_mask) == 10000


def test_unknown_speaker(spark, turns):
    known, aside = split_turns(turns)
    assert (known.count(), aside.count()) == (6, 1)
    with pytest.raises(Exception, match="unknown speaker robot"):
        flag_turns(turns, "fail").collect()
    with pytest.raises(ValueError):
        flag_turns(turns, "other")


def test_empty_text_is_the_end_mark_alone(spark):
    docs = spark.createDataFrame([(1, "")], "doc_id bigint, text string")
    row = with_mask(text_spans(docs, tokenizer(spark), ["doc_id"])).first()
    assert (row.token_ids, row.tgt_mask) == ([2], [1])


def test_json_line(spark):
    df = spark.createDataFrame([([1, 2], [0, 1])], "token_ids array<int>, tgt_mask array<int>")
    line = df.select(example_to_json(F.col("token_ids"), F.col("tgt_mask")).alias("line"))
    assert line.first().line == '{"token_ids":[1,2],"tgt_mask":[0,1]}'
    back = line.select(example_from_json(F.col("line")).alias("e")).first().e
    assert (back.token_ids, back.tgt_mask) == ([1, 2], [0, 1])


def test_rules(spark):
    df = spark.createDataFrame([([1], [1], "chat"), ([1], [], "video"), ([1], None, None)],
                               "a array<int>, b array<int>, kind string")
    rules = {"length": same_length(F.col("a"), F.col("b")), "kind": F.col("kind").isin("chat", "text")}
    got = {r.rule: (r.n_checked, r.n_violations) for r in check_rules(df, rules).collect()}
    assert got == {"length": (3, 2), "kind": (3, 2)}
    assert all(r.n_violations == 0 for r in check_rules(df.limit(1), rules, fail=True).collect())
    with pytest.raises(Exception, match="rule broken"):
        check_rules(df, rules, fail=True).collect()


def test_a_mask_beside_its_ids_is_found(spark):
    ids, mask = [5, 6, 9, 7, 8, 9, 4], [0, 1, 1, 0, 1, 1, 0]
    rows = [(1, ids, mask), (2, ids, mask[1:] + [0]), (3, ids, [0] + mask[:-1]), (4, [5], [1]), (5, [], []), (6, [5, 6], [0, 1]), (7, None, None)]
    df = spark.createDataFrame(rows, "id int, token_ids array<int>, tgt_mask array<int>")
    ok = targets_end_at(df["token_ids"], df["tgt_mask"], 9)
    assert {r.id: r.ok for r in df.select("id", ok.alias("ok")).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: None}
    assert check_rules(df, {"marked": ok}).collect()[0].n_violations == 3
