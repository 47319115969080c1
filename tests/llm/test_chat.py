import hashlib

from pyspark.sql import functions as F

from packwright.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, segments string"
ODD = ["", "plain", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s> [\\INST]", "<s", "[/INST", "<<s>>", "a\n\\", "[[INST]]", "\U0001f600 <s>"]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "f", "s") for r in rows], SCHEMA)


def test_everything_comes_back(spark):
    rows = [(c, t, r, x) for c, x in enumerate(ODD) for t, r in enumerate(["user", "assistant", "<s>[INST]"])]
    rows += [(99, 0, None, None), (99, 0, None, None), (99, None, "assistant", "z"), (None, 1, "assistant", "n"), (None, 0, "user", None)]
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(rows_of(spark, rows))).collect()}
    conversations = {}
    for c, t, r, x in rows:
        conversations.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(conversations)
    for c, turns in conversations.items():
        turns.sort()
        spelled = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        row = got[c]
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(spelled.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "calm"), (1, 1, "assistant", "a </s> b"), (2, 0, "user", "calm")]
    got = {r.conv_id: r for r in chat.format_chats(rows_of(spark, rows)).collect()}
    assert got[1].formatted == "<s>[INST]user[/INST]calm</s><s>[INST]assistant[/INST]a <\\/s> b</s>"
    assert (got[1].escaped_turns, got[2].escaped_turns) == (1, 0)
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert [s.text for s in got[1].segments if s.loss] == ["a <\\/s> b"]


def test_the_parser_refuses_what_breaks_the_grammar(spark):
    texts = ["<s>[INST]u[/INST]a<s>b</s>", "<s>[INST]u[/INST]a", "<s>[INST]ua</s>", "<s>[INST]u[/INST]a</s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(chat.parse(F.col("t"), chat.Template()).alias("p")).collect()]
    assert [[t and t.text for t in p] for p in got] == [[None], [None], [None], ["a"]]


def test_no_conversations(spark):
    assert chat.read_chats(chat.format_chats(rows_of(spark, []))).collect() == []


def test_runs_no_python(spark, sf_small):
    turns = spark.read.parquet(f"{sf_small}/conversations.parquet")
    plan = chat.read_chats(chat.format_chats(turns))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
