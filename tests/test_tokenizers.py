import pytest
from pyspark.sql import functions as F

from packwright.functions import vocabularies
from packwright.functions.text import _word_ids_udf, affix, word_ids
from packwright.functions.tokenizers import TEXTS_PER_CALL, _lists, forget_tokenizer, register_tokenizer, tokenizer
from packwright.plans import jobs, tokens
from packwright.plans.tokens import bpe_token_counts


def plain_encoder(name, window=8192):
    import base64

    import public_tokenizers

    if name == "piece_bpe_32k":
        import sentencepiece

        whole = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path("piece_bpe_32k.model")
        ).encode
    else:
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines)}
        whole = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def encode(text):
        words = text.split(" ")
        windows = [" ".join(words[i : i + window]) for i in range(0, len(words), window)]
        return [token for part in windows for token in whole(part)]

    return encode


TEXTS = [
    "",
    " ",
    "one",
    "two  spaces and a tail ",
    "a b c d e f g h i j k l m n",
    "</s> <s> <|endoftext|> stay text",
    "Zeilen\nund\tTabs, ünïcödé 漢字 🙂",
    "x" * 5000,
]


@pytest.mark.parametrize("name", ["piece_bpe_32k", "byte_bpe_50k"])
@pytest.mark.parametrize("window", [1, 4, 8192])
def test_windows_are_tokenized_apart(spark, name, window):
    tok = tokenizer(spark, name, window)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, text string")
    got = {r.i: r.ids for r in rows.select("i", tok.encode(F.col("text")).alias("ids")).collect()}
    encode = plain_encoder(name, window)
    assert got == {**{i: encode(t) for i, t in enumerate(TEXTS)}, len(TEXTS): None}


@pytest.mark.parametrize("name", ["piece_bpe_32k", "byte_bpe_50k"])
def test_decode_gives_the_text_back(spark, name):
    tok = tokenizer(spark, name)
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    back = rows.select("text", tok.decode(tok.encode(F.col("text"))).alias("back")).collect()
    assert all(r.text == r.back for r in back)


def test_word_ids(spark):
    from hashlib import md5

    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in rows.select("text", word_ids(F.col("text")).alias("ids")).collect():
        want = [int(md5(w.encode()).hexdigest()[:7], 16) for w in r.text.split(" ")] if r.text else []
        assert r.ids == want


def test_words_are_cut_as_columns_however_many_at_a_time(spark):
    from hashlib import md5

    import pyarrow as pa

    texts = [None, "", "a", " ", "  ", "", "a  b", "é ß\n\tx", None, *("x yy  z " * (i % 9) for i in range(200)), ""]
    want = [None if t is None else [int(md5(w.encode()).hexdigest()[:7], 16) for w in t.split(" ")] if t else [] for t in texts]
    for held in (1, 40, 1 << 20):
        parts = list(_word_ids_udf(held).func(iter([pa.array(texts), pa.array([], pa.string()), pa.array([None], pa.string())])))
        assert pa.concat_arrays(parts).to_pylist() == [*want, None]
        assert held < 1 << 20 or len(parts) == 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", word_ids(F.col("t")).alias("ids"))
    assert [r.ids for r in rows.orderBy("k").collect()] == want
    # No UTF-8: as the engine reads it.
    odd = spark.sql("SELECT cast(X'6120FFFE61' AS string) AS t")
    assert odd.select(word_ids(F.col("t"))).first()[0] == [int(md5(w.encode()).hexdigest()[:7], 16) for w in ("a", "\ufffd\ufffda")]


def test_affixes(spark):
    one = spark.createDataFrame([([5, 6],)], "ids array<int>")
    ids, pre, suf = F.col("ids"), F.array(F.lit(1)), F.array(F.lit(2))
    got = one.select(affix(ids), affix(ids, prefix=pre), affix(ids, suffix=suf), affix(ids, pre, suf)).first()
    assert list(got) == [[5, 6], [1, 5, 6], [5, 6, 2], [1, 5, 6, 2]]


def test_unknown_tokenizer(spark):
    with pytest.raises(ValueError):
        tokenizer(spark, "no such vocabulary")


def test_token_counts_per_language(spark, sf_small):
    encode = plain_encoder("piece_bpe_32k")
    want = {}
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("lang", "text").collect():
        n_examples, n_tokens = want.get(r.lang, (0, 0))
        want[r.lang] = n_examples + 1, n_tokens + len(encode(r.text)) + 1  # and the end mark
    got = bpe_token_counts(spark, sf_small).collect()
    assert {r.subset_name: (r.n_examples, r.n_tokens, r.n_target_tokens) for r in got} == {k: (a, b, b) for k, (a, b) in want.items()}


def made_ranks(texts):
    """A small vocabulary: all bytes, then merges of pairs in the given texts, longest words first."""
    ranks = {bytes([b]): b for b in range(256)}
    for text in texts:
        for word in text.split():
            token = word.encode()
            for n in range(2, len(token) + 1):
                ranks.setdefault(token[:n], len(ranks))
    return ranks


def plain_merges(ranks, pattern):
    """Merge the pair of lowest rank until there is none, word by word."""
    import regex

    def encode(text):
        ids = []
        for word in regex.findall(pattern, text):
            parts = [bytes([b]) for b in word.encode()]
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ids += [ranks[p] for p in parts]
        return ids

    return encode


def write_vocabulary(path, ranks):
    import base64

    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    return str(path)


SAID = ["low lower lowest", "", "newer  newest été", "x" * 50, "low\nlow", "<|endoftext|> a b c d e f g"]


@pytest.fixture
def own(spark, tmp_path):
    ranks = made_ranks(SAID)
    register_tokenizer(spark, "own_words", write_vocabulary(tmp_path / "own.ranks", ranks), eos_id=len(ranks), window=4)
    yield ranks
    forget_tokenizer(spark, "own_words")


def in_windows(encode, text, window):
    words = text.split(" ")
    return [t for i in range(0, len(words), window) for t in encode(" ".join(words[i : i + window]))]


def test_own_vocabulary_in_sql_and_by_name(spark, own):
    encode = plain_merges(own, vocabularies.WORD_PATTERN)
    want = [in_windows(encode, t, 4) for t in SAID]
    spark.createDataFrame([*enumerate(SAID), (99, None)], "k int, text string").createOrReplaceTempView("said")
    rows = spark.sql(
        "SELECT k, own_words_encode(text) AS ids, own_words_count(text) AS n, own_words_decode(own_words_encode(text)) AS back FROM said ORDER BY k"
    ).collect()
    assert [list(r.ids) for r in rows[:-1]] == want and [r.n for r in rows[:-1]] == [len(w) for w in want]
    assert rows[-1].ids is None and rows[-1].n is None and rows[-1].back is None
    assert [r.back for r in rows[:-1] if r.k != 5] == SAID[:5] and rows[5].back == "<|endoftext|> a b cd e f g"
    tok = tokenizer(spark, "own_words")
    assert tok.eos_id == len(own)
    by_name = spark.table("said").where("k < 99").orderBy("k").select(tok.encode(F.col("text")).alias("ids"))
    assert [list(r.ids) for r in by_name.collect()] == want
    assert spark.sql("SELECT sum(own_words_count(text)) FROM said WHERE own_words_count(text) > 0").first()[0] == sum(map(len, want))


def test_own_vocabulary_in_the_jobs(spark, own, tmp_path):
    import json

    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "textbooks.jsonl").write_text("".join(json.dumps({"markdown": t}) + "\n" for t in SAID))
    turns = [{"from": "human", "value": SAID[0]}, {"from": "gpt", "value": SAID[2]}]
    (raw / "talk.jsonl").write_text(json.dumps({"conversations": turns}) + "\n")
    jobs.tokenize_files(spark, f"{raw}/*", str(tmp_path / "out"), "own_words")
    spans = spark.read.schema(jobs.SPAN_SCHEMA).parquet(str(tmp_path / "out" / "spans")).orderBy("file_id", "row_in_part", "turn").collect()
    encode, end = plain_merges(own, vocabularies.WORD_PATTERN), [len(own)]
    texts = [list(r.token_ids) for r in spans if r.data_type == "text"]
    assert texts == [in_windows(encode, t, 4) + end for t in SAID]
    chat = [list(r.token_ids) for r in spans if r.data_type == "chat"]
    assert chat == [in_windows(encode, SAID[0], 4), in_windows(encode, SAID[2], 4) + end]


def test_files_of_all_formats(spark, tmp_path):
    import public_tokenizers

    texts = ["The quick brown fox. <s> <|endoftext|>", "été  日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for file, end in (("piece_bpe_32k.model", 2), ("byte_bpe_50k.tiktoken", 50256), ("byte_bpe_50k.json", 50256)):
        tok = register_tokenizer(spark, "from_file", public_tokenizers.path(file), end)
        ids = [list(r[0]) for r in rows.select(tok.encode(F.col("text"))).collect()]
        built_in = tokenizer(spark, "piece_bpe_32k" if end == 2 else "byte_bpe_50k")
        assert ids == [list(r[0]) for r in rows.select(built_in.encode(F.col("text"))).collect()]
        assert [r[0] for r in rows.select(tok.decode(tok.encode(F.col("text")))).collect()] == texts
    forget_tokenizer(spark, "from_file")
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tokenizer(spark, "from_file")
    with pytest.raises(Exception, match="from_file_encode"):
        spark.sql("SELECT from_file_encode('a')").collect()


def test_files_and_names_that_are_refused(spark, tmp_path):
    good = {bytes([b]): b for b in range(256)}
    refused = [
        ("no vocabulary", b"hello there\nmore\n"),
        ("lacks 1 of the 256 bytes, first 0x41", "".join(f"{__import__('base64').b64encode(t).decode()} {r}\n" for t, r in good.items() if r != 65).encode()),
        ("two tokens", "".join(f"{__import__('base64').b64encode(t).decode()} {r // 2}\n" for t, r in good.items()).encode()),
    ]
    for i, (message, content) in enumerate(refused):
        (tmp_path / f"bad{i}").write_bytes(content)
        with pytest.raises(ValueError, match=message):
            register_tokenizer(spark, "refused", str(tmp_path / f"bad{i}"), 1)
    path = write_vocabulary(tmp_path / "good", good)
    for name in ("word_md5", "1st", "a b", "x; DROP"):
        with pytest.raises(ValueError):
            register_tokenizer(spark, name, path, 1)
    with pytest.raises(ValueError, match="end id"):
        register_tokenizer(spark, "refused", path, -1)
    assert vocabularies.registered(spark, "refused") is None


def test_registrations_belong_to_their_session(spark, own, tmp_path):
    other = spark.newSession()
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tokenizer(other, "own_words")
    ranks = {bytes([b]): 255 - b for b in range(256)}
    register_tokenizer(other, "own_words", write_vocabulary(tmp_path / "bytes", ranks), 300)
    assert list(other.sql("SELECT own_words_encode('ab')").first()[0]) == [255 - 97, 255 - 98]
    assert list(spark.sql("SELECT own_words_encode('low')").first()[0]) == [own[b"low"]]


@pytest.mark.parametrize("name", ["piece_bpe_32k", "byte_bpe_50k"])
def test_results_go_back_part_by_part(spark, name):
    """A worker holds the ids of a few texts, not those of a batch of the engine."""
    import pyarrow as pa

    tok = tokenizer(spark, name, window=50)
    texts = [None, "", *(f"{i} words, " * (i % 40) for i in range(1000)), "a long one " * 3000]
    parts = list(tok.encode.func(iter([pa.array(texts)])))
    assert max(map(len, parts)) <= TEXTS_PER_CALL
    ids = pa.concat_arrays(parts)
    assert ids.to_pylist() == [r.ids for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", tok.encode("t").alias("ids")).orderBy("k").collect()]
    back = list(tok.decode.func(iter([ids])))
    assert max(map(len, back)) <= TEXTS_PER_CALL
    short = [i for i, t in enumerate(texts) if t is not None and t.count(" ") < 50]
    assert [pa.concat_arrays(back)[i].as_py() for i in short] == [texts[i] for i in short]
    assert [len(p) for p in tok.encode.func(iter([pa.array([], pa.string())]))] == [0]


def test_a_round_trip_encodes_once(spark, sf_small):
    plan = tokens.bpe_roundtrip(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert sum(line.count("encode_batches(") for line in steps) == 1


def test_ids_are_handed_to_the_decoder_without_a_step_for_each():
    import pyarrow as pa

    ids = pa.array([[7], None, [], [1, 2, 3], [4], [5, 6]], pa.list_(pa.int32()))
    for part in (ids, ids.slice(1, 4), ids.slice(3), ids.slice(0, 0)):
        assert _lists(part) == part.to_pylist()
    assert _lists(pa.array([[1, None], [2]], pa.list_(pa.int32()))) == [[1, None], [2]]
