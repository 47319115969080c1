import random

from brute import contaminated, words
from packwright.llm import decontam

SCHEMA = "doc_id bigint, text string"


def check(spark, docs, items, params=decontam.Params()):
    df = spark.createDataFrame(list(enumerate(docs)), SCHEMA).repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string, window string, hash string") if items and len(items[0]) == 4 else spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(df, bench, params).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        n, hit, ids = contaminated(text, [r[:2] for r in items if r[0] is not None], params.window)
        assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == (n, hit, ids), i


def test_random_texts_against_all_windows(spark):
    draw = random.Random(9)
    letters = "aé bB c".split(" ")
    text = lambda n: " ".join(draw.choice(letters) for _ in range(n))
    items = [(i, text(draw.randrange(0, 14))) for i in range(25)]
    check(spark, [text(draw.randrange(60)) for _ in range(50)], items, decontam.Params(window=6, shingle=3))


def test_long_items_short_items_and_borders(spark):
    base = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(base)), (2, "Solo"), (10, "two words"), (3, None), (4, "--"), (None, " ".join(base)), (5, " ".join(base)), (6, "q q q q")]
    docs = [
        " ".join(base), " ".join(base[:10]), " ".join(base[:9]), "x " + ", ".join(base[20:]).upper(), "solo", "two-words two", None, "",
        "q q q q q q", "q q q", " ".join(base[5:25] + base[5:25]), "z " * 3000 + " ".join(base[3:14]) + " z" * 3000,
    ]
    check(spark, docs, [(*i, "c", "d") for i in items])


def test_an_item_without_id_hits_nothing(spark):
    words_of_it = " ".join(f"only{i}" for i in range(12))
    items = [(None, words_of_it), (1, " ".join(f"w{i}" for i in range(12)))]
    check(spark, [words_of_it, "w0 w1"], items)
    docs = spark.createDataFrame([(1, words_of_it)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert not decontam.report(decontam.decontaminate(docs, bench)).first().contaminated
    assert decontam.clean(docs, bench).count() == 1


def test_edges(spark, edge_docs, edge_rows, no_docs):
    bench = spark.createDataFrame([(1, "the quick brown fox jumped over the very lazy dog"), (1, "word")], "item_id bigint, text string")
    got = decontam.decontaminate(edge_docs, bench).collect()
    key = lambda i, n, h: (i is not None, i or 0, n, h)
    want = [key(i, *contaminated(t, [(1, "the quick brown fox jumped over the very lazy dog"), (1, "word")])[:2]) for i, t in edge_rows]
    assert sorted(key(r.doc_id, r.n_words, r.n_hit) for r in got) == sorted(want)
    clean = decontam.clean(edge_docs, bench)
    assert clean.columns == edge_docs.columns
    assert sorted((i or 0, t or "") for i, t in edge_rows if not contaminated(t, [(1, "the quick brown fox jumped over the very lazy dog"), (1, "word")])[1]) == sorted((r.doc_id or 0, r.text or "") for r in clean.collect())
    assert decontam.decontaminate(no_docs, bench).collect() == []
    empty = decontam.report(decontam.decontaminate(edge_docs, bench.limit(0))).collect()
    assert len(empty) == len(edge_rows) and not any(r.contaminated for r in empty)
    assert sorted(r.n_words for r in empty) == sorted(len(words(t)) for _, t in edge_rows)
