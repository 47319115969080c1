import random

from brute import deleted_lines
from packwright.llm import linedup

PARAMS = linedup.Params(least_chars=10)


def check(spark, texts, params=PARAMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in linedup.dedup_lines(docs, params).collect()}
    lines, gone = deleted_lines(texts, params.least_chars)
    for i in range(len(texts)):
        want = "\n".join(line for p, line in enumerate(lines[i]) if p not in gone[i])
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == (want, len(lines[i]), len(gone[i])), i


def test_random_lines_against_all_runs(spark):
    draw = random.Random(5)
    lines = ["", "a", "bb", "four", "five5", "ten chars.", "eleven char", "x" * 30]
    check(spark, ["\n".join(draw.choice(lines) for _ in range(draw.randrange(12))) for _ in range(60)])


def test_long_runs_of_short_lines_and_ties(spark):
    run = [f"l{i % 3}" for i in range(23)]
    texts = ["\n".join(run), "q\n" + "\n".join(run[2:]) + "\nz", "\n".join(run), "\n".join(run[:4]), "\n".join([""] * 40 + ["end of it all"]) , "\n".join([""] * 40 + ["end of it all"])]
    check(spark, texts)


def test_maximal_stretches(spark):
    docs = spark.createDataFrame([(1, "first line here\nsecond line here\nx"), (2, "y\nfirst line here\nsecond line here\nz")], "doc_id bigint, text string")
    assert [(r.doc_id, r.begin, r.stop) for r in linedup.later_copies(docs, PARAMS).collect()] == [(2, 1, 3)]


def test_overlapping_copies_are_cut_down_to_one_period(spark):
    check(spark, ["\n".join(["e" * 6] * 3), "\n".join(["abcdef", "ghijkl"] * 4)])
    docs = spark.createDataFrame([(1, "\n".join(["e" * 6] * 3)), (2, "\n".join(["abcdef", "ghijkl"] * 4))], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in linedup.dedup_lines(docs, PARAMS).collect()} == {1: "e" * 6, 2: "abcdef\nghijkl"}


def test_edges(spark, edge_docs, edge_rows):
    got = linedup.dedup_lines(edge_docs, linedup.Params(least_chars=60)).collect()
    assert len(got) == len(edge_rows) and set(got[0].asDict()) == set(edge_docs.columns)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in got))
    # The row without an id comes first and keeps the sentence; later documents lose it.
    some = edge_rows[0][1]
    want = [(i, "" if t == some and i is not None else t) for i, t in edge_rows]
    assert rows == sorted((i is not None, i or 0, t is not None, t or "") for i, t in want)
    assert all(r.a == "y" if "a" in r.asDict() else r["a.b"] == "y" for r in got)


def test_no_documents(no_docs):
    assert linedup.dedup_lines(no_docs).collect() == []


def test_runs_no_python(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    plan = linedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
