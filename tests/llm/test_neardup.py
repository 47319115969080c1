import random

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from brute import components
from packwright.llm import neardup
from packwright.llm.grams import bitmap


def near_copies(seed=1, groups=12, size=9):
    draw = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 8, 40, 120]))]
        for _ in range(draw.randrange(1, size)):
            copy = list(base)
            for _ in range(draw.randrange(0, max(1, len(base) // 18))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    return [*texts, "", None, "UP " + texts[0], texts[0].upper().replace(" ", "\t")]


@pytest.mark.parametrize("block_shingles, block_docs", [(400_000, 1_500), (60, 1_500), (400_000, 3)])
def test_against_all_pairs(spark, block_shingles, block_docs):
    texts = near_copies()
    roots, sizes = components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r for r in neardup.find_near_duplicates(docs, neardup.Params(block_shingles=block_shingles, block_docs=block_docs)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[i], roots[i], roots[i] == i)


def test_the_border_is_exact(spark):
    """75 of 100 shingles in common link, 74 do not."""
    base = [f"b{i}" for i in range(79)]
    exact = base + [f"x{i}" for i in range(25)]  # 75 shingles and 25 of its own
    short = base[1:] + [f"y{i}" for i in range(26)]  # 74 and 26
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(exact)), (3, " ".join(short))], "doc_id bigint, text string")
    members = docs.selectExpr("0L AS pair", "doc_id AS class", "false AS second", "cast(text AS binary) AS text")
    found = members.groupBy("pair").applyInArrow(neardup.compare_blocks(neardup.Params()), "a long, b long").collect()
    assert [tuple(r) for r in found] == [(2, 1)]


def test_min_and_max_agree_as_often_as_sets_are_alike():
    draw = np.random.default_rng(2)
    numbers = draw.integers(0, 1 << 63, 1250, dtype=np.uint64)
    a, b = np.sort(numbers[:1000]), np.sort(numbers[250:])
    params = neardup.Params(bands=500, rows=2)
    keys = neardup.band_keys([a, b], neardup.Params(bands=1000, rows=2))
    both = (keys[0] == keys[1]).mean()  # the least and the greatest of one permutation
    assert abs(both - 0.6**2) < 0.06 and params.bands == 500


def test_a_band_misses_almost_nothing():
    draw = np.random.default_rng(4)
    for _ in range(200):
        numbers = draw.integers(0, 1 << 63, 125, dtype=np.uint64)
        keys = neardup.band_keys([np.sort(numbers[:110]), np.sort(numbers[15:])], neardup.Params())
        assert (keys[0] == keys[1]).any()


def test_small_sets_are_missed_no_more_than_stated():
    """Of 200,000 pairs of 4 against 3 shingles, 32 bands of 4 miss about 20."""
    draw = np.random.default_rng(6)
    missed = 0
    for _ in range(20):
        numbers = draw.integers(0, 1 << 63, (10_000, 4), dtype=np.uint64)
        keys = neardup.band_keys([s for n in numbers for s in (n, n[:3])], neardup.Params())
        missed += int((keys[0::2] != keys[1::2]).all(axis=1).sum())
    assert missed == 0


def test_the_driver_gets_no_row_per_candidate(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FILTER_BITS", 1 << 12)
    got = []
    for name in ("collect", "toArrow"):
        plain = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, f=plain: (rows := f(self, *a), got.append(len(rows)))[0])
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id) AS text")
    sets = neardup.shingle_sets([f"word{i}".encode() for i in range(3000)], 5)
    rows = [(int(c), i) for i, c in enumerate(neardup.signed(np.array([neardup.class_of(s) for s in sets], dtype=np.uint64)))]
    wanted = spark.createDataFrame(rows, "class bigint, rep bigint")
    texts = neardup.candidate_texts(docs, wanted, neardup.Params())
    assert max(got) <= (1 << 12) // 64
    assert texts.count() == 3000


def test_bitmap_has_the_places_and_no_others(spark):
    places = spark.createDataFrame([(p,) for p in (0, 5, 63, 64, 4095, 4095)], "place bigint")
    assert np.flatnonzero(np.unpackbits(bitmap(places, 4096), bitorder="little")).tolist() == [0, 5, 63, 64, 4095]


def test_members_near_their_hub_are_not_compared_among_themselves(spark):
    """Each of 60 copies differs from the hub in one word of its own; three more only link with a copy."""
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(base)] + [" ".join([*base[:-1], f"x{i}"]) for i in range(60)]
    texts += [" ".join([*base[16 + i :], f"y{i}", "z"]) for i in range(3)]
    classes = [int(neardup.signed(np.array([neardup.class_of(s)], dtype=np.uint64))[0]) for s in neardup.shingle_sets([t.encode() for t in texts], 5)]
    members = spark.createDataFrame([(classes[0], c, 56) for c in classes], "hub bigint, class bigint, n_shingles bigint")
    params = neardup.Params(block_docs=5)
    assert neardup.with_hub(members, params).count() == 63 + 13
    near = spark.createDataFrame([(classes[0], c) for c in classes[1:61]], "hub bigint, class bigint")
    # One block of the rest: it meets itself and 12 blocks, and each near member meets it once.
    assert neardup.without_hub(members, near, params).count() == 60 + 3 * 13
    everyone = spark.createDataFrame([(classes[0], c) for c in classes[1:]], "hub bigint, class bigint")
    assert neardup.without_hub(members, everyone, params).count() == 0
    found = neardup.links(members, spark.createDataFrame(list(zip(classes, [t.encode() for t in texts])), "class bigint, text binary"), params)
    roots = {r.node: r.root for r in neardup.components(found).collect()}
    want, _ = components(texts)
    group = lambda of: [[j for j in range(len(texts)) if of(j) == of(i)] for i in range(len(texts))]
    assert group(lambda i: roots.get(classes[i], classes[i])) == group(lambda i: want[i])


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100 + i, 900) for i in range(60)]
    edges = spark.createDataFrame(chain + star, "a bigint, b bigint")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in [*range(100, 160), 900]} == {100}


def test_edges(edge_docs, edge_rows):
    got = neardup.find_near_duplicates(edge_docs).collect()
    assert len(got) == len(edge_rows)
    some = edge_rows[0][1]
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles > 10 and r.n_shingles < 100} == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles == 0} == {(i, i, True) for i, t in edge_rows if not (t or "").strip()}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (9, 10)} == {(9, 9), (10, 9)}
    stay = neardup.one_of_each(edge_docs)
    assert stay.columns == edge_docs.columns
    kept = [(r.doc_id, r.text) for r in stay.collect()]
    assert kept.count((1, some)) == 1 and not any(i in (2, 3, 10) for i, _ in kept)
    assert sorted(i for i, _ in kept if i in (8, 9)) == [8, 8, 9]


def test_no_documents(no_docs):
    assert neardup.find_near_duplicates(no_docs).collect() == []
    assert neardup.one_of_each(no_docs).collect() == []
