import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brute import blank_words
from packwright.llm import simhash


def plain_fingerprint(text, k=4):
    words = blank_words(text)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(fps, most=4):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= most:
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return [find(i) for i in range(len(fps))]


def near_texts():
    draw = random.Random(3)
    base = [f"w{draw.randrange(400)}" for _ in range(300)]
    texts = []
    for group in range(12):
        words = [f"{w}g{group}" for w in base]
        for copy in range(6):
            changed = list(words)
            for _ in range(copy):
                changed[draw.randrange(len(changed))] = f"x{draw.randrange(10 ** 6)}"
            texts.append(" ".join(changed))
    return texts + texts[:5] + ["a b c", "A\tb\vc ", "one", "", " \n ", None, "a b c d", "a b c d e", "été É   x y z"]


def check(spark, texts, params=simhash.Params()):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in simhash.report(simhash.find_near_duplicates(docs, params)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(fps, params.most)


def test_texts_against_all_pairs(spark):
    check(spark, near_texts())


def test_spark_has_the_same_hash(spark):
    text = "the quick brown fox"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == np.array(simhash.shingle_hashes(text.encode(), simhash.Params()), dtype=np.uint64).view(np.int64)[0]


def linked(spark, fps, params):
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    docs = spark.createDataFrame([(x, 1 + i % 3) for i, x in enumerate(signed)], "fp bigint, n_docs bigint")
    rows = simhash.links(docs, params).collect()
    label = {x: x for x in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in rows:
        a, b = find(r.a), find(r.b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in signed], rows


@pytest.mark.parametrize("most, variant_rows", [(4, 1024), (4, 8), (3, 8), (2, 8), (6, 50)])
def test_links_connect_what_all_pairs_connect(spark, most, variant_rows):
    """Balls around centres, chains of single bits, borders of segments, and large variants in blocks."""
    draw = random.Random(most)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 8))))
    walk = draw.getrandbits(64)
    for step in range(40):
        walk ^= sum(1 << b for b in draw.sample(range(64), most))
        fps.add(walk)
    fps = sorted(fps)
    got, rows = linked(spark, fps, simhash.Params(most=most, variant_rows=variant_rows))
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(got) == groups(plain_components(fps, most))


def test_one_ball_gives_a_star_and_not_its_pairs(spark):
    """Every two of these link: nearly a million pairs, but links in proportion to the rows."""
    fps = [sum(1 << b for b in bits) for n in (0, 1, 2) for bits in itertools.combinations(range(48), n)]
    for variant_rows in (4096, 300, 64):
        got, rows = linked(spark, fps, simhash.Params(variant_rows=variant_rows))
        assert len(set(got)) == 1 and len(rows) < 70 * len(fps) < len(fps) ** 2 / 2


def test_every_pair_that_may_link_meets_in_a_variant(spark):
    params = simhash.Params()
    assert [n for _, n in params.segments] == [21, 21, 22] and sum(n for _, n in params.segments) == 64
    draw = random.Random(1)
    pairs = [(x, x ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5)))) for x in (draw.getrandbits(64) for _ in range(300))]
    flat = np.array([x for p in pairs for x in p], dtype=np.uint64).view(np.int64).tolist()
    rows = simhash.variants(spark.createDataFrame([(x, 1) for x in flat], "fp bigint, n_docs bigint"), params).collect()
    held = {}
    for r in rows:
        held.setdefault(r.fp, set()).add(r.variant)
    assert all(len(v) == 67 for v in held.values())
    assert all(held[a] & held[b] for a, b in zip(flat[::2], flat[1::2]))


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = simhash.report(simhash.find_near_duplicates(edge_docs)).collect()
    fps = [plain_fingerprint(t) for _, t in edge_rows]
    label = plain_components(fps)
    least = {x: min((i for (i, _), y in zip(edge_rows, label) if y == x and i is not None), default=None) for x in label}
    key = lambda i, f, c: (i is not None, i or 0, f, c is not None, c or 0)
    want = sorted(key(i, f"{f:016x}", least[x]) for (i, _), f, x in zip(edge_rows, fps, label))
    assert sorted(key(r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.find_near_duplicates(no_docs).collect() == []
    nameless = spark.createDataFrame([(None, "a b")] * 2, "doc_id bigint, text string")
    assert [r.component_id for r in simhash.find_near_duplicates(nameless).collect()] == [None, None]
