import numpy as np
import pyarrow as pa
import pytest

from packwright.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, codes string, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "v") for i, v in rows], SCHEMA)


def exact(ids, x, k=20):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    found = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        found[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return found


def searched(df, **options):
    found = {}
    for r in sorted(ann.nearest(df, params=ann.Params(**options)).collect()):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def test_recall_and_scores(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(3000, 32)) * draw.uniform(0.2, 3, size=(3000, 1))  # lengths differ
    ids = np.arange(3000)
    want, got = exact(ids, x), searched(vectors(spark, zip(range(3000), x)), block_rows=900, block_queries=60)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert set(got) == set(want) and recall >= 0.9
    for q, rows in got.items():
        scores = dict(exact(ids, x, 3000)[q]) if q == 0 else None
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True) and len(rows) == 20
        assert scores is None or all(scores[i] == s for i, s in rows)


def test_ties_go_by_id_over_a_common_vector(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(300)] + [(1000 + i, [0.05 * i, -1.0, 0.3]) for i in range(20)]
    got = searched(vectors(spark, rows), block_rows=50)
    assert [i for i, _ in got[40]] == [i for i in range(21) if i != 40][:20]
    assert [i for i, _ in got[0]] == list(range(1, 21))


def test_copies_of_a_query_do_not_count_once_per_tree(spark):
    """A few equal vectors are many entries in 64 trees, but too few rows."""
    for copies, n in ((13, 500), (16, 1000), (20, 1800)):
        x = np.random.default_rng(copies).standard_normal((n, 64))
        x[:copies] = x[0]
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        want, got = exact(np.arange(n), x), searched(vectors(spark, zip(range(n), x)))
        assert all(len(rows) == 20 for rows in got.values()) and set(got) == set(want)
        assert [i for i, _ in got[0]][: copies - 1] == list(range(1, copies))
        assert np.mean([i in dict(got[q]) for q in want for i, _ in want[q]]) >= 0.9


def test_rows_that_take_no_part(spark):
    rows = [(0, [1, 2]), (20, [0, 0]), (40, None), (60, [1, None]), (80, [float("nan"), 1]), (100, [float("inf"), 1]), (None, [1, 1]),
            (1, [3, 1]), (1, [3, 1]), (2, [1, 2, 3]), (3, [])]
    assert searched(vectors(spark, rows)) == {0: [(1, 5.0)]}
    longer = [(120, [2, 0, 1]), (3, [1, 0, -1]), (140, [1, 1, 1, 1])]
    assert searched(vectors(spark, rows + longer)) == {0: [(1, 5.0)], 120: [(2, 5.0), (3, 1.0)]}
    assert searched(vectors(spark, [])) == {}
    assert searched(vectors(spark, [(20, [1, 1])])) == {}


def test_lengths_are_searched_apart(spark):
    draw = np.random.default_rng(3)
    x = [draw.standard_normal(8 if i % 3 else 5).astype(np.float32) for i in range(600)]
    got = searched(vectors(spark, enumerate(x)), block_rows=150)
    assert set(got) == set(range(0, 600, 20))
    for alike in (range(0, 600, 3), [i for i in range(600) if i % 3]):
        want = exact(np.array(alike), np.array([x[i] for i in alike]))
        assert np.mean([i in dict(got[q]) for q in want for i, _ in want[q]]) >= 0.9


def test_prefix_ranges_in_a_sorted_array():
    codes = np.sort(np.array([0b0000, 0b0011, 0b0100, 0b1000, 0b1001, 0b1111]))
    for depth, want in ((0, 6), (1, 3), (2, 2), (3, 2), (4, 1)):
        begin, stop = ann.entries_at(codes, np.array([0b1000]), depth, 4)
        assert int(stop[0] - begin[0]) == want


def block_of(x, params):
    """Recall of one block's search, and the share of its rows that were scored."""
    x = np.ascontiguousarray(x, dtype=np.float32).astype(np.float64)
    ids = np.arange(len(x))
    longest = (x * x).sum(axis=1).max()

    def coded(some, asks):
        rows = pa.array(list(x[some]), pa.list_(pa.float64()))
        batch = pa.RecordBatch.from_arrays([pa.array(ids[some]), rows], names=["vec_id", "vector"])
        table = pa.Table.from_batches(ann.forest_codes(params, longest, not asks)([batch]))
        return table.append_column("asks", pa.array([asks] * len(some)))

    found = ann.search_block(params)(pa.concat_tables([coded(ids, False), coded(ids[::20], True)])).to_pydict()
    got, scored = {}, {}
    for q, i, n in zip(found["query_id"], found["vec_id"], found["scored"]):
        got.setdefault(q, set()).add(i)
        scored[q] = n
    want = exact(ids, x)
    recall = np.mean([len(got[q] & {i for i, _ in rows}) / len(rows) for q, rows in want.items()])
    return recall, np.mean(list(scored.values())) / (len(x) - 1)


def test_tight_groups_end_after_a_few_per_cent():
    draw = np.random.default_rng(5)
    x = np.repeat(draw.standard_normal((60, 64)), 100, axis=0) + 0.25 * draw.standard_normal((6000, 64))
    recall, share = block_of(x / np.linalg.norm(x, axis=1, keepdims=True), ann.Params())
    assert recall >= 0.97 and share < 0.05


@pytest.mark.parametrize("n", [500, 2000])
def test_vectors_without_neighbourhoods_take_most_rows_but_not_all(n):
    x = np.random.default_rng(n).standard_normal((n, 64))
    recall, share = block_of(x / np.linalg.norm(x, axis=1, keepdims=True), ann.Params())
    assert 0.9 <= recall and share < 0.97
