import itertools
import math

import numpy as np
import pytest

from packwright.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim string, key string, t string, block string"


def frame(spark, rows):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], y, *"dktb") for i, v, y in rows]
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    sound = []
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, [math.floor(float(np.float32(x)) * scale) for x in v], y))
    anchors = {}
    for i, v, y in sound:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (len(v), None, v, y)), (len(v), None, v, y), key=lambda r: (r[0], r[2], r[3]))
    out = []
    for a, (_, _, av, ay) in anchors.items():
        scored = [(-sum(x * z for x, z in zip(av, v)), i, y) for i, v, y in sound if i != a and len(v) == len(av)]
        for s, p, _ in sorted(r for r in scored if r[2] == ay)[:positives]:
            fits = sorted((n, i) for n, i, y in scored if y != ay and low * -s <= 100 * -n <= high * -s)[:negatives]
            out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    found = hardneg.mine(frame(spark, rows), hardneg.Params(**options)).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


def clustered(n, dim, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    of = draw.integers(0, 12, n)
    x = centres[of] + 0.3 * draw.normal(size=(n, dim))
    return [(int(i), x[i].tolist(), int(draw.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"most_rows": 7, "blocks_at_once": 3, "zones_at_once": 40, "first_look": 1}])
def test_all_pairs(spark, options):
    rows = clustered(900, 16, 2)
    assert mined(spark, rows, every=20, **options) == plain(rows, every=20)


def test_ties_copies_and_other_windows(spark):
    """Many equal vectors, products that tie, windows that hold nothing, and more places than rows."""
    draw = np.random.default_rng(4)
    rows = [(i, draw.integers(-2, 3, 3) / 4, int(draw.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5], i % 2) for i in range(300)]
    rows = [(i, np.asarray(v).tolist(), y) for i, v, y in rows]
    options = {"every": 50, "positives": 3, "negatives": 400, "low": 10, "high": 100}
    assert mined(spark, rows, most_rows=16, **options) == plain(rows, **options)


def test_rows_that_take_no_part(spark):
    rows = [
        (0, [1, 2], 1), (0, [1, 2], 1), (None, [1, 1], 1), (1, [2, 1], None), (2, None, 1), (3, [1, None], 1), (4, [float("nan"), 1], 1),
        (5, [float("-inf"), 1], 1), (6, [1, 1.5], 1), (7, [1, 1.5], 1), (8, [0.5, 0.5], 2), (8, [0.5, 0.5], 2), (9, [1, 2, 3], 1), (10, [1, 0, 1], 2),
        (11, [], 1), (12, [], 2), (100, [], 1), (200, [1, 1, 1], 1), (300, [-1, -1], 3), (400, [-0.1, 0.2], 1),
    ]
    want = plain(rows)
    assert want and {r[0] for r in want} == {0, 100, 200}
    assert mined(spark, rows) == want
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_large_components_are_still_exact(spark):
    rows = [(0, [1e6, 3.0], 1), (1, [1e6, 1.0], 1), (2, [5e5, 7.0], 2), (3, [5e5, 7.5], 2), (4, [9e5, -1.0], 2)]
    assert mined(spark, rows) == plain(rows) != []


def test_curve_visits_neighbours():
    """In two and three dimensions every step along the curve is to a neighbouring cell, and all cells are met."""
    for n, bits in ((2, 4), (3, 3), (1, 4)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = [k.tobytes() for k in hardneg.hilbert_keys(grid, bits)]
        assert len(set(keys)) == len(grid)
        ordered = grid[np.argsort(np.array(keys, dtype=object))]
        assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()
    assert hardneg.hilbert_keys(np.zeros((2, 0), dtype=np.int64), 4).shape == (2, 0)


def test_bounds_hold_and_leave_out_what_is_far(spark):
    draw = np.random.default_rng(1)
    low = draw.integers(-50, 50, (20, 6)).astype(float)
    high = low + draw.integers(0, 20, (20, 6))
    a = draw.integers(-40, 40, (5, 6)).astype(float)
    least, most = hardneg.score_bounds(a, low, high)
    for _ in range(200):
        v = np.floor(low + draw.random(low.shape) * (high - low + 1)).clip(low, high)
        assert (least <= a @ v.T).all() and (a @ v.T <= most).all()
    # Tight groups far from each other: an anchor reads a small part of the blocks.
    x = np.repeat(np.eye(20) * 4, 50, axis=0) + 0.05 * draw.random((1000, 20))
    rows = [(i, x[i].tolist(), i % 3) for i in range(1000)]
    params = hardneg.Params(every=10, most_rows=16)
    blocks = hardneg.stage(hardneg.in_blocks(hardneg.on_curve(hardneg.usable(frame(spark, rows)), params), params), "blocks")
    asked = hardneg.stage(blocks.where("array_contains(ids, 0)").limit(1), "asked")
    wide = lambda value: hardneg.F.transform("ids", lambda _: hardneg.F.lit(value).cast("long"))
    asked = asked.withColumns({"t_pos": hardneg.F.expr("sequence(0, size(ids) - 1)"), "t_low": wide(hardneg.LEAST), "t_high": wide(hardneg.MOST)})
    n = blocks.count()
    floored = asked.withColumn("t_floor", wide(3_000 * 256 // 10)).drop("low", "high", "label_set")
    zones = blocks.select("dim", "block", "low", "high", "label_set")
    pairs = floored.groupBy("dim").cogroup(zones.groupBy("dim")).applyInArrow(hardneg.which_blocks(True, None), "chunk long, block long, t array<int>")
    assert n >= 60 and 0 < pairs.count() <= n // 4
