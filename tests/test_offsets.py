import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from packwright.operators.offsets import dense_positions, running_offsets

QUIET = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def expected(rows):
    """rows: (group, key, n) -> {(group, key): (start, total)}"""
    totals, found = {}, {}
    for group, key, n in sorted(rows):
        found[group, key] = totals.get(group, 0)
        totals[group] = totals.get(group, 0) + n
    return {k: (start, totals[k[0]]) for k, start in found.items()}


def measured(df):
    return {(r.g, r.k): (r.start, r.total) for r in df.collect()}


wide_keys = st.integers(-(2**62), 2**62) | st.integers(-5, 5) | st.integers(2**21 - 3, 2**21 + 3)


@QUIET
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), wide_keys), st.integers(0, 50), min_size=1, max_size=40))
def test_offsets_of_any_integer_keys(spark, lengths):
    rows = [(g, k, n) for (g, k), n in lengths.items()]
    df = spark.createDataFrame(rows, "g string, k bigint, n bigint")
    assert measured(running_offsets(df, ["g"], ["k"], "n")) == expected(rows)


def test_hot_group_and_any_partitioning(spark):
    draw = random.Random(7)
    rows = [("hot" if draw.random() < 0.6 else draw.choice("abc"), k * 700_001, draw.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k bigint, n bigint")
    want = expected(rows)
    for parts in (1, 3, 11):
        assert measured(running_offsets(df.repartition(parts), ["g"], ["k"], "n")) == want


def test_two_keys_with_one_parent_holding_most_rows(spark):
    rows = [("g", 7, t, t % 3) for t in range(2000)] + [("g", c, 0, 5) for c in range(7)] + [("g", 9, 1, 1)]
    df = spark.createDataFrame(rows, "g string, k bigint, t int, n bigint")
    got = {(r.k, r.t): r.start for r in running_offsets(df, ["g"], ["k", "t"], "n").collect()}
    at, want = 0, {}
    for _, k, t, n in sorted(rows):
        want[k, t] = at
        at += n
    assert got == want


def test_no_groups(spark):
    df = spark.createDataFrame([(5,), (1,), (2**40,)], "k bigint")
    got = {r.k: (r.position, r.total) for r in dense_positions(df, [], ["k"]).collect()}
    assert got == {1: (0, 3), 5: (1, 3), 2**40: (2, 3)}


def test_null_key_is_an_error_and_not_a_lost_row(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 2, 1)], "g string, k bigint, n bigint")
    with pytest.raises(Exception, match="null in key column g"):
        running_offsets(df, ["g"], ["k"], "n").collect()


def test_text_keys_are_refused(spark):
    df = spark.createDataFrame([("a", "1", 1)], "g string, k string, n bigint")
    with pytest.raises(TypeError):
        running_offsets(df, ["g"], ["k"], "n")
