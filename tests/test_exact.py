import math
import random
import struct

from pyspark.sql import functions as F

from packwright.operators.exact import exact_mean, exact_norm, exact_sums, limbs

BORDERS = [
    0.0, -0.0, 1.0, -1.0, 0.1, 2.0**32, 2.0**32 - 1, -(2.0**32), 2.0**64, 2.0**-32, 5e-324, -5e-324, 2.2250738585072014e-308,
    1.7976931348623157e308, -1.7976931348623157e308, math.pi, 1e16, 1e-16, 2.0**-1056, 2.0**-1057 * 3, math.nextafter(2.0**32, 0),
    math.nextafter(2.0**-64, 1), 2.0**1023, 123456789.123456789,
]


def any_doubles(n, seed):
    draw, found = random.Random(seed), []
    while len(found) < n:
        x = struct.unpack("<d", draw.randbytes(8))[0]
        if math.isfinite(x):
            found.append(x)
    return found


def unit(b):
    return -1074 if b == -34 else 32 * b


def test_limbs_are_the_value(spark):
    values = BORDERS + any_doubles(400, 1)
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", "x", limbs(F.col("x")).alias("parts")).collect()
    for r in rows:
        total = sum(p.part << (unit(p.bin) + 1074) for p in r.parts)
        assert total / (1 << 1074) == r.x and all(abs(p.part) <= 1 << 33 for p in r.parts)
        assert len(r.parts) >= 1


def test_nearest_to_the_true_sum_in_any_order(spark):
    """Against exact summation, with cancellation over the whole range of doubles."""
    draw = random.Random(3)
    groups = {
        "wide": any_doubles(300, 5),
        "borders": [x for x in BORDERS if abs(x) < 1e300] * 3,
        "cancels": [v for x in any_doubles(100, 7) if abs(x) < 1e300 for v in (x, -x)] + [1e-30],
        "small": [draw.uniform(-1, 1) for _ in range(500)],
        "tiny": [5e-324] * 7,
        "zeros": [0.0, -0.0],
        "one": [0.1],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("nulls", None), ("one", None), (None, 0.5)]
    draw.shuffle(rows)
    found = []
    for n in (1, 7, 64):
        df = spark.createDataFrame(rows, "g string, x double").repartition(n)
        got = exact_sums(df, ["g"], {"total": F.col("x")}, {"n": F.count("*")}).collect()
        found.append({r.g: (r.total, r.n) for r in got})
    assert found[0] == found[1] == found[2]
    for g, xs in groups.items():
        assert found[0][g][0] == math.fsum(xs), g
    assert found[0]["nulls"] == (None, 1) and found[0][None] == (0.5, 1) and found[0]["one"] == (0.1, 2)


def test_what_is_no_number(spark):
    inf = float("inf")
    rows = [("a", inf), ("a", 1.0), ("b", -inf), ("c", inf), ("c", -inf), ("d", float("nan")), ("d", inf), ("e", 1e308), ("e", 1e308)]
    got = {r.g: r.s for r in exact_sums(spark.createDataFrame(rows, "g string, x double"), ["g"], {"s": F.col("x")}).collect()}
    assert got["a"] == inf and got["b"] == -inf and math.isnan(got["c"]) and math.isnan(got["d"]) and got["e"] == inf


def test_means_and_norms_are_the_same_bits_for_any_partitioning(spark, sf_small):
    events = spark.read.parquet(f"{sf_small}/events.parquet").select("event_type", "value", (F.col("event_id") % 3 != 0).cast("int").alias("m"))
    vectors = spark.read.parquet(f"{sf_small}/embeddings.parquet").select("label", "embedding")
    means, norms = [], []
    for n in (1, 7, 64):
        means.append(sorted((r.event_type, r.mean) for r in exact_mean(events.repartition(n), ["event_type"], F.col("value"), F.col("m")).collect()))
        norms.append(sorted((r.label, r.norm) for r in exact_norm(vectors.repartition(n), ["label"], "embedding").collect()))
    assert means[0] == means[1] == means[2] and norms[0] == norms[1] == norms[2] and means[0] and norms[0]
    per = {}
    for r in events.where("m = 1").collect():
        per.setdefault(r.event_type, []).append(r.value)
    assert means[0] == sorted((k, math.fsum(v) / len(v)) for k, v in per.items())


def test_over_everything_and_over_nothing(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    assert exact_sums(df, [], {"s": F.col("x"), "t": F.col("x") * 2}, {"n": F.count("*")}).first().asDict() == {"s": 0.6, "t": 1.2, "n": 3}
    assert exact_sums(df.limit(0), ["x"], {"s": F.col("x")}).collect() == []
    masked = spark.createDataFrame([("a", 1.0, 0), ("b", 3.0, 1)], "g string, x double, m int")
    assert sorted(tuple(r) for r in exact_mean(masked, ["g"], F.col("x"), F.col("m")).collect()) == [("a", 0.0), ("b", 3.0)]
    empty = spark.createDataFrame([(1, []), (2, None), (3, [3.0, 4.0])], "g int, v array<double>")
    assert sorted(tuple(r) for r in exact_norm(empty, ["g"], "v").collect()) == [(1, 0.0), (2, 0.0), (3, 5.0)]


def test_rows_are_reduced_before_they_are_exchanged(spark):
    """A group of all rows sends a few bins per task."""
    df = spark.range(20_000, numPartitions=64).select(F.lit("a").alias("g"), (F.rand(1) * 1000).alias("x"))
    plan = exact_sums(df, ["g"], {"s": F.col("x")})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.index("partial_sum") > plan.index("Exchange hashpartitioning")
