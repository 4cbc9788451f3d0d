import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from treeline.llm import percentiles as P


def exact(values, p):
    return sorted(values)[max(math.ceil(round(p * 1e6) * len(values) / 1e6), 1) - 1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=60))
def test_error_bound_of_integers(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = P.percentiles(P.sketch(df, [], "v"), [], [0.01, 0.5, 0.9, 1.0]).first()
    for i, p in enumerate((0.01, 0.5, 0.9, 1.0)):
        true = exact(values, p)
        assert abs(got[f"p{i}"] - true) <= abs(true) * P.relative_error() * 1.0001


def test_doubles_and_what_is_left_out(spark):
    values = [0.0, -0.0, 1e-300, -1e-300, 5e-324, 1.5, -2.5, 1e308, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    counts = P.sketch(df, ["k"], "v")
    assert counts.agg(F.sum("n")).first()[0] == 8
    got = P.percentiles(counts, ["k"], [1.0, 0.0]).first()
    assert abs(got["p0"] / 1e308 - 1) < 0.006 and abs(got["p1"] / -2.5 - 1) < 0.006


def test_powers_of_two_begin_a_bucket(spark):
    df = spark.createDataFrame([(x,) for e in range(63) for x in (2**e - 1, 2**e)], "v bigint")
    b = [r[0] for r in df.select(P.bucket_of(F.col("v"), True).alias("b")).collect()]
    for e in range(1, 63):
        assert b[2 * e + 1] == (e - P.FLOOR_EXPONENT) * 64 and b[2 * e] < b[2 * e + 1], e


def test_parts_add_up_to_the_whole(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("v"))
    whole = P.sketch(df, ["k"], "v")
    parts = [P.sketch(df.filter(F.col("v") % 4 == i), ["k"], "v") for i in range(4)]
    assert rows(P.merge(parts, ["k"]), "k", "bucket", "n") == rows(whole, "k", "bucket", "n")


def test_median_takes_the_lower_middle_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2**20), ("a", None)], "k string, v bigint")
    got = P.percentile_buckets(P.sketch(df, ["k"], "v"), ["k"], [0.5])
    assert rows(got.select("k", "n", P.at_least(F.col("b0"), 2**20))) == [(None, 2, False)]
    assert rows(P.percentiles(P.sketch(df.limit(0), ["k"], "v"), ["k"], [0.5])) == []
