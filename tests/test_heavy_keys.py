from pyspark.sql import functions as F

from tests.conftest import rows
from treeline.operators import heavy_keys as H


def test_totals_with_nulls_ties_and_clashing_columns(spark):
    data = [("a", 1, 5), ("a", 1, 5), ("a", 2, None), (None, 1, 7), ("b", None, -3), ("b", 2, 2**62), ("b", 3, 2**62)]
    df = spark.createDataFrame([(k, o, v, "z", 1, 2) for k, o, v in data], "key string, o int, v bigint, n string, k0 int, n_rows int")
    got = rows(H.key_totals(df, ["key"], "o", "v").withColumn("sum_value", F.col("sum_value").cast("string")), "key", "n_rows", "n_values", "sum_value", "min_value", "max_value")
    assert got == sorted([("a", 3, 2, "10", 5, 5), ("b", 3, 3, str(2**63 - 3), -3, 2**62), (None, 1, 1, "7", 7, 7)], key=repr)
    assert rows(H.key_totals(df.limit(0), ["key"], "o", "v")) == []


def test_a_key_with_most_rows_is_split_and_complete(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("key"), (F.col("id") % 50).alias("o"), F.col("id").alias("v"))
    out = H.key_totals(df, ["key"], "o", "v", partitions=8)
    want = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("decimal(38,0)").alias("s"))
    assert rows(out, "key", "n_rows", "sum_value") == rows(want, "key", "n", "s")


def test_order_never_changes_the_result(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("key"), F.col("id").alias("v"))
    a = H.key_totals(df, ["key"], F.lit(None).cast("int"), "v")
    b = H.key_totals(df, ["key"], F.rand(3), "v")
    assert rows(a) == rows(b)


def test_running_totals_of_a_heavy_key(spark):
    data = [(None if i % 50 == 7 else "hot" if i % 3 else f"k{i % 9}", i * 37 % 4000, None if i % 11 == 0 else i) for i in range(4000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "key string, o int, v bigint, r int, n0 int")
    want, totals = [], {}
    for k, o, v in sorted(data, key=lambda t: t[1]):
        n, s = totals.get(k, (0, 0))
        totals[k] = n + 1, s + (v or 0)
        want.append((k, o, v, *totals[k]))
    got = rows(H.running_totals(df, ["key"], ["o"], "v").withColumn("running", F.col("running").cast("long")))
    assert got == sorted(want, key=repr)
    assert H.running_totals(df.limit(0), ["key"], ["o"], "v").count() == 0
