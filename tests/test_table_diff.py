from pyspark.sql import functions as F

from tests.conftest import rows
from treeline.operators.table_diff import Field, table_diff

S = "k string, type string, size bigint, m bigint, n bigint, leaf int, a string"
FIELDS = [Field("SIZE", ("size",), unless=("type", "DIR")), Field("M", ("m", "n"))]


def diff(spark, a, b, **kw):
    make = lambda t: spark.createDataFrame([(*r, 1, "x") for r in t], S)
    return rows(table_diff(make(a), make(b), "k", "k", FIELDS, **kw))


def test_every_case(spark):
    a = [("same", "FILE", 1, 1, 1), ("same", "FILE", 1, 1, 1), ("gone", "FILE", 1, 1, 1), ("size", "FILE", 1, 1, 1), ("dir", "DIR", 1, 1, 1), ("mixed", "FILE", 1, 1, 1),
         ("null", "FILE", None, None, 1), ("bothnull", None, None, None, None), ("nsec", "FILE", 1, 1, 1), (None, "FILE", 1, 1, 1)]
    b = [("same", "FILE", 1, 1, 1), ("new", "FILE", 1, 1, 1), ("size", "FILE", 2, 1, 1), ("dir", "DIR", 2, 1, 1), ("mixed", "DIR", 2, 2, 1),
         ("null", "FILE", 0, 0, 1), ("bothnull", None, None, None, None), ("nsec", "FILE", 1, 1, 2), ("Same", "FILE", 1, 1, 1)]
    want = [("Same", "EXIST", "ONLY_DEST"), ("gone", "EXIST", "ONLY_SRC"), ("mixed", "M", "DIFFER"), ("new", "EXIST", "ONLY_DEST"), ("nsec", "M", "DIFFER"),
            ("null", "M", "DIFFER"), ("null", "SIZE", "DIFFER"), ("size", "SIZE", "DIFFER")]
    assert diff(spark, a, b) == want
    assert diff(spark, a, b, leaf_rows=1) == want
    assert diff(spark, [], b[:1]) == [("same", "EXIST", "ONLY_DEST")]
    assert diff(spark, a[:1], []) == [("same", "EXIST", "ONLY_SRC")]
    assert diff(spark, [], []) == [] and diff(spark, a, a) == []


def test_repeats_never_hide_a_difference(spark):
    assert diff(spark, [("x", "FILE", 1, 1, 1)] * 2, [("x", "FILE", 2, 1, 1)] * 2) == [("x", "SIZE", "DIFFER")]


def test_many_rows_at_any_leaf_size(spark):
    a = spark.range(3000).select(F.concat(F.lit("/"), "id").alias("k"), F.lit("FILE").alias("type"), F.col("id").alias("size"), F.lit(1).alias("m"), F.lit(1).alias("n"))
    b = a.filter("size % 100 <> 0").withColumn("size", F.when(F.col("size") % 77 == 0, F.lit(-1)).otherwise(F.col("size")))
    want = sorted([(f"/{i}", "EXIST", "ONLY_SRC") for i in range(0, 3000, 100)] + [(f"/{i}", "SIZE", "DIFFER") for i in range(0, 3000, 77) if i % 100])
    for leaf in (1, 8, 10**6):
        assert rows(table_diff(a, b, "k", "k", FIELDS, leaf_rows=leaf)) == want


def test_columns_of_any_name_and_a_row_repeated_often(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)] + [("hot", 3)] * 3000, "x string, k int")
    b = spark.createDataFrame([("a", 1), ("b", 5), ("hot", 3)], "y string, k int")
    assert rows(table_diff(a, b, "x", "y", [Field("K", ("k",))], leaf_rows=1)) == [("b", "K", "DIFFER")]
