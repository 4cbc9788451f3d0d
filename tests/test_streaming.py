from pyspark.sql import functions as F

from tests.conftest import rows
from treeline.streaming import changes


def test_windowed_counts_in_one_run(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.sql("select timestamp'2025-01-01 00:01:00' as t, 'a' as k union all select timestamp'2025-01-01 00:04:00', 'a' union all select timestamp'2025-01-01 00:06:00', 'a'")
    df.write.parquet(src)
    out = changes.run_to_table(changes.windowed_counts(spark.readStream.schema(df.schema).parquet(src), "t", "k"))
    assert sorted(r.n for r in out.collect()) == [1, 2]


def test_changed_items_ignores_late_and_repeated_listings(spark, tmp_path):
    schema = "name string, walked bigint, size bigint"
    src, out = str(tmp_path / "in"), []
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", 1, 1), ("a", 3, 2), ("b", 1, 1), ("a", 3, 2), (None, 1, 1)])
    stream = changes.changed_items(spark.readStream.schema(schema).parquet(src), "name", "walked", ["size"])
    run = lambda: changes.sync_stream(stream, lambda df: out.extend(map(tuple, df.collect())), str(tmp_path / "state")).awaitTermination()
    run()
    put([("a", 2, 9), ("b", 2, 1), ("b", 5, 7), ("c", 1, None)])
    run()
    assert sorted(out) == [("a", 1, "added"), ("a", 3, "changed"), ("b", 1, "added"), ("b", 5, "changed"), ("c", 1, "added")]


def test_shared_dir_is_that_of_the_session(spark):
    from treeline.plans.lineage import cut, shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir()) and spark.sparkContext.getCheckpointDir()
    assert rows(cut(spark.range(3).select(F.col("id") + 1))) == [(1,), (2,), (3,)]
