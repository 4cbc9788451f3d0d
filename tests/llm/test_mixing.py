import numpy as np
from pyspark.sql import functions as F

from tests.conftest import rows
from treeline.llm import mixing as M

TARGETS = "mix_name string, source string, weight double, max_repeats int, n_tokens int"


def sizes(spark, n=600):
    big = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("big").alias("source"), (F.col("id") % 50 + 10).alias("n_tokens"))
    small = spark.range(n, n + 20).select(F.col("id").alias("doc_id"), F.lit("small").alias("source"), F.lit(30).cast("long").alias("n_tokens"))
    return big.unionByName(small)


def run(spark, targets, **kw):
    s = sizes(spark)
    plan = M.mix_plan(s, spark.createDataFrame([(*t, 1) for t in targets], TARGETS), **kw)
    drawn = M.copies(s, plan)
    return plan, drawn, {(r.mix_name, r.source): r for r in M.shares(drawn, plan).collect()}


def test_shares_and_caps(spark):
    _, drawn, got = run(spark, [("m", "big", 1.0, 4), ("m", "small", 1.0, 4), ("m", "none", 2.0, None), ("m", "zero", 0.0, 3), ("n", "big", 3.0, None), ("n", "small", 1.0, None)], keep_shares=True)
    assert got["m", "small"].most_copies == 4 and got["m", "small"].copies == 80
    assert abs(got["m", "big"].actual_share - 0.5) < 0.02 and got["m", "none"].tokens == 0 and got["m", "none"].target_share == 0.5
    assert abs(got["n", "big"].actual_share - 0.75) < 0.02 and got["n", "small"].most_copies > 4
    assert rows(drawn) == rows(run(spark, [("m", "big", 1.0, 4), ("m", "small", 1.0, 4), ("m", "none", 2.0, None), ("m", "zero", 0.0, 3), ("n", "big", 3.0, None), ("n", "small", 1.0, None)], keep_shares=True)[1])


def test_rows_of_the_mix(spark):
    _, drawn, got = run(spark, [("m", "big", 1.0, 2), ("m", "small", 1.0, None)])
    out = M.mixed(drawn)
    assert out.count() == sum(r.copies for r in got.values())
    assert out.select("mix_name", "doc_id", "copy_no").distinct().count() == out.count()
    for part in out.rdd.glom().collect():
        assert [r.place for r in part] == sorted(r.place for r in part)


def test_large_rates_and_totals(spark):
    _, _, got = run(spark, [("m", "big", 1.0, None), ("m", "small", 9.0, None)], total_tokens=20_000_000)
    assert abs(got["m", "small"].actual_share - 0.9) < 0.01


def test_odd_targets(spark):
    plan, drawn, got = run(spark, [("m", "big", None, 1), ("m", "small", -1.0, 1), (None, "big", 1.0, 1), ("m", None, 1.0, 1), ("z", "big", 1.0, 0)])
    assert drawn.count() == 0 and all(r.tokens == 0 and r.actual_share == 0 for r in got.values())
    empty = M.mix_plan(sizes(spark).limit(0), spark.createDataFrame([("m", "big", 1.0, 1, 1)], TARGETS))
    assert M.copies(sizes(spark).limit(0), empty).count() == 0


def test_null_texts_and_sources(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "some words here", None), (4, "some words here", "a")], "doc_id bigint, text string, source string")
    assert rows(M.document_sizes(docs)) == [(1, "a", 0), (2, "a", 0), (4, "a", 3)]


def test_cuts_are_the_poisson_distribution():
    base, cuts = M.poisson_cuts(2.0, None)
    assert base == 0 and np.allclose(cuts[:3], [np.exp(-2), 3 * np.exp(-2), 5 * np.exp(-2)])
    u = (np.arange(200_000) + 0.5) / 200_000
    for rate in (0.01, 2.0, 255.0, 257.0, 400.0, 90_000.0):  # one law at every rate: mean and variance are the rate
        base, cuts = M.poisson_cuts(rate, None)
        k = base + np.searchsorted(cuts, u, side="right")
        assert abs(k.mean() - rate) < 1e-3 * max(1, rate**0.5) and abs(k.var() / rate - 1) < 0.01
    assert len(M.poisson_cuts(2.0, 3)[1]) == 3 and M.poisson_cuts(1000.0, 5)[0] == 5 and M.poisson_cuts(0.0, None)[0] == 0


def test_a_capped_source_falls_short_and_holds_nobody_back(spark):
    _, _, got = run(spark, [("m", "big", 1.0, None), ("m", "small", 1.0, 2)])
    total = got["m", "big"].source_tokens + got["m", "small"].source_tokens
    assert abs(got["m", "big"].tokens - total / 2) < 0.02 * total and got["m", "small"].tokens == 2 * got["m", "small"].source_tokens
    assert got["m", "small"].actual_share < got["m", "small"].target_share == 0.5 and got["m", "small"].most_copies == 2


def test_texts_of_the_mix(spark):
    docs = sizes(spark).withColumn("text", F.concat(F.lit("t"), "doc_id"))
    plan = M.mix_plan(sizes(spark), spark.createDataFrame([("m", "big", 1.0, 3, 1), ("m", "small", 1.0, 3, 1)], TARGETS))
    out = M.mixed(M.draw(docs.select("doc_id", "source", "text"), M.draw_rates(sizes(spark), plan)))
    ids = M.mixed(M.copies(sizes(spark), plan))
    assert rows(out, "mix_name", "doc_id", "copy_no", "place") == rows(ids, "mix_name", "doc_id", "copy_no", "place")
    assert out.filter("text <> concat('t', doc_id)").count() == 0
