"""Queries over their whole tables, where another query of the operator looks at a part."""

import hashlib

from pyspark.sql import functions as F

from tests.conftest import rows
from treeline import problem_queries
from treeline import tree_queries as Q
from treeline.functions import scalars
from treeline.operators import chunks


def test_texts_of_all_languages_are_compared_by_chunks(spark, tmp_path):
    texts = ["é" * 3505, "a" + "漢" * 4001, "😀" * 2048, "plain", "", "ß" * 2047 + "x", None]
    docs = spark.createDataFrame([("w", "l", str(i), t) for i, t in enumerate(texts)], "source string, lang string, doc_id string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [(f"/corpus/w/l/{i}", len(t.encode()) % 7 == 3) for i, t in enumerate(texts) if t is not None]
    got = rows(Q.join_content_by_chunks(spark, str(tmp_path)), "rel", "differs")
    assert got == sorted(want, key=repr) and any(d for _, d in got)
    # sections are cut at bytes, also within a character
    cut = lambda b: [(o, hashlib.sha256(b[o : o + 4096]).hexdigest()) for o in range(0, max(len(b), 1), 4096)]
    pieces = [(f"/corpus/w/l/{i}", o, h) for i, t in enumerate(texts) if t is not None for o, h in cut(t.encode())]
    assert rows(Q._chunk_digests(docs, -1), "rel", "offset", "digest") == sorted(pieces, key=repr)


def test_every_crowded_directory_is_compacted(spark, tmp_path):
    # one more file than makes a crowd: hashed into as many writers, some directories would fill fewer files than a crowd
    items = [(f"/l/{d}/{i}", f"/a{i}|F\n" if i else None) for d in range(4) for i in range(problem_queries.compaction.CROWD)] + [("/l/few/0", "/b|F\n")]
    lists = spark.createDataFrame([(n, b, 1) for n, b in items], "name string, body string, mtime bigint")
    lists.write.parquet(f"{tmp_path}/saved_lists.parquet")
    got = rows(problem_queries.p1_compacted_files(spark, str(tmp_path)), "dir", "files_before", "rewritten", "crowded_after")
    assert got == [*[(f"/l/{d}", 24, True, False) for d in range(4)], ("/l/few", 1, False, False)]
    assert rows(problem_queries.p1_compacted(spark, str(tmp_path)), "path") == sorted([(f"/a{i}",) for i in range(1, 24)] * 4 + [("/b",)])


def test_rows_without_size_and_very_large_ones_count(spark, tmp_path):
    items = [("/a", "FILE", 5), ("/b", "FILE", None), ("/c", "DIR", None), ("/d", "FILE", 9_007_201_376_147_040), ("/e", None, 7)]
    spark.createDataFrame(items, "name string, type string, size bigint").write.parquet(f"{tmp_path}/tree_src.parquet")
    (got,) = Q.agg_summary(spark, str(tmp_path)).collect()
    assert (got.n_items, got.n_dirs, got.n_files, got.n_unknown, got.bytes) == (5, 1, 3, 1, 9_007_201_376_147_045)
    end = 9_007_201_376_147_045
    assert rows(Q.window_positions(spark, str(tmp_path))) == [("/a", 0, 0), ("/b", 1, 5), ("/c", 2, 5), ("/d", 3, 5), ("/e", 4, end)]


def test_sizes_are_parsed_and_shown_exactly(spark):
    texts = ["9007199254740993", "9223372036854775807", "9223372036854775808", "8796093022207.9999999999999999999m", "8e", "7.999999999999999999e", "0." + "9" * 80 + "e", "1" * 60, "1.5k", ".5kb", "3.", "x"]
    got = [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.parse_bytes_col(F.col("t")).alias("b")).collect()]
    top, e = 2**63 - 1, 2**60
    want = [2**53 + 1, top, None, 2**63 - 1, None, 8 * e - 2, e - 1, None, 1536, 512, 3, None]
    assert got == want
    shown = spark.createDataFrame([(n,) for n in (10**9 + 1, 9_007_201_376_147_040, top)], "n bigint").select(scalars.show_count(F.col("n")).alias("c"))
    assert [r.c for r in shown.collect()] == ["1.000 G", "9.007 P", "9.223 E"]


def test_sections_of_files_of_any_size(spark):
    sizes = [0, 1, 1 << 20, (1 << 20) + 1, 9_007_201_376_147_040, 2**63 - 1, None]
    files = spark.createDataFrame([(f"/{i}", "FILE", n) for i, n in enumerate(sizes)], "name string, type string, size bigint")
    few = chunks.explode_chunks(files, F.greatest(F.lit(1 << 20), F.call_function("div", F.col("size"), F.lit(100_000))))
    got = {r.name: (r.n, r.b, r.e) for r in few.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length").cast("decimal(20,0)")).alias("b"), F.max(F.col("offset").cast("decimal(20,0)") + F.col("length")).alias("e")).collect()}
    assert set(got) == {f"/{i}" for i in range(6)} and all(got[f"/{i}"][1:] == (n, n) for i, n in enumerate(sizes[:-1]))
    assert [got[f"/{i}"][0] for i in range(4)] == [1, 1, 1, 2] and 100_000 <= got["/5"][0] <= 100_001
