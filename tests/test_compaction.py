import datetime as dt
import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from treeline.operators import compaction as C

T = dt.datetime(2025, 1, 1)
LISTED = "name string, type string, size bigint, walked_at timestamp_ntz, dir string"


def listed(spark, items):
    return spark.createDataFrame([(n, t, s, w and T + dt.timedelta(microseconds=w), "x") for n, t, s, w in items], LISTED)


def test_crowded_counts_current_rows_only(spark):
    items = [(f"/d/{i}", "FILE", 10, 1) for i in range(3)] * 2  # repeated as they are
    items += [("/d/0", "FILE", 10**6, 2)]  # the newest row of /d/0 is large
    items += [("/d/3", "DIR", 10, 1), ("/d/4", "FILE", None, 1), ("/d/5", "FILE", 0, 1), ("/d/6", "FILE", 32768, 1), ("/d/7", None, 5, 1)]
    items += [(None, "FILE", 1, 1), ("/d/8", "FILE", 1, None), ("/x", "FILE", 1, 1)]
    df = listed(spark, items)
    assert rows(C.crowded_directories(df, crowd=1), "dir", "n_small", "small_bytes") == [("", 1, 1), ("/d", 3, 20)]
    assert rows(C.crowded_directories(df, crowd=3), "dir") == [("/d",)]
    assert rows(C.crowded_directories(df.limit(0))) == []


def test_newest_by_microsecond(spark):
    df = listed(spark, [("/d/a", "FILE", 1, 5), ("/d/a", "DIR", 1, 6)])
    assert rows(C.crowded_directories(df, crowd=1)) == []
    ltz = df.withColumn("walked_at", F.col("walked_at").cast("timestamp"))
    assert rows(C.crowded_directories(ltz, crowd=1)) == []


LISTS = "name string, size bigint, mtime bigint, body string, part string"


def lists(spark, items):
    return spark.createDataFrame([(n, len(b or ""), m, b, "p") for n, m, b in items], LISTS)


def test_records_of_all_line_ends(spark):
    df = lists(spark, [("/l/a", 1, "/x|F\r\n/y|b|D\n\n/z"), ("/l/a", 1, "/x|F\r\n/y|b|D\n\n/z"), ("/l/b", 1, None), ("/l/c", 1, ""), ("/l/d", None, "/q|L")])
    out = C.records(C.stored_files(df))
    assert rows(out, "file", "line", "path", "type") == [("/l/a", 0, "/x", "F"), ("/l/a", 1, "/y|b", "D"), ("/l/a", 3, "/z", None), ("/l/d", 0, "/q", "L")]


def test_every_record_lands_once(spark):
    df = lists(spark, [(f"/big/{i}", 1, f"/r{i}|F\n" * (i % 4)) for i in range(300)] + [(f"/few/{i}", 1, "/s|D\n") for i in range(3)])
    out = C.compact_lists(df, 100, crowd=24)
    assert out.count() == sum(i % 4 for i in range(300)) + 3
    assert out.select("file", "line").distinct().count() == out.count()
    assert out.filter("dir = '/few' and part is not null").count() == 0
    assert out.filter("dir = '/big' and part is null").count() == 0
    assert 1 < out.filter("dir = '/big'").select("subset", "part").distinct().count() < 60


def test_parts_split_a_huge_directory(spark):
    files = spark.range(1000).select(F.lit("/d").alias("dir"), F.concat(F.lit("/d/"), "id").alias("name"), F.lit(10).alias("bytes"))
    placed = C.assign_parts(files, 100, subset_files=100)
    assert placed.count() == 1000 and placed.select("subset").distinct().count() == 10
    assert placed.groupBy("subset", "part").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] <= 100
    assert rows(C.assign_parts(files.limit(0), 100)) == []


def put(path, day, data):
    """A file as another writer appends it."""
    os.makedirs(f"{path}/day={day}", exist_ok=True)
    v, n = zip(*data, strict=True)
    pq.write_table(pa.table({"v": pa.array(v, pa.string()), "n": pa.array(n, pa.int32())}), f"{path}/day={day}/part-{uuid.uuid4().hex}.parquet")


def table(spark, path, small=30, other=2):
    for i in range(small):
        put(path, "hot", [(f"a{i}", i)])
    for i in range(other):
        put(path, "calm", [(f"b{i}", i)])


def append(spark, path, n, day="hot", start=1000):
    put(path, day, [(f"late{i}", i) for i in range(start, start + n)])


def test_compaction_rewrites_crowded_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path)
    before = rows(spark.read.parquet(path), "v", "day", "n")
    calm = sorted(os.listdir(f"{path}/day=calm"))
    t = C.CompactableTable(spark, path, "day")
    assert rows(t.crowded(), "folder") == [("day=hot",)]
    done = t.compact(1 << 20)
    assert done == {"version": 1, "partitions": 1, "files_before": 30, "files_after": 1}
    # after cleaning, readers that don't know the log see the same
    assert rows(spark.read.parquet(path), "v", "day", "n") == before == rows(t.read(), "v", "day", "n")
    assert sorted(os.listdir(f"{path}/day=calm")) == calm and os.listdir(f"{path}/{t.STAGE}") == []
    assert t.compact(1 << 20)["partitions"] == 0 and t.version() == 1


def test_files_of_other_writers_stay(spark, tmp_path):
    """Rows appended before the commit, after it, and while the driver is lost are all there, once."""
    path = str(tmp_path / "t")
    table(spark, path, small=30, other=1)
    t = C.CompactableTable(spark, path, "day")
    t.compact(1 << 20, before_commit=lambda: append(spark, path, 10))
    assert t.read().count() == 41 == t.read().distinct().count()
    for i in range(30):
        append(spark, path, 1, start=2000 + i)

    class Lost(Exception):
        pass

    def lose():
        raise Lost

    with pytest.raises(Lost):  # after the commit, before anything is deleted
        t.compact(1 << 20, before_clean=lose)
    append(spark, path, 10, start=3000)
    again = C.CompactableTable(spark, path, "day")
    assert again.version() == 2 and again.read().count() == 81 == again.read().distinct().count()
    again.clean()
    assert again.read().count() == 81 == spark.read.parquet(path).count()


def test_a_rewrite_without_commit_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, small=25, other=1)
    t = C.CompactableTable(spark, path, "day")
    undo, t._undo = t._undo, lambda me: None  # the driver is lost: nobody takes the files away
    with pytest.raises(RuntimeError, match="lost"):
        t.compact(1 << 20, before_commit=lambda: (_ for _ in ()).throw(RuntimeError("lost")))
    t._undo = undo
    assert t.version() == 0 and t.read().count() == 26 and spark.read.parquet(path).count() == 51
    t.clean(orphan_seconds=-60)
    assert spark.read.parquet(path).count() == 26 and not [f for f in os.listdir(f"{path}/{t.LOG}") if f.endswith(".files")]


def test_readers_see_whole_versions_and_disturb_nobody(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, small=30, other=1)
    t, counts = C.CompactableTable(spark, path, "day"), []
    reader = C.CompactableTable(spark, path, "day")
    early = reader.read()
    look = lambda: counts.append((reader.version(), reader.read().count(), early.count()))
    assert t.compact(1 << 20, before_commit=look, before_clean=look, keep_seconds=3600)["version"] == 1
    look()  # replaced files are kept for readers that began before
    assert counts == [(0, 31, 31), (1, 31, 31), (1, 31, 31)]
    t.clean()
    assert reader.read().count() == 31 == spark.read.parquet(path).count()


def test_two_rewrites_of_one_file_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, small=25, other=1)
    t, other = C.CompactableTable(spark, path, "day"), C.CompactableTable(spark, path, "day")
    with pytest.raises(C.ConflictError):
        t.compact(1 << 20, before_commit=lambda: other.compact(1 << 20, keep_seconds=3600))
    assert t.version() == 1 and t.read().count() == 26
    t.clean()
    assert spark.read.parquet(path).count() == 26
    for i in range(30):
        append(spark, path, 1, start=i)
        append(spark, path, 1, day="calm", start=i)
    # rewrites of other files get the next version
    elsewhere = lambda: other._take(2, {"id": "0" * 32, "at": 0.0}) or open(f"{path}/{t.LOG}/{'0' * 32}.files", "w").close()
    assert t.compact(1 << 20, before_commit=elsewhere)["version"] == 3
    assert t.read().count() == 86
    with pytest.raises(C.ConflictError):
        t._take(3, {"id": "1" * 32, "at": 0.0})
    for i in range(24):
        append(spark, path, 1, start=100 + i)
    with pytest.raises(C.ConflictError):  # a file was removed by one who doesn't know the log
        t.compact(1 << 20, before_commit=lambda: os.remove(next(f"{path}/day=hot/{f}" for f in os.listdir(f"{path}/day=hot") if f.startswith("part-"))))
    assert t.read().count() == 109


def test_turns_of_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "MOST_FILES", 10)
    path = str(tmp_path / "t")
    table(spark, path, small=25, other=1)
    t = C.CompactableTable(spark, path, "day")
    assert t.compact(1 << 20) == {"version": 3, "partitions": 1, "files_before": 25, "files_after": 3}
    assert t.read().count() == 26 == spark.read.parquet(path).count()


def test_empty_table(spark, tmp_path):
    t = C.CompactableTable(spark, str(tmp_path / "none"), "day")
    assert t.version() == 0 and t.listing().count() == 0 and t.compact(1 << 20)["partitions"] == 0


def test_partition_names_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    for day in ("01", "1", "a/b c+d%", "ü"):
        for i in range(24):
            put(path, C.escaped(day), [(str(i), i)])
    t = C.CompactableTable(spark, path, "day")
    folders = rows(t.listing(), "folder")
    done = t.compact(200)
    after = t.listing().collect()
    assert done["partitions"] == 4 and sorted((r.folder,) for r in after) == sorted(folders) and all(r.n_files < 24 for r in after)
    assert sorted(map(tuple, t.read().groupBy("day").count().collect())) == sorted((d, 24) for d in ("01", "1", "a/b c+d%", "ü"))
