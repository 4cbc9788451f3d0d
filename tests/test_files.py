"""Walks, copies, removals, archives and lists on real temporary folders."""

import io
import os
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from treeline import disk_queries
from treeline import entries as E
from treeline.functions.paths import dirname
from treeline.operators import apply, archive, blockzip, chunks, compare, duplicates, order, plans, relink, sync, textsearch
from treeline.operators.progress import Progress
from treeline.plans import lineage
from treeline.sources import generate, lists, owners, walk


def tree(root):
    os.makedirs(root / "d1" / "d2")
    (root / "f0").write_text("hello\nworld\n")
    (root / "d1" / "f1").write_text("same")
    (root / "d1" / "d2" / "f2").write_text("same")
    (root / "d1" / "ü|b").write_text("")
    os.symlink("f1", root / "d1" / "l")
    os.symlink(root / "d1", root / "up")
    os.chmod(root / "f0", 0o640)
    return str(root)


def snapshot(root):
    out = {}
    for d, ds, fs in os.walk(root):
        for n in ds + fs:
            p = os.path.join(d, n)
            s = os.lstat(p)
            out[os.path.relpath(p, root)] = os.readlink(p) if os.path.islink(p) else (s.st_mode, None if os.path.isdir(p) else open(p, "rb").read(), s.st_mtime_ns if not os.path.isdir(p) else None)
    return out


@pytest.mark.parametrize("parts", [1, 64])
def test_walk(spark, tmp_path, parts):
    root = tree(tmp_path / "r")
    df = walk.walk(spark, root, partitions=parts)
    assert sorted(r.name for r in df.collect()) == sorted([root, *[f"{root}/{p}" for p in snapshot(root)]])
    got = {r.name[len(root):]: r for r in df.collect()}
    assert got["/d1/l"].target == "f1" and got["/d1/l"].type == "LINK" and got["/f0"].size == 12 and got["/f0"].mode == 0o100640
    assert got["/f0"].mtime * 10**9 + got["/f0"].mtime_nsec == os.stat(f"{root}/f0").st_mtime_ns and got["/d1"].depth == root.count("/") + 1
    light = walk.walk(spark, root, lite=True)
    assert rows(light, "name", "type") == rows(df, "name", "type") and light.filter("mode is not null").count() == 0
    assert rows(walk.restat(light), "name", "size") == rows(df, "name", "size")
    assert walk.restat(light, skip=lambda n: n.endswith("f0")).count() == df.count() - 1


def test_walk_follows_links_without_end(spark, tmp_path):
    root = tree(tmp_path / "r")
    os.symlink(root, f"{root}/d1/loop")
    df = walk.walk(spark, root, dereference=True, partitions=1)
    assert df.filter("type = 'LINK'").count() == 0 and df.count() < 60


def test_walk_reports_errors(spark, tmp_path):
    df = walk.walk(spark, [str(tmp_path / "missing")])
    assert [(r.type, r.error is not None) for r in df.collect()] == [("UNKNOWN", True)] and walk.errors(df).count() == 1


def test_copy_remove_and_sync(spark, tmp_path):
    root = tree(tmp_path / "r")
    dest = str(tmp_path / "c")
    df = walk.walk(spark, root)
    plan = plans.copy_plan(df, [(root, dest)])
    told = []
    with Progress(spark, told.append, 0.05) as progress:
        assert apply.run_copy(plan, batch=2, progress=progress) == df.count()
    assert told[-1]["items"] == 6 and told[-1]["bytes"] == 20
    assert snapshot(dest) == snapshot(root)
    copy = walk.walk(spark, dest)
    opts = dict(delete=True, target="target")
    assert sync.sync_plan(df, copy, root, dest, **opts).filter("action <> 'refresh'").count() == 0
    os.unlink(f"{dest}/f0")
    os.makedirs(f"{dest}/extra/deep")
    os.utime(f"{dest}/d1/f1", (5, 5))
    os.unlink(f"{dest}/d1/l")
    os.symlink("other", f"{dest}/d1/l")
    plan = sync.sync_plan(df, walk.walk(spark, dest), root, dest, **opts)
    fixed = spark.createDataFrame(plan.collect(), plan.schema)
    done = apply.run_sync(fixed, root, dest)
    assert done["remove"] == 4 and snapshot(dest) == snapshot(root)
    again = sync.sync_plan(walk.walk(spark, root), walk.walk(spark, dest), root, dest, **opts)
    assert again.filter("action <> 'refresh'").count() == 0
    gone = spark.createDataFrame(plans.remove_plan(copy).collect(), plans.remove_plan(copy).schema)
    apply.run_remove(gone)
    assert not os.path.exists(dest)
    apply.run_remove(gone)  # a repeated task finds nothing and is no error


def test_sparse_copies_and_extents(spark, tmp_path):
    p = str(tmp_path / "s")
    with open(p, "wb") as f:
        f.write(b"a" * 4096)
        f.seek(1 << 22)
        f.write(b"b" * 4096)
    e = walk.extents(walk.walk(spark, p)).collect()
    assert sum(r.length for r in e) < 1 << 20
    assert apply.copy_one(p, p + "2", sparse=True) < 1 << 20 and open(p + "2", "rb").read() == open(p, "rb").read()


def test_chmod_relink_and_hard_links(spark, tmp_path):
    root = tree(tmp_path / "r")
    plan = plans.chmod_plan(walk.walk(spark, root), "u=rwx,go-rwx".replace("u=rwx", "u+rwX"))
    fixed = spark.createDataFrame(plan.collect(), plan.schema)
    done = apply.run_chmod(fixed)
    assert done["change"] >= 3 and os.stat(f"{root}/f0").st_mode & 0o777 == 0o600 and os.stat(f"{root}/d1").st_mode & 0o777 == 0o700
    links = relink.relink_plan(walk.walk(spark, root), root, "/elsewhere")
    assert apply.run_relink(spark.createDataFrame(links.collect(), links.schema)) == 1 and os.readlink(f"{root}/up") == "/elsewhere/d1"
    hard = spark.createDataFrame([(f"{root}/f0", f"{root}/again")], "source string, name string")
    apply.make_hard_links(hard)
    apply.make_hard_links(hard)
    assert os.path.samefile(f"{root}/f0", f"{root}/again")


def test_hard_links_of_links_that_lead_nowhere(spark, tmp_path):
    for k in "ab":
        os.symlink("/none", tmp_path / k)
    hard = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/c"), (f"{tmp_path}/a", f"{tmp_path}/b")], "source string, name string")
    for _ in range(2):  # a task may run twice
        apply.make_hard_links(hard)
        assert len({os.lstat(tmp_path / k).st_ino for k in "abc"}) == 1 and os.readlink(tmp_path / "c") == "/none"


def test_links_are_replaced(spark, tmp_path):
    os.symlink("old", tmp_path / "a")
    links = spark.createDataFrame([(f"{tmp_path}/{k}", f"to-{k}") for k in "ab"], "name string, target string")
    for _ in range(2):
        apply.make_links(links)
        assert sorted((n, os.readlink(tmp_path / n)) for n in os.listdir(tmp_path)) == [("a", "to-a"), ("b", "to-b")]


@pytest.mark.parametrize("columns", [["name", "type", "target"], ["size", "name", "error"]])
def test_walk_of_some_columns(spark, tmp_path, columns):
    root = tree(tmp_path / "r")
    for k in range(5_000):
        os.symlink(f"/x{k}", f"{root}/d1/d2/n{k}")
    whole, some = walk.walk(spark, root, partitions=3), walk.walk(spark, root, partitions=3, columns=columns)
    assert some.columns == columns and rows(some) == rows(whole, *columns) and some.count() == 5_009


def test_links_of_a_table_lie_in_many_directories(spark, tmp_path, monkeypatch):
    """One directory that held them all took one change at a time, and one task walked it."""
    spark.range(5, 1_005).selectExpr("id * 3 as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(disk_queries, "LINKS_OF_DIRECTORY", 100, raising=False)
    most, link = [], apply.make_hard_links

    def seen(df):
        most.append(df.groupBy(dirname("source")).count().agg(F.max("count")).first()[0])
        link(df)

    monkeypatch.setattr(apply, "make_hard_links", seen)
    got = disk_queries.QUERIES["disk_links"](spark, str(tmp_path))
    assert rows(got) == sorted(((f"/l{3 * k}", f"/new/{3 * k}", True) for k in range(5, 1_005)), key=repr) and most[0] < 200
    shared = lineage.shared_dir(spark).removeprefix("file:").removeprefix("//")
    assert not [x for x in os.listdir(shared) if x.startswith("disk-")]


def test_packed_rows(spark):
    df = spark.range(25_000, numPartitions=3).selectExpr("id", "if(id % 7 = 0, null, 'n' || id) as s", "id % 2 = 0 as b")
    got = lineage.cut_packed(df)
    assert got.schema.names == df.schema.names and got.exceptAll(df).isEmpty() and got.count() == 25_000 and lineage.cut_packed(df.filter("id < 0")).isEmpty()


def test_making_and_filling(spark, tmp_path):
    made = generate.random_tree(spark, str(tmp_path), items=60, levels=3, max_size=50, seed=4)
    again = generate.random_tree(spark, str(tmp_path), items=60, levels=3, max_size=50, seed=4)
    assert rows(made) == rows(again) and rows(made) != rows(generate.random_tree(spark, str(tmp_path), items=60, levels=3, max_size=50, seed=5))
    assert made.select("name").distinct().count() == 60
    apply.make_directories(made)
    apply.make_files(made)
    apply.fill_files(chunks.explode_chunks(made, 16), 65)
    apply.make_links(made.filter("type = 'LINK'").withColumn("target", F.lit("x")))
    assert rows(walk.walk(spark, str(tmp_path)).filter("type = 'FILE'"), "name", "size") == rows(made.filter("type = 'FILE'"), "name", "size")
    assert generate.fill_bytes("alternate", 3) == b"\xaa" * 3 and len(generate.fill_bytes("random", 9)) == 9
    assert made.select(generate.item_number(F.col("name")).alias("n")).distinct().count() == 60


def test_archive_round_trip(spark, tmp_path):
    root = tree(tmp_path / "r")
    long = "n" * 120
    os.makedirs(f"{root}/{long}")
    open(f"{root}/{long}/{long}", "w").write("x" * 1000)
    out = str(tmp_path / "a.tar")
    df = walk.walk(spark, root)
    layout = archive.create_archive(df, root, out).collect()
    with tarfile.open(out) as t:
        assert sorted(t.getnames()) == sorted(snapshot(root))
    assert {r.entry_offset for r in layout} == {r.entry_offset for r in archive.read_index(spark, out).select("entry_offset").collect()} or len(layout) == archive.read_index(spark, out).count()
    dest = str(tmp_path / "x")
    archive.save_index(archive.read_index(spark, out), out)
    assert rows(archive.load_index(spark, out)) == rows(archive.read_index(spark, out))
    assert archive.extract(archive.load_index(spark, out), out, dest) == len(layout)
    strip = lambda s: {k: v if isinstance(v, str) else v[:2] for k, v in s.items()}
    assert strip(snapshot(dest)) == strip(snapshot(root))


@pytest.mark.parametrize("size", [0, 1, 99_999, 100_000, 250_001])
def test_block_compression(spark, tmp_path, size):
    src = tmp_path / "s"
    src.write_bytes(os.urandom(size // 2) + b"z" * (size - size // 2))
    done = blockzip.compress_file(spark, str(src), str(tmp_path / "p"), blocksize=1)
    foot = blockzip.read_footer(str(tmp_path / "p"))
    assert foot["bytes"] == size and foot["blocks"] == done["blocks"] == -(-size // 100_000)
    blockzip.decompress_file(spark, str(tmp_path / "p"), str(tmp_path / "q"))
    assert (tmp_path / "q").read_bytes() == src.read_bytes()
    with pytest.raises(FileExistsError):
        blockzip.decompress_file(spark, str(tmp_path / "p"), str(tmp_path / "q"))
    with pytest.raises(ValueError):
        blockzip.read_footer(str(src))


def test_lists_round_trip(spark, tmp_path):
    root = tree(tmp_path / "r")
    df = E.conform(walk.walk(spark, root))
    n = lists.write_binary(df, str(tmp_path / "l4"), users=[(0, "root"), (7, "ümit")], groups=[(0, "wheel")])
    assert n == df.count() and rows(lists.read_list(spark, str(tmp_path / "l4"))) == rows(df) and rows(lists.read_binary(spark, str(tmp_path / "l4"), split=2)) == rows(df)
    head = lists.read_header(str(tmp_path / "l4"))
    assert head["users"] == [(0, "root"), (7, "ümit")] and head["groups"] == [(0, "wheel")] and head["version"] == 4
    lists.write_lite(df, str(tmp_path / "lite"))
    assert rows(lists.read_list(spark, str(tmp_path / "lite"))) == rows(E.lite(df))
    df.write.parquet(str(tmp_path / "pq"))
    assert rows(lists.read_list(spark, str(tmp_path / "pq"))) == rows(df)
    lists.write_binary(df.limit(0), str(tmp_path / "none"))
    assert lists.read_list(spark, str(tmp_path / "none")).count() == 0
    lists.write_text(df.withColumns({"user": F.lit("u"), "group": F.lit("g")}), str(tmp_path / "text"))
    assert any("-rw-r----- u g  12.000   B" in r.value for r in spark.read.text(str(tmp_path / "text")).collect())


def test_version_3_lists(spark, tmp_path):
    rec = b"/a".ljust(8, b"\0") + struct.pack(lists.RECORD, 0o100644, 1, 2, 3, 4, 5, 6, 7, 8, 9)
    p = tmp_path / "l3"
    p.write_bytes(struct.pack(">9Q", 3, 100, 200, 1, 8, 0, 0, 1, 8) + b"bob".ljust(8, b"\0") + struct.pack(">Q", 1) + rec)
    assert rows(lists.read_list(spark, str(p)), "name", "type", "uid", "gid", "mtime", "size") == [("/a", "FILE", 1, 2, 5, 9)]
    assert lists.read_header(str(p))["users"] == [(1, "bob")] and lists.read_header(str(p))["end"] == 200


def test_lite_names_with_bars(spark):
    df = spark.createDataFrame([("/a|b|F",), ("/c|D\r",), ("/d",), ("/e|Q",), ("",)], "v string")
    assert rows(lists.parse_lite(df, "v"), "name", "type") == [("/a|b", "FILE"), ("/c", "DIR"), ("/d", "UNKNOWN"), ("/e", "UNKNOWN")]


def test_duplicates_and_search_of_files(spark, tmp_path):
    root = tree(tmp_path / "r")
    assert rows(duplicates.duplicate_files(walk.walk(spark, root)), "name") == [(f"{root}/d1/d2/f2",), (f"{root}/d1/f1",)]
    assert [r.line for r in textsearch.grep_files(spark, f"{root}/f0", "wor").collect()] == ["world"]
    assert chunks.read_chunks(chunks.explode_chunks(walk.walk(spark, root), 5)).filter("digest is null").count() == 0


@pytest.mark.parametrize("strategy", ["spread", "sorted", "parent"])
def test_removal_strategies(spark, tmp_path, strategy):
    root = tree(tmp_path / "r")
    plan = plans.remove_plan(walk.walk(spark, root))
    apply.run_remove(spark.createDataFrame(plan.collect(), plan.schema), strategy)
    assert not os.path.exists(root)
    with pytest.raises(ValueError):
        apply.dealt(plan, "other")


def test_single_paths_and_file_systems(spark, tmp_path):
    root = tree(tmp_path / "r")
    df = E.append(E.conform(walk.walk(spark, f"{root}/d1")), E.conform(walk.stat_paths(spark, [root, f"{root}/none"])))
    assert df.count() == 8 and df.filter("name like '%none' and mode is null").count() == 1
    table = tmp_path / "mounts"
    table.write_text(f"a / ext rw 0 0\nb {tmp_path} fast rw 0 0\n")
    assert walk.file_system_of(root, str(table)) == "fast" and walk.file_system_of("/", str(table)) == "ext" and walk.file_system_of("/", "/no/table") is None


def test_machine_tables(spark):
    assert owners.users(spark).filter("name = 'root'").count() == 1 and owners.groups(spark).count() > 0
    assert owners.user_id("root") == 0 and owners.user_id("12") == 12
    with pytest.raises(ValueError):
        owners.group_id("no such")
    a = owners.PathArgument.of("/etc/../tmp/.")
    assert a.path == "/tmp" and a.is_dir and a.exists and a.readable()


def test_commands(spark):
    df = spark.createDataFrame([("echo hi",), ("exit 3",)], "command string")
    assert rows(apply.run_commands(df)) == [("echo hi", 0, "hi\n"), ("exit 3", 3, "")]


def test_repartitioning_keeps_rows(spark, tmp_path):
    df = walk.walk(spark, tree(tmp_path / "r")).select("name", "depth")
    for moved in (order.by_parent(df, 3), order.spread(df, 3), order.remap(df, F.col("depth"), 2)):
        assert rows(moved) == rows(df)


def test_a_flat_and_a_deep_tree_are_dealt_out_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "FIRST_ROUND", 3)
    (tmp_path / "flat").mkdir()
    for i in range(50):
        (tmp_path / "flat" / str(i)).write_text("x")
    os.makedirs(tmp_path / "/".join(["deep", *map(str, range(30))]))
    got = walk.walk(spark, [str(tmp_path)], partitions=4)
    assert got.count() == got.select("name").distinct().count() == 1 + 51 + 31
    first = rows(got, "name")
    (tmp_path / "late").write_text("x")
    assert rows(got, "name") == first  # the walk happened once


def test_mounts_are_rows(spark):
    with open("/proc/mounts") as f:
        assert walk.mounts(spark).count() == len(f.readlines()) > 0


def test_bytes_are_compared_and_only_unlike_sections_written(spark, tmp_path, capsys):
    from treeline.cli import main

    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        d.mkdir()
        (d / "same").write_bytes(b"q" * 3_000_000)
        (d / "byte").write_bytes(b"q" * 3_000_000)
        os.utime(d / "byte", (10**9, 10**9))
    with open(b / "byte", "r+b") as f:
        f.seek(2_500_000)
        f.write(b"Q")
    os.utime(b / "byte", (10**9, 10**9))
    os.utime(b / "same", (1, 1))  # equal bytes, other time
    common, differ = "EXIST=COMMON@CONTENT=COMMON", "EXIST=COMMON@CONTENT=DIFFER"
    main(["cmp", "-o", common, "-o", differ, str(a), str(b)], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[0].split("\t") == [common, "1", "2"] and out[1].split("\t") == [differ, "1", "1"]
    main(["cmp", "--lite", "-o", differ, str(a), str(b)], spark)
    assert capsys.readouterr().out.splitlines()[0].split("\t")[2] == "1"  # the one of other time
    pairs = compare.file_pairs(compare.sides(walk.walk(spark, str(a)), walk.walk(spark, str(b)), str(a), str(b)))
    assert rows(chunks.unlike_sections(pairs)) == [("/byte", 2 << 20, 3_000_000 - (2 << 20))]
    inode = os.stat(b / "byte").st_ino
    main(["sync", "--contents", str(a), str(b)], spark)
    assert (b / "byte").read_bytes() == (a / "byte").read_bytes() and os.stat(b / "byte").st_ino == inode
    assert os.stat(b / "same").st_mtime_ns == os.stat(a / "same").st_mtime_ns


def test_an_archive_is_indexed_by_many_tasks(spark, tmp_path):
    inner, src, out = tmp_path / "inner.tar", tmp_path / "s", str(tmp_path / "o.tar")
    src.mkdir()
    with tarfile.open(inner, "w") as t:
        for i in range(40):
            (tmp_path / "x").write_bytes(bytes([i]) * 700)
            t.add(tmp_path / "x", arcname=f"in/{i}")
    for i in range(30):
        (src / f"f{i}").write_bytes(b"y" * (i * 300))
    (src / "nested").write_bytes(inner.read_bytes())  # headers that aren't entries
    (src / ("long" * 40)).write_text("z")
    with tarfile.open(out, "w") as t:
        t.add(src, arcname="s")
    with tarfile.open(out) as t:
        want = sorted((m.name, m.offset, m.offset_data) for m in t)
    for stretch in (512, 4096, 1 << 20):
        assert rows(archive.read_index(spark, out, stretch), "name", "entry_offset", "data_offset") == sorted(want, key=repr)


def test_nothing_is_extracted_outside(spark, tmp_path):
    out, dest, other = str(tmp_path / "e.tar"), tmp_path / "dest", tmp_path / "other"
    other.mkdir()
    with tarfile.open(out, "w") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, str(other)
        t.addfile(link)
        for name in ("l/evil", "../evil", "ok"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    archive.extract(archive.read_index(spark, out), out, str(dest))
    os.path.isdir(dest / "l") and not os.path.islink(dest / "l") or (dest / "l").unlink()
    (dest / "l2").symlink_to(other)
    assert os.listdir(other) == [] and (dest / "ok").read_bytes() == b"abc" and not (tmp_path / "evil").exists()


def test_times_of_parents_stay_in_a_traceless_removal(spark, tmp_path):
    root = tree(tmp_path / "r")
    os.utime(root, ns=(5 * 10**9 + 7, 6 * 10**9 + 8))
    gone = walk.walk(spark, root).filter(f"name = '{root}/f0'")
    assert apply.run_remove(plans.remove_plan(gone), traceless=True) == 1
    # the walk has read the directory, which may change its time of access
    assert not os.path.exists(f"{root}/f0") and os.stat(root).st_mtime_ns == 6 * 10**9 + 8


def test_files_filled_at_random_are_the_same_each_time(spark, tmp_path):
    found = []
    for d in ("a", "b"):
        name = str(tmp_path / "f")
        files = spark.createDataFrame([(name, "FILE", 5000)], "name string, type string, size bigint")
        apply.fill_files(chunks.explode_chunks(files, 1024), "random", 3)
        found.append(open(name, "rb").read())
    assert found[0] == found[1] and len(found[0]) == 5000 and len(set(found[0])) > 200
