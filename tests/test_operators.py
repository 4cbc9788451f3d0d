import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from treeline import entries as E
from treeline.operators import aggregate as A
from treeline.operators import chunks, compare, duplicates, exprs, order, plans, predicates as P, relink, sync, textsearch

DEFAULT = {"type": "FILE", "mode": 0o100644, "uid": 1, "gid": 1, "size": 1, **{c: 10 for t in E.TIMES for c in (t, f"{t}_nsec")}}


def make(spark, items):
    return E.entry_rows(spark, [{**DEFAULT, **({"mode": 0o040755} if i.get("type") == "DIR" else {"mode": 0o120777} if i.get("type") == "LINK" else {}), **i} for i in items])


def names(df):
    return sorted(r.name for r in df.collect())


def test_ages_floor_and_clip(spark):
    now = (100_000, 500)
    df = make(spark, [{"name": "future", "mtime": 200_000}, {"name": "just2", "mtime": 100_000 - 120, "mtime_nsec": 500}, {"name": "short", "mtime": 100_000 - 120, "mtime_nsec": 501}, {"name": "old", "mtime": 5}])
    assert names(P.find(df, P.minutes("mtime", "0", now))) == ["future"]
    assert names(P.find(df, P.minutes("mtime", "2", now))) == ["just2"]
    assert names(P.find(df, P.minutes("mtime", "1", now))) == ["short"]
    assert names(P.find(df, P.days("mtime", "+0", now))) == ["old"]
    assert names(P.find(df, P.days("mtime", "-1", now))) == ["future", "just2", "short"]


@pytest.mark.parametrize("bad", ["+1.5", "x", "", "1k"])
def test_fractions_of_time_are_rejected(bad):
    with pytest.raises(ValueError):
        P.minutes("mtime", bad, (0, 0))


def test_bad_sizes_and_types_are_rejected():
    with pytest.raises(ValueError):
        P.size("+3x")
    with pytest.raises(ValueError):
        P.type_is("q")


def test_lite_rows_never_pass_and_missing_columns_raise(spark):
    df = E.lite(make(spark, [{"name": "/a"}]))
    assert P.find(df, P.size("+0")).count() == 0 and not E.has_detail(df)
    with pytest.raises(ValueError):
        P.find(spark.createDataFrame([("/a",)], "name string"), P.size("+0"))


def test_newer_is_strict(spark):
    df = make(spark, [{"name": n, "mtime": 5, "mtime_nsec": k} for n, k in (("a", 4), ("b", 5), ("c", 6))])
    assert names(P.find(df, P.newer("mtime", 5, 5))) == ["c"]


def test_regex_filters(spark):
    df = make(spark, [{"name": "/x/ab"}, {"name": "/ab/x"}])
    assert names(P.filter_regex(df, "a", only_basename=True)) == ["/x/ab"]
    assert names(P.filter_regex(df, "b$", exclude=True)) == ["/ab/x"]
    assert names(P.filter_regex(df, None)) == []
    hit, rest = P.filter_regex(df, "b/"), P.filter_regex(df, "b/", exclude=True)
    assert sorted(names(hit) + names(rest)) == names(df)


def test_functions_and_commands_as_tests(spark):
    df = make(spark, [{"name": "/etc"}, {"name": "/nowhere"}])
    assert names(P.passing_command(df, ["test", "-d", "{}"])) == ["/etc"]
    assert names(P.passing(df, lambda r: None if r["name"] == "/etc" else True)) == ["/nowhere"]


@pytest.mark.parametrize("bad", ["SIZE=ONLY_SRC", "FOO=COMMON", "", "EXIST", "EXIST=MAYBE", ",@"])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        exprs.parse(bad)


def test_expressions():
    c = exprs.parse("EXIST=COMMON@TYPE=DIFFER,,EXIST=ONLY_SRC")
    assert [[(t.field, t.state) for t in x] for x in c] == [[("EXIST", "COMMON"), ("TYPE", "DIFFER")], [("EXIST", "ONLY_SRC")]]
    assert exprs.needed(c) == {"EXIST", "TYPE"} and exprs.parse_output("EXIST=COMMON:f")[1] == "f"
    assert exprs.needed(exprs.parse("CONTENT=DIFFER")) == {"EXIST", "TYPE", "SIZE", "CONTENT"}


def two_trees(spark):
    s = [{"name": "/s"}, {"name": "/s/same"}, {"name": "/s/size", "size": 2}, {"name": "/s/type"}, {"name": "/s/dir", "type": "DIR", "size": 9}, {"name": "/s/new"}, {"name": "/s/time", "mtime": 11}, {"name": "/s/link", "type": "LINK"}]
    d = [{"name": "/d"}, {"name": "/d/same"}, {"name": "/d/size"}, {"name": "/d/type", "type": "DIR"}, {"name": "/d/dir", "type": "DIR"}, {"name": "/d/old"}, {"name": "/d/time"}, {"name": "/d/link", "type": "LINK"}, {"name": "/dx/same"}]
    t = lambda df: df.withColumn("target", F.when(F.col("name") == "/d/link", "ab").otherwise("abc"))
    return t(make(spark, s)), t(make(spark, d))


def test_comparison_states(spark):
    s, d = two_trees(spark)
    c = {r.rel: r for r in compare.states(compare.sides(s, d, "/s", "/d"), target="target").collect()}
    assert c["/same"].CONTENT == "COMMON" and c["/size"].CONTENT == "DIFFER" and c["/size"].SIZE == "DIFFER"
    assert (c["/type"].TYPE, c["/type"].CONTENT) == ("DIFFER", "DIFFER") and c["/dir"].SIZE == "COMMON" and c["/dir"].CONTENT == "COMMON"
    assert (c["/new"].EXIST, c["/new"].TYPE, c["/old"].EXIST) == ("ONLY_SRC", None, "ONLY_DEST")
    assert c["/time"].CONTENT == "DIFFER" and c["/link"].CONTENT == "DIFFER"  # a target that only begins alike
    assert c[""].EXIST == "COMMON" and c["/same"].ACL is None and len(c) == 9


def test_only_needed_fields_are_compared(spark):
    s, d = two_trees(spark)
    out = compare.compare(s, d, "/s", "/d", ["EXIST=COMMON@SIZE=DIFFER"])
    assert out.filter("MTIME is not null or CONTENT is not null or TYPE is not null").count() == 0
    assert rows(compare.matching(out, "EXIST=COMMON@SIZE=DIFFER,EXIST=ONLY_DEST"), "side", "clause", "name") == [("dest", 1, "/d/size"), ("dest", 2, "/d/old"), ("src", 1, "/s/size")]
    assert rows(compare.counts(out, ["EXIST=COMMON", "EXIST=DIFFER"])) == [("EXIST=COMMON", 1, 7, 7), ("EXIST=DIFFER", 1, 1, 1)]
    shown = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int").select(compare.show_counts(F.col("a"), F.col("b")).alias("x"))
    assert rows(shown) == [("1",), ("N/A (Src: 1 Dest: 2)",)]
    same = compare.compare(s, s, "/s", "/s")
    assert same.filter("CONTENT = 'DIFFER' or EXIST <> 'COMMON'").count() == 0


def test_sync_plans(spark):
    s, d = two_trees(spark)
    plan = rows(sync.sync_plan(s, d, "/s", "/d", delete=True, target="target"), "rel", "action")
    assert plan == [("/link", "copy"), ("/link", "remove"), ("/new", "copy"), ("/old", "remove"), ("/size", "copy"), ("/size", "remove"), ("/time", "copy"), ("/time", "refresh"), ("/time", "remove"), ("/type", "copy"), ("/type", "refresh"), ("/type", "remove")]
    assert ("/old", "remove") not in rows(sync.sync_plan(s, d, "/s", "/d"), "rel", "action")
    assert ("/old", "remove") not in rows(sync.sync_plan(s, d, "/s", "/d", delete=True, walk_errors=True), "rel", "action")
    linked = rows(sync.sync_plan(s, d, "/s", "/d", link_dest=s, link_root="/s", target="target"), "rel", "action")
    assert ("/new", "link") in linked and ("/link", "copy") in linked and ("/size", "link") in linked
    assert sync.sync_plan(s, s, "/s", "/s", delete=True).count() == 0
    with pytest.raises(sync.EmptySourceError):
        sync.check_source(s.limit(0))


def test_sync_by_contents(spark):
    s, d = two_trees(spark)
    c = lambda df, v: df.withColumn("content", F.when(F.col("name").endswith("/same"), F.lit(v)).otherwise(F.lit("x")))
    get = lambda **k: rows(sync.sync_plan(c(s, "p"), c(d, "q"), "/s", "/d", contents=True, content="content", **k), "rel", "action")
    assert ("/same", "overwrite") in get() and ("/time", "copy") not in get() and ("/time", "refresh") in get()
    assert ("/same", "remove") in get(link_dest=c(s.limit(0), "p"), link_root="/s")


def test_histogram_bins(spark):
    df = make(spark, [{"name": str(i), "size": n} for i, n in enumerate((0, 1, 2, 1024, 1025))])
    assert rows(A.histogram(df)) == [(0, None, 1, 2), (1, 1, 1024, 2), (2, 1024, 1048576, 1), (3, 1048576, None, 0)]
    assert rows(A.histogram(df, [0, 80, 100]), "n") == [(0,), (1,), (2,), (2,)]
    assert A.default_bins(0) == [1] and A.default_bins(1 << 20) == [1, 1 << 10, 1 << 20] and rows(A.histogram(df.limit(0)), "n") == [(0,), (0,)]
    for bad in ("size:1,1", "mtime:1", "size:", "size:" + ",".join(map(str, range(129)))):
        with pytest.raises(ValueError):
            A.parse_bins(bad)


def test_summaries(spark):
    df = make(spark, [{"name": "/a", "size": 3}, {"name": "/b", "size": 4}, {"name": "/c", "type": "DIR", "size": 4096}, {"name": "/d", "type": "LINK"}, {"name": "/e", "type": "UNKNOWN"}])
    assert rows(A.summary(df)) == [(5, 1, 2, 1, 1, 7, 3)]
    assert rows(A.summary(df.limit(0))) == [(0, 0, 0, 0, 0, 0, 0)]
    assert rows(A.all_true(df.select((F.col("size") > 0).alias("f")), "f")) == [(True,)] and rows(A.all_true(df.limit(0).select(F.lit(False).alias("f")), "f")) == [(True,)]


def test_children(spark):
    df = make(spark, [{"name": "/a"}, {"name": "/a/x", "size": 5}, {"name": "/a/x/y", "size": 7}, {"name": "/a/z", "size": 12}, {"name": "/ab/q"}])
    assert [tuple(r) for r in A.children(df, "/a").collect()] == [("x", 2, 12), ("z", 1, 12)]
    assert rows(A.children_report(df, "/a", 1)) == [("x", 2, 12), (None, 3, 24)]


def test_lookup_of_names(spark, monkeypatch):
    df = make(spark, [{"name": "/a", "uid": 1}, {"name": "/b", "uid": 2}, {"name": "/c", "uid": None}, {"name": "/d", "uid": 3}])
    users = spark.createDataFrame([(1, "zed"), (1, "amy"), (2, None), (None, "x")], "id bigint, name string")
    want = [("/a", "amy"), ("/b", "2"), ("/c", None), ("/d", "3")]
    assert rows(A.lookup(df, users, "uid", "user"), "name", "user") == want
    monkeypatch.setattr(A, "MOST_NAMES", 1)
    assert rows(A.lookup(df, users, "uid", "user"), "name", "user") == want


def test_positions_and_blocks(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1).alias("position_"))
    out = order.positions(df, [F.asc("k")], F.col("k"))
    assert all(r.position == r.k and r.offset == r.k * (r.k - 1) // 2 for r in out.collect())
    sizes = [r["count"] for r in order.even_blocks(df, [F.asc("k")], 7).groupBy("block").count().orderBy("block").collect()]
    assert sizes == [143] * 6 + [142]
    assert sorted(r[0] for r in order.even_blocks(spark.range(3), [F.asc("id")], 5).select("block").collect()) == [0, 1, 2]
    assert order.positions(df.limit(0), [F.asc("k")]).count() == 0


def test_sorting(spark):
    df = make(spark, [{"name": f"/{n}", "size": s, "mtime": m} for n, s, m in (("b", 1, 5), ("a", 1, 5), ("c", 2, 1), ("B", 1, 5))])
    assert [r.name for r in order.sort_entries(df, "-size").collect()] == ["/c", "/B", "/a", "/b"]
    assert [r.name for r in order.sort_entries(df, "mtime,-name").collect()] == ["/c", "/b", "/a", "/B"]
    with pytest.raises(ValueError):
        order.sort_keys("color")
    many = make(spark, [{"name": f"/{i:03}"} for i in range(30)])
    got = [(r.name, r.part) for r in order.head_and_tail(many).collect()]
    assert sorted(got) == [(f"/{i:03}", "head") for i in range(10)] + [(f"/{i:03}", "tail") for i in range(20, 30)]
    assert order.head_and_tail(many.filter("name < '/020'")).count() == 20


@pytest.mark.parametrize(("size", "n"), [(0, 1), (1, 1), (9, 1), (10, 1), (11, 2)])
def test_chunks(spark, size, n):
    got = chunks.explode_chunks(make(spark, [{"name": "/a", "size": size}, {"name": "/d", "type": "DIR"}, {"name": "/n", "size": None}]), 10).collect()
    assert len(got) == n and sum(r.length for r in got) == size and all(r.offset % 10 == 0 for r in got)


def test_chunk_ranks_and_flags(spark):
    df = spark.range(10).select("id", chunks.chunk_rank(F.col("id"), 10, 4).alias("r"))
    assert [r.r for r in df.orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    flags = spark.createDataFrame([("a", False), ("a", True), ("b", None), ("c", False)], "name string, f boolean")
    assert rows(chunks.any_of_file(flags, "f")) == [("a", True), ("b", False), ("c", False)]
    zero = spark.createDataFrame([(b"\0\0",), (b"\0a",), (b"",), (b"\x10\x01",)], "b binary").select(chunks.is_all_zero(F.col("b")).alias("z"))
    assert [r.z for r in zero.collect()] == [True, False, True, False]


def test_duplicates(spark):
    df = make(spark, [{"name": n, "size": s} for n, s in (("a", 3), ("b", 3), ("c", 3), ("d", 0), ("e", 0), ("f", 4))])
    df = df.withColumn("content", F.when(F.col("name") == "c", "xyz").when(F.col("size") == 3, "abc").otherwise(""))
    assert names(duplicates.duplicates(df)) == ["a", "b"]


def test_relinking(spark):
    df = spark.createDataFrame([("/l/a", "LINK", "/old/x/y"), ("/l/b", "LINK", "/older/x"), ("/l/c", "LINK", "old/x"), ("/l/d", "LINK", "/old"), ("/n/x", "LINK", "/old/x"), ("/f", "FILE", None)], "name string, type string, target string")
    assert rows(relink.relink_plan(df, "/old/", "/n"), "name", "new_target") == [("/l/a", "/n/x/y"), ("/n/x", "/n/x")]
    assert rows(relink.relink_plan(df, "/old", "/n", as_relative=True), "name", "new_target") == [("/l/a", "../n/x/y"), ("/n/x", "x")]


def test_plans(spark):
    df = make(spark, [{"name": "/a", "type": "DIR", "depth": 1}, {"name": "/a/b", "type": "DIR"}, {"name": "/a/b/f"}, {"name": "/a/l", "type": "LINK"}])
    steps = {r.name: r.step for r in plans.remove_plan(df).collect()}
    assert steps["/a/b/f"] == steps["/a/l"] == 0 and 0 < steps["/a/b"] < steps["/a"]
    assert rows(plans.traceless_parents(df)) == []
    got = rows(plans.copy_plan(df, [("/a", "/z")]), "dest", "action")
    assert got == [("/z", "metadata"), ("/z", "mkdir"), ("/z/b", "metadata"), ("/z/b", "mkdir"), ("/z/b/f", "copy"), ("/z/l", "symlink")]
    with pytest.raises(ValueError):
        plans.check_copy(["/a", "/b"], "/c", False, True)
    out = rows(plans.chmod_plan(df, "644"), "name", "outcome")
    assert out == [("/a", "change"), ("/a/b", "change"), ("/a/b/f", "skip"), ("/a/l", "skip")]
    assert rows(plans.chmod_plan(df, "644", force=True, only_owner=2), "outcome") == [("skip",)] * 4
    with pytest.raises(ValueError):
        plans.select_items(df, match="a", exclude="b")


def test_grep(spark):
    df = spark.createDataFrame([("a", "one\ntwo\n\nthree\n"), ("b", None), ("c", "")], "name string, content string")
    assert rows(textsearch.grep(df, "t")) == [("a", 2, "two"), ("a", 4, "three")]
    assert rows(textsearch.grep(df, "T", ignore_case=True, invert=True)) == [("a", 1, "one"), ("a", 3, "")]
