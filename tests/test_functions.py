import fnmatch
import posixpath
import re
import shutil
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeline.functions import maps, modes, paths, patterns, scalars, times


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [("10", 10), ("1.5k", 1536), ("2KB", 2048), ("3m", 3 << 20), (".5g", 1 << 29), ("1e", 1 << 60), ("0", 0), ("2b", 2)])
def test_sizes_are_parsed(spark, text, want):
    assert scalars.parse_bytes(text) == want and one(spark, scalars.parse_bytes_col(F.col("t")), t=text) == want


@pytest.mark.parametrize("text", ["3x", "-1", "1kbb", "", "k", "1 0", "99999e"])
def test_bad_sizes_are_rejected(spark, text):
    with pytest.raises(ValueError):
        scalars.parse_bytes(text)
    if text != "99999e":
        assert one(spark, scalars.parse_bytes_col(F.col("t")), t=text) is None


@pytest.mark.parametrize(("n", "want"), [(0, "0.000 B"), (1000, "1000.000 B"), (1001, "0.978 KiB"), (1024, "1.000 KiB"), (1025, "1.001 KiB"), (1 << 20, "1.000 MiB"), (1600, "1.562 KiB"), (1 << 62, "4.000 EiB")])
def test_sizes_are_shown(spark, n, want):
    assert one(spark, scalars.show_bytes(F.col("n")), n=n) == want


def test_counts_modes_and_times(spark):
    assert [one(spark, scalars.show_count(F.col("n")), n=n) for n in (0, 1000, 1001, 1_234_567)] == ["0.000", "1000.000", "1.001 k", "1.235 M"]
    assert one(spark, scalars.show_mode(F.col("m")), m=0o040755) == "drwxr-xr-x"
    assert one(spark, scalars.show_mode(F.col("m")), m=0o107777) == "-rwxrwxrwx"
    assert one(spark, times.show_time(F.col("t")), t=1735787045) == "Jan  2 2025 03:04"
    assert [scalars.even_share(10, 4, i) for i in range(4)] == [(0, 3), (3, 3), (6, 2), (8, 2)]
    assert [one(spark, scalars.round_up(F.col("n")), n=n) for n in (0, 1, 512, 513)] == [0, 512, 512, 1024]


@pytest.mark.parametrize(("path", "want"), [("/a//b/./c/..", "/a/b"), ("../x", "../x"), ("/..", "/"), ("a/..", "."), ("", "."), ("/", "/"), ("../../x/..", "../.."), ("/a/../../b/", "/b")])
def test_paths_are_reduced(spark, path, want):
    assert paths.reduce_text(path) == want and one(spark, paths.reduce(F.col("p")), p=path) == want


@settings(max_examples=40, deadline=None)
@given(parts=st.lists(st.sampled_from(["a", "b", "..", ".", ""]), max_size=8))
def test_reduce_agrees_with_normpath(spark, parts):
    path = "/" + "/".join(parts)
    want = "/" + posixpath.normpath(path).lstrip("/")
    assert paths.reduce_text(path) == want == one(spark, paths.reduce(F.col("p")), p=path)


def test_path_pieces(spark):
    p = F.col("p")
    get = lambda c, v: one(spark, c, p=v)
    assert [get(paths.dirname(p), v) for v in ("/a/b", "/a", "a", "/a/b/")] == ["/a", "", "", "/a/b"]
    assert [get(paths.basename(p), v) for v in ("/a/b", "a", "/a/")] == ["b", "a", ""]
    assert get(paths.depth(p), "/a/b/c") == 3
    assert get(paths.slice_path(p, -2), "/a/b/c") == "b/c" and get(paths.slice_path(p, 1, 1), "/a/b/c") == "b"
    assert get(paths.insert(p, 1, "x"), "/a/b") == "/a/x/b" and get(paths.insert(p, -1, "x"), "/a/b") == "/a/b/x"
    assert [get(paths.below(p, "/a/b"), v) for v in ("/a/bc", "/a/b", "/a/b/c", "/a/b/")] == [False, False, True, False]
    assert [get(paths.strip_root(p, "/a"), v) for v in ("/a", "/a/b", "/ab")] == ["", "/b", None]
    assert [get(paths.relation(p, F.lit("/a/b")), v) for v in ("/a/b", "/a/b/c", "/a", "/a/bc", "/")] == ["EQUAL", "CHILD", "PARENT", "DIFF", "PARENT"]
    assert [get(paths.move_root(p, [("/a/b", "/x"), ("/a", "/y")]), v) for v in ("/a/b/c", "/a/bc", "/z", "/a")] == ["/x/c", "/y/bc", None, "/y"]
    for a, b in (("/a/b", "/a/c/d"), ("/a", "/a"), ("/a/b/c", "/a"), ("/x", "/")):
        assert get(paths.relative(p, F.lit(b)), a) == posixpath.relpath(a, b) == paths.relative_text(a, b)


@pytest.mark.parametrize(("glob", "text", "want"), [
    ("*", ".hidden", False), (".*", ".hidden", True), ("?x", ".x", False), ("[.]x", ".x", False), ("a*", "a/b", True), ("a?b", "a/b", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False),
    ("a[", "a[", True), ("\\*", "*", True), ("\\*", "x", False), ("*.c", "x.c", True), ("*.c", "xyc", False), ("[[:digit:]]*", "7x", True), ("a+b", "a+b", True), ("", "", True), ("*", "a\nb", True),
])
def test_globs(spark, glob, text, want):
    assert one(spark, patterns.matches_glob(F.col("t"), glob), t=text) is want


@settings(max_examples=60, deadline=None)
@given(glob=st.text("ab*?[]-!/.", max_size=6), text=st.text("ab-/.!]", max_size=5))
def test_globs_agree_with_fnmatch_apart_from_dots(spark, glob, text):
    if glob[:1] in ("*", "?", "[") and text.startswith(".") or "[!" in glob and "]" not in glob.split("[!", 1)[1][1:]:
        return
    try:
        want = re.match(fnmatch.translate(glob), text) is not None
    except re.error:
        return
    if re.search(r"\[[^\]]*-[^\]]*\]|\[\]|\[!\]|\[[^\]]*\[", glob):
        return
    assert one(spark, patterns.matches_glob(F.col("t"), glob), t=text) is want


BASIC = ["a\\(b\\)c", "a+b", "a\\+b", "^a", "a$", "a*", "*a", "\\(a\\|b\\)c", "a\\{2\\}", "a\\{1,2\\}b", "[a-c]x", "[^a]", "[[:alpha:]]1", "a|b", "(a)", "a{2}", "x\\.y", "\\(a*\\)b\\1", "a^b", "a$b", "[]a]", "[]]", "."]
TEXTS = ["abc", "a+b", "aab", "ab", "aa", "b", "*a", "bc", "ac", "a|b", "(a)", "a{2}", "x.y", "xxy", "cx", "q1", "a^b", "a$b", "]", "", "aabaa"]


def test_basic_regexes_agree_with_grep(spark):
    if not shutil.which("grep"):
        pytest.skip("no grep")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").cache()
    for p in BASIC:
        want = [subprocess.run(["grep", "-q", "--", p], input=t + "\n", text=True, check=False).returncode == 0 for t in TEXTS]
        got = [r[0] for r in df.orderBy("i").select(F.col("t").rlike(patterns.basic_regex(p))).collect()]
        assert got == want, p


@pytest.mark.parametrize("bad", ["[a", "\\(a", "a\\)", "a\\{x\\}", "a\\"])
def test_bad_basic_regexes(bad):
    with pytest.raises(ValueError):
        patterns.basic_regex(bad)


@pytest.mark.parametrize(("change", "kind", "mode", "want"), [
    ("755", "FILE", 0o104644, 0o100755), ("u+rwX", "FILE", 0o100000, 0o100600), ("u+rwX", "DIR", 0o040000, 0o040700), ("g=u", "FILE", 0o100640, 0o100660), ("a-x", "FILE", 0o100755, 0o100644),
    ("+w", "FILE", 0o100444, 0o100644), ("g+X", "FILE", 0o100644, 0o100644), ("go+X", "FILE", 0o100744, 0o100755), ("g-X", "FILE", 0o100755, 0o100745), ("u-X", "FILE", 0o100755, 0o100755),
    ("a+rX,o-w", "DIR", 0o040002, 0o040555), ("uo=g", "FILE", 0o100750, 0o100555), ("-r", "FILE", 0o100777, 0o100333), ("7", "FILE", 0o100777, 0o100007),
])
def test_mode_changes(spark, change, kind, mode, want):
    assert oct(one(spark, modes.new_mode(F.col("m"), F.col("k"), change), m=mode, k=kind)) == oct(want)


def test_times_in_two_parts(spark):
    for n in (0, 1, -1, 1_700_000_000_123_456_789, -1_500_000_000):
        s, k = times.split_nanos(F.col("n"))
        assert one(spark, F.struct(s, k), n=F.lit(n).cast("long")) == divmod(n, 10**9)
        assert one(spark, times.join_nanos(s, k), n=F.lit(n).cast("long")) == n


def test_maps(spark):
    m = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    get = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    k = F.lit
    assert get(maps.put(m, k("a"), k("9"))) == {"a": "9", "b": "1"} and get(maps.put(maps.empty(), k("z"), k("0"))) == {"z": "0"}
    assert get(maps.get(m, k("b"))) == "1" and get(maps.get(m, k("x"))) is None and get(maps.unset(m, k("a"))) == {"b": "1"} and get(maps.size(m)) == 2
    assert [tuple(e) for e in get(maps.ordered(m))] == [("a", "2"), ("b", "1")] and get(maps.first(m)).key == "a" and get(maps.last(m)).key == "b"
    assert get(maps.after(m, k("a"))).key == "b" and get(maps.after(m, k("b"))) is None and get(maps.before(m, k("b"))).key == "a" and get(maps.before(m, k("a"))) is None
    assert get(maps.first(maps.empty())) is None


def test_mode_texts():
    for bad in ("8", "u+", "z+r", "u=z", "77777", ""):
        with pytest.raises(ValueError):
            modes.parse_mode(bad)
    assert modes.opens_directories("u+rx") and modes.opens_directories("a+rX") and modes.opens_directories("755") and not modes.opens_directories("g+rx")
