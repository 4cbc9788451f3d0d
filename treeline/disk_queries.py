"""Queries of what operators leave on disk: the tables become real files in the shared folder, and the result is read from them.

Each has SQL over the tables that says what must lie there. They need a shared folder that
tasks can open as files.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import entries as E
from treeline.functions.paths import basename, strip_root
from treeline.operators import apply, archive, blockzip, chunks, compare, plans, relink, sync
from treeline.plans import lineage
from treeline.sources import lists, walk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@contextmanager
def folder(spark: SparkSession, many: bool = False) -> Iterator[str]:
    shared = lineage.shared_dir(spark)
    path = f"{shared}/disk-{uuid.uuid4().hex}"
    root = path.removeprefix("file://").removeprefix("file:")
    yield root
    if many:
        clear(spark, root)
    lineage.drop(path, spark)


def clear(spark: SparkSession, root: str) -> None:
    """Delete the directories two levels below ``root`` by tasks; the driver couldn't list millions of files."""
    inner = lambda d: [e.path for e in os.scandir(d) if e.is_dir(follow_symlinks=False)]
    found = [p for d in inner(root) for p in inner(d)]
    if found:
        spark.sparkContext.parallelize(found, min(len(found), 64)).foreach(lambda p: shutil.rmtree(p, ignore_errors=True))


def on_disk(sql: str, many: bool = False) -> Callable:
    """A query that works in a folder of its own; what it returns is written down before the folder goes.

    ``many``: it returns and leaves so many items that rows are written in batches and files deleted by tasks.
    """

    def note(f: Callable) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            with folder(spark, many) as root:
                return (lineage.cut_packed if many else lineage.cut)(f(spark, d, root))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return run

    return note


def put_texts(spark: SparkSession, d: str, root: str, content: Column | None = None, keep: Column | None = None) -> None:
    """The documents as files below ``root``, with their texts or other contents."""
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    docs = docs if keep is None else docs.filter(keep)
    files = E.documents_as_entries(docs.withColumn("text", F.col("text") if content is None else content))

    def write(rows: Iterator) -> None:
        for r in rows:
            path = root + r["name"]
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r["content"])

    os.makedirs(root, exist_ok=True)
    files.select("name", F.col("content").cast("binary").alias("content")).foreachPartition(write)


def digests(spark: SparkSession, root: str) -> DataFrame:
    """``rel``, ``sha256`` of the files that lie below ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                with open(name, "rb") as f:
                    out.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["name", "sha256"])

    found = walk.walk(spark, root).filter("type = 'FILE'").select("name").mapInArrow(run, "name string, sha256 string")
    return found.select(strip_root("name", root).alias("rel"), "sha256")


_DOCS = "docs as (select '/corpus/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id as rel, doc_id, text from documents where text is not null)"
_WHOLE = f"with {_DOCS} select rel, sha256(text) as sha256 from docs"


@on_disk(f"""with {_DOCS}
select rel, 'FILE' as type, strlen(text) as size from docs
union all select distinct regexp_replace(rel, '/[^/]*$', ''), 'DIR', null from docs
union all select distinct regexp_replace(rel, '/[^/]*/[^/]*$', ''), 'DIR', null from docs
union all select * from (values ('/corpus', 'DIR', null), ('', 'DIR', null)) v""")
def disk_walk(spark: SparkSession, d: str, root: str) -> DataFrame:
    put_texts(spark, d, root)
    found = walk.walk(spark, root)
    return found.select(strip_root("name", root).alias("rel"), "type", F.when(F.col("type") == "FILE", F.col("size")).alias("size"))


@on_disk(_WHOLE)
def disk_copy(spark: SparkSession, d: str, root: str) -> DataFrame:
    put_texts(spark, d, f"{root}/a")
    apply.run_copy(plans.copy_plan(walk.walk(spark, f"{root}/a"), [(f"{root}/a", f"{root}/b")]), batch=5_000)
    return digests(spark, f"{root}/b")


@on_disk(_WHOLE)
def disk_archive(spark: SparkSession, d: str, root: str) -> DataFrame:
    """Files archived by many tasks, indexed by many, and extracted."""
    put_texts(spark, d, f"{root}/a")
    tar = f"{root}/a.tar"
    archive.create_archive(walk.walk(spark, f"{root}/a"), f"{root}/a", tar).count()
    archive.extract(archive.read_index(spark, tar, 1 << 20), tar, f"{root}/b")
    return digests(spark, f"{root}/b")


@on_disk(_WHOLE)
def disk_sync(spark: SparkSession, d: str, root: str) -> DataFrame:
    """A copy with some files gone, some longer, some with other bytes of the same length and time, and some too many, made equal again."""
    a, b, i = f"{root}/a", f"{root}/b", F.col("doc_id")
    put_texts(spark, d, a)
    other = F.when(i % 3 == 0, F.concat("text", F.lit("+"))).when(i % 3 == 1, F.translate("text", "e", "E")).otherwise(F.col("text"))
    put_texts(spark, d, b, other, i % 7 != 0)
    put_texts(spark, d, f"{b}/more", None, i % 11 == 0)
    still = lambda rows: [os.utime(r["name"], (10**9, 10**9)) for r in rows] and None
    for root_ in (a, b):
        walk.walk(spark, root_).filter("type = 'FILE'").select("name").foreachPartition(still)
    src, dst = walk.walk(spark, a), walk.walk(spark, b)
    pairs = compare.file_pairs(compare.sides(src, dst, a, b, ["name", "type", "size"]))
    unlike = lineage.cut(chunks.unlike_sections(pairs, 4096))
    apply.run_sync(sync.sync_plan(src, dst, a, b, delete=True, contents=True, target="target", unlike=unlike), a, b, sections=unlike)
    return digests(spark, b)


@on_disk(f"""with {_DOCS}, c as (select rel, text as x, case when doc_id % 3 = 1 then translate(text, 'e', 'E') else text end as y from docs)
select rel, x <> y as unlike from c""")
def disk_compare(spark: SparkSession, d: str, root: str) -> DataFrame:
    """Pairs of files of one size compared byte by byte."""
    a, b = f"{root}/a", f"{root}/b"
    put_texts(spark, d, a)
    put_texts(spark, d, b, F.when(F.col("doc_id") % 3 == 1, F.translate("text", "e", "E")).otherwise(F.col("text")))
    src, dst = walk.walk(spark, a), walk.walk(spark, b)
    unlike = chunks.unlike_sections(compare.file_pairs(compare.sides(src, dst, a, b, ["name", "type", "size"])), 4096)
    out = compare.compare(src, dst, a, b, ["EXIST=COMMON@CONTENT=DIFFER"], unlike=unlike)
    return out.filter("s.type = 'FILE'").select("rel", (F.col("CONTENT") == "DIFFER").alias("unlike"))


@on_disk(f"with {_DOCS} select rel, sha256(text) as sha256 from docs where doc_id % 2 = 1")
def disk_remove(spark: SparkSession, d: str, root: str) -> DataFrame:
    """Every second file removed, by each way of dealing removals out."""
    put_texts(spark, d, root)
    number = F.regexp_extract("name", "/([0-9]+)$", 1).cast("long")
    plan = plans.remove_plan(walk.walk(spark, root).filter("type = 'FILE'").filter(number % 2 == 0))
    for k, strategy in enumerate(("spread", "sorted", "parent")):
        apply.run_remove(plan.filter(number % 6 == 2 * k), strategy, traceless=strategy == "sorted")
    return digests(spark, root)


@on_disk(f"with {_DOCS} select rel, case when doc_id % 2 = 0 then 320 else 416 end::bigint as perm from docs")
def disk_chmod(spark: SparkSession, d: str, root: str) -> DataFrame:
    put_texts(spark, d, root)
    files = walk.walk(spark, root).filter("type = 'FILE'")
    even = F.regexp_extract("name", "/([0-9]+)$", 1).cast("long") % 2 == 0
    apply.run_chmod(plans.chmod_plan(files.filter(even), "500"))
    apply.run_chmod(plans.chmod_plan(files.filter(~even), "u+rw,g+r,o-rwx,a-x,g-w"))
    return walk.walk(spark, root).filter("type = 'FILE'").select(strip_root("name", root).alias("rel"), F.col("mode").bitwiseAND(F.lit(0o777).cast("long")).alias("perm"))


#: Links of a directory, on average: a directory admits one change at a time, so one that held them all would be the work of one task.
LINKS_OF_DIRECTORY = 4_096


@on_disk("select '/l' || o_orderkey as rel, '/new/' || o_orderkey as target, true as twin from orders", many=True)
def disk_links(spark: SparkSession, d: str, root: str) -> DataFrame:
    """Symbolic links pointed elsewhere, and a second name for each. They lie in directories by a hash of their keys, which ``rel`` leaves out."""
    a, b = f"{root}/a", f"{root}/b"
    keys = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("k"))
    n = max(1, -(-keys.count() // LINKS_OF_DIRECTORY))
    apply.make_directories(spark.range(n).select(F.explode(F.array(F.concat(F.lit(f"{a}/"), "id"), F.concat(F.lit(f"{b}/"), "id"))).alias("name"), F.lit("DIR").alias("type"), F.lit(0).alias("depth")))
    dealt = keys.withColumn("dir", F.pmod(F.xxhash64("k"), F.lit(n))).repartition(min(n, 64), "dir")
    apply.make_links(dealt.select(F.concat(F.lit(f"{a}/"), "dir", F.lit("/l"), "k").alias("name"), F.concat(F.lit("/old/"), "k").alias("target")))
    links = lambda: walk.walk(spark, a, columns=["name", "type", "target"]).filter("type = 'LINK'")
    apply.run_relink(relink.relink_plan(links(), "/old/", "/new/"), written=True)
    found = links().select("name", "target", F.concat(F.lit(b), strip_root("name", a)).alias("second"))
    apply.make_hard_links(found.select(F.col("name").alias("source"), F.col("second").alias("name")))
    return read_twins(found).select(F.concat(F.lit("/"), basename("name")).alias("rel"), "target", F.col("t").eqNullSafe(F.col("target")).alias("twin"))


def read_twins(found: DataFrame) -> DataFrame:
    """``name``, ``target`` and ``t``, to which the link of the name ``second`` points; null where there is none."""

    def target(name: str) -> str | None:
        try:
            return os.readlink(name)
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:2], pa.array([target(x) for x in batch.column(2).to_pylist()], pa.string())], names=["name", "target", "t"])

    return found.select("name", "target", "second").mapInArrow(run, "name string, target string, t string")


_NUMBERS = ("mode", "uid", "gid", "atime", "atime_nsec", "mtime", "mtime_nsec", "ctime", "ctime_nsec", "size")


@on_disk(f"select name, type, {', '.join(f'coalesce({c}, 0) as {c}' for c in _NUMBERS)} from (select distinct * from tree_src) where mode is not null")
def disk_binary_list(spark: SparkSession, d: str, root: str) -> DataFrame:
    """A list written in its binary form by many tasks, and read again by many. Items without mode have no type there and are left out of the result."""
    os.makedirs(root)
    tree = E.conform(spark.read.parquet(f"{d}/tree_src.parquet").distinct())
    lists.write_binary(tree, f"{root}/list")
    back = lists.read_list(spark, f"{root}/list").filter("mode <> 0")
    return back.select("name", "type", *_NUMBERS)


@on_disk("select name, type from entries")
def disk_lite_list(spark: SparkSession, d: str, root: str) -> DataFrame:
    lists.write_lite(spark.read.parquet(f"{d}/entries.parquet"), f"{root}/list")
    return lists.read_list(spark, f"{root}/list").select("name", "type")


@on_disk("select 'documents' as name, true as same, true as smaller")
def disk_block_file(spark: SparkSession, d: str, root: str) -> DataFrame:
    """All texts in one file, compressed by blocks and unpacked again."""
    put_texts(spark, d, f"{root}/a")
    apply.run_commands(spark.createDataFrame([(f"find {root}/a -type f | sort | xargs cat > {root}/all",)], "command string")).collect()
    packed = blockzip.compress_file(spark, f"{root}/all", f"{root}/all.z", blocksize=1, keep=True)
    blockzip.decompress_file(spark, f"{root}/all.z", f"{root}/back")
    with open(f"{root}/all", "rb") as f, open(f"{root}/back", "rb") as g:
        same = hashlib.file_digest(f, "sha256").digest() == hashlib.file_digest(g, "sha256").digest()
    return spark.createDataFrame([("documents", same, 0 < packed["packed"] < packed["bytes"])], "name string, same boolean, smaller boolean")
