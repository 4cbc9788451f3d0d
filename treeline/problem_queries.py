"""Queries pN_ of the general problems over the test tables, with the SQL that states the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.paths import strip_root
from treeline.operators import compaction, heavy_keys, snapshot_changes, table_diff
from treeline.plans import lineage

#: Bytes of a compacted list file.
LIST_BYTES = 65_536
DIFF_FIELDS = (
    table_diff.Field("SIZE", ("size",), unless=("type", "DIR")),
    table_diff.Field("MTIME", ("mtime", "mtime_nsec")),
    table_diff.Field("MODE", ("mode",)),
)
CHANGE_FIELDS = ("mtime", "mtime_nsec", "ctime", "ctime_nsec", "size")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.crowded_directories(read(spark, d, "entries")).select("dir")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    out = compaction.compact_lists(read(spark, d, "saved_lists"), LIST_BYTES)
    return out.select("dir", "file", F.col("line").cast("long").alias("line"), "path", "type", F.col("part").isNotNull().alias("moved"))


def _lists_table(spark: SparkSession, d: str) -> compaction.CompactableTable:
    """A table of the records by directory, with a file for each stored file."""
    path = f"{lineage.shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    files = compaction.stored_files(read(spark, d, "saved_lists"))
    compaction.write_each(files, path)
    return compaction.CompactableTable(spark, path, "dir", compaction.records(files).schema)


def p1_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The records after a table of them, written by many writers, is compacted in place."""
    table = _lists_table(spark, d)
    table.compact(LIST_BYTES)
    rows = lineage.cut(table.read().select("dir", "file", F.col("line").cast("long").alias("line"), "path", "type"))
    lineage.drop(table.path, spark)
    return rows


def p1_compacted_files(spark: SparkSession, d: str) -> DataFrame:
    """Live files of each directory before that compaction, whether they became fewer, and whether the directory is still crowded."""
    table = _lists_table(spark, d)
    before = lineage.cut(table.listing().select("folder", F.col("n_files").alias("files_before")))
    table.compact(LIST_BYTES)
    after = lineage.cut(table.listing().select("folder", F.col("n_files").alias("files_after"), "n_small"))
    lineage.drop(table.path, spark)
    name = F.url_decode(F.replace(F.substring_index("folder", "=", -1), F.lit("+"), F.lit("%2B")))
    fewer, crowded = F.col("files_after") < F.col("files_before"), F.col("n_small") >= compaction.CROWD
    joined = before.join(after, "folder", "left")
    return joined.select(name.alias("dir"), "files_before", F.coalesce(fewer, F.lit(False)).alias("rewritten"), F.coalesce(crowded, F.lit(False)).alias("crowded_after"))


def p1_parts(spark: SparkSession, d: str) -> DataFrame:
    """What each directory of stored lists is packed into: files and bytes kept, and whether parts are as few as their size calls for."""
    files = compaction.stored_files(read(spark, d, "saved_lists"))
    placed = compaction.assign_parts(files, LIST_BYTES)
    parts = placed.groupBy("dir", "subset", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    # a subset has one part begun beside those that are full
    sums = parts.groupBy("dir").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("parts"), F.sum("b").alias("bytes"), F.count_distinct("subset").alias("subsets"))
    return sums.select("dir", "files", "bytes", (F.col("parts") <= F.expr(f"bytes div {LIST_BYTES}") + F.col("subsets")).alias("packed"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "entries")
    total = entries.count()
    return heavy_keys.owner_and_directory_totals(entries).filter(F.col("n_rows") * 100 >= 3 * total).select("key_name", "key_value")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    out = heavy_keys.owner_and_directory_totals(read(spark, d, "entries"))
    return out.select("key_name", "key_value", "n_rows", "n_values", F.col("sum_value").cast("long").alias("sum_size"), "min_value", "max_value")


def p2_running(spark: SparkSession, d: str) -> DataFrame:
    """How many rows and bytes each uid and directory had come to by each of its walks."""
    rows = heavy_keys.owner_and_directory_rows(read(spark, d, "entries"))
    out = heavy_keys.running_totals(rows, ["key_name", "key_value"], ["walked_at", "size"], "size")
    return out.select("key_name", "key_value", "walked_at", "size", "row_no", F.col("running").cast("long").alias("running"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    src, dst = read(spark, d, "tree_src"), read(spark, d, "tree_dst")
    out = table_diff.table_diff(src, dst, strip_root("name", "/vault/prod"), strip_root("name", "/mirror/keep/prod"), DIFF_FIELDS)
    return out.select(F.col("key").alias("rel"), "field", "state")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes.snapshot_changes(read(spark, d, "snapshots"), "snap_no", "name", CHANGE_FIELDS)


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_compacted, p1_compacted_files, p1_parts, p2_found, p2_totals, p2_running, p3_found, p4_found)}

_DIR = "regexp_replace(name, '/[^/]*$', '')"
_KEYS = f"""
keyed as (select 'uid' as key_name, cast(uid as varchar) as key_value, size from entries where uid is not null
  union all select 'dir', {_DIR}, size from entries)"""
_FILES = f"""
files as (select name, {_DIR} as dir, strlen(coalesce(any_value(body), '')) as bytes, any_value(body) as body from saved_lists group by name)"""
_DIFF = " or ".join(f"a.{c} is distinct from b.{c}" for c in CHANGE_FIELDS)

SQL = {
    "p1_found": f"""
with newest as (select name, max(walked_at) as w from entries group by name),
cur as (select distinct e.name from entries e join newest n on e.name = n.name and e.walked_at = n.w
  where e.type = 'FILE' and e.size is not null and e.size < 32768)
select {_DIR} as dir from cur group by 1 having count(*) >= 24""",
    "p1_records": f"""
with {_FILES},
crowded as (select dir from files group by dir having count(*) filter (where bytes < 32768) >= 24),
lines as (select dir, name as file, unnest(string_split(body, chr(10))) as t, generate_subscripts(string_split(body, chr(10)), 1) - 1 as line from files where body is not null),
clean as (select dir, file, line, case when t like '%' || chr(13) then left(t, length(t) - 1) else t end as t from lines)
select dir, file, cast(line as bigint) as line,
  case when t like '%|%' then left(t, length(t) - strpos(reverse(t), '|')) else t end as path,
  case when t like '%|%' then right(t, strpos(reverse(t), '|') - 1) end as type,
  dir in (select dir from crowded) as moved
from clean where t <> ''""",
    "p1_compacted": f"""
with {_FILES},
lines as (select dir, name as file, unnest(string_split(body, chr(10))) as t, generate_subscripts(string_split(body, chr(10)), 1) - 1 as line from files where body is not null),
clean as (select dir, file, line, case when t like '%' || chr(13) then left(t, length(t) - 1) else t end as t from lines)
select dir, file, cast(line as bigint) as line,
  case when t like '%|%' then left(t, length(t) - strpos(reverse(t), '|')) else t end as path,
  case when t like '%|%' then right(t, strpos(reverse(t), '|') - 1) end as type
from clean where t <> ''""",
    "p1_compacted_files": f"""
with {_FILES}
select dir, count(*) as files_before, count(*) >= 24 as rewritten, false as crowded_after from files group by dir""",
    "p1_parts": f"""
with {_FILES}
select dir, count(*) as files, cast(sum(bytes) as bigint) as bytes, true as packed from files group by dir""",
    "p2_found": f"""
with {_KEYS}
select key_name, key_value from keyed group by 1, 2 having count(*) * 100 >= 3 * (select count(*) from entries)""",
    "p2_totals": f"""
with {_KEYS}
select key_name, key_value, count(*) as n_rows, count(size) as n_values, cast(sum(size) as bigint) as sum_size,
  min(size) as min_value, max(size) as max_value from keyed group by 1, 2""",
    "p2_running": f"""
with keyed as (select 'uid' as key_name, cast(uid as varchar) as key_value, walked_at, size from entries where uid is not null
  union all select 'dir', {_DIR}, walked_at, size from entries)
select key_name, key_value, walked_at, size, row_number() over w as row_no, cast(coalesce(sum(size) over w, 0) as bigint) as running from keyed
window w as (partition by key_name, key_value order by walked_at, size nulls first rows between unbounded preceding and current row)""",
    "p3_found": """
with s as (select distinct substr(name, 12) as rel, type, size, mtime, mtime_nsec, mode from tree_src),
d as (select distinct substr(name, 18) as rel, type, size, mtime, mtime_nsec, mode from tree_dst),
j as (select s.rel as srel, d.rel as drel, s.type as st, d.type as dt, s.size as s1, d.size as s2, s.mtime as m1, d.mtime as m2,
  s.mtime_nsec as n1, d.mtime_nsec as n2, s.mode as o1, d.mode as o2 from s full join d on s.rel = d.rel)
select srel as rel, 'EXIST' as field, 'ONLY_SRC' as state from j where drel is null
union all select drel, 'EXIST', 'ONLY_DEST' from j where srel is null
union all select srel, 'SIZE', 'DIFFER' from j where srel = drel and st <> 'DIR' and dt <> 'DIR' and s1 is distinct from s2
union all select srel, 'MTIME', 'DIFFER' from j where srel = drel and (m1 is distinct from m2 or n1 is distinct from n2)
union all select srel, 'MODE', 'DIFFER' from j where srel = drel and o1 is distinct from o2""",
    "p4_found": f"""
with r as (select distinct snap_no, name, {", ".join(CHANGE_FIELDS)} from snapshots),
o as (select snap_no, lead(snap_no) over (order by snap_no) as nxt from (select distinct snap_no from snapshots)),
p as (select r.*, o.nxt from r join o using (snap_no)),
b as (select * from r where snap_no > (select min(snap_no) from r))
select b.snap_no, b.name, case when a.name is null then 'added' else 'changed' end as change
from b left join p a on a.nxt = b.snap_no and a.name = b.name where a.name is null or {_DIFF}
union all
select a.nxt, a.name, 'removed' from p a left join b on a.nxt = b.snap_no and a.name = b.name where a.nxt is not null and b.name is null""",
}
