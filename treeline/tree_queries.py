"""Queries of the tree operators over the test tables, each with the SQL that states the same.

Names begin with the kind of operator: scan, sink, get, find, join, agg, window, sort, set,
scalar, dist, stream, udf. Every query runs over its whole tables; a filter is the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline import entries as E
from treeline.functions import paths, scalars
from treeline.functions.modes import new_mode
from treeline.functions.times import show_time, show_time_iso
from treeline.operators import aggregate, archive, blockzip, chunks, compare, duplicates, order, plans, predicates, relink, sync, textsearch
from treeline.plans import lineage
from treeline.sources import generate, lists, walk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The fixed query time of the age tests.
NOW = (1_757_300_000, 500_000_000)


def query(sql: str | None = None) -> Callable:
    def note(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def entries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "entries")


def unique(spark: SparkSession, d: str) -> DataFrame:
    """One row for each path and time of a walk."""
    return entries(spark, d).dropDuplicates(["name", "walked_at"])


BASE = "split_part(name, '/', -1)"
DIR = "regexp_replace(name, '/[^/]*$', '')"
FILES = "files as (select name, any_value(body) as body from saved_lists group by name)"


# -- scans
@query(f"""
with {FILES}, l as (select unnest(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10))) as t from files where body is not null),
p as (select left(t, length(t) - strpos(reverse(t), '|')) as name, right(t, strpos(reverse(t), '|') - 1) as letter from l where t <> '')
select name, length(name) - length(replace(name, '/', '')) as depth,
  case letter when 'F' then 'FILE' when 'D' then 'DIR' when 'L' then 'LINK' else 'UNKNOWN' end as type, count(*) as n from p group by all""")
def scan_lite_lists(spark: SparkSession, d: str) -> DataFrame:
    bodies = read(spark, d, "saved_lists").groupBy("name").agg(F.max("body").alias("body"))
    lines = bodies.select(F.explode(F.split("body", "\n", -1)).alias("line"))
    return lists.parse_lite(lines, "line").groupBy("name", "depth", "type").agg(F.count(F.lit(1)).alias("n"))


@query()
def scan_walk(spark: SparkSession, d: str) -> DataFrame:
    return walk.walk(spark, d).select("name", "depth", "type", "size", "error")


@query()
def scan_walk_lite(spark: SparkSession, d: str) -> DataFrame:
    return walk.walk(spark, d, lite=True).select("name", "depth", "type")


@query()
def scan_restat(spark: SparkSession, d: str) -> DataFrame:
    return walk.restat(walk.walk(spark, d, lite=True)).select("name", "type", "size")


@query()
def scan_random_tree(spark: SparkSession, d: str) -> DataFrame:
    return generate.random_tree(spark, "/made", items=3000, levels=5, max_size=2000, seed=7)


@query()
def scan_mounts(spark: SparkSession, d: str) -> DataFrame:
    return walk.mounts(spark)


@query("""
select '/data/' || o_orderpriority || '/' || o_orderstatus || '/o_' || o_orderkey as name, o_custkey as uid,
  cast(round(o_totalprice * 100) as bigint) as size, cast(epoch(o_orderdate) as bigint) + 3600 as mtime from orders""")
def scan_orders_as_entries(spark: SparkSession, d: str) -> DataFrame:
    return E.orders_as_entries(read(spark, d, "orders")).select("name", "uid", "size", "mtime")


# -- sinks
@query("select name || '|' || case type when 'FILE' then 'F' when 'DIR' then 'D' when 'LINK' then 'L' else 'U' end as value from entries")
def sink_lite_lines(spark: SparkSession, d: str) -> DataFrame:
    return lists.lite_lines(entries(spark, d))


_SCALE = "case " + " ".join(f"when size > {1000 * 1024 ** (k - 1)} then {{}}".format(f"printf('%7.3f', size / {1024**k}.0) || ' ' || '{scalars.SIZE_UNITS[k].rjust(3)}'") for k in range(6, 0, -1)) + " else printf('%7.3f', size / 1.0) || '   B' end"
_MODE = "case mode & 61440 when 16384 then 'd' when 40960 then 'l' else '-' end || " + " || ".join(f"case when mode & {1 << (8 - i)} <> 0 then '{'rwx'[i % 3]}' else '-' end" for i in range(9))
_NAMES = """
u as (select id, min(name) as n from user_names where name is not null and id is not null group by id),
g as (select id, min(name) as n from group_names where name is not null and id is not null group by id),
named as (select e.*, coalesce(u.n, cast(uid as varchar)) as "user", coalesce(g.n, cast(gid as varchar)) as "group"
  from entries e left join u on e.uid = u.id left join g on e.gid = g.id)"""


def named(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.with_owner_names(entries(spark, d), read(spark, d, "user_names"), read(spark, d, "group_names"))


@query(f"""with {_NAMES}
select case when mode is null then '-' else {_MODE} end || ' ' || coalesce("user", '-') || ' ' || coalesce("group", '-') || ' ' || case when size is null then '-' else {_SCALE} end || ' '
  || coalesce(strftime(to_timestamp(mtime) at time zone 'UTC', '%b ') || lpad(cast(day(to_timestamp(mtime) at time zone 'UTC') as varchar), 2, ' ') || strftime(to_timestamp(mtime) at time zone 'UTC', ' %Y %H:%M'), '-') || ' ' || name as value
from named""")
def sink_text_lines(spark: SparkSession, d: str) -> DataFrame:
    return lists.text_lines(named(spark, d))


@query("select 'Type=' || case type when 'DIR' then 'DIR' when 'FILE' then 'REG' when 'LINK' then 'LNK' else 'UNK' end || ' File=' || name as value from entries")
def sink_text_lines_lite(spark: SparkSession, d: str) -> DataFrame:
    return lists.text_lines(entries(spark, d), detail=False)


@query("""
select name, type, case when type = 'DIR' then 'rmdir' else 'unlink' end as action, case when type = 'DIR' then 1000000 - depth else 0 end as step from tree_src""")
def sink_remove_plan(spark: SparkSession, d: str) -> DataFrame:
    return plans.remove_plan(read(spark, d, "tree_src"))


@query(f"select distinct {DIR} as name from tree_src where {DIR} <> '' and {DIR} not in (select name from tree_src where type = 'DIR')")
def sink_traceless_parents(spark: SparkSession, d: str) -> DataFrame:
    return plans.traceless_parents(read(spark, d, "tree_src"))


@query("""
with t as (select distinct * from tree_src where type in ('FILE', 'DIR', 'LINK')),
m as (select *, '/mirror/keep' || substr(name, 7) as dest from t where name = '/vault' or starts_with(name, '/vault/'))
select name, dest, case type when 'DIR' then 'mkdir' when 'LINK' then 'symlink' else 'copy' end as action, case type when 'DIR' then depth else 1000000 end as step from m
union all select name, dest, 'metadata', 2000000 - depth from m where type = 'DIR'""")
def sink_copy_plan(spark: SparkSession, d: str) -> DataFrame:
    return plans.copy_plan(read(spark, d, "tree_src").distinct(), [("/vault", "/mirror/keep"), ("/", "/other")]).select("name", "dest", "action", "step")


_X = "case when type = 'DIR' or mode & 64 <> 0 then mode | 511 & 73 else mode end"


@query("""
with m as (select name, type, uid, gid, mode, case when mode is null then null else mode & ~18 end as w from tree_src),
x as (select *, w | 292 | case when type = 'DIR' then 73 when w & 64 <> 0 then 9 else 0 end as n from m)
select name, n as new_mode, 7::bigint as new_uid, gid as new_gid, case when type = 'LINK' then 'skip' when n & 4095 is not distinct from mode & 4095 and uid is not distinct from 7 then 'skip' else 'change' end as outcome from x""")
def sink_chmod_plan(spark: SparkSession, d: str) -> DataFrame:
    return plans.chmod_plan(read(spark, d, "tree_src"), "go-w,a+rX", uid=7)


@query("""
with o as (select name, case when type in ('FILE', 'DIR', 'LINK') then 512 else 0 end as h,
  case when type in ('FILE', 'DIR', 'LINK') then 512 else 0 end + case when type = 'FILE' then (coalesce(size, 0) + 511) // 512 * 512 else 0 end as e from (select distinct * from tree_src)),
p as (select name, h, e, coalesce(sum(e) over (order by name rows between unbounded preceding and 1 preceding), 0) as o from o)
select name, cast(h as bigint) as header_size, cast(e as bigint) as entry_size, cast(o as bigint) as entry_offset, cast(o + h as bigint) as data_offset from p""")
def sink_archive_layout(spark: SparkSession, d: str) -> DataFrame:
    return archive.layout(archive.plain_sizes(read(spark, d, "tree_src").distinct()))


@query("select doc_id, text from documents where text is not null")
def sink_bzip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bzip2 blocks, unpacked again."""
    packed = blockzip.compress_column(read(spark, d, "documents").filter("text is not null"), ["doc_id"], "text", 1)

    def unpack(batches):
        import bz2

        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bz2.decompress(x).decode() for x in b.column(1).to_pylist()])], names=["doc_id", "text"])

    return packed.mapInArrow(unpack, "doc_id bigint, text string")


@query()
def sink_bzip_table(spark: SparkSession, d: str) -> DataFrame:
    packed = blockzip.compress_column(read(spark, d, "documents").filter("text is not null").withColumnRenamed("doc_id", "block"), ["block"], "text", 1)
    return blockzip.block_table(packed.select("block", F.octet_length("packed").cast("long").alias("length")))


# -- accessors
@query(f"""
select name, walked_at, mode & 4095 as perm, case mode & 61440 when 32768 then 'FILE' when 16384 then 'DIR' when 40960 then 'LINK' else 'UNKNOWN' end as kind, {BASE} as base, {DIR} as dir,
  length(name) - length(replace(name, '/', '')) as levels from (select distinct name, walked_at, mode from entries where mode is not null)""")
def get_fields(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).filter("mode is not null").select("name", "walked_at", "mode").distinct()
    return e.select(
        "name", "walked_at", scalars.perm(F.col("mode")).alias("perm"), scalars.type_of_mode(F.col("mode")).alias("kind"),
        paths.basename("name").alias("base"), paths.dirname("name").alias("dir"), paths.depth("name").alias("levels"),
    )


@query("""
select count(*) as n_items, min(depth) as min_depth, max(depth) as max_depth, max(strlen(name)) as longest_name, count(distinct uid) as n_users,
  count(distinct gid) as n_groups, count(mode) > 0 as detail from entries""")
def get_measures(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.measures(entries(spark, d))


# -- find
def _find(name: str, sql: str, *tests, table: Callable = unique) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return predicates.find(table(spark, d), *[t() for t in tests]).select("name", "walked_at")

    run.__name__ = name
    query(f"with {_NAMES} select distinct name, walked_at from named where {sql}" if table is named_unique else f"select distinct name, walked_at from entries where {sql}")(run)


def named_unique(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).dropDuplicates(["name", "walked_at"])


def _age(field: str, unit: int) -> str:
    return f"greatest({NOW[0]} - {field} - case when {field}_nsec > {NOW[1]} then 1 else 0 end, 0) // {unit}"


_P = predicates
_find("find_type_directory", "mode & 61440 = 16384", lambda: _P.type_is("d"))
_find("find_type_link", "mode & 61440 = 40960", lambda: _P.type_is("l"))
_find("find_name_glob", f"regexp_full_match({BASE}, '[^.].*\\.(nc|dat)|[^.]*\\.nc') and ends_with(name, '.nc')", lambda: _P.name_like("*.nc"))
_find("find_name_glob_hidden", f"starts_with({BASE}, '.')", lambda: _P.name_like(".*"))
_find("find_name_glob_class", f"regexp_full_match({BASE}, '[a-f].*[0-9]..*', 's')", lambda: _P.name_like("[a-f]*[0-9]?*"))
_find("find_path_glob", "regexp_full_match(name, '/tank/.*/pr.*', 's')", lambda: _P.path_like("/tank/*/pr*"))
_find("find_path_regex", "regexp_matches(name, '/(sim|lab)/.*[0-9]{4}')", lambda: _P.path_regex("/\\(sim\\|lab\\)/.*[0-9]\\{4\\}"))
_find("find_path_regex_plain_plus", "regexp_matches(name, 'a\\+b|\\(1\\)')", lambda: _P.path_regex("a+b\\|(1)"))
_find("find_uid", "uid = 10128", lambda: _P.uid("10128"))
_find("find_uid_above", "uid > 40000", lambda: _P.uid("+40000"))
_find("find_gid_below", "gid < 1000", lambda: _P.gid("-1000"))
_find("find_size_above", "size > 10485760", lambda: _P.size("+10M"))
_find("find_size_below", "size < 1536", lambda: _P.size("-1.5k"))
_find("find_size_exact", "size = 4096", lambda: _P.size("4KB"))
_find("find_mmin", f"{_age('mtime', 60)} < 600000", lambda: _P.minutes("mtime", "-600000", NOW))
_find("find_amin", f"{_age('atime', 60)} > 100000", lambda: _P.minutes("atime", "+100000", NOW))
_find("find_cmin", f"{_age('ctime', 60)} = 0", lambda: _P.minutes("ctime", "0", NOW))
_find("find_mtime", f"{_age('mtime', 86400)} = 200", lambda: _P.days("mtime", "200", NOW))
_find("find_atime", f"{_age('atime', 86400)} < 90", lambda: _P.days("atime", "-90", NOW))
_find("find_ctime", f"{_age('ctime', 86400)} > 365", lambda: _P.days("ctime", "+365", NOW))
_find("find_newer", "mtime > 1750000000 or mtime = 1750000000 and mtime_nsec > 5", lambda: _P.newer("mtime", 1_750_000_000, 5))
_find("find_anewer", "atime > 1750000000 or atime = 1750000000 and atime_nsec > 5", lambda: _P.newer("atime", 1_750_000_000, 5))
_find("find_cnewer", "ctime > 1750000000 or ctime = 1750000000 and ctime_nsec > 5", lambda: _P.newer("ctime", 1_750_000_000, 5))
_find("find_maxdepth", "depth <= 5", lambda: _P.max_depth(4, 1))
_find("find_conjunction", "mode & 61440 = 32768 and size > 1048576 and uid = 43283 and depth <= 6", lambda: _P.type_is("f"), lambda: _P.size("+1M"), lambda: _P.uid(43283), lambda: _P.max_depth(6))
_OWNER = """(select n from {} where id = (select {} from entries where {} in (select id from {}) group by 1 order by count(*) desc, 1 limit 1))"""
SQL["find_user"] = f"with {_NAMES} select distinct name, walked_at from named where \"user\" = {_OWNER.format('u', 'uid', 'uid', 'u')}"
SQL["find_group"] = f"with {_NAMES} select distinct name, walked_at from named where \"group\" = {_OWNER.format('g', 'gid', 'gid', 'g')}"


def _commonest(rows: DataFrame, key: str, name: str) -> str:
    """The name of the id that most rows have, of those with a name."""
    known = rows.filter(F.col(name) != F.col(key).cast("string"))
    found = known.groupBy(key, name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).first()
    return found[name] if found else ""


def _find_owner(key: str, name: str, test: Callable[[str], Column]) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = named(spark, d)
        return rows.filter(test(_commonest(rows, key, name))).select("name", "walked_at").distinct()

    return run


QUERIES["find_user"] = _find_owner("uid", "user", predicates.user)
QUERIES["find_group"] = _find_owner("gid", "group", predicates.group)


@query("select name, walked_at from (select distinct name, walked_at from entries) where not regexp_matches(name, 'logs_[0-9]')")
def find_exclude_regex(spark: SparkSession, d: str) -> DataFrame:
    return predicates.filter_regex(unique(spark, d), "logs_[0-9]", exclude=True).select("name", "walked_at")


@query(f"select name, walked_at from (select distinct name, walked_at from entries) where regexp_matches({BASE}, '^msg')")
def find_match_basename(spark: SparkSession, d: str) -> DataFrame:
    return predicates.filter_regex(unique(spark, d), "^msg", only_basename=True).select("name", "walked_at")


@query("""
select name, walked_at, starts_with(name, '/tank/sim/') as inside from (select distinct name, walked_at from entries)""")
def find_split_by_root(spark: SparkSession, d: str) -> DataFrame:
    inside, rest = predicates.split_by_root(unique(spark, d), "/tank/sim")
    mark = lambda t, v: t.select("name", "walked_at", F.lit(v).alias("inside"))
    return mark(inside, True).unionByName(mark(rest, False))


@query("select name, walked_at from (select distinct name, walked_at from entries) where starts_with(name, '/tank/') and regexp_full_match(split_part(name, '/', 3), 's.*', 's')")
def find_child_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return predicates.child_like(unique(spark, d), "/tank", "s*").select("name", "walked_at")


@query("select name, walked_at from (select distinct name, walked_at from entries) where starts_with(name, '/tank/lab/') or starts_with(name, '/tank/ingest/') or name in ('/tank/lab', '/tank/ingest')")
def find_under_roots(spark: SparkSession, d: str) -> DataFrame:
    return predicates.under_any(unique(spark, d), ["/tank/lab", "/tank/ingest"]).select("name", "walked_at")


@query(f"select distinct name, walked_at from entries where type in ('FILE', 'LINK') and {NOW[0]} - atime > 5184000 and {NOW[0]} - ctime > 5184000")
def find_purge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return predicates.purge_candidates(unique(spark, d), NOW).select("name", "walked_at")


@query("select name, size from tree_src where type = 'FILE' and size >= 1048576 and not (size % 5 = 4 and size % 3 = 0)")
def find_restripe(spark: SparkSession, d: str) -> DataFrame:
    striped = read(spark, d, "tree_src").withColumns({"stripe_count": F.col("size") % 5, "stripe_size": F.col("size") % 3})
    return plans.restripe_report(striped, 4, 0, 1 << 20).select("name", "size")


# -- joins: comparison and synchronization
_PAIR = """
s as (select distinct substr(name, 12) as rel, * from tree_src), d as (select distinct substr(name, 18) as rel, * from tree_dst),
j as (select coalesce(s.rel, d.rel) as rel, s.rel is null as no_s, d.rel is null as no_d, s, d from s full join d on s.rel = d.rel),
c as (select *, no_s or no_d as one, coalesce(s.mode & 61440 = d.mode & 61440, s.type is not distinct from d.type) as same_type,
    (s.type = 'DIR' and d.type = 'DIR') or s.size is not distinct from d.size as same_size,
    s.size is not distinct from d.size as equal_size,
    s.mtime is not distinct from d.mtime and s.mtime_nsec is not distinct from d.mtime_nsec as same_mtime,
    s.atime is not distinct from d.atime and s.atime_nsec is not distinct from d.atime_nsec as same_atime,
    s.ctime is not distinct from d.ctime and s.ctime_nsec is not distinct from d.ctime_nsec as same_ctime,
    s.mode & 4095 is not distinct from d.mode & 4095 as same_perm,
    s.uid is not distinct from d.uid as same_uid, s.gid is not distinct from d.gid as same_gid from j),
k as (select *, same_type and case s.type when 'LINK' then same_mtime when 'FILE' then equal_size and same_mtime else true end as same_content from c)"""


def _s(flag: str) -> str:
    return f"case when one then null when {flag} then 'COMMON' else 'DIFFER' end"


_STATES = f"""{_PAIR},
states as (select rel, s.name as src_name, d.name as dst_name, case when no_d then 'ONLY_SRC' when no_s then 'ONLY_DEST' else 'COMMON' end as EXIST, {_s('same_type')} as TYPE, {_s('same_size')} as SIZE, {_s('same_uid')} as UID, {_s('same_gid')} as GID,
  {_s('same_atime')} as ATIME, {_s('same_mtime')} as MTIME, {_s('same_ctime')} as CTIME, {_s('same_perm')} as PERM, {_s('same_content')} as CONTENT from k)"""
FIELDS = ["EXIST", "TYPE", "SIZE", "UID", "GID", "ATIME", "MTIME", "CTIME", "PERM", "CONTENT"]


def trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str, str]:
    return read(spark, d, "tree_src").distinct(), read(spark, d, "tree_dst").distinct(), "/vault/prod", "/mirror/keep/prod"


@query(f"with {_STATES} select rel, {', '.join(FIELDS)} from states")
def join_compare_states(spark: SparkSession, d: str) -> DataFrame:
    s, t, a, b = trees(spark, d)
    return compare.states(compare.sides(s, t, a, b)).select("rel", *FIELDS)


_CLAUSES = {
    "EXIST=COMMON": ["EXIST = 'COMMON'"], "EXIST=DIFFER": ["EXIST <> 'COMMON'"], "EXIST=COMMON@TYPE=COMMON": ["EXIST = 'COMMON' and TYPE = 'COMMON'"],
    "EXIST=COMMON@TYPE=DIFFER": ["EXIST = 'COMMON' and TYPE = 'DIFFER'"], "EXIST=COMMON@CONTENT=COMMON": ["EXIST = 'COMMON' and CONTENT = 'COMMON'"],
    "EXIST=COMMON@CONTENT=DIFFER": ["EXIST = 'COMMON' and CONTENT = 'DIFFER'"],
    "EXIST=COMMON@SIZE=DIFFER,MTIME=DIFFER@PERM=COMMON,EXIST=ONLY_SRC": ["EXIST = 'COMMON' and SIZE = 'DIFFER'", "MTIME = 'DIFFER' and PERM = 'COMMON'", "EXIST = 'ONLY_SRC'"],
}


def _counts_sql() -> str:
    parts = []
    for text, clauses in _CLAUSES.items():
        case = "case " + " ".join(f"when {c} then {i}" for i, c in enumerate(clauses, 1)) + " end"
        for i in range(1, len(clauses) + 1):
            parts.append(f"select '{text}' as output, {i} as clause, count(src_name) as n_src, count(dst_name) as n_dest from states where {case} = {i}")
    return f"with {_STATES} " + " union all ".join(parts)


@query(_counts_sql())
def join_compare_counts(spark: SparkSession, d: str) -> DataFrame:
    s, t, a, b = trees(spark, d)
    return compare.counts(compare.compare(s, t, a, b, list(_CLAUSES)), list(_CLAUSES))


@query(f"""with {_STATES},
m as (select *, case when EXIST = 'COMMON' and MTIME = 'DIFFER' then 1 when EXIST = 'ONLY_DEST' then 2 end as clause from states)
select 'src' as side, clause, rel, src_name as name from m where clause is not null and src_name is not null
union all select 'dest', clause, rel, dst_name from m where clause is not null and dst_name is not null""")
def join_compare_matching(spark: SparkSession, d: str) -> DataFrame:
    s, t, a, b = trees(spark, d)
    text = "EXIST=COMMON@MTIME=DIFFER,EXIST=ONLY_DEST"
    return compare.matching(compare.compare(s, t, a, b, [text]), text)


_SYNC = f"""with {_PAIR},
f as (select *, not one and not same_content as changed, not one and (not same_uid or not same_gid or not same_perm or s.atime is distinct from d.atime or s.mtime is distinct from d.mtime) as meta from k)
select rel, 'remove' as action, 1 as step from f where no_s or changed union all select rel, 'copy', 2 from f where no_d or changed union all select rel, 'refresh', 5 from f where meta"""


@query(_SYNC)
def join_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    s, t, a, b = trees(spark, d)
    return sync.sync_plan(s, t, a, b, delete=True)


@query(f"""with {_PAIR},
q as (select rel, cast(size as bigint) as size, mtime, mtime_nsec, type from s where size % 2 = 0),
l as (select f.rel from s f join q on f.rel = q.rel where f.type = 'FILE' and q.type = 'FILE'),
f as (select *, not one and not same_content as changed, not one and (not same_uid or not same_gid or not same_perm or s.atime is distinct from d.atime or s.mtime is distinct from d.mtime) as meta from k)
select rel, 'remove' as action from f where changed
union all select rel, case when s.type = 'FILE' and rel in (select rel from l) then 'link' else 'copy' end from f where no_d or changed union all select rel, 'refresh' from f where meta""")
def join_sync_plan_link_dest(spark: SparkSession, d: str) -> DataFrame:
    """Even-sized source files are also in a third tree, so they are linked."""
    s, t, a, b = trees(spark, d)
    return sync.sync_plan(s, t, a, b, link_dest=s.filter("size % 2 = 0"), link_root=a).select("rel", "action")


@query(f"with {_PAIR} select d.name from k where no_s")
def join_only_in_destination(spark: SparkSession, d: str) -> DataFrame:
    s, t, a, b = trees(spark, d)
    return sync.only_in(t, s, b, a).select("name")


@query(f'with {_NAMES} select name, walked_at, uid, "user", "group" from (select distinct name, walked_at, uid, gid, "user", "group" from named)')
def join_owner_names(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).select("name", "walked_at", "uid", "gid", "user", "group").distinct().drop("gid")


@query("select distinct name, case when starts_with(name, '/tank/sim/') then '/a' || substr(name, 10) when starts_with(name, '/tank/') then '/b' || substr(name, 6) end as dest from entries where name <> '/tank'")
def join_copy_destination(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("name").distinct()
    return e.select("name", paths.move_root("name", [("/tank/sim", "/a"), ("/tank", "/b")]).alias("dest"))


def _chunk_digests(docs: DataFrame, change: int, to: Callable[[Column], Column] = F.upper) -> DataFrame:
    e = E.documents_as_entries(docs.filter("text is not null")).withColumn("content", F.when(F.col("size") % 7 == change, to(F.col("content"))).otherwise(F.col("content")))
    e = e.withColumn("size", F.octet_length("content").cast("long"))
    parts = chunks.explode_chunks(e, 4096).select("name", "offset", "length").join(e.select("name", "content"), "name")
    return parts.select(F.col("name").alias("rel"), "offset", F.sha2(chunks.text_chunk(F.col("content"), F.col("offset"), F.col("length")), 256).alias("digest"))


@query("""
select '/corpus/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id as rel, strlen(text) % 7 = 3 as differs from documents where text is not null""")
def join_content_by_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All texts compared chunk by chunk with a copy in which every seventh has one character more."""
    docs = read(spark, d, "documents")
    return compare.content_by_chunks(_chunk_digests(docs, -1), _chunk_digests(docs, 3, lambda c: F.concat(c, F.lit("~"))))


# -- aggregates
@query("""
select count(*) as n_items, count(*) filter (where type = 'DIR') as n_dirs, count(*) filter (where type = 'FILE') as n_files, count(*) filter (where type = 'LINK') as n_links,
  count(*) filter (where type not in ('DIR', 'FILE', 'LINK') or type is null) as n_unknown, cast(coalesce(sum(size) filter (where type = 'FILE'), 0) as bigint) as bytes,
  cast(coalesce(sum(size) filter (where type = 'FILE'), 0) // greatest(count(*) filter (where type = 'FILE'), 1) as bigint) as mean_bytes from tree_src""")
def agg_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.summary(read(spark, d, "tree_src"))


def _histogram_sql(bounds: str) -> str:
    return f"""
with b as (select list_sort({bounds}) as l), k as (select unnest(range(0, len(l) + 1)) as bin, l from b),
e as (select case when size is null then null else len(list_filter(l, lambda x: x < size)) end as bin from entries, b), c as (select bin, count(*) as n from e group by bin)
select cast(k.bin as int) as bin, case when k.bin > 0 then l[k.bin] end as above, l[k.bin + 1] as upto, coalesce(n, 0) as n from k left join c on k.bin = c.bin"""


@query(_histogram_sql("[0, 80, 1000, 4096, 1048576]::bigint[]"))
def agg_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.histogram(entries(spark, d), aggregate.parse_bins("size:0,80,1000,4k,1m"))


@query(_histogram_sql("(select [1::bigint] || list_transform(range(1, cast(ceil(ceil(log2(max(size))) / 10) as bigint) + 1), lambda x: 1::bigint << cast(10 * x as int)) from entries)"))
def agg_histogram_default(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.histogram(entries(spark, d))


@query("""
with c as (select split_part(name, '/', 3) as child, count(*) as n, cast(coalesce(sum(size), 0) as bigint) as bytes from entries where starts_with(name, '/tank/') group by 1)
select *, row_number() over (order by bytes desc, child) as rank from c""")
def agg_children(spark: SparkSession, d: str) -> DataFrame:
    return ranked(aggregate.children(entries(spark, d), "/tank"))


@query("""
with c as (select split_part(name, '/', 4) as child, count(*) as n, cast(coalesce(sum(size), 0) as bigint) as bytes from entries where starts_with(name, '/tank/proj/') group by 1)
(select * from c order by bytes desc, child limit 100) union all select null, cast(sum(n) as bigint), cast(sum(bytes) as bigint) from c""")
def agg_children_report(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.children_report(entries(spark, d), "/tank/proj")


@query("select uid, count(*) as n, count(*) filter (where type = 'FILE') as n_files, cast(coalesce(sum(size) filter (where type = 'FILE'), 0) as bigint) as bytes from entries group by uid")
def agg_by_owner(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.by_owner(entries(spark, d))


@query("select l_orderkey as name, bool_or(coalesce(l_quantity > 49 and l_returnflag = 'R', false)) as flag from lineitem group by 1")
def agg_any_of_file(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), ((F.col("l_quantity") > 49) & (F.col("l_returnflag") == "R")).alias("flag"))
    return chunks.any_of_file(rows, "flag")


@query("""
with e as (select '/corpus/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id as name, strlen(text) as size, sha256(text) as sha256 from documents where text is not null and text <> '')
select name, size, sha256 from e where (size, sha256) in (select (size, sha256) from e group by size, sha256 having count(*) > 1)""")
def agg_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicates(E.documents_as_entries(read(spark, d, "documents")))


@query("select coalesce(bool_and(o_totalprice > 0), true) as all_true from orders")
def agg_all_true(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.all_true(read(spark, d, "orders").select((F.col("o_totalprice") > 0).alias("flag")), "flag")


@query(f"select distinct {DIR} as name from entries where {DIR} <> ''")
def agg_distinct_parents(spark: SparkSession, d: str) -> DataFrame:
    return order.parents(entries(spark, d))


# -- windows
@query("""
with t as (select distinct name, size from tree_src)
select name, row_number() over w - 1 as position, cast(coalesce(sum(size) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from t window w as (order by name nulls first, size nulls first)""")
def window_positions(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tree_src").select("name", "size").distinct()
    return order.positions(t, [F.asc("name"), F.asc("size")], F.col("size")).select("name", "position", "offset")


@query("select o_orderkey, ntile(7) over (order by o_orderkey) - 1 as block from orders")
def window_even_blocks(spark: SparkSession, d: str) -> DataFrame:
    return order.even_blocks(read(spark, d, "orders").select("o_orderkey"), [F.asc("o_orderkey")], 7).select("o_orderkey", "block")


@query("select o_orderkey, (row_number() over (order by o_orderkey desc) - 1) // 1000 as batch from orders")
def window_batches(spark: SparkSession, d: str) -> DataFrame:
    return order.batches(read(spark, d, "orders").select("o_orderkey"), [F.desc("o_orderkey")], 1000).select("o_orderkey", "batch")


# -- sorts
@query("""
with t as (select distinct name, size, mtime, mtime_nsec from tree_src),
r as (select *, row_number() over (order by size desc nulls last, mtime nulls first, mtime_nsec nulls first, name) as i, count(*) over () as n from t)
select name, size, case when i <= 10 then 'head' else 'tail' end as part from r where i <= 10 or i > n - 10""")
def sort_head_and_tail(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tree_src").select("name", "size", "mtime", "mtime_nsec").distinct()
    return order.head_and_tail(t, "-size,mtime").select("name", "size", "part")


def ranked(df: DataFrame) -> DataFrame:
    """``df`` with ``rank``, the place at which a row lies as the rows follow each other, whatever order that is."""
    laid = lineage.cut(df.withColumn("__at", F.monotonically_increasing_id()))
    part, own = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = laid.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("__s"))
    return laid.join(F.broadcast(starts), part == F.col("__p")).withColumn("rank", F.col("__s") + own + 1).drop("__at", "__p", "__s")


@query("select name, size, row_number() over (order by size nulls first, name) as rank from (select distinct name, size from tree_src)")
def sort_by_size(spark: SparkSession, d: str) -> DataFrame:
    return ranked(order.sort_entries(read(spark, d, "tree_src").select("name", "size").distinct(), "size"))


@query(f"with {_NAMES} select \"user\", \"group\", name, row_number() over (order by \"user\" desc nulls last, \"group\" nulls first, name) as rank from named")
def sort_by_owner_names(spark: SparkSession, d: str) -> DataFrame:
    return ranked(order.sort_entries(named(spark, d).select("user", "group", "name"), "-user,group"))


# -- sets
@query("select name, type from tree_src union all select name, type from tree_dst")
def set_append(spark: SparkSession, d: str) -> DataFrame:
    return E.append(E.conform(read(spark, d, "tree_src")), E.conform(read(spark, d, "tree_dst"))).select("name", "type")


@query("select distinct substr(name, 12) as rel from tree_src where substr(name, 12) in (select substr(name, 18) from tree_dst)")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    s, t, a, b = trees(spark, d)
    return compare.sides(s, t, a, b).filter("s is not null and d is not null").select("rel")


@query("""
select distinct substr(name, 12) as rel, 'src' as side from tree_src where substr(name, 12) not in (select substr(name, 18) from tree_dst)
union all select distinct substr(name, 18), 'dest' from tree_dst where substr(name, 18) not in (select substr(name, 12) from tree_src)""")
def set_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    s, t, a, b = trees(spark, d)
    j = compare.sides(s, t, a, b).filter("s is null or d is null")
    return j.select("rel", F.when(F.col("d").isNull(), F.lit("src")).otherwise(F.lit("dest")).alias("side"))


@query("select depth, count(*) as n from tree_src where depth is not null group by depth")
def set_partition_by_depth(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tree_src")
    levels = [order.at_depth(t, k).agg(F.lit(k).alias("depth"), F.count(F.lit(1)).alias("n")) for k in order.depths(t)]
    return E.append(levels[0], *levels[1:])


@query("select o_orderstatus as k, min(o_orderpriority) as v from orders where o_orderstatus <> 'F' group by 1 union all select 'F', 'last'")
def set_map_merge(spark: SparkSession, d: str) -> DataFrame:
    """A string map with a second one laid over it."""
    rows = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.min("o_orderpriority").alias("v"))
    one = rows.agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("m"))
    over = F.create_map(F.lit("F"), F.lit("last"))
    merged = F.map_concat(F.map_filter("m", lambda k, _: ~F.map_contains_key(over, k)), over)
    return one.select(F.explode(merged).alias("k", "v"))


# -- scalars
@query(f"""
select distinct name, {BASE} as base, {DIR} as dir, array_to_string(list_slice(list_filter(string_split(name, '/'), lambda x: x <> ''), 2, 3), '/') as middle,
  len(list_filter(string_split(name, '/'), lambda x: x <> '')) as parts, '/x/y' || name as moved, split_part(name, '/', 3) as second, name || '/z' as below from entries""")
def scalar_path_parts(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("name").distinct().select(
        "name", paths.basename("name").alias("base"), paths.dirname("name").alias("dir"), paths.slice_path("name", 1, 2).alias("middle"),
        paths.n_components("name").alias("parts"), paths.insert("name", 0, "x/y").alias("moved"), paths.component("name", 2).alias("second"), paths.join("name", F.lit("z")).alias("below"),
    )


@query("""
select distinct name, name as reduced, case when name = '/tank' then '../..' when starts_with(name, '/tank/') then '../../' || substr(name, 7) else '../../..' || name end as up from entries""")
def scalar_path_reduce(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("name").distinct()
    messy = F.concat(F.lit("/../."), F.regexp_replace("name", "^/([^/]*)", "/$1//x/../"), F.lit("/./y/../"))
    return e.select("name", paths.reduce(messy).alias("reduced"), paths.relative(F.col("name"), F.lit("/tank/no/where")).alias("up"))


@query("""
select distinct name, case when name = '/tank/sim' then 'EQUAL' when starts_with(name, '/tank/sim/') then 'CHILD' when name = '/tank' then 'PARENT' else 'DIFF' end as relation from entries""")
def scalar_path_relation(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("name").distinct().select("name", paths.relation("name", F.lit("/tank/sim")).alias("relation"))


_COUNTED = "case " + " ".join(f"when size > {1000**k} then ((size + {small // 2}) // {small} // 1000) || '.' || lpad(cast((size + {small // 2}) // {small} % 1000 as varchar), 3, '0') || ' {scalars.COUNT_UNITS[k]}'" for k in range(6, 0, -1) for small in [1000 ** (k - 1)]) + " else size || '.000' end"


@query(f"""
select distinct size, ltrim({_SCALE.replace("|| '   B'", "|| ' B'").replace("' ' || '  B'", "' B'")}) as shown, {_COUNTED} as counted from entries""")
def scalar_show_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("size").distinct()
    return e.select("size", scalars.show_bytes(F.col("size")).alias("shown"), scalars.show_count(F.col("size")).alias("counted"))


@query("select distinct size, " + ", ".join(f"try_cast(size::hugeint * {1024**k} as bigint) as {c}" for k, c in enumerate(("plain", "k", "m", "g", "t"))) + ", null::bigint as bad from entries")
def scalar_parse_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of every magnitude in several units; null beyond bigint."""
    e = entries(spark, d).select("size").distinct()
    parse = lambda suffix: scalars.parse_bytes_col(F.concat(F.col("size").cast("string"), F.lit(suffix)))
    return e.select("size", parse("b").alias("plain"), parse("k").alias("k"), parse("MB").alias("m"), parse("g").alias("g"), parse("TB").alias("t"), parse("kbb").alias("bad"))


@query(f"select distinct mode, {_MODE} as shown from entries where mode is not null")
def scalar_show_modes(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("mode").filter("mode is not null").distinct().select("mode", scalars.show_mode(F.col("mode")).alias("shown"))


@query("""
with m as (select distinct mode, type from entries where mode is not null)
select mode, type, (mode & 61440) | 493 as octal, (mode & ~56) | ((mode & 448) >> 3) as g_u, mode & ~73 as a_x,
  mode | 128 | (case when type = 'DIR' then 64 else 0 end) as u_wX from m""")
def scalar_chmod(spark: SparkSession, d: str) -> DataFrame:
    m = entries(spark, d).select("mode", "type").filter("mode is not null").distinct()
    change = lambda c, n: new_mode(F.col("mode"), F.col("type"), c).alias(n)
    return m.select("mode", "type", change("755", "octal"), change("g=u", "g_u"), change("a-x", "a_x"), change("u+wX", "u_wX"))


@query("""
select distinct mtime, strftime(to_timestamp(mtime) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as iso,
  strftime(to_timestamp(mtime) at time zone 'UTC', '%b ') || lpad(cast(day(to_timestamp(mtime) at time zone 'UTC') as varchar), 2, ' ') || strftime(to_timestamp(mtime) at time zone 'UTC', ' %Y %H:%M') as shown
from entries where mtime is not null""")
def scalar_show_times(spark: SparkSession, d: str) -> DataFrame:
    t = entries(spark, d).select("mtime").filter("mtime is not null").distinct()
    return t.select("mtime", show_time_iso(F.col("mtime")).alias("iso"), show_time(F.col("mtime")).alias("shown"))


@query("""
with l as (select distinct name, replace(name, '/tank/', '/old/') as target from entries where type = 'LINK' and starts_with(name, '/tank/'))
select name, target, '/new/root' || substr(target, 5) as new_target from l""")
def scalar_relink(spark: SparkSession, d: str) -> DataFrame:
    links = entries(spark, d).filter("type = 'LINK'").select("name", "type").distinct()
    return relink.relink_plan(links.withColumn("target", F.regexp_replace("name", "^/tank/", "/old/")), "/old/", "/new//root/")


# -- distribution
@query("""
with f as (select distinct name, size, case when size < 10000000000 then 1048576 else 68719476736 end as chunk from tree_src where type = 'FILE' and size is not null),
c as (select *, unnest(range(0, greatest((size + chunk - 1) // chunk, 1))) as i from f)
select name, i * chunk as "offset", least(chunk, size - i * chunk) as length, size as file_size from c""")
def dist_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sections of 1 MiB, of huge files of 64 GiB."""
    files = read(spark, d, "tree_src").select("name", "type", "size").distinct()
    return chunks.explode_chunks(files, F.when(F.col("size") < 10_000_000_000, F.lit(1 << 20)).otherwise(F.lit(1 << 36)))


@query("""
with l as (select '/corpus/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id as name, string_split(text, chr(10)) as ls from documents where text is not null),
x as (select name, unnest(ls) as line, generate_subscripts(ls, 1) as line_no, len(ls) as n from l)
select name, cast(line_no as int) as line_no, line from x where not (line_no = n and line = '') and regexp_matches(line, 'section|cite')""")
def dist_grep(spark: SparkSession, d: str) -> DataFrame:
    return textsearch.grep(E.documents_as_entries(read(spark, d, "documents")), "section\\|cite")


@query(f"select {DIR} as dir, count(*) as n, true as together from tree_src group by 1")
def dist_by_parent(spark: SparkSession, d: str) -> DataFrame:
    """Rows spread by directory: each is there, and a directory's lie in at most 16 partitions, alike names in one."""
    moved = order.by_parent(read(spark, d, "tree_src"), 64).withColumn("p", F.spark_partition_id())
    alike = moved.groupBy(paths.dirname("name").alias("dir"), "name").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"), F.max("p").alias("q"))
    return alike.groupBy("dir").agg(F.sum("n").alias("n"), (F.bool_and(F.col("p") == F.col("q")) & (F.count_distinct("p") <= 16)).alias("together"))


@query("select coalesce(depth, 0) % 4 as place, count(*) as n from tree_dst group by 1")
def dist_remap(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt out evenly, then moved to the partition that they name."""
    moved = order.remap(order.spread(read(spark, d, "tree_dst"), 5), F.coalesce("depth", F.lit(0)), 4)
    return moved.groupBy(F.spark_partition_id().alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("select 5 as parts, true as even, count(*) as n from tree_dst")
def dist_spread(spark: SparkSession, d: str) -> DataFrame:
    parts = order.spread(read(spark, d, "tree_dst"), 5).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tasks = F.lit(64)  # each task that deals rows out may give one more to some
    return parts.agg(F.count(F.lit(1)).cast("int").alias("parts"), (F.max("n") - F.min("n") <= tasks).alias("even"), F.sum("n").alias("n"))


# -- streams (an extension) and functions of the user
@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all")
def stream_daily_events(spark: SparkSession, d: str) -> DataFrame:
    """Events counted by day as a stream would be, in one run over what is there."""
    from treeline.streaming.changes import run_to_table, windowed_counts

    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_table(windowed_counts(stream, "ts", "event_type", width="1 day", late="36500 days"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select distinct name from tree_src where length(name) % 3 = 0")
def udf_filter(spark: SparkSession, d: str) -> DataFrame:
    return predicates.passing(read(spark, d, "tree_src").select("name").distinct(), lambda r: len(r["name"]) % 3 == 0)


@query("select r_name as command from region where r_name < 'B'")
def udf_command(spark: SparkSession, d: str) -> DataFrame:
    """A command runs for each row; those it succeeds for stay."""
    rows = read(spark, d, "region").select(F.col("r_name").alias("name"))
    return predicates.passing_command(rows, ["sh", "-c", 'case "$0" in A*) exit 0;; *) exit 1;; esac', "{}"]).select(F.col("name").alias("command"))
