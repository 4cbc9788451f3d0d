"""``python -m treeline TOOL ...``: the operators as command-line tools over real trees and saved lists."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import entries as E
from treeline.functions.scalars import parse_bytes, show_bytes, show_count
from treeline.operators import aggregate, apply, archive, blockzip, chunks, compare, duplicates, exprs, order, plans, predicates as P, relink, sync, textsearch
from treeline.operators.progress import Progress
from treeline.plans.session import ship
from treeline.sources import generate, lists, owners, walk


def fixed(df: DataFrame) -> DataFrame:
    """A plan written down before it is carried out, so that its effects can't change it."""
    from treeline.plans.lineage import cut

    return cut(df)


def load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The items of ``--input`` or of a walk, with user and group names if there is detail."""
    if getattr(a, "input", None):
        df = lists.read_list(spark, a.input)
    else:
        df = walk.walk(spark, a.paths, lite=getattr(a, "lite", False), dereference=getattr(a, "dereference", False))
        for r in walk.errors(df).limit(20).collect():  # the walk itself was written down
            print(f"{r.name}: {r.error}", file=sys.stderr)
    return df


def named(spark: SparkSession, df: DataFrame) -> DataFrame:
    return aggregate.with_owner_names(df, owners.users(spark), owners.groups(spark))


def save(spark: SparkSession, df: DataFrame, a: argparse.Namespace) -> None:
    if getattr(a, "output", None):
        if a.text:
            lists.write_text(named(spark, df), a.output, E.has_detail(df))
        elif E.has_detail(df):
            lists.write_binary(E.conform(df), a.output, [tuple(r) for r in owners.users(spark).collect()], [tuple(r) for r in owners.groups(spark).collect()])
        else:
            lists.write_lite(df, a.output)


def say(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(*r, sep="\t")


def do_walk(spark: SparkSession, a: argparse.Namespace) -> None:
    df = load(spark, a)
    if a.sort:
        df = order.sort_entries(named(spark, df), a.sort)
    if a.print:
        parts = order.head_and_tail(named(spark, df), a.sort or "name")
        lines = lists.text_lines(parts, E.has_detail(df)).withColumn("part", F.lit(""))
        say(lines.select("value"))
    say(aggregate.summary(df))
    if a.distribution:
        say(aggregate.histogram(df, aggregate.parse_bins(a.distribution)))
    if a.file_histogram:
        say(aggregate.histogram(df))
    save(spark, df, a)


def do_find(spark: SparkSession, a: argparse.Namespace) -> None:
    df, now = named(spark, load(spark, a)), P.now()
    tests = []
    for field, short in (("atime", "a"), ("mtime", "m"), ("ctime", "c")):
        if v := getattr(a, f"{short}min"):
            tests.append(P.minutes(field, v, now))
        if v := getattr(a, field):
            tests.append(P.days(field, v, now))
    for field, v in (("atime", a.anewer), ("mtime", a.newer), ("ctime", a.cnewer)):
        if v:
            r = walk.stat_row(v, True)
            tests.append(P.newer(field, r[8], r[9]))
    make = {"gid": P.gid, "group": P.group, "uid": P.uid, "user": P.user, "name": P.name_like, "path": P.path_like, "regex": P.path_regex, "size": P.size, "type": P.type_is}
    tests += [f(getattr(a, k)) for k, f in make.items() if getattr(a, k)]
    if a.maxdepth is not None:
        base = min((p.rstrip("/").count("/") for p in a.paths), default=0)
        tests.append(P.max_depth(a.maxdepth, base))
    df = P.find(df, *tests)
    if a.exec:
        df = P.passing_command(df, a.exec.split())
    if a.print or not a.output:
        say(df.select("name").orderBy("name"))
    save(spark, df, a)


def unlike_bytes(src: DataFrame, dst: DataFrame, src_root: str, dst_root: str) -> DataFrame:
    """Sections in which files of the same path and size differ, read once and written down."""
    pairs = compare.file_pairs(compare.sides(src, dst, src_root, dst_root, ["name", "type", "size"]))
    return fixed(chunks.unlike_sections(pairs))


def do_cmp(spark: SparkSession, a: argparse.Namespace) -> None:
    outputs = a.output or list(compare.DEFAULT_OUTPUTS)
    src, dst = walk.walk(spark, a.src), walk.walk(spark, a.dest)
    began = time.time()
    exprs_ = [o.partition(":")[0] for o in outputs]
    need = set().union(*[exprs.needed(exprs.parse(e)) for e in exprs_])
    unlike = unlike_bytes(src, dst, a.src, a.dest) if "CONTENT" in need and not a.lite else None
    out = fixed(compare.compare(src, dst, a.src, a.dest, exprs_, target="target", unlike=unlike))
    for r in compare.counts(out, exprs_).collect():
        print(r.output, r.clause, r.n_src if r.n_src == r.n_dest else f"N/A (Src: {r.n_src} Dest: {r.n_dest})", sep="\t")
    for o in outputs:
        expr, _, file = o.partition(":")
        if file:
            hit = compare.matching(out, expr).select("name")
            both = src.unionByName(dst).join(hit, "name", "left_semi")
            save(spark, both, argparse.Namespace(output=os.path.join(a.base or "", file), text=a.text))
    n = out.count()
    print(aggregate.rates(n, 0, time.time() - began))


def do_sync(spark: SparkSession, a: argparse.Namespace) -> None:
    src = walk.walk(spark, a.src, dereference=a.dereference)
    dst = walk.walk(spark, a.dest)
    bad = walk.errors(src)
    if owners.PathArgument.of(a.dest).exists is False and not owners.PathArgument.of(a.dest.rstrip("/").rpartition("/")[0] or "/").is_dir:
        raise SystemExit("the destination's parent doesn't exist")
    if not owners.PathArgument.of(a.src).exists:
        raise SystemExit("the source doesn't exist")
    sync.check_source(src)
    if not owners.PathArgument.of(a.dest).exists:
        dst = dst.limit(0)
    link = walk.walk(spark, a.link_dest) if a.link_dest else None
    unlike = unlike_bytes(src, dst, a.src, a.dest) if a.contents else None
    unlike_link = unlike_bytes(src, link, a.src, a.link_dest) if a.contents and link is not None else None
    plan = fixed(
        sync.sync_plan(src, dst, a.src, a.dest, delete=a.delete, contents=a.contents, target="target", link_dest=link, link_root=a.link_dest, walk_errors=not bad.isEmpty(), unlike=unlike, unlike_link=unlike_link)
    )
    if a.dryrun:
        say(plan.orderBy("step", "rel"))
    else:
        print(apply.run_sync(plan, a.src, a.dest, link_root=a.link_dest, sections=unlike, sparse=a.sparse, attributes=a.xattrs, batch=a.batch_files))


def do_dup(spark: SparkSession, a: argparse.Namespace) -> None:
    say(duplicates.duplicate_files(load(spark, a)).orderBy("sha256", "name").select("sha256", "name"))


def do_cp(spark: SparkSession, a: argparse.Namespace) -> None:
    *sources, dest = a.paths
    to = owners.PathArgument.of(dest)
    plans.check_copy(sources, dest, to.is_dir, to.exists)
    a.paths = sources
    inside = lambda s: f"{to.path}/{s.rstrip('/').rpartition('/')[2]}" if to.is_dir else to.path
    roots = [(owners.PathArgument.of(s).path, inside(s)) for s in sources]
    items = plans.below_roots(load(spark, a), [r for r, _ in roots])
    plan = fixed(plans.copy_plan(items, roots))
    with Progress(spark, lambda x: print(x, file=sys.stderr)) as progress:
        print(apply.run_copy(plan, preserve=a.preserve, sparse=a.sparse, batch=a.batch_files, attributes=a.xattrs, progress=progress))


def do_rm(spark: SparkSession, a: argparse.Namespace) -> None:
    items = plans.select_items(load(spark, a), match=a.match, exclude=a.exclude, only_basename=a.name)
    plan = fixed(plans.remove_plan(items))
    if a.dryrun:
        say(plan.orderBy("step", "name").select("action", "name"))
    else:
        print(apply.run_remove(plan, traceless=a.traceless))
    save(spark, items, a)


def do_chmod(spark: SparkSession, a: argparse.Namespace) -> None:
    items = plans.select_items(load(spark, a), match=a.match, exclude=a.exclude, only_basename=a.name)
    uid = owners.user_id(a.owner) if a.owner else None
    gid = owners.group_id(a.group) if a.group else None
    print(apply.run_chmod(fixed(plans.chmod_plan(items, a.mode, uid=uid, gid=gid, force=a.force))))


def do_reln(spark: SparkSession, a: argparse.Namespace) -> None:
    old, new, *a.paths = a.paths
    print(apply.run_relink(fixed(relink.relink_plan(load(spark, a), old, new, as_relative=a.relative)), preserve=a.preserve))


def do_tar(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.create:
        root = owners.PathArgument.of(a.chdir or ".").path
        paths = [p if p.startswith("/") else f"{root}/{p}" for p in a.paths]
        print(archive.create_archive(walk.walk(spark, paths), root, a.file).count())
        archive.save_index(archive.read_index(spark, a.file), a.file)
    else:
        print(archive.extract(archive.load_index(spark, a.file), a.file, a.chdir or ".", owner=a.preserve_owner, times=not a.no_times, modes=not a.no_modes))


def do_bz2(spark: SparkSession, a: argparse.Namespace) -> None:
    for p in a.paths:
        if a.decompress:
            print(blockzip.decompress_file(spark, p, p.removesuffix(".dbz2"), force=a.force))
        else:
            print(blockzip.compress_file(spark, p, f"{p}.dbz2", blocksize=a.blocksize, keep=a.keep, force=a.force))


def do_bcast(spark: SparkSession, a: argparse.Namespace) -> None:
    print(apply.share_file(spark, a.paths[0]))


def do_make(spark: SparkSession, a: argparse.Namespace) -> None:
    df = generate.random_tree(spark, owners.PathArgument.of(a.paths[0]).path, items=a.nitems, levels=a.depth, max_size=parse_bytes(a.size), seed=a.seed)
    apply.make_directories(df)
    apply.make_files(df)
    apply.fill_files(chunks.explode_chunks(df), a.fill, a.seed)
    apply.make_links(df.filter("type = 'LINK'").withColumn("target", F.lit("nowhere")))
    say(aggregate.summary(df))


def do_du(spark: SparkSession, a: argparse.Namespace) -> None:
    root = a.root or owners.PathArgument.of(a.paths[0]).path
    rows = aggregate.children_report(load(spark, a), root, a.top)
    say(rows.select(show_bytes(F.col("bytes")), show_count(F.col("n")), F.coalesce("child", F.lit("total"))))


def do_grep(spark: SparkSession, a: argparse.Namespace) -> None:
    pattern, *folders = a.paths
    for f in folders:
        say(textsearch.grep_files(spark, f, pattern))


def do_run(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = [x.rstrip("\n") for x in sys.stdin if x.strip()]
    rows = spark.createDataFrame([(x,) for x in lines], "command string").repartition(max(1, min(len(lines), 64)))
    for r in apply.run_commands(rows).toLocalIterator():
        print(r.output, end="")


def do_stripe(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reports layouts that the file system tells; refuses where it tells none."""
    files = fixed(walk.stripes(load(spark, a)).filter("type = 'FILE'"))
    if files.filter("stripe_count is not null").isEmpty():
        raise SystemExit("no file here has a layout: the file system isn't striped")
    hit = files if a.report else plans.restripe_report(files, a.count, parse_bytes(a.size), parse_bytes(a.minsize))
    say(hit.select("size", "stripe_count", "stripe_size", "name"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeline", description=__doc__)
    tools = p.add_subparsers(dest="tool", required=True)

    def tool(name: str, run, *flags: str, io: bool = True, paths: str | None = "*") -> argparse.ArgumentParser:
        t = tools.add_parser(name)
        t.set_defaults(run=run)
        if io:
            t.add_argument("--input", "-i")
            t.add_argument("--text", "-t", action="store_true")
        for f in flags:
            t.add_argument(f"--{f}", action="store_true")
        if paths:
            t.add_argument("paths", nargs=paths)
        return t

    t = tool("walk", do_walk, "lite", "print", "file-histogram", "dereference")
    for f in ("output", "sort", "distribution"):
        t.add_argument(f"--{f}")
    t = tool("find", do_find, "print")
    for f in "output amin anewer atime cmin cnewer ctime mmin newer mtime gid group uid user name path regex size type exec".split():
        t.add_argument(f"--{f}")
    t.add_argument("--maxdepth", type=int)
    t = tool("cmp", do_cmp, "text", "lite", io=False, paths=None)
    t.add_argument("--base")
    t.add_argument("--output", "-o", action="append")
    t.add_argument("src")
    t.add_argument("dest")
    t = tool("sync", do_sync, "dryrun", "contents", "delete", "dereference", "sparse", io=False, paths=None)
    t.add_argument("--link-dest")
    t.add_argument("--batch-files", type=int)
    t.add_argument("--xattrs", default="none")
    t.add_argument("src")
    t.add_argument("dest")
    tool("dup", do_dup)
    t = tool("cp", do_cp, "preserve", "sparse", "dereference")
    t.add_argument("--batch-files", type=int)
    t.add_argument("--xattrs", default="none")
    for name, run in (("rm", do_rm), ("chmod", do_chmod)):
        t = tool(name, run, "name", *(["dryrun", "lite", "traceless"] if name == "rm" else ["force"]))
        for f in ("match", "exclude", *(["output"] if name == "rm" else ["mode", "owner", "group"])):
            t.add_argument(f"--{f}")
    tool("reln", do_reln, "preserve", "relative")
    t = tool("stripe", do_stripe, "report")
    t.add_argument("--count", type=int, default=1)
    t.add_argument("--size", default="1MB")
    t.add_argument("--minsize", default="0")
    t = tool("tar", do_tar, "create", "extract", "preserve-owner", "no-times", "no-modes", io=False)
    t.add_argument("--file", "-f", required=True)
    t.add_argument("--chdir", "-C")
    t = tool("bz2", do_bz2, "compress", "decompress", "keep", "force", io=False)
    t.add_argument("--blocksize", type=int, default=9)
    tool("bcast", do_bcast, io=False)
    t = tool("make", do_make, io=False)
    for f, kind, default in (("seed", int, 1), ("nitems", int, 3000), ("depth", int, 5), ("size", str, "2000"), ("fill", str, "random")):
        t.add_argument(f"--{f}", type=kind, default=default)
    t = tool("du", do_du)
    t.add_argument("--root")
    t.add_argument("--top", type=int, default=100)
    tool("grep", do_grep, io=False)
    tool("run", do_run, io=False, paths=None)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if spark is None:
        spark = SparkSession.builder.appName("treeline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        ship(spark)
    a.run(spark, a)
