"""Carrying out plans on real trees. Every action may be repeated, since Spark may run a task twice."""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.order import depths
from treeline.operators.progress import Progress
from treeline.plans.lineage import cut


def draft_of(path: str) -> str:
    """A name beside ``path`` that no other attempt of a task, on whatever machine, writes to."""
    return f"{path}.part-{uuid.uuid4().hex}"


def _each(df: DataFrame, act: Callable) -> None:
    def run(rows: Iterator) -> None:
        for r in rows:
            act(r)

    df.foreachPartition(run)


def _each_text(df: DataFrame, columns: list[str], act: Callable) -> int:
    """:func:`_each` for columns of text, in batches, with an end for names of drafts that no other attempt has; number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = draft_of("")
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                act(*values, end)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select(*columns).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _levels(df: DataFrame, act: Callable, deepest_first: bool = False) -> None:
    """One level of directories after the other; there are as many jobs as the tree has levels."""
    for d in sorted(depths(df), reverse=deepest_first):
        _each(df.filter(F.col("depth") == d), act)


def make_directories(df: DataFrame) -> None:
    """Create the directories of a list, shallow to deep."""
    _levels(df.filter("type = 'DIR'"), lambda r: os.makedirs(r["name"], exist_ok=True))


def make_files(df: DataFrame) -> None:
    """Create the files of a list, empty; existing ones stay."""
    _each(df.filter("type = 'FILE'"), lambda r: open(r["name"], "ab").close())


def make_links(df: DataFrame) -> None:
    """Create symbolic links ``name`` to ``target``, replacing what is there."""

    def act(target: str, name: str, end: str) -> None:
        try:
            os.symlink(target, name)
        except FileExistsError:
            tmp = name + end
            os.symlink(target, tmp)
            os.replace(tmp, name)

    _each_text(df, ["target", "name"], act)


def make_hard_links(df: DataFrame) -> None:
    """Give ``source`` the further name ``name``; a symbolic link itself gets it, wherever it points."""

    def act(source: str, name: str, _: str) -> None:
        try:
            os.link(source, name, follow_symlinks=False)
        except FileExistsError:
            if not os.path.samestat(os.lstat(source), os.lstat(name)):
                os.unlink(name)
                os.link(source, name, follow_symlinks=False)

    _each_text(df, ["source", "name"], act)


def fill_files(chunks: DataFrame, fill: int | str = 0, seed: int = 1) -> None:
    """Fill sections of files with one byte, or by a pattern of :data:`treeline.sources.generate.FILL`.

    Random bytes follow from the seed, the file and the place, so a task run again writes the same.
    """
    from treeline.sources.generate import fill_bytes

    def act(r) -> None:
        fd = os.open(r["name"], os.O_RDWR | os.O_CREAT, 0o644)
        try:
            own = zlib.crc32(f"{seed} {r['offset']} {r['name']}".encode("utf-8", "surrogateescape"))
            data = bytes([fill]) * r["length"] if isinstance(fill, int) else fill_bytes(fill, r["length"], own)
            os.pwrite(fd, data, r["offset"])
        finally:
            os.close(fd)

    _each(chunks, act)


def copy_one(source: str, dest: str, *, sparse: bool = False) -> int:
    """Copy a file's data under another name and rename it; holes stay holes with ``sparse``. Bytes written."""
    tmp, written = draft_of(dest), 0
    with open(source, "rb") as f, open(tmp, "wb") as g:
        size = os.fstat(f.fileno()).st_size
        if not sparse:
            shutil.copyfileobj(f, g, 1 << 20)
            written = size
        at = 0
        while sparse and at < size:
            try:
                start = os.lseek(f.fileno(), at, os.SEEK_DATA)
            except OSError:
                break
            at = os.lseek(f.fileno(), start, os.SEEK_HOLE)
            f.seek(start)
            g.seek(start)
            left = at - start
            while left and (data := f.read(min(1 << 20, left))):
                g.write(data)
                left -= len(data)
            written += at - start
        g.truncate(size)
    os.replace(tmp, dest)
    return written


def copy_metadata(source: str, dest: str, *, owner: bool = False, attributes: str = "none") -> None:
    """Mode, times and, if asked, owner and extended attributes (none, all, or a prefix such as ``user.``)."""
    s = os.lstat(source)
    if owner:
        os.chown(dest, s.st_uid, s.st_gid, follow_symlinks=False)
    if attributes != "none":
        for a in os.listxattr(source, follow_symlinks=False):
            if attributes == "all" or a.startswith(attributes):
                os.setxattr(dest, a, os.getxattr(source, a, follow_symlinks=False), follow_symlinks=False)
    if not os.path.islink(source):
        os.chmod(dest, s.st_mode & 0o7777)
    os.utime(dest, ns=(s.st_atime_ns, s.st_mtime_ns), follow_symlinks=False)


def run_copy(plan: DataFrame, *, preserve: bool = True, owner: bool = False, sparse: bool = False, attributes: str = "none", batch: int | None = None, progress: Progress | None = None) -> int:
    """Carry out a copy plan (:func:`treeline.operators.plans.copy_plan`); number of items.

    Directories first, level by level, then links and files, then directories' metadata from
    the deepest. With ``batch``, files go in runs of that many, a job to each. The plan is
    written down first, so that what is done can't change it.
    """
    plan = cut(plan)
    for step in sorted(r[0] for r in plan.filter("action = 'mkdir'").select("step").distinct().collect()):
        _each(plan.filter((F.col("action") == "mkdir") & (F.col("step") == step)), lambda r: os.makedirs(r["dest"], exist_ok=True))

    def item(r) -> int:
        size = 0
        if r["action"] == "symlink":
            tmp = draft_of(r['dest'])
            os.symlink(os.readlink(r["name"]), tmp)
            os.replace(tmp, r["dest"])
        else:
            size = copy_one(r["name"], r["dest"], sparse=sparse)
        if preserve:
            copy_metadata(r["name"], r["dest"], owner=owner, attributes=attributes)
        return size

    one = progress.counted(item) if progress else item
    files = plan.filter("action in ('copy', 'symlink')")
    if batch:
        from treeline.operators.order import batches

        split = batches(files, [F.asc("dest")], batch)
        for b in sorted(r[0] for r in split.select("batch").distinct().collect()):
            _each(split.filter(F.col("batch") == b), one)
    else:
        _each(files, one)
    if preserve:
        for step in sorted(r[0] for r in plan.filter("action = 'metadata'").select("step").distinct().collect()):
            _each(plan.filter((F.col("action") == "metadata") & (F.col("step") == step)), lambda r: copy_metadata(r["name"], r["dest"], owner=owner, attributes=attributes))
    return plan.filter("action <> 'metadata'").count()


def dealt(plan: DataFrame, strategy: str, partitions: int | None = None) -> DataFrame:
    """How removals are dealt to tasks: ``spread`` evenly, ``sorted`` evenly and in order of names, ``parent`` by directory."""
    from treeline.operators.order import by_parent

    n = partitions or plan.sparkSession.sparkContext.defaultParallelism
    if strategy == "parent":
        return by_parent(plan, n)
    if strategy == "sorted":
        return plan.repartition(n).sortWithinPartitions("name")
    if strategy == "spread":
        return plan.repartition(n)
    raise ValueError(f"not a strategy: {strategy!r}")


def run_remove(plan: DataFrame, strategy: str = "spread", *, traceless: bool = False) -> int:
    """Carry out a removal plan: everything but directories at once, then directories from the deepest. Gone items are no error.

    With ``traceless``, directories that stay get back the times they had.
    """
    plan = cut(plan)
    parents = None
    if traceless:
        from treeline.operators.plans import traceless_parents
        from treeline.sources.walk import restat

        stay = traceless_parents(plan).withColumn("mode", F.lit(None).cast("long"))
        parents = cut(restat(stay).select("name", "atime", "atime_nsec", "mtime", "mtime_nsec"))

    def act(r) -> None:
        try:
            (os.rmdir if r["action"] == "rmdir" else os.unlink)(r["name"])
        except FileNotFoundError:
            pass

    def restore(r) -> None:
        os.utime(r["name"], ns=(r["atime"] * 10**9 + r["atime_nsec"], r["mtime"] * 10**9 + r["mtime_nsec"]))

    for step in sorted(r[0] for r in plan.select("step").distinct().collect()):
        _each(dealt(plan.filter(F.col("step") == step), strategy), act)
    if parents is not None:
        _each(parents, restore)
    return plan.count()


def run_chmod(plan: DataFrame) -> dict[str, int]:
    """Carry out a plan of modes and owners; how many items changed and were skipped."""
    plan = cut(plan)

    def act(r) -> None:
        s = os.stat(r["name"])
        if (r["new_uid"], r["new_gid"]) != (s.st_uid, s.st_gid):
            os.chown(r["name"], r["new_uid"], r["new_gid"])
        os.chmod(r["name"], r["new_mode"] & 0o7777)

    _each(plan.filter("outcome = 'change'"), act)
    return {r["outcome"]: r["n"] for r in plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}


def run_relink(plan: DataFrame, *, preserve: bool = True, written: bool = False) -> int:
    """Point links to their ``new_target``; with ``preserve`` their times stay.

    ``written`` says that the plan follows from a list in the shared folder, such as a walk
    is, and needn't be written down once more.
    """
    plan = plan if written else cut(plan)

    def act(name: str, new_target: str, end: str) -> None:
        tmp = name + end
        s = os.lstat(name)
        os.symlink(new_target, tmp)
        if preserve:
            os.utime(tmp, ns=(s.st_atime_ns, s.st_mtime_ns), follow_symlinks=False)
        os.replace(tmp, name)

    return _each_text(plan, ["name", "new_target"], act)


def run_sync(
    plan: DataFrame, src_root: str, dst_root: str, *, link_root: str | None = None, sections: DataFrame | None = None, owner: bool = False, sparse: bool = False, attributes: str = "none", batch: int | None = None
) -> dict[str, int]:
    """Carry out a synchronization plan in order: remove, copy, overwrite, link, refresh. Items by action.

    ``sections`` (``rel``, ``offset``, ``length``) are the parts in which files to be overwritten
    differ: only these are written, at their places, by as many tasks as there are. Without it
    such files are copied whole. With ``batch``, files to be copied go in runs of that many.
    """
    plan = cut(plan)
    join = lambda root: F.concat(F.lit(root.rstrip("/")), F.col("rel"))
    rows = plan.select("rel", "action", join(src_root).alias("src"), join(dst_root).alias("dst"), F.length(F.regexp_replace("rel", "[^/]", "")).alias("depth"))
    meta = {"owner": owner, "attributes": attributes}

    def remove(r) -> None:
        if os.path.isdir(r["dst"]) and not os.path.islink(r["dst"]):
            shutil.rmtree(r["dst"], ignore_errors=True)
        elif os.path.lexists(r["dst"]):
            os.unlink(r["dst"])

    def copy(r) -> None:
        if os.path.islink(r["src"]):
            tmp = draft_of(r['dst'])
            os.symlink(os.readlink(r["src"]), tmp)
            os.replace(tmp, r["dst"])
        elif os.path.isdir(r["src"]):
            os.makedirs(r["dst"], exist_ok=True)
            return
        else:
            copy_one(r["src"], r["dst"], sparse=sparse)
        copy_metadata(r["src"], r["dst"], **meta)

    def patch(r) -> None:
        with open(r["src"], "rb") as f, open(r["dst"], "r+b") as g:
            at, left = r["offset"], r["length"]
            while left and (data := os.pread(f.fileno(), min(left, 1 << 20), at)):
                os.pwrite(g.fileno(), data, at)
                at, left = at + len(data), left - len(data)

    def link(r) -> None:
        if os.path.lexists(r["dst"]):
            os.unlink(r["dst"])
        os.link(link_root.rstrip("/") + r["rel"], r["dst"])

    _levels(rows.filter("action = 'remove'"), remove, deepest_first=True)
    copied = rows.filter("action = 'copy'")
    if batch:
        from treeline.operators.order import batches

        made = batches(copied, [F.asc("depth"), F.asc("rel")], batch)
        for b in sorted(r[0] for r in made.select("batch").distinct().collect()):
            _levels(made.filter(F.col("batch") == b), copy)
    else:
        _levels(copied, copy)
    changed = rows.filter("action = 'overwrite'")
    if sections is None:
        _each(changed, copy)
    else:
        _each(changed.join(sections, "rel").repartition(F.xxhash64("rel", "offset")), patch)
        _each(changed, lambda r: copy_metadata(r["src"], r["dst"], **meta))
    _each(rows.filter("action = 'link'"), link)
    _levels(rows.filter("action in ('refresh', 'copy')"), lambda r: copy_metadata(r["src"], r["dst"], **meta), deepest_first=True)
    return {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}


def share_file(spark, path: str) -> str:
    """Send one file to local storage of every executor; its name for ``SparkFiles.get``."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def run_commands(commands: DataFrame, column: str = "command") -> DataFrame:
    """``command``, ``status``, ``output`` of shell commands, one to a row, run by the executors."""
    import subprocess

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [subprocess.run(c, shell=True, capture_output=True, text=True, check=False) for c in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([d.returncode for d in done], pa.int32()), pa.array([d.stdout for d in done])], names=["command", "status", "output"])

    return commands.select(F.col(column).alias("command")).mapInArrow(run, "command string, status int, output string")
