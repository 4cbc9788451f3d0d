"""Parallel walks of real trees."""

from __future__ import annotations

import itertools
import os
import stat
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.entries import SCHEMA
from treeline.functions.paths import reduce_text
from treeline.plans.lineage import cut, pack, unpack

WALK_SCHEMA = T.StructType([*[T.StructField(f.name, f.dataType) for f in SCHEMA.fields], T.StructField("target", T.StringType()), T.StructField("error", T.StringType())])


def kind_of(mode: int) -> str:
    return "FILE" if stat.S_ISREG(mode) else "DIR" if stat.S_ISDIR(mode) else "LINK" if stat.S_ISLNK(mode) else "UNKNOWN"


def _text(path: str) -> str:
    return os.fsencode(path).decode("utf-8", "replace")


def stat_row(path: str, dereference: bool) -> tuple:
    """The row of one path; with an ``error`` and no detail if it can't be read."""
    name = _text(path)
    try:
        s = os.stat(path) if dereference else os.lstat(path)
        kind = kind_of(s.st_mode)
        target = _text(os.readlink(path)) if kind == "LINK" else None
    except OSError as e:
        return (name, name.count("/"), "UNKNOWN", *[None] * 10, None, e.strerror or str(e))
    times = [x for t in (s.st_atime_ns, s.st_mtime_ns, s.st_ctime_ns) for x in divmod(t, 1_000_000_000)]
    return (name, name.count("/"), kind, s.st_mode, s.st_uid, s.st_gid, *times, s.st_size, target, None)


def lite_row(path: str, kind: str) -> tuple:
    name = _text(path)
    return (name, name.count("/"), kind, *[None] * 10, None, None)


def target_row(path: str, kind: str) -> tuple:
    """:func:`lite_row` with the target of a link, or an ``error`` if it can't be read."""
    row = lite_row(path, kind)
    if kind != "LINK":
        return row
    try:
        return (*row[:-2], _text(os.readlink(path)), None)
    except OSError as e:
        return (*row[:2], "UNKNOWN", *row[3:-1], e.strerror or str(e))


#: What a walk tells without a stat of each item.
UNSTATTED = {"name", "depth", "type", "target", "error"}

#: Items a task lists before it hands the directories it hasn't got to back to be dealt out; each round as many again.
FIRST_ROUND = 2_000


def _listing(path: str, dereference: bool) -> Iterator[tuple[str, str]]:
    """Path and type of each child, as they are read: a huge directory is never a list."""
    with os.scandir(path) as it:
        for e in it:
            try:
                kind = "DIR" if e.is_dir(follow_symlinks=dereference) else "LINK" if e.is_symlink() and not dereference else "FILE" if e.is_file(follow_symlinks=dereference) else "UNKNOWN"
            except OSError:
                kind = "UNKNOWN"
            yield e.path, kind


def _loops(path: str, parent: str) -> bool:
    """Whether a followed link leads back to a directory above it."""
    real, above = os.path.realpath(path), os.path.realpath(parent)
    return above == real or above.startswith(real.rstrip("/") + "/")


def _expand(paths: Iterable[str], lite: bool, dereference: bool, budget: int, targets: bool = False) -> Iterator[tuple[tuple | None, bytes | None]]:
    """Rows of the items below ``paths`` until the budget is spent, then the directories that are left."""
    row = lite_row if lite else target_row if targets and not dereference else (lambda p, _: stat_row(p, dereference))
    stack, done = list(paths), 0
    while stack:
        if done >= budget:
            yield from ((None, os.fsencode(p)) for p in stack)
            return
        d = stack.pop()
        mine, error = row(d, "DIR"), None
        try:
            for p, k in _listing(d, dereference):
                if k == "DIR" and not (dereference and _loops(p, d)):
                    stack.append(p)
                else:
                    done += 1
                    yield row(p, k), None
        except OSError as e:
            error = e.strerror or str(e)
        done += 1
        yield (mine if error is None else (*mine[:-1], error)), None


def walk(spark: SparkSession, paths: str | Iterable[str], *, lite: bool = False, dereference: bool = False, partitions: int = 64, columns: list[str] | None = None) -> DataFrame:
    """Entries of whole trees, the roots among them, with ``target`` of links and ``error``.

    An item that can't be read has an error and no detail; a directory that can't be listed
    has its detail and an error. Nothing else is lost. With ``lite`` nothing but roots is
    stat'ed. Followed links that lead back above themselves are rows, but not entered.

    Tasks list directories until they have met a number of items; what they haven't got to is
    dealt out anew among all, so one deep or large subtree is soon the work of many. The driver
    sees no item: each round is written to the shared folder, so the walk happens once
    however often the result is read, and a lost executor repeats a task only. The folder must
    be visible to all executors.

    With ``columns`` only these are kept, in compressed batches: for trees of many millions of items.
    Where they are of ``UNSTATTED``, items aren't stat'ed.
    """
    roots = [reduce_text(p, True) for p in ([paths] if isinstance(paths, str) else list(paths))]
    kept = [WALK_SCHEMA.fieldNames().index(c) for c in columns] if columns else []
    schema = T.StructType([*([T.StructField("packed", T.BinaryType())] if columns else WALK_SCHEMA.fields), T.StructField("todo", T.BinaryType())])
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in WALK_SCHEMA]

    def batches_of(found: Iterator[tuple[tuple | None, bytes | None]]) -> Iterator[pa.RecordBatch]:
        none = (None,) * len(kinds)
        while rows := list(itertools.islice(found, 4096)):
            if columns:
                items, todo = [r for r, _ in rows if r], [t for _, t in rows if t]
                packed = [pack(pa.record_batch([pa.array([r[k] for r in items], kinds[k]) for k in kept], names=columns))] if items else []
                yield pa.record_batch([pa.array([*packed, *[None] * len(todo)], pa.binary()), pa.array([*[None] * len(packed), *todo], pa.binary())], names=schema.names)
                continue
            cols = list(zip(*[r or none for r, _ in rows], strict=True))
            yield pa.record_batch([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([t for _, t in rows], pa.binary())], names=schema.names)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[tuple | None, bytes | None]]:
            for batch in batches:
                for p in map(os.fsdecode, batch.column(0).to_pylist()):
                    row = stat_row(p, dereference)
                    yield (None, os.fsencode(p)) if row[2] == "DIR" else (lite_row(p, row[2]) if lite and row[-1] is None else row, None)

        yield from batches_of(found())

    def go_on(budget: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = [os.fsdecode(p) for batch in batches for p in batch.column(0).to_pylist()]
            yield from batches_of(_expand(work, lite, dereference, budget, bool(columns) and UNSTATTED >= {*columns}))

        return run

    todo = spark.createDataFrame([(os.fsencode(r),) for r in roots], "todo binary").coalesce(1)
    parts, budget, run = [], FIRST_ROUND, begin
    while True:
        found = cut(todo.mapInArrow(run, schema))
        mine = found.filter("todo is null").drop("todo")
        parts.append(unpack(mine, T.StructType([WALK_SCHEMA[k] for k in kept])) if columns else mine)
        left = found.filter("todo is not null").select("todo")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        todo = left.repartition(partitions, "todo") if len(parts) > 1 else left.coalesce(partitions)
        run, budget = go_on(budget), 2 * budget


def errors(walked: DataFrame) -> DataFrame:
    return walked.filter("error is not null").select("name", "error")


def restat(df: DataFrame, *, dereference: bool = False, skip: Callable[[str], bool] | None = None) -> DataFrame:
    """The items of a list stat'ed anew, without those a function skips or that are gone.

    Links are followed only if asked, or if the list knows the mode and it isn't a link's.
    """
    names = [f.name for f in WALK_SCHEMA]
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in WALK_SCHEMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, mode in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if skip and skip(name):
                    continue
                row = stat_row(name, dereference or (mode is not None and not stat.S_ISLNK(mode)))
                if row[-1] is None:
                    rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return df.select("name", "mode").mapInArrow(run, WALK_SCHEMA)


def stat_paths(spark: SparkSession, paths: list[str], dereference: bool = False) -> DataFrame:
    """Entries of a few single paths, stat'ed by the driver; to be appended to a list."""
    return spark.createDataFrame([stat_row(p, dereference) for p in paths], WALK_SCHEMA)


def file_system_of(path: str, table: str = "/proc/mounts") -> str | None:
    """The type of the file system that a path lies on: that of the longest mount above it."""
    path, best = os.path.realpath(path), ("", None)
    try:
        with open(table) as f:
            for line in f:
                _, mount, kind, *_ = line.split(" ")
                if (path == mount or path.startswith(mount.rstrip("/") + "/")) and len(mount) > len(best[0]):
                    best = (mount, kind)
    except OSError:
        return None
    return best[1]


def extents(df: DataFrame) -> DataFrame:
    """``name``, ``offset``, ``length`` of the stretches of files that hold data; holes are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    with open(name, "rb") as f:
                        size, at = os.fstat(f.fileno()).st_size, 0
                        while at < size:
                            try:
                                start = os.lseek(f.fileno(), at, os.SEEK_DATA)
                            except OSError:
                                break
                            at = os.lseek(f.fileno(), start, os.SEEK_HOLE)
                            rows.append((name, start, at - start))
                except OSError:
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["name", "offset", "length"])

    return df.filter("type = 'FILE'").select("name").mapInArrow(run, "name string, offset bigint, length bigint")


def extended_attributes(df: DataFrame) -> DataFrame:
    """``name``, ``attribute``, ``value`` of every item; access control lists are among them where the system has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    rows += [(name, a, os.getxattr(name, a, follow_symlinks=False)) for a in os.listxattr(name, follow_symlinks=False)]
                except OSError:
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], names=["name", "attribute", "value"])

    return df.select("name").mapInArrow(run, "name string, attribute string, value binary")


def mounts(spark: SparkSession, table: str = "/proc/mounts") -> DataFrame:
    """``device``, ``mount``, ``fstype`` of the file systems mounted where the task runs. The table has no length, so it is read by hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with open(table) as f:
                rows = [line.split(" ")[:3] for line in f if line.count(" ") >= 2]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["device", "mount", "fstype"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "device string, mount string, fstype string")


# The attribute that holds a file's layout on striped file systems, the two magic
# numbers of its plain forms, and the places of stripe size and stripe count behind them.
LAYOUT_ATTRIBUTE = "lustre.lov"
LAYOUT_MAGIC = (0x0BD10BD0, 0x0BD30BD0)
LAYOUT_FORM = "<II16xIH"


def stripes(df: DataFrame) -> DataFrame:
    """``df`` with ``stripe_count`` and ``stripe_size`` of its files, as the file system tells them; null where it has none."""
    import struct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, size = [], []
            for name in batch.column(0).to_pylist():
                found = (None, None)
                try:
                    magic, _, width, n = struct.unpack_from(LAYOUT_FORM, os.getxattr(name, LAYOUT_ATTRIBUTE, follow_symlinks=False))
                    found = (n, width) if magic in LAYOUT_MAGIC else found
                except (OSError, struct.error):
                    pass
                count.append(found[0])
                size.append(found[1])
            yield pa.record_batch([batch.column(0), pa.array(count, pa.int64()), pa.array(size, pa.int64())], names=["name", "stripe_count", "stripe_size"])

    asked = df.filter("type = 'FILE'").select("name").mapInArrow(run, "name string, stripe_count bigint, stripe_size bigint")
    return df.join(asked, "name", "left")
