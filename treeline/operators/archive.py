"""Tar archives: layout by prefix sums, parallel writing, and reading by offsets."""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.scalars import round_up
from treeline.operators.apply import draft_of
from treeline.operators.order import positions
from treeline.plans.lineage import cut

BLOCK = 512
LAYOUT = "name string, header_size bigint, entry_size bigint, entry_offset bigint, data_offset bigint"


def plain_sizes(df: DataFrame) -> DataFrame:
    """``header_size`` and ``entry_size`` of entries that fit plain headers: 512, and for files their data padded to 512.

    Items that are neither file, directory nor link take no room.
    """
    known = F.col("type").isin("FILE", "DIR", "LINK")
    header = F.when(known, F.lit(BLOCK)).otherwise(F.lit(0)).cast("long")
    data = F.when(F.col("type") == "FILE", round_up(F.coalesce("size", F.lit(0)))).otherwise(F.lit(0))
    return df.withColumn("header_size", header).withColumn("entry_size", header + data)


def layout(sized: DataFrame) -> DataFrame:
    """Where each entry and its data begin, entries in order of names so that parents come first."""
    placed = positions(sized, [F.asc("name")], F.col("entry_size"))
    return placed.select("name", "header_size", "entry_size", F.col("offset").alias("entry_offset"), (F.col("offset") + F.col("header_size")).alias("data_offset"))


def total_bytes(df: DataFrame) -> DataFrame:
    """One row: bytes of data of all files."""
    return df.agg(F.coalesce(F.sum(F.when(F.col("type") == "FILE", F.col("size"))), F.lit(0)).alias("bytes"))


def _header(path: str, arcname: str, row: dict) -> bytes:
    info = tarfile.TarInfo(arcname)
    info.mode, info.uid, info.gid = (row["mode"] or 0) & 0o7777, row["uid"] or 0, row["gid"] or 0
    info.mtime = row["mtime"] or 0
    if row["type"] == "DIR":
        info.type = tarfile.DIRTYPE
    elif row["type"] == "LINK":
        info.type, info.linkname = tarfile.SYMTYPE, os.readlink(path)
    else:
        info.size = row["size"] or 0
    return info.tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape")


def real_sizes(df: DataFrame, root: str) -> DataFrame:
    """Header and entry sizes of real items with the headers they will get (long names and links take more room)."""
    root = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, sizes = [], []
            for r in batch.to_pylist():
                if r["type"] not in ("FILE", "DIR", "LINK"):
                    heads.append(0)
                    sizes.append(0)
                    continue
                n = len(_header(r["name"], os.path.relpath(r["name"], root), r))
                heads.append(n)
                sizes.append(n + (-(-(r["size"] or 0) // BLOCK) * BLOCK if r["type"] == "FILE" else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.int64()), pa.array(sizes, pa.int64())], names=[*batch.schema.names, "header_size", "entry_size"])

    cols = ["name", "type", "mode", "uid", "gid", "mtime", "size"]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)
    return df.select(*cols).mapInArrow(run, f"{kinds}, header_size bigint, entry_size bigint")


def create_archive(df: DataFrame, root: str, out: str) -> DataFrame:
    """Write the items of a walk below ``root`` to one tar file on a file system that all executors share; the layout.

    Offsets come from a prefix sum, so tasks write their entries at their places at once and
    may be repeated. Two empty blocks end the archive.
    """
    root = root.rstrip("/")
    # places and length must come from one and the same walk
    sized = cut(real_sizes(df.filter(F.col("name") != root), root))
    placed = positions(sized, [F.asc("name")], F.col("entry_size"))
    end = sized.agg(F.coalesce(F.sum("entry_size"), F.lit(0))).first()[0]
    with open(out, "wb") as f:
        f.truncate(end + 2 * BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(out, "r+b") as f:
            for batch in batches:
                for r in batch.to_pylist():
                    if not r["entry_size"]:
                        continue
                    f.seek(r["offset"])
                    f.write(_header(r["name"], os.path.relpath(r["name"], root), r))
                    if r["type"] == "FILE":
                        left = r["size"] or 0
                        with open(r["name"], "rb") as g:
                            while left and (data := g.read(min(1 << 20, left))):
                                f.write(data)
                                left -= len(data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name"), batch.column("header_size"), batch.column("entry_size"), batch.column("offset"), pa.array([a + b for a, b in zip(batch.column("offset").to_pylist(), batch.column("header_size").to_pylist(), strict=True)], pa.int64())],
                    names=["name", "header_size", "entry_size", "entry_offset", "data_offset"],
                )

    return placed.mapInArrow(run, LAYOUT)


INDEX = "name string, type string, size bigint, mode bigint, uid bigint, gid bigint, mtime bigint, target string, entry_offset bigint, data_offset bigint"
_KINDS = {tarfile.DIRTYPE: "DIR", tarfile.SYMTYPE: "LINK", tarfile.REGTYPE: "FILE", tarfile.AREGTYPE: "FILE"}


#: An archive is looked through in stretches of at least so many bytes, and in at most so many stretches.
STRETCH = 64 << 20
MOST_STRETCHES = 4_096


def _first_header(f, low: int, high: int) -> int | None:
    """The first place from ``low`` on that looks like a header: its mark, and a checksum that holds."""
    for at in range(low, high, 1 << 20):
        f.seek(at)
        data = f.read(min(1 << 20, high - at))
        for k in range(0, len(data) - BLOCK + 1, BLOCK):
            block = data[k : k + BLOCK]
            if block[257:262] == b"ustar":
                try:
                    if tarfile.nti(block[148:156]) in tarfile.calc_chksums(block):
                        return at + k
                except tarfile.HeaderError:
                    continue
    return None


def _chain(f, start: int, high: int) -> Iterator[tarfile.TarInfo | int]:
    """The entries that begin in ``[start, high)``, one after the other, then the place of the first that begins beyond."""
    f.seek(start)
    end = os.fstat(f.fileno()).st_size
    try:
        with tarfile.open(fileobj=f, mode="r:") as t:
            for m in t:
                if m.offset >= high:
                    end = m.offset
                    break
                yield m
                t.members = []
    except tarfile.ReadError:
        pass  # nothing but the empty blocks at the end
    yield end


def read_index(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """Entries of a tar file with their offsets, found by many tasks.

    Each looks through a stretch: finds the first header there by its checksum and jumps from
    one to the next. A stretch's find is believed only if the chain of the stretch before ends
    at it (a file may hold an archive itself); else that stretch is begun anew from where the
    chain ends. So it is exactly the list that one task from header to header would find.
    """
    size = os.path.getsize(path)
    stretch = max(stretch, -(-size // MOST_STRETCHES))
    stretch += -stretch % BLOCK
    lows = list(range(0, size, stretch)) or [0]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, starts, ends = [], [], []
            with open(path, "rb") as f:
                for k, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    low, high = k * stretch, min((k + 1) * stretch, size)
                    start = known if known is not None else 0 if k == 0 else _first_header(f, low, high)
                    ks.append(k)
                    starts.append(start)
                    *_, end = _chain(f, start, high) if start is not None else (None,)
                    ends.append(end)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (ks, starts, ends)], names=["k", "start", "end"])

    def look(work: list[tuple[int, int | None]]) -> dict[int, tuple[int | None, int | None]]:
        rows = spark.createDataFrame(work, "k bigint, known bigint").repartitionById(min(len(work), 256), F.pmod("k", F.lit(min(len(work), 256))).cast("int"))
        return {r.k: (r.start, r.end) for r in rows.mapInArrow(probe, "k bigint, start bigint, `end` bigint").collect()}

    found = look([(k, None) for k in range(len(lows))])
    while True:
        at, anew, true = 0, [], []
        for k, low in enumerate(lows):
            high = min(low + stretch, size)
            if at >= high and size:
                continue  # within an entry that began before
            if found[k][0] != at:
                anew.append((k, at))
                # later finds are checked once this one is known, unless they meet what it is likely to come to
                at = found[k][1] if found[k][1] is not None else high
                if found[k][1] is None:
                    break
            else:
                true.append((k, at))
                at = found[k][1]
        if not anew:
            break
        found.update(look(anew))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with open(path, "rb") as f:
                for k, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows: list[tuple] = []
                    for m in _chain(f, start, min((k + 1) * stretch, size)):
                        if isinstance(m, int):
                            continue
                        rows.append((m.name, _KINDS.get(m.type, "UNKNOWN"), m.size, m.mode, m.uid, m.gid, int(m.mtime), m.linkname or None, m.offset, m.offset_data))
                        if len(rows) == 4096:
                            yield _index_batch(rows)
                            rows = []
                    yield _index_batch(rows)

    work = spark.createDataFrame(true, "k bigint, start bigint")
    return work.repartitionById(max(1, min(len(true), 256)), F.pmod("k", F.lit(256)).cast("int") % max(1, min(len(true), 256))).mapInArrow(run, INDEX)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in INDEX.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def save_index(index: DataFrame, path: str) -> None:
    """Keep the index of an archive beside it, so that it needn't be scanned again."""
    index.write.mode("overwrite").parquet(f"{path}.index")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The saved index of an archive if there is one, else a scan."""
    return spark.read.parquet(f"{path}.index") if os.path.isdir(f"{path}.index") else read_index(spark, path)


def extract(index: DataFrame, path: str, dest: str, *, owner: bool = False, times: bool = True, modes: bool = True) -> int:
    """Put the entries of an index below ``dest``: directories, then files, then links, then directories' details. Number of items.

    Files are written under other names and renamed, so a task may be repeated. Absolute names,
    names with ``..`` and names that lead through a link are left out: nothing is written
    outside of ``dest``, and links are made when no file is to come any more.
    """
    index = cut(index.filter(~F.col("name").startswith("/") & ~F.array_contains(F.split("name", "/"), "..") & (F.col("type") != "UNKNOWN")))
    root = os.path.realpath(dest)

    def place(name: str) -> str | None:
        to = os.path.join(root, name.rstrip("/"))
        above = os.path.realpath(os.path.dirname(to))
        return to if above == root or above.startswith(root + "/") else None

    def dirs(rows: Iterator) -> None:
        for r in rows:
            if (to := place(r["name"])) and not os.path.islink(to):
                os.makedirs(to, exist_ok=True)

    def finish(r, to: str) -> None:
        if owner:
            os.chown(to, r["uid"], r["gid"], follow_symlinks=False)
        if modes:
            os.chmod(to, r["mode"])
        if times:
            os.utime(to, (r["mtime"], r["mtime"]))

    def files(rows: Iterator) -> None:
        with open(path, "rb") as f:
            for r in rows:
                if not (to := place(r["name"])):
                    continue
                os.makedirs(os.path.dirname(to), exist_ok=True)
                tmp = draft_of(to)
                f.seek(r["data_offset"])
                with open(tmp, "wb") as g:
                    left = r["size"]
                    while left and (data := f.read(min(1 << 20, left))):
                        g.write(data)
                        left -= len(data)
                finish(r, tmp)
                os.replace(tmp, to)

    def links(rows: Iterator) -> None:
        for r in rows:
            to = place(r["name"])
            if not to or os.path.isdir(to) and not os.path.islink(to):
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            tmp = draft_of(to)
            os.symlink(r["target"], tmp)
            os.replace(tmp, to)

    def details(rows: Iterator) -> None:
        for r in rows:
            if (to := place(r["name"])) and os.path.isdir(to) and not os.path.islink(to):
                finish(r, to)

    os.makedirs(root, exist_ok=True)
    index.filter("type = 'DIR'").foreachPartition(dirs)
    index.filter("type = 'FILE'").foreachPartition(files)
    index.filter("type = 'LINK'").foreachPartition(links)
    index.filter("type = 'DIR'").foreachPartition(details)
    return index.count()
