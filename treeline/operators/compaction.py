"""Far too many small files: finding crowded directories, and rewriting them into few well-sized files.

Two levels. :func:`crowded_directories`, :func:`assign_parts` and :func:`compact_lists` work on
tables that describe or hold stored files. :class:`CompactableTable` compacts a partitioned
Parquet table in place.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.paths import dirname
from treeline.functions.times import micros
from treeline.plans.lineage import cut

SMALL_BYTES = 32_768
CROWD = 24
#: Files of one directory are packed in subsets of about this many, so that no task orders a whole huge directory.
SUBSET_FILES = 4_096
#: Files replaced by one version at most: their names are held by the driver and sent to every task (a few MB).
MOST_FILES = 50_000
#: Ids of versions are sent to every task up to this many.
MOST_SENT = 50_000


def crowds(files: DataFrame, place: Column | str, small: Column, size: str = "bytes") -> DataFrame:
    """``n_files``, ``n_small``, ``small_bytes`` and ``bytes`` of each ``place`` (a directory or partition) of a table of files.

    ``small`` says which files are. Counts are combined before they are shuffled, so a place
    that holds a third of all files is no more work than any.
    """
    b = F.col(size)
    return files.groupBy(place).agg(
        F.count(F.lit(1)).alias("n_files"), F.count(F.when(small, 1)).alias("n_small"),
        F.coalesce(F.sum(F.when(small, b)), F.lit(0)).alias("small_bytes"), F.coalesce(F.sum(b.cast("decimal(20,0)")), F.lit(0)).alias("bytes"),
    )


def crowded_directories(
    entries: DataFrame, *, small_bytes: int = SMALL_BYTES, crowd: int = CROWD, name: str = "name", version: str = "walked_at"
) -> DataFrame:
    """``dir``, ``n_small``, ``small_bytes``: directories that directly hold at least ``crowd`` small files.

    ``entries`` may list a path many times; its row with the greatest ``version`` (a timestamp)
    is its current one, and counts if its type is FILE and its size isn't null and is below
    ``small_bytes``. Listings are combined by path before and after one shuffle on the path, so
    neither a hot directory nor a path listed often holds up a task; directories are then
    counted by :func:`crowds`, as those of a table to be compacted are. Rows without name or
    version are left out. If current rows of a path contradict each other, a small one stands.
    """
    small = (F.col("type") == "FILE") & (F.col("size") >= 0) & (F.col("size") < small_bytes)
    # newest first, then small before other, in one long: both sides of the shuffle aggregate in place
    state = micros(entries, version) * 2 + F.coalesce(small, F.lit(False)).cast("long")
    listed = entries.filter(F.col(name).isNotNull() & F.col(version).isNotNull()).select(
        F.col(name).alias("p"), state.alias("s"), F.when(small, F.col("size")).alias("bytes")
    )
    current = listed.groupBy("p").agg(F.max("s").alias("s"), F.max_by("bytes", "s").alias("bytes")).filter(F.col("s") % 2 != 0)
    totals = crowds(current, dirname("p").alias("dir"), F.lit(True))
    return totals.filter(F.col("n_small") >= crowd).select("dir", "n_small", "small_bytes")


def stored_files(lists: DataFrame) -> DataFrame:
    """One row for each stored file: ``name``, ``dir``, ``bytes`` (of the body) and ``body``.

    Rows repeated as they are are one file; a null name is left out; of differing rows of one
    name the one with the greatest mtime, then the longest body stands.
    """
    best = F.struct("mtime", F.octet_length("body").alias("bytes"), "body")
    one = lists.filter("name is not null").groupBy("name").agg(F.max(best).alias("r"))
    return one.select("name", dirname("name").alias("dir"), F.coalesce("r.bytes", F.lit(0)).alias("bytes"), F.col("r.body").alias("body"))


def assign_parts(files: DataFrame, target_bytes: int, *, small_bytes: int | None = None, subset_files: int = SUBSET_FILES) -> DataFrame:
    """``dir``, ``name``, ``bytes``, ``subset``, ``part``: into which output file of its directory each file goes.

    Files are taken in byte order of names; a part closes where the running size passes a
    multiple of ``target_bytes``. A directory with many files is split by a hash of the name
    into subsets of about ``subset_files``, each packed by itself, so a directory that holds a
    third of all files is packed by many tasks. Files of ``small_bytes`` and more keep a part
    of their own when it is given.
    """
    files = files.select("dir", "name", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    counts = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    split = F.ceil(F.col("n") / subset_files).cast("long")
    placed = files.join(counts, "dir").select(
        "dir", "name", "bytes", F.pmod(F.xxhash64("name"), F.greatest(split, F.lit(1).cast("long"))).alias("subset")
    )
    w = Window.partitionBy("dir", "subset").orderBy("name")
    before = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.expr(f"before div {int(target_bytes)}")
    out = placed.withColumn("before", before).withColumn("part", part).drop("before")
    return out if small_bytes is None else out.withColumn("part", F.when(F.col("bytes") < small_bytes, F.col("part")))


def records(files: DataFrame) -> DataFrame:
    """The records of stored files: ``dir``, ``file``, ``line``, ``path``, ``type``.

    A record is a line; lines end with LF or CRLF, the last may have no end. Empty lines, null
    and empty bodies hold no record. The type letter stands after the last bar, since paths may
    hold bars; a line without a bar has a null type.
    """
    lines = files.select("dir", F.col("name").alias("file"), F.posexplode(F.split("body", "\n", -1)).alias("line", "text"))
    text = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    lines = lines.withColumn("text", text).filter("text <> ''")
    letter = F.substring_index("text", "|", -1)
    bar = F.contains("text", F.lit("|"))
    path = F.when(bar, F.expr("left(text, length(text) - length(substring_index(text, '|', -1)) - 1)")).otherwise(F.col("text"))
    return lines.select("dir", "file", "line", path.alias("path"), F.when(bar, letter).alias("type"))


def compact_lists(lists: DataFrame, target_bytes: int, crowd: int = CROWD, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """One row for each record of each stored file with the compacted file ``dir``, ``subset``, ``part`` that holds it.

    Only directories with at least ``crowd`` small files are rewritten; records of other
    directories have null ``subset`` and ``part``, and stay where they are (``file``).
    """
    files = stored_files(lists)
    small = F.sum(F.when(F.col("bytes") < small_bytes, 1).otherwise(0)).alias("n_small")
    crowded = files.groupBy("dir").agg(small).filter(F.col("n_small") >= crowd).select("dir")
    where = assign_parts(files.join(crowded, "dir", "left_semi"), target_bytes).select(F.col("name").alias("file"), "subset", "part")
    return records(files).join(where, "file", "left").select("dir", "subset", "part", "file", "line", "path", "type")


def write_each(files: DataFrame, path: str, column: str = "dir") -> None:
    """A Parquet file of its records for each stored file, in the folder of its directory below ``path``.

    A file without records becomes one without rows. Names and contents follow from the stored
    file, so that a task run again writes the same.
    """
    # records by stored file lie in one array each, made from the body where it is read
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), "\n", -1), lambda t, i: F.struct(i.alias("line"), t.alias("body")))
    each = files.select("dir", F.col("name").alias("file"), lines.alias("r"))
    # time goes by files, not bytes: a fixed number of tasks isn't joined into a few
    each = each.repartition(4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("line", pa.int32()), ("path", pa.string()), ("type", pa.string())])
        fs, root = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        made = set()
        for batch in batches:
            for folder, file, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                folder = f"{root}/{column}={escaped(folder)}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                rows = [(file, x["line"], *_record(x["body"])) for x in lines if x["body"].removesuffix("\r")]
                table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds.types, strict=True)], schema=kinds)
                name = hashlib.sha256(file.encode()).hexdigest()
                draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
                pq.write_table(table, draft, filesystem=fs, use_dictionary=False, write_statistics=False, compression="none", store_schema=False)
                fs.move(draft, f"{folder}/{name}.parquet")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    each.mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


def _record(line: str) -> tuple[str, str | None]:
    """Path and type letter of a line, as in :func:`records`."""
    path, bar, letter = line.removesuffix("\r").rpartition("|")
    return (path, letter) if bar else (letter, None)


def escaped(value: str | None) -> str:
    """A partition's value as Spark writes it into the folder's name."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\x7f\"#%'*/:=?\\{[]^" else c for c in value)


class ConflictError(RuntimeError):
    """Another writer replaced or removed a file between its reading and the commit."""


FILE = "folder string, file string, bytes bigint"


class CompactableTable:
    """A Parquet table partitioned by one string column, with a log of versions that says which files are live.

    ``compact`` finds the partitions that :func:`crowded` names and rewrites their small files
    only. New files are written and counted aside, moved into their partitions under names
    that carry the id of the rewrite, and count for nothing until the commit: one log file
    for the next version, which only one writer can create. It names the id and the list of
    files replaced. From then on the new files are live and the replaced ones aren't, all at
    once, and nothing moves any more; replaced files are deleted later, by ``clean``.

    So nothing that happens between can lose or double a record: files that others append, at
    whatever moment, under names of their own, are on no list and stay live; a driver lost
    before the commit leaves files that count for nothing, and one lost after it leaves files
    to delete. ``read`` writes nothing. Who removes files must do so by ``compact``; that two
    rewrites replace one file is refused. A reader that doesn't know the log sees replaced files
    beside new ones until ``clean``. A dynamic overwrite of whole partitions, which deletes
    what it finds before its own files come, gives none of this.
    """

    LOG = "_versions"
    STAGE = "_staged"
    NEW = "compacted-"

    def __init__(self, spark: SparkSession, path: str, column: str, schema: T.StructType | None = None) -> None:
        """``schema`` saves reading the footers of files; the column must be a string in it."""
        self.spark, self.path, self.column, self.schema = spark, path.rstrip("/"), column, schema
        self._uri = self.path if ":/" in self.path else f"file://{self.path}"
        self._fs, self._root = pafs.FileSystem.from_uri(self._uri)

    # -- the log
    def _log(self) -> list[str]:
        found = self._fs.get_file_info(pafs.FileSelector(f"{self._root}/{self.LOG}", allow_not_found=True))
        return sorted(f.base_name for f in found)

    def version(self) -> int:
        """The greatest version in the log, 0 without one."""
        return max((int(n.split(".")[0]) for n in self._log() if n.endswith(".json")), default=0)

    def _entries(self) -> list[dict]:
        """Every version's id, and whether its replaced files are deleted already."""
        names = self._log()
        out = []
        for n in names:
            if n.endswith(".json"):
                with self._fs.open_input_stream(f"{self._root}/{self.LOG}/{n}") as f:
                    entry = json.loads(f.read())
                out.append({**entry, "version": int(n[:-5]), "clean": f"{n[:-5]}.clean" in names})
        return out

    def _take(self, version: int, entry: dict) -> None:
        """Create the log file of a version, whole, unless it is there."""
        name = f"{self._root}/{self.LOG}/{version:020d}.json"
        draft = f"{self._root}/{self.LOG}/.{uuid.uuid4().hex}"
        self._fs.create_dir(f"{self._root}/{self.LOG}", recursive=True)
        with self._fs.open_output_stream(draft) as f:
            f.write(json.dumps(entry).encode())
        try:
            if isinstance(self._fs, pafs.LocalFileSystem):
                os.link(draft, name)
            else:  # a rename that doesn't replace, which file systems of clusters do in one step
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(self._uri), self.spark._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                place = lambda p: jvm.org.apache.hadoop.fs.Path(self._uri + p[len(self._root) :])
                context.rename(place(draft), place(name), none)
        except Exception as e:
            if self._fs.get_file_info(name).type == pafs.FileType.NotFound:
                raise
            raise ConflictError(f"version {version} is taken") from e
        finally:
            if self._fs.get_file_info(draft).type != pafs.FileType.NotFound:
                self._fs.delete_file(draft)

    # -- files
    def files(self) -> DataFrame:
        """``folder``, ``file``, ``bytes`` of every data file, live or not; folders are listed by tasks, names only."""
        uri, column = self._uri, self.column

        def visible(name: str) -> bool:
            return not name.startswith(("_", "."))

        def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                fs, root = pafs.FileSystem.from_uri(uri)
                found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
                names = [f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith(f"{column}=")]
                for at in range(0, len(names), 10_000):
                    yield pa.record_batch([pa.array(names[at : at + 10_000], pa.string())], names=["folder"])

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = pafs.FileSystem.from_uri(uri)
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    found = [f for f in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}")) if f.type == pafs.FileType.File and visible(f.base_name)]
                    for at in range(0, len(found), 10_000):
                        part = found[at : at + 10_000]
                        cols = [pa.array([folder] * len(part), pa.string()), pa.array([f.base_name for f in part], pa.string()), pa.array([f.size for f in part], pa.int64())]
                        yield pa.record_batch(cols, names=["folder", "file", "bytes"])

        each = self.spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string")
        return each.repartition(self._tasks(), "folder").mapInArrow(listed, FILE)

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _live(self, rows: DataFrame, folder: Column, file: Column) -> DataFrame:
        """The rows of live files: new files count once their id is committed, replaced ones no more."""
        log = self._entries()
        rows = rows.withColumns({"__folder": folder, "__file": file})
        ids = self.spark.createDataFrame([(e["id"],) for e in log], "__id string")
        few = F.broadcast if len(log) <= MOST_SENT else (lambda t: t)
        theirs = F.when(F.startswith("__file", F.lit(self.NEW)), F.substring("__file", len(self.NEW) + 1, 32))
        known = rows.withColumn("__id", theirs).join(few(ids.withColumn("__known", F.lit(True))), "__id", "left").filter("__id is null or __known").drop("__id", "__known")
        lists = [f"{self.path}/{self.LOG}/{e['id']}.files" for e in log if not e["clean"]]
        if lists:
            gone = self.spark.read.schema("f string, n string").json(lists).select(F.col("f").alias("__folder"), F.col("n").alias("__file"))
            # each list has at most MOST_FILES names
            gone = F.broadcast(gone) if len(lists) * MOST_FILES <= 4 * MOST_FILES else gone
            known = known.join(gone, ["__folder", "__file"], "left_anti")
        return known.drop("__folder", "__file")

    def live_files(self) -> DataFrame:
        """``folder``, ``file``, ``bytes`` of the files that make up the table."""
        return self._live(self.files(), F.col("folder"), F.col("file"))

    def listing(self, small_bytes: int = SMALL_BYTES) -> DataFrame:
        """``folder``, ``n_files``, ``n_small``, ``small_bytes`` and ``bytes`` of each partition."""
        return crowds(self.live_files(), "folder", F.col("bytes") < small_bytes)

    def crowded(self, small_bytes: int = SMALL_BYTES, crowd: int = CROWD) -> DataFrame:
        """The partitions with at least ``crowd`` small files."""
        return self.listing(small_bytes).filter(F.col("n_small") >= crowd)

    def read(self) -> DataFrame:
        """The rows of the live files as of now; nothing is written, and nothing it reads moves before ``clean``."""
        rows = self._rows([self.path]).select("*", "_metadata.file_path")
        path = F.split(_plain_path("file_path"), "/")
        return self._live(rows, F.element_at(path, -2), F.element_at(path, -1)).drop("file_path")

    def _rows(self, paths: list[str], base: str | None = None) -> DataFrame:
        """Rows below ``paths``, the partition column as the text that its folders carry (never a number read from it)."""
        reader = self.spark.read.option("basePath", base or self.path)
        if self.schema is None:
            found = reader.option("mergeSchema", "true").parquet(*paths).schema
            self.schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == self.column else f.dataType) for f in found])
        return reader.schema(self.schema).parquet(*paths)

    # -- the work
    def compact(self, target_bytes: int, small_bytes: int = SMALL_BYTES, crowd: int = CROWD, *, keep_seconds: float = 0, before_commit=None, before_clean=None) -> dict:
        """Rewrite the small files of crowded partitions; what was done, with live files before and after.

        Files are taken in turns of at most ``MOST_FILES``, each a version of its own, so that no
        list that the driver or a task holds grows with the table. Raises :class:`ConflictError`
        when another rewrite replaced one of the same files meanwhile: the turn is left undone,
        call again. Rewrites of other files aren't in the way. Replaced files are deleted after
        ``keep_seconds``, which gives readers that began before time to end.
        """
        read_at = self.version()
        crowded = self.crowded(small_bytes, crowd).select("folder")
        inputs = cut(self.live_files().filter(F.col("bytes") < small_bytes).join(crowded, "folder", "left_semi"))
        last, did = None, {"version": read_at, "partitions": 0, "files_before": 0, "files_after": 0}
        while True:
            rest = inputs if last is None else inputs.filter((F.col("folder") > last[0]) | ((F.col("folder") == last[0]) & (F.col("file") > last[1])))
            turn = rest.orderBy("folder", "file").limit(MOST_FILES).collect()
            if not turn:
                break
            did["partitions"] += len({r.folder for r in turn} - {last and last[0]})
            last = (turn[-1].folder, turn[-1].file)
            did["version"], written = self._rewrite(turn, target_bytes, read_at, before_commit)
            did["files_before"] += len(turn)
            did["files_after"] += written
        if before_clean:
            before_clean()
        self.clean(keep_seconds)
        return did

    def _rewrite(self, turn: list, target_bytes: int, read_at: int, before_commit=None) -> tuple[int, int]:
        """Replace the files of a turn by few; the version and the number of new files."""
        me = uuid.uuid4().hex
        stage = f"{self.path}/{self.STAGE}/{me}"
        try:
            self._write_stage(turn, stage, target_bytes)
            written = self._move_in(me, stage)
            self._fs.create_dir(f"{self._root}/{self.LOG}", recursive=True)
            with self._fs.open_output_stream(f"{self._root}/{self.LOG}/{me}.files") as f:
                f.write("".join(json.dumps({"f": r.folder, "n": r.file}) + "\n" for r in turn).encode())
            if before_commit:
                before_commit()
            version = self._commit(me, {(r.folder, r.file) for r in turn}, read_at)
        except BaseException:
            self._undo(me)
            raise
        return version, written

    def _commit(self, me: str, replaced: set[tuple[str, str]], read_at: int) -> int:
        while True:
            log = self._entries()
            for e in log:
                if e["version"] > read_at and replaced & self._replaced(e["id"]):
                    raise ConflictError(f"version {e['version']} replaced files that this rewrite read")
            missing = self._missing(replaced)
            if missing:
                raise ConflictError(f"removed since they were read: {missing[:5]}")
            version = max((e["version"] for e in log), default=0) + 1
            try:
                self._take(version, {"id": me, "at": time.time()})
                return version
            except ConflictError:  # another rewrite came first; it may be of other files
                continue

    def _replaced(self, me: str) -> set[tuple[str, str]]:
        with self._fs.open_input_stream(f"{self._root}/{self.LOG}/{me}.files") as f:
            return {(r["f"], r["n"]) for r in map(json.loads, f.read().decode().splitlines())}

    def _missing(self, files: set[tuple[str, str]]) -> list[str]:
        by_folder = defaultdict(set)
        for folder, name in files:
            by_folder[folder].add(name)
        found = []
        for folder, names in by_folder.items():
            there = {x.base_name for x in self._fs.get_file_info(pafs.FileSelector(f"{self._root}/{folder}", allow_not_found=True))}
            found += [f"{folder}/{n}" for n in sorted(names - there)]
        return found

    def _write_stage(self, turn: list, stage: str, target_bytes: int) -> None:
        """The rows of the turn's files, each partition in as many new files as its bytes call for."""
        total = defaultdict(lambda: [0, 0])
        for r in turn:
            total[r.folder][0] += 1
            total[r.folder][1] += r.bytes
        # never more new files than half the old ones
        parts = {k: max(1, min(math.ceil(b / target_bytes), n // 2)) for k, (n, b) in total.items()}
        first, n_parts = {}, 0
        for k in sorted(parts):
            first[k], n_parts = n_parts, n_parts + parts[k]
        # whole folders are listed, which takes one request for each, and other files dropped before they are opened
        rows = self._rows([f"{self.path}/{k}" for k in sorted(parts)]).select("*", "_metadata.file_path")
        path = F.split(_plain_path("file_path"), "/")
        named = rows.withColumns({"__folder": F.element_at(path, -2), "__file": F.element_at(path, -1)}).drop("file_path")
        wanted = self.spark.createDataFrame([(r.folder, r.file, first[r.folder], parts[r.folder]) for r in turn], "__folder string, __file string, __first int, __parts int")
        chosen = named.join(F.broadcast(wanted), ["__folder", "__file"])
        # the place of a row follows from the row, so that a task run again writes the same
        hashable = [f.name for f in self.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        placed = chosen.withColumn("__p", (F.col("__first") + F.pmod(F.xxhash64(*hashable), F.col("__parts"))).cast("int"))
        out = placed.repartitionById(n_parts, "__p").select(*self.schema.names)
        out.write.partitionBy(self.column).parquet(stage)
        want, got = chosen.count(), self._rows([stage], stage).count() if self._exists(stage, self.column) else 0
        if want != got:
            raise RuntimeError(f"{got} rows were written of {want}")

    def _exists(self, stage: str, column: str) -> bool:
        root = self._root + stage[len(self.path) :]
        return any(f.base_name.startswith(f"{column}=") for f in self._fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)))

    def _move_in(self, me: str, stage: str) -> int:
        """Move staged files into their partitions, named by the id; how many there are now. May run again."""
        uri, new = self._uri, self.NEW
        staged = f"{self._root}{stage[len(self.path) :]}"
        moves = [
            (f"{staged}/{d.base_name}/{f.base_name}", f"{self._root}/{d.base_name}", f"{new}{me}-{f.base_name}")
            for d in self._fs.get_file_info(pafs.FileSelector(staged, allow_not_found=True))
            if d.type == pafs.FileType.Directory
            for f in self._fs.get_file_info(pafs.FileSelector(d.path))
            if f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", "."))
        ]
        if not moves:
            return 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, _ = pafs.FileSystem.from_uri(uri)
            for batch in batches:
                for a, folder, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if fs.get_file_info(a).type == pafs.FileType.NotFound and fs.get_file_info(f"{folder}/{name}").type == pafs.FileType.File:
                        continue  # an earlier run of this task moved it
                    fs.move(a, f"{folder}/{name}")
                yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

        plan = self.spark.createDataFrame(moves, "a string, folder string, name string").repartition(self._tasks(), "a")
        plan.mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()
        self._fs.delete_dir(staged)
        return len(moves)

    def _undo(self, me: str) -> None:
        """Take away what a rewrite that wasn't committed has written."""
        if any(e["id"] == me for e in self._entries()):
            return
        self._delete(self.files().filter(F.startswith("file", F.lit(f"{self.NEW}{me}-"))))
        for name in (f"{self._root}/{self.STAGE}/{me}", f"{self._root}/{self.LOG}/{me}.files"):
            kind = self._fs.get_file_info(name).type
            if kind == pafs.FileType.Directory:
                self._fs.delete_dir(name)
            elif kind == pafs.FileType.File:
                self._fs.delete_file(name)

    def _delete(self, files: DataFrame) -> None:
        uri = self._uri

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = pafs.FileSystem.from_uri(uri)
            for batch in batches:
                for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if fs.get_file_info(f"{root}/{folder}/{name}").type == pafs.FileType.File:
                        fs.delete_file(f"{root}/{folder}/{name}")
                yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

        files.select("folder", "file").mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()

    def clean(self, keep_seconds: float = 0, orphan_seconds: float = 7 * 86_400) -> None:
        """Delete files replaced at least ``keep_seconds`` ago, and what rewrites left that ended ``orphan_seconds`` ago without a commit.

        May run at any time, by anybody, and again: only files that a committed version lists, or
        whose id no version has, are touched.
        """
        now, log = time.time(), self._entries()
        for e in log:
            if not e["clean"] and e["at"] <= now - keep_seconds:
                gone = self.spark.read.schema("f string, n string").json(f"{self.path}/{self.LOG}/{e['id']}.files")
                self._delete(gone.select(F.col("f").alias("folder"), F.col("n").alias("file")).repartition(self._tasks(), "file"))
                with self._fs.open_output_stream(f"{self._root}/{self.LOG}/{e['version']:020d}.clean"):
                    pass
        known = {e["id"] for e in log}
        lists = self._fs.get_file_info(pafs.FileSelector(f"{self._root}/{self.LOG}", allow_not_found=True))
        stages = self._fs.get_file_info(pafs.FileSelector(f"{self._root}/{self.STAGE}", allow_not_found=True))
        for f in [*stages, *(f for f in lists if f.base_name.endswith(".files"))]:
            me = f.base_name.removesuffix(".files")
            if me not in known and f.mtime is not None and f.mtime.timestamp() <= now - orphan_seconds:
                self._undo(me)


def _plain_path(column: str) -> Column:
    """A file's path as it is on disk, from the escaped form that Spark reports."""
    return F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))
