"""Files as fixed-size sections."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Sections of a file are made from runs of runs, each of two to this power.
RUN_BITS = 16


def n_chunks(size: Column, chunk: int | Column) -> Column:
    """Sections of a file; an empty one has one."""
    each = chunk if isinstance(chunk, Column) else F.lit(chunk)
    each = each.cast("long")
    whole = F.call_function("div", size, each)
    return F.greatest(whole + F.when(F.pmod(size, each) > 0, 1).otherwise(0), F.lit(1).cast("long"))


def explode_chunks(df: DataFrame, chunk: int | Column = 1 << 20) -> DataFrame:
    """``name``, ``offset``, ``length``, ``file_size`` of every section of every file; the last one is short.

    ``chunk`` is the length of sections, or a Column that follows the file. A file of any size can
    be cut: of files with more than 65,536 sections, runs of runs are made first and dealt out to
    all tasks at each step, so neither a row nor a task ever holds more than that many
    sections of a file. Other files are cut where they are. Files of null size give none.
    """
    each = chunk if isinstance(chunk, Column) else F.lit(chunk)
    rows = df.filter("type = 'FILE' and size is not null").select("name", F.col("size").alias("file_size"), each.cast("long").alias("chunk"), (n_chunks(F.col("size"), each) - 1).alias("last"))
    numbers = lambda low, high: F.explode(F.sequence(low, high))
    zero, run = F.lit(0).cast("long"), 1 << RUN_BITS
    few = rows.filter(F.col("last") < run).withColumn("i", numbers(zero, F.col("last")))
    many = rows.filter(F.col("last") >= run).withColumn("i", zero)
    for bits in range(48, -1, -RUN_BITS):
        # the numbers of this level below the one above: the last of the file's, or all of the run's
        upto = F.least(F.shiftright("last", bits), F.col("i") * run + (run - 1))
        many = many.withColumn("i", numbers(F.col("i") * run, upto))
        many = many.repartition("name", "i") if bits else many
    offset = F.col("i") * F.col("chunk")
    return few.unionByName(many).select("name", offset.alias("offset"), F.least(F.col("chunk"), F.col("file_size") - offset).alias("length"), "file_size")


def chunk_rank(index: Column, total: int, parts: int) -> Column:
    """Which of ``parts`` holds section ``index`` of ``total`` when they are dealt out in even runs."""
    each, rest = divmod(total, parts)
    split = rest * (each + 1)
    late = F.floor((index - split) / max(each, 1)) + rest
    return F.when(index < split, F.floor(index / (each + 1))).otherwise(late).cast("long")


def any_of_file(flags: DataFrame, flag: str, name: str = "name") -> DataFrame:
    """Whether the flag is true for any section of a file; nulls count as false."""
    return flags.groupBy(name).agg(F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias(flag))


def text_chunk(text: Column, offset: Column, length: Column) -> Column:
    """Bytes of a section of a text column."""
    return F.substring(text.cast("binary"), (offset + 1).cast("int"), length.cast("int"))


def read_chunks(chunks: DataFrame) -> DataFrame:
    """``name``, ``offset``, ``digest`` of sections of real files; the digest is null where less could be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for r in batch.to_pylist():
                try:
                    with open(r["name"], "rb") as f:
                        f.seek(r["offset"])
                        data = f.read(r["length"])
                    digests.append(hashlib.sha256(data).hexdigest() if len(data) == r["length"] else None)
                except OSError:
                    digests.append(None)
            yield pa.record_batch([batch.column("name"), batch.column("offset"), pa.array(digests, pa.string())], names=["name", "offset", "digest"])

    return chunks.select("name", "offset", "length").mapInArrow(run, "name string, offset bigint, digest string")


def unlike_sections(pairs: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``rel``, ``offset``, ``length`` of the sections in which two real files differ, byte by byte.

    ``pairs`` holds ``rel``, the paths ``a`` and ``b`` and their common ``size``. Sections of all
    files are dealt out to all tasks, so one huge file is compared by many. A section that can't
    be read whole on either side counts as different.
    """
    sections = explode_chunks(pairs.select(F.struct("rel", "a", "b").alias("name"), F.lit("FILE").alias("type"), "size"), chunk)

    def read(path: str, offset: int, length: int) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return os.pread(f.fileno(), length, offset)
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unlike = []
            for r in batch.to_pylist():
                x, y = read(r["a"], r["offset"], r["length"]), read(r["b"], r["offset"], r["length"])
                unlike.append(x is None or x != y or len(x) != r["length"])
            found = batch.filter(pa.array(unlike, pa.bool_()))
            yield pa.record_batch([found.column(k) for k in ("rel", "offset", "length")], names=["rel", "offset", "length"])

    rows = sections.select("name.rel", "name.a", "name.b", "offset", "length")
    return rows.repartition(F.xxhash64("rel", "offset")).mapInArrow(run, "rel string, offset bigint, length bigint")


def is_all_zero(data: Column) -> Column:
    """Whether a binary holds only zero bytes (a hole); true for an empty one."""
    return F.length(F.replace(F.hex(data), F.lit("00"), F.lit(""))) == 0
