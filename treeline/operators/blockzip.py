"""Block-parallel bzip2: independent blocks, a table of their places, and a footer."""

from __future__ import annotations

import bz2
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.apply import draft_of

from treeline.operators.order import positions

# The footer holds six numbers of 64 bits, most significant byte first: start of the
# block table, number of blocks, size of a block, size of the data, version, magic number.
FOOTER, FOOTER_SIZE = ">6Q", 48
ENTRY, ENTRY_SIZE = ">2Q", 16
VERSION, MAGIC = 1, 0x3141314131413141
UNIT = 100_000


def block_table(lengths: DataFrame) -> DataFrame:
    """``block``, ``offset``, ``length`` of compressed blocks: offsets are the running sum of lengths in block order."""
    return positions(lengths, [F.asc("block")], F.col("length")).select("block", "offset", "length")


def compress_column(df: DataFrame, keys: list[str], data: str, level: int = 9) -> DataFrame:
    """``keys``, ``packed``: each row's bytes as one bzip2 block; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if x is None else bz2.compress(x, level) for x in batch.column(len(keys)).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(keys)], pa.array(packed, pa.binary())], names=[*keys, "packed"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(data).cast("binary").alias("__data")).mapInArrow(run, f"{kinds}, packed binary")


def _blocks(spark: SparkSession, size: int, block: int) -> DataFrame:
    n = max(1, -(-size // block)) if size else 0
    return spark.range(n).select(F.col("id").alias("block"))


def compress_file(spark: SparkSession, source: str, dest: str, *, blocksize: int = 9, keep: bool = True, force: bool = False) -> dict:
    """Compress a file on a shared file system, block by block, in parallel. ``blocksize`` is 1 to 9, in 100 kB."""
    if not 1 <= blocksize <= 9:
        raise ValueError("blocksize is 1 to 9")
    if os.path.exists(dest) and not force:
        raise FileExistsError(dest)
    block, size = blocksize * UNIT, os.path.getsize(source)
    parts = f"{dest}.blocks"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(source, "rb") as f:
            for batch in batches:
                numbers, lengths = batch.column(0).to_pylist(), []
                for k in numbers:
                    f.seek(k * block)
                    packed = bz2.compress(f.read(block), blocksize)
                    draft = draft_of(f"{parts}/{k}")
                    with open(draft, "wb") as g:
                        g.write(packed)
                    os.replace(draft, f"{parts}/{k}")
                    lengths.append(len(packed))
                yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(lengths, pa.int64())], names=["block", "length"])

    os.makedirs(parts, exist_ok=True)
    table = block_table(_blocks(spark, size, block).mapInArrow(run, "block bigint, length bigint"))
    last = table.agg(F.coalesce(F.max(F.col("offset") + F.col("length")), F.lit(0)).alias("end"), F.count(F.lit(1)).alias("n")).first()
    with open(dest, "wb") as f:
        f.truncate(last["end"] + last["n"] * ENTRY_SIZE + FOOTER_SIZE)
        f.seek(last["end"] + last["n"] * ENTRY_SIZE)
        f.write(struct.pack(FOOTER, last["end"], last["n"], block, size, VERSION, MAGIC))
    start = last["end"]

    def place(rows: Iterator) -> None:
        with open(dest, "r+b") as f:
            for r in rows:
                with open(f"{parts}/{r['block']}", "rb") as g:
                    f.seek(r["offset"])
                    f.write(g.read())
                f.seek(start + r["block"] * ENTRY_SIZE)
                f.write(struct.pack(ENTRY, r["offset"], r["length"]))

    table.foreachPartition(place)
    for name in os.listdir(parts):
        os.remove(f"{parts}/{name}")
    os.rmdir(parts)
    if not keep:
        os.remove(source)
    return {"blocks": last["n"], "bytes": size, "packed": os.path.getsize(dest)}


def read_footer(path: str) -> dict:
    """The fields of the footer. Raises ValueError for another kind of file."""
    with open(path, "rb") as f:
        f.seek(0, 2)
        if f.tell() < FOOTER_SIZE:
            raise ValueError("the file is too short")
        f.seek(-FOOTER_SIZE, 2)
        table, n, block, size, version, magic = struct.unpack(FOOTER, f.read(FOOTER_SIZE))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block-compressed file")
    return {"table": table, "blocks": n, "block": block, "bytes": size}


def decompress_file(spark: SparkSession, source: str, dest: str, *, force: bool = False) -> dict:
    """The inverse of :func:`compress_file`."""
    if os.path.exists(dest) and not force:
        raise FileExistsError(dest)
    foot = read_footer(source)
    with open(dest, "wb") as f:
        f.truncate(foot["bytes"])

    def run(rows: Iterator) -> None:
        with open(source, "rb") as f, open(dest, "r+b") as g:
            for r in rows:
                f.seek(foot["table"] + r["block"] * ENTRY_SIZE)
                offset, length = struct.unpack(ENTRY, f.read(ENTRY_SIZE))
                f.seek(offset)
                g.seek(r["block"] * foot["block"])
                g.write(bz2.decompress(f.read(length)))

    spark.range(foot["blocks"]).select(F.col("id").alias("block")).foreachPartition(run)
    return foot
