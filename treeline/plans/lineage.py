"""Cutting lineage through storage that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` is the cluster's shared folder and is used as it is. Only a
    local master, where one machine holds everything, may fall back on a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        own = tempfile.mkdtemp(prefix="treeline-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back.

    Meant for small or expensive intermediate tables that a plan reads more than once;
    the files survive the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pack(batch: pa.RecordBatch) -> bytes:
    """A batch of rows as one compressed value."""
    out = pa.BufferOutputStream()
    pq.write_table(pa.Table.from_batches([batch]), out, compression="zstd", use_dictionary=False, write_statistics=False)
    return out.getvalue().to_pybytes()


def unpack(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The rows that the only column of ``df`` holds as :func:`pack` made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                yield from pq.read_table(pa.BufferReader(packed.as_py())).to_batches()

    return df.mapInArrow(run, schema)


def cut_packed(df: DataFrame) -> DataFrame:
    """:func:`cut` for many millions of short rows: they are stored in compressed batches, for about a tenth of the disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array([pack(batch)], pa.binary())], names=["packed"])

    return unpack(cut(df.mapInArrow(run, "packed binary")), df.schema)


def drop(path: str, spark: SparkSession) -> None:
    """Delete a folder that this library wrote below the shared one."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} isn't below the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
