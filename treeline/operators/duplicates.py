"""Files with the same content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ = 1 << 20


def same_size(df: DataFrame) -> DataFrame:
    """Non-empty files whose size another one has; only these need reading."""
    files = df.filter("type = 'FILE' and size > 0")
    many = files.groupBy("size").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("size")
    return files.join(many, "size", "left_semi")


def grouped(digests: DataFrame) -> DataFrame:
    """``name``, ``size``, ``sha256`` of rows whose size and digest another row has.

    Counts are combined before the shuffle and joined back, so a digest of most rows is split
    among tasks like any skewed join.
    """
    many = digests.groupBy("size", "sha256").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return digests.join(many, ["size", "sha256"], "left_semi").select("name", "size", "sha256")


def duplicates(df: DataFrame, content: str = "content") -> DataFrame:
    """Duplicates of a list that holds the content of its files; null contents are left out."""
    digests = same_size(df).filter(F.col(content).isNotNull()).select("name", "size", F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    return grouped(digests)


def read_digests(df: DataFrame) -> DataFrame:
    """``name``, ``size``, ``sha256`` of real files, read in pieces; ``sha256`` is null where reading failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                try:
                    h = hashlib.sha256()
                    with open(name, "rb") as f:
                        while block := f.read(READ):
                            h.update(block)
                    digests.append(h.hexdigest())
                except OSError:
                    digests.append(None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["name", "size", "sha256"])

    return df.select("name", "size").mapInArrow(run, "name string, size bigint, sha256 string")


def duplicate_files(df: DataFrame) -> DataFrame:
    """Duplicates among real files of a walk. Unreadable files are left out; see :func:`read_digests`."""
    return grouped(read_digests(same_size(df)).filter("sha256 is not null"))
