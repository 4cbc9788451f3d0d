"""Random trees for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.entries import conform

FILL = ("random", "true", "false", "alternate")


def _draw(seed: int, what: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(1 << 40))


def item_name(kind: Column, number: Column) -> Column:
    """``file_00000007``, ``dir_00000007``, ``link_00000007``."""
    prefix = F.when(kind == "DIR", F.lit("dir_")).when(kind == "LINK", F.lit("link_")).otherwise(F.lit("file_"))
    return F.concat(prefix, F.format_string("%08d", number))


def item_number(name: Column) -> Column:
    return F.regexp_extract(name, "_([0-9]+)$", 1).try_cast("long")


def random_tree(spark: SparkSession, root: str, *, items: int = 3000, levels: int = 5, max_size: int = 2000, seed: int = 1) -> DataFrame:
    """Entries of a random tree: types drawn evenly, sizes below ``max_size``, more items on deeper levels.

    The first item of every level above the last is a directory, in which the next level's
    items without another directory lie. The same seed gives the same tree on any cluster.
    """
    weight = levels * (levels + 1) // 2
    base = spark.range(items)
    level = F.lit(1)
    for k in range(2, levels + 1):
        level = F.when(F.col("id") >= items * (k * (k - 1) // 2) // weight, F.lit(k)).otherwise(level)
    rows = base.withColumn("level", level)
    heads = {k: items * (k * (k - 1) // 2) // weight for k in range(1, levels + 1)}
    is_head = F.col("id").isin(list(heads.values()))
    kind = F.when(is_head, F.lit("DIR")).otherwise(F.element_at(F.array(F.lit("FILE"), F.lit("DIR"), F.lit("LINK")), (_draw(seed, "type") % 3 + 1).cast("int")))
    parent = F.lit(root.rstrip("/"))
    path = parent
    for k in range(2, levels + 1):
        parent = F.concat(parent, F.lit("/"), F.lit(f"dir_{heads[k - 1]:08d}"))
        path = F.when(F.col("level") == k, parent).otherwise(path)
    rows = rows.withColumn("type", kind)
    mode = F.when(F.col("type") == "DIR", F.lit(0o040755)).when(F.col("type") == "LINK", F.lit(0o120777)).otherwise(F.lit(0o100644))
    size = F.when(F.col("type") == "FILE", _draw(seed, "size") % max_size).otherwise(F.lit(0))
    return conform(rows.select(F.concat(path, F.lit("/"), item_name(F.col("type"), F.col("id"))).alias("name"), "type", mode.alias("mode"), size.alias("size")))


def fill_bytes(pattern: str, size: int, seed: int = 1) -> bytes:
    """The content of a generated file."""
    if pattern not in FILL:
        raise ValueError(f"not a fill pattern: {pattern!r}")
    if pattern == "random":
        import numpy as np

        return np.random.default_rng(seed).bytes(size)
    return {"true": b"\xff", "false": b"\0", "alternate": b"\xaa"}[pattern] * size
