"""Sorting, head and tail, positions and running sums over a global order, even spreading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.paths import basename, dirname
from treeline.plans.lineage import cut

# The fields a sort may name, and the columns behind them.
SORT_FIELDS = {
    "name": ("name",), "user": ("user",), "group": ("group",), "uid": ("uid",), "gid": ("gid",), "size": ("size",),
    "atime": ("atime", "atime_nsec"), "mtime": ("mtime", "mtime_nsec"), "ctime": ("ctime", "ctime_nsec"),
}
SNIP = 10


def sort_keys(spec: str) -> list[Column]:
    """``size,-mtime``: ascending fields, descending after a minus; the name is always the last key.

    Times sort by second, then nanosecond; names by their bytes; nulls first when ascending.
    """
    keys, named = [], False
    for part in spec.split(","):
        down, field = part.startswith("-"), part.lstrip("-")
        if field not in SORT_FIELDS:
            raise ValueError(f"not a sort field: {field!r}")
        named |= field == "name"
        keys += [F.desc(c) if down else F.asc(c) for c in SORT_FIELDS[field]]
    return keys if named else [*keys, F.asc("name")]


def sort_entries(df: DataFrame, spec: str = "name") -> DataFrame:
    return df.orderBy(*sort_keys(spec))


def positions(df: DataFrame, keys: list[Column], measure: Column | None = None) -> DataFrame:
    """``df`` with ``position`` (0-based) in the global order, and with ``offset``, the sum of ``measure`` before the row.

    Exact, and no task sees all rows: rows are range-partitioned by the keys and written once
    with the number of their range; counts and sums of the ranges (a row each) give what
    precedes each range; a window runs within ranges only. Keys should be unique, else the
    order of ties is open.
    """
    m = measure if measure is not None else F.lit(0)
    ranged = cut(df.withColumn("__m", m.cast("long")).repartitionByRange(*keys).withColumn("__r", F.spark_partition_id()))
    # ranges are as many as shuffle partitions, which bounds this window and the broadcast
    sums = ranged.groupBy("__r").agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("__m"), F.lit(0)).alias("s"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__r", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    own = Window.partitionBy("__r").orderBy(*keys)
    upto = F.coalesce(F.sum("__m").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.join(F.broadcast(starts), "__r").withColumn("position", F.col("c0") + F.row_number().over(own) - 1)
    if measure is not None:
        out = out.withColumn("offset", F.col("s0") + upto)
    return out.drop("__m", "__r", "c0", "s0")


def head_and_tail(df: DataFrame, spec: str = "name", n: int = SNIP) -> DataFrame:
    """The first and last ``n`` rows in order with their ``part`` (head, tail); all rows, as head, if there are at most 2n."""
    keys = sort_keys(spec)
    total = df.count()
    if total <= 2 * n:
        return df.orderBy(*keys).withColumn("part", F.lit("head"))
    head = df.orderBy(*keys).limit(n).withColumn("part", F.lit("head"))
    return head.unionByName(df.orderBy(*_reverse(spec)).limit(n).withColumn("part", F.lit("tail")))


def _reverse(spec: str) -> list[Column]:
    turned = ",".join(p[1:] if p.startswith("-") else f"-{p}" for p in spec.split(","))
    keys = sort_keys(turned)
    return keys if "name" in turned.replace("-", "").split(",") else [*keys[:-1], F.desc("name")]


def even_blocks(df: DataFrame, keys: list[Column], blocks: int) -> DataFrame:
    """``df`` with ``block``: ``blocks`` runs of the order, sizes equal up to one, larger ones first."""
    total = df.count()
    each, rest = divmod(total, blocks)
    placed = positions(df, keys)
    p = F.col("position")
    split = rest * (each + 1)
    late = F.lit(rest) + F.expr(f"(position - {split}) div {max(each, 1)}")
    return placed.withColumn("block", F.when(p < split, F.expr(f"position div {each + 1}")).otherwise(late).cast("int"))


def batches(df: DataFrame, keys: list[Column], size: int) -> DataFrame:
    """``df`` with ``batch``: runs of ``size`` rows of the order."""
    return positions(df, keys).withColumn("batch", F.expr(f"position div {int(size)}"))


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt evenly to partitions; their order isn't kept."""
    return df.repartition(partitions)


def by_parent(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of one directory together, except that a directory is spread over 16 parts by its names, so none is too large."""
    keys = [dirname("name"), F.pmod(F.xxhash64("name"), F.lit(16))]
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def remap(df: DataFrame, partition: Column, partitions: int) -> DataFrame:
    """Rows moved to the very partition that a Column names, counted around; a null names the first."""
    to = F.coalesce(F.pmod(partition, F.lit(partitions)), F.lit(0)).cast("int")
    return df.repartitionById(partitions, to)


def at_depth(df: DataFrame, level: int) -> DataFrame:
    return df.filter(F.col("depth") == level)


def depths(df: DataFrame) -> list[int]:
    """Levels present, shallow to deep; as many as the tree is deep."""
    return [r[0] for r in df.select("depth").filter("depth is not null").distinct().orderBy("depth").collect()]


def sort_by_last_part(df: DataFrame) -> DataFrame:
    return df.orderBy(basename("name"), "name")


def parents(df: DataFrame) -> DataFrame:
    """Distinct parent directories (``name``) of the rows."""
    return df.select(dirname("name").alias("name")).filter("name <> ''").distinct()
