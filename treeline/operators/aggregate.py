"""Summaries, histograms and rollups of entry lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import below, components
from treeline.functions.scalars import parse_bytes

#: Names are sent to every task up to this many rows (a few MB); beyond, they are joined by shuffle.
MOST_NAMES = 100_000
MOST_BINS = 128


def lookup(df: DataFrame, names: DataFrame, id_col: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the name of ``id_col``, or the id as text where there is none.

    Of several names of an id the least stands, null names don't count; a null id has a null
    name. The names are broadcast only when there are at most ``MOST_NAMES``.
    """
    one = names.filter("id is not null and name is not null").groupBy("id").agg(F.min("name").alias("__name"))
    if names.limit(MOST_NAMES + 1).count() <= MOST_NAMES:
        one = F.broadcast(one)
    joined = df.join(one, df[id_col] == one["id"], "left").drop(one["id"])
    return joined.withColumn(out, F.coalesce("__name", F.col(id_col).cast("string"))).drop("__name")


def with_owner_names(df: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with the columns ``user`` and ``group``."""
    return lookup(lookup(df, users, "uid", "user"), groups, "gid", "group")


def summary(df: DataFrame) -> DataFrame:
    """One row: items by type, bytes of files and their truncated mean (0 without files)."""
    n = lambda t: F.count(F.when(F.col("type") == t, 1))
    out = df.agg(
        F.count(F.lit(1)).alias("n_items"), n("DIR").alias("n_dirs"), n("FILE").alias("n_files"), n("LINK").alias("n_links"),
        F.count(F.when(F.coalesce(~F.col("type").isin("DIR", "FILE", "LINK"), F.lit(True)), 1)).alias("n_unknown"),
        F.coalesce(F.sum(F.when(F.col("type") == "FILE", F.col("size")).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("bytes"),
    )
    return out.withColumn("bytes", F.col("bytes").cast("long")).withColumn("mean_bytes", F.expr("if(n_files = 0, 0L, bytes div greatest(n_files, 1))"))


def measures(df: DataFrame) -> DataFrame:
    """One row: number of items, least and greatest depth, longest name, distinct owners, whether there is detail."""
    return df.agg(
        F.count(F.lit(1)).alias("n_items"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"),
        F.max(F.octet_length("name")).alias("longest_name"), F.countDistinct("uid").alias("n_users"), F.countDistinct("gid").alias("n_groups"),
        F.coalesce(F.bool_or(F.col("mode").isNotNull()), F.lit(False)).alias("detail"),
    )


def default_bins(largest: int) -> list[int]:
    """1, then powers of 1024 up to the first that holds the largest size."""
    bits = math.ceil(math.ceil(math.log2(largest)) / 10) * 10 if largest > 1 else 0
    return [1, *[1 << b for b in range(10, bits + 1, 10)]]


def parse_bins(text: str) -> list[int]:
    """``size:0,80,1k``: sorted bounds. Raises ValueError for another field, repeated bounds or more than 128."""
    field, colon, rest = text.partition(":")
    if field != "size" or not colon:
        raise ValueError(f"not a distribution: {text!r}")
    bounds = sorted(parse_bytes(x) for x in rest.split(",") if x)
    if len(set(bounds)) != len(bounds):
        raise ValueError("a bound is given twice")
    if not bounds or len(bounds) > MOST_BINS:
        raise ValueError(f"between 1 and {MOST_BINS} bounds are needed")
    return bounds


def bin_of(size: Column, bounds: list[int]) -> Column:
    """Bin j holds sizes above bound j-1 up to and with bound j; the last one all above."""
    out = F.lit(len(bounds))
    for j in range(len(bounds) - 1, -1, -1):
        out = F.when(size <= bounds[j], F.lit(j)).otherwise(out)
    return F.when(size.isNotNull(), out)


def histogram(df: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """``bin``, ``above`` (null for the first), ``upto`` (null for the last), ``n`` of items of every type; empty bins have 0."""
    if bounds is None:
        bounds = default_bins(df.agg(F.max("size")).first()[0] or 0)
    rows = [(j, bounds[j - 1] if j else None, bounds[j] if j < len(bounds) else None) for j in range(len(bounds) + 1)]
    every = F.broadcast(df.sparkSession.createDataFrame(rows, "bin int, above bigint, upto bigint"))
    found = df.select(bin_of(F.col("size"), bounds).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "bin", "left").fillna(0, ["n"]).select("bin", "above", "upto", "n")


def children(df: DataFrame, root: str) -> DataFrame:
    """``child``, ``n``, ``bytes`` (items of every type) of each first part below ``root``, largest first, then by name.

    Counts are combined before the shuffle, so a child with most of the rows is no burden.
    """
    level = len([x for x in root.split("/") if x]) + 1
    rows = df.filter(below("name", root)).select(F.get(components("name"), F.lit(level)).alias("child"), "size")
    sums = rows.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return sums.orderBy(F.desc("bytes"), "child")


def children_report(df: DataFrame, root: str, top: int = 100) -> DataFrame:
    """The ``top`` largest children, and a row with the totals of all (null ``child``)."""
    every = children(df, root)
    total = every.agg(F.lit(None).cast("string").alias("child"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return every.limit(top).unionByName(total)


def by_owner(df: DataFrame, key: str = "uid") -> DataFrame:
    """Items, files and bytes of files of each owner or group."""
    is_file = F.col("type") == "FILE"
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_file, 1)).alias("n_files"), F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes")
    )


def all_true(df: DataFrame, flag: str) -> DataFrame:
    """One row: whether every flag is true; true for no rows."""
    return df.agg(F.coalesce(F.bool_and(flag), F.lit(True)).alias("all_true"))


def rates(items: int, size: int, seconds: float) -> dict[str, float]:
    """Items and bytes a second, as tools report them."""
    seconds = max(seconds, 1e-9)
    return {"seconds": seconds, "items_per_s": items / seconds, "bytes_per_s": size / seconds}
