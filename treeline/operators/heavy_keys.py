"""Per-key totals when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.paths import dirname
from treeline.plans.lineage import cut

WIDE = "decimal(38,0)"


def key_totals(
    df: DataFrame, keys: Sequence[str], order: Column | str, value: str, *, partitions: int | None = None
) -> DataFrame:
    """Rows, non-null values, sum, least and greatest ``value`` for each combination of ``keys``.

    Rows are first combined into states of (keys, ``order``), before and after one shuffle, so a
    heavy key is already as many small states as ``order`` has values. The states are range-partitioned
    on the composite of keys and order at quantiles that Spark samples, which splits a heavy
    key over neighbouring partitions. Each partition then folds its stretch of every key, and
    the stretches of keys that cross a boundary are stitched in a last merge of one state
    per key and partition. No task ever holds all rows of a key.

    ``order`` may be any expression that varies within a key (a day, a hash bucket); it decides
    how finely a key can be split and never changes the result. Null keys form a key of their
    own; null values are counted in ``n_rows`` only. An empty input gives an empty result.
    Sums are exact (decimal). Other columns are ignored, whatever their names.
    """
    o = F.col(order) if isinstance(order, str) else order
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], o.alias("o"), F.col(value).alias("v"))
    ks = [f"k{i}" for i in range(len(keys))]
    # a long is summed as two halves: exact for any count below 2**31 rows of a state, and hash-aggregated in place
    states = rows.groupBy(*ks, "o").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("v").alias("c"),
        F.sum(F.shiftright("v", 32)).alias("hi"),
        F.sum(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("lo"),
        F.min("v").alias("lo_v"),
        F.max("v").alias("hi_v"),
    )
    spread = states.repartitionByRange(*([partitions] if partitions else []), *ks, "o")
    done = spread.groupBy(*ks).agg(
        F.sum("n").alias("n_rows"),
        F.sum("c").alias("n_values"),
        F.sum(F.col("hi").cast("decimal(20,0)")).alias("hi"),
        F.sum(F.col("lo").cast("decimal(20,0)")).alias("lo"),
        F.min("lo_v").alias("min_value"),
        F.max("hi_v").alias("max_value"),
    )
    total = (F.col("hi").cast("decimal(28,0)") * F.lit(4294967296).cast("decimal(10,0)") + F.col("lo")).cast(WIDE)
    return done.select(
        *[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)],
        "n_rows",
        "n_values",
        total.alias("sum_value"),
        "min_value",
        "max_value",
    )


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``df``'s keys, order and value with ``row_no`` (from 1) and ``running``, the sum of ``value`` so far within the key.

    Rows are range-partitioned on (keys, order) at sampled quantiles and written once with the
    number of their range, so a heavy key lies in several neighbouring ranges. A window runs
    within a range and key only; what a key had in earlier ranges comes from a state for each
    range and key. Only a range's first key can go on from an earlier one, so at most one
    row for each range is sent to every task.

    Null keys form a key of their own; nulls of the order come first; null values add nothing.
    Rows equal in keys and order are numbered in an open order. The value may be one of the order's columns.
    """
    ks, os = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    named = [F.col(c).alias(n) for c, n in zip([*keys, *order], [*ks, *os], strict=True)]
    rows = df.select(*named, F.col(value).alias("v"))
    # rows alike in keys and order are told apart by where they were read, so that any number of them can be split
    ranged = cut(rows.withColumn("t", F.spark_partition_id()).repartitionByRange(*ks, *os, "t").drop("t").withColumn("r", F.spark_partition_id()))
    exact = F.coalesce(F.col("v").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    states = ranged.groupBy("r", *ks).agg(F.count(F.lit(1)).alias("n"), F.sum(exact).alias("s"))
    before = Window.partitionBy(*ks).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    carried = states.select("r", *ks, F.sum("n").over(before).alias("n0"), F.sum("s").over(before).alias("s0")).filter("n0 > 0")
    carried = carried.select(F.col("r").alias("cr"), *[F.col(k).alias(f"c{k}") for k in ks], "n0", "s0")
    same = F.col("r") == F.col("cr")
    for k in ks:
        same &= F.col(k).eqNullSafe(F.col(f"c{k}"))
    own = Window.partitionBy("r", *ks).orderBy(*os)
    upto = F.sum(exact).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranged.join(F.broadcast(carried), same, "left")
    return out.select(
        *[F.col(n).alias(c) for c, n in zip([*keys, *order], [*ks, *os], strict=True)],
        *([] if value in [*keys, *order] else [F.col("v").alias(value)]),
        (F.coalesce("n0", F.lit(0)) + F.row_number().over(own)).alias("row_no"),
        (F.coalesce("s0", F.lit(0)) + upto).cast(WIDE).alias("running"),
    )


def owner_and_directory_rows(entries: DataFrame) -> DataFrame:
    """Two rows for each entry: its uid and its directory as ``key_name``, ``key_value``; null keys give none."""
    return (
        entries.select(
            F.explode(
                F.array(
                    F.struct(F.lit("uid").alias("key_name"), F.col("uid").cast("string").alias("key_value")),
                    F.struct(F.lit("dir").alias("key_name"), dirname("name").alias("key_value")),
                )
            ).alias("key"),
            "walked_at",
            "size",
        )
        .select("key.key_name", "key.key_value", "walked_at", "size")
        .filter("key_value is not null")
    )


def owner_and_directory_totals(entries: DataFrame) -> DataFrame:
    """:func:`key_totals` of ``size`` for each uid and directory, split by the day of the walk."""
    rows = owner_and_directory_rows(entries)
    return key_totals(rows, ["key_name", "key_value"], F.to_date("walked_at"), "size")
