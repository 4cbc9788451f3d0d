"""Changes between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Snapshot numbers up to this many are sent to every task (a few MB); beyond, they are joined by shuffle.
MOST_SENT = 50_000


def null_safe_hash(*cols: str) -> Column:
    """A 64-bit hash in which a null differs from every value and its place counts."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.xxhash64(F.col(c)), F.col(c).isNull()]
    return F.xxhash64(*parts)


def snapshot_order(df: DataFrame, snap: str) -> DataFrame:
    """``snap``, its dense index ``idx`` from 0, and the number of the next snapshot ``after`` (null for the last)."""
    spark = df.sparkSession
    present = df.select(snap).filter(F.col(snap).isNotNull()).distinct().orderBy(snap)
    few = [r[0] for r in present.limit(MOST_SENT + 1).collect()]
    if len(few) <= MOST_SENT:
        kind = df.schema[snap].dataType.simpleString()
        rows = [(x, i, few[i + 1] if i + 1 < len(few) else None) for i, x in enumerate(few)]
        return F.broadcast(spark.createDataFrame(rows, f"`{snap}` {kind}, idx int, after {kind}"))
    w = Window.orderBy(snap)
    return present.select(snap, (F.row_number().over(w) - 1).alias("idx"), F.lead(snap).over(w).alias("after"))


def snapshot_changes(df: DataFrame, snap: str, key: str, fields: Sequence[str]) -> DataFrame:
    """``snap``, ``key``, ``change``: what was added, removed or changed in each snapshot against the one before.

    Repeated rows are combined before the shuffle. Each key's rows are put in order of the
    dense snapshot index: a lag of the hash of ``fields`` shows changes, a gap in the index
    a removal just after it began and an addition where it ends. Snapshots need not arrive
    in order, and their numbers may have gaps; consecutive means next among those present.

    A null field differs from any value and equals a null. Rows without snapshot or key are
    left out. If rows of one key in one snapshot differ, the one with the least hash stands.
    The first snapshot has no changes; an empty table none. Other columns are ignored.
    """
    order = snapshot_order(df, snap)
    rows = df.filter(F.col(snap).isNotNull() & F.col(key).isNotNull())
    states = rows.groupBy(F.col(key).alias("k"), F.col(snap).alias(snap)).agg(F.min(null_safe_hash(*fields)).alias("h"))
    at = states.join(order, snap)
    w = Window.partitionBy("k").orderBy("idx")
    seen = at.select(
        "k", F.col(snap).alias("s"), "after", "idx", "h",
        F.lag("idx").over(w).alias("prev"), F.lag("h").over(w).alias("prev_h"), F.lead("idx").over(w).alias("next"),
    )
    came = (F.col("idx") > 0) & (F.col("prev").isNull() | (F.col("prev") < F.col("idx") - 1))
    altered = (F.col("prev") == F.col("idx") - 1) & (F.col("prev_h") != F.col("h"))
    left = F.col("after").isNotNull() & (F.col("next").isNull() | (F.col("next") > F.col("idx") + 1))
    event = lambda when, number, name: F.when(when, F.struct(number.alias("s"), F.lit(name).alias("c")))
    events = F.array_compact(
        F.array(event(came, F.col("s"), "added"), event(altered, F.col("s"), "changed"), event(left, F.col("after"), "removed"))
    )
    return seen.select(F.col("k").alias(key), F.explode(events).alias("e")).select(
        F.col("e.s").alias(snap), key, F.col("e.c").alias("change")
    )
