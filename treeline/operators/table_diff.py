"""Differences between two copies of a keyed table, found by hierarchical checksums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.plans.lineage import cut

#: The first level has 2**16 ranges of the hashed key; each range that differs is halved as often again for the next.
STEP_BITS = 16
#: Rows to a leaf range, about.
LEAF_ROWS = 8
#: Differing ranges are sent to every task up to this many (a few MB); beyond, rows are shuffled to meet them.
MOST_SENT = 500_000


@dataclass(frozen=True)
class Field:
    """One reported field: the columns that make it up, and rows for which it isn't compared on either side."""

    name: str
    columns: Sequence[str]
    unless: tuple[str, str] | None = None


def _sum(cols: Sequence[str], seed: int) -> Column:
    parts: list[Column] = [F.lit(seed)]
    for c in cols:
        parts += [F.xxhash64(F.col(c)), F.col(c).isNull()]
    return F.xxhash64(*parts)


def _leaf(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("k"), 64 - bits)


def range_checksums(left: DataFrame, right: DataFrame, cols: Sequence[str], bits: int) -> DataFrame:
    """``leaf``, ``rows`` and what the left rows of a range of the hashed key have over the right ones.

    Counts and sums of row hashes are added for the left and taken off for the right, so a
    range of equal copies comes to zeros. They are put together before the shuffle, on the map
    side. A row repeated on one side only makes a range differ; the comparison of its rows
    then finds nothing.
    """
    half = F.lit(0x7FFFFFFF).cast("long")

    def side(rows: DataFrame, sign: int) -> DataFrame:
        s = F.lit(sign).cast("long")
        h = _sum(["k", *cols], 1)
        return rows.select(_leaf(bits).alias("leaf"), s.alias("n"), (s * h.bitwiseAND(half)).alias("lo"), (s * F.shiftrightunsigned(h, 33)).alias("hi"), _sum(["k", *cols], 2).alias("x"))

    both = side(left, 1).unionByName(side(right, -1))
    return both.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in ("n", "lo", "hi")], F.bit_xor("x").alias("x"))


def _in_ranges(rows: DataFrame, ranges: DataFrame | None, bits: int, few: bool) -> DataFrame:
    if ranges is None:
        return rows
    ranges = F.broadcast(ranges) if few else ranges
    return rows.join(ranges, _leaf(bits) == ranges["leaf"], "left_semi")


def mismatched_rows(left: DataFrame, right: DataFrame, cols: Sequence[str], leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that lie in leaf ranges whose checksums differ.

    From the top down, only ranges that differ are divided. Each level reads the columns again
    but shuffles checksums of ranges only, and rows of agreeing ranges are dropped where they
    are read.
    """
    bad, bits, few, size = None, 0, True, math.inf
    while size > leaf_rows:
        deeper = min(bits + STEP_BITS, 62) if bad is None else min(62, bits + min(STEP_BITS, math.ceil(math.log2(size / leaf_rows))))
        if deeper == bits:
            break
        sums = cut(range_checksums(_in_ranges(left, bad, bits, few), _in_ranges(right, bad, bits, few), cols, deeper))
        bad, bits = sums.filter("n <> 0 or lo <> 0 or hi <> 0 or x <> 0").select("leaf"), deeper
        total = sums.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("ranges"), F.count(F.when(F.expr("n <> 0 or lo <> 0 or hi <> 0 or x <> 0"), 1)).alias("bad")).first()
        few = total["bad"] <= MOST_SENT
        # rows of a range on one side
        size = (total["rows"] or 0) / 2 / max(total["ranges"], 1) if total["bad"] else 0
    return _in_ranges(left, bad, bits, few), _in_ranges(right, bad, bits, few)


def table_diff(
    left: DataFrame, right: DataFrame, left_key: Column | str, right_key: Column | str, fields: Sequence[Field], *, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """``key``, ``field``, ``state`` of every difference between two copies.

    ``EXIST`` with ``ONLY_SRC`` or ``ONLY_DEST`` for a key on one side only; for a key on both,
    one row with ``DIFFER`` for each field of which any column differs. Both sides make checksums
    of ranges of the hashed key (ranges are equally full, whatever the keys); ranges are
    compared from the top down, divided where they differ and left where they agree, and only
    rows of differing leaves are brought together and compared field by field.

    A null differs from any value and equals a null. Repeated rows count once; if rows of one
    key differ on one side, the least stands. Rows with a null key are left out. Either side
    may be empty. Other columns are ignored.
    """
    # compared columns get names of their own, whatever they are called
    named = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(c for f in fields for c in [*f.columns, *([f.unless[0]] if f.unless else [])]))}
    cols = list(named.values())
    side = lambda t, key: t.select((F.col(key) if isinstance(key, str) else key).alias("k"), *[F.col(c).alias(n) for c, n in named.items()]).filter("k is not null")
    a, b = mismatched_rows(side(left, left_key), side(right, right_key), cols, leaf_rows)
    empty = F.lit(None)
    both_sides = a.select("k", F.struct(*cols).alias("x"), empty.alias("y")).unionByName(b.select("k", empty.alias("x"), F.struct(*cols).alias("y")))
    # repeated rows fall together on the map side, and both sides meet in one shuffle
    pair = both_sides.groupBy("k").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    state = lambda when, f, s: F.when(when, F.struct(F.lit(f).alias("field"), F.lit(s).alias("state")))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    found = [state(F.col("y").isNull(), "EXIST", "ONLY_SRC"), state(F.col("x").isNull(), "EXIST", "ONLY_DEST")]
    for f in fields:
        differs = both
        if f.unless:
            c, v = named[f.unless[0]], f.unless[1]
            differs &= ~F.col("x")[c].eqNullSafe(v) & ~F.col("y")[c].eqNullSafe(v)
        any_ = F.lit(False)
        for c in (named[c] for c in f.columns):
            any_ |= ~F.col("x")[c].eqNullSafe(F.col("y")[c])
        found.append(state(differs & any_, f.name, "DIFFER"))
    return pair.select(F.col("k").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("d")).select("key", "d.field", "d.state")
