"""Mergeable percentiles of numeric columns from signed logarithmic buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets to a doubling. A bucket spans a factor of 2**(1/64), so a reported value is within 0.55 % of the true one.
PER_OCTAVE = 64
#: Exponents of doubles lie above this, so shifted bucket numbers of magnitudes are positive.
FLOOR_EXPONENT = -1100


def relative_error(per_octave: int = PER_OCTAVE) -> float:
    """The guaranteed bound on |reported - true| / |true|."""
    width = 2 ** (1 / per_octave)
    return (width - 1) / (width + 1)


def bucket_of(value: Column, integral: bool, per_octave: int = PER_OCTAVE) -> Column:
    """The signed bucket of a number: 0 for zero, positive or negative with its sign, rising with the value.

    Powers of two begin a bucket exactly, also for integers beyond 2**53. Null, NaN and the
    infinities give null. The least bigint counts as its successor.
    """
    if integral:
        size = F.abs(F.greatest(value.cast("long"), F.lit(-(2**63) + 1)))
        guess = F.least(F.floor(F.log2(size.cast("double"))), F.lit(62)).cast("int")
        power = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e)
        high = guess + F.when((guess < 62) & (power(F.least(guess + 1, F.lit(62))) <= size), 1).otherwise(0)
        e = high - F.when(power(high) > size, 1).otherwise(0)
        ratio = size.cast("double") / power(e).cast("double")
    else:
        size = F.abs(value.cast("double"))
        guess = F.floor(F.log2(size)).cast("int")
        power = lambda e: F.pow(F.lit(2.0), e)
        e = guess + F.when(power(guess + 1) <= size, 1).otherwise(0) - F.when(power(guess) > size, 1).otherwise(0)
        ratio = size / power(e)
    step = F.greatest(F.least(F.floor(F.log2(ratio) * per_octave), F.lit(per_octave - 1)), F.lit(0))
    place = (e - FLOOR_EXPONENT).cast("long") * per_octave + step
    real = value.isNotNull() if integral else value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(real, F.when(value == 0, F.lit(0).cast("long")).when(value > 0, place).otherwise(-place))


def value_of(bucket: Column, per_octave: int = PER_OCTAVE) -> Column:
    """The number within a bucket whose relative distance to both ends is least."""
    low = F.pow(F.lit(2.0), F.abs(bucket) / F.lit(float(per_octave)) + FLOOR_EXPONENT)
    width = 2 ** (1 / per_octave)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * low * (2 * width / (1 + width)))


def sketch(df: DataFrame, keys: Sequence[str], value: str, per_octave: int = PER_OCTAVE) -> DataFrame:
    """Bucket counts (keys, ``bucket``, ``n``) of ``value`` for each combination of ``keys``.

    Counts are combined before they are shuffled; a key has at most two buckets for each
    step of the number range, whatever its rows, so heavy keys cost no more than others.
    Null, NaN and infinite values are left out; a null key is a key of its own.
    """
    if {"bucket", "n"} & set(keys):
        raise ValueError("a key can't be named bucket or n")
    integral = isinstance(df.schema[value].dataType, T.IntegralType)
    rows = df.select(*[F.col(k) for k in keys], bucket_of(F.col(value), integral, per_octave).alias("bucket"))
    return rows.filter("bucket is not null").groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The sketch of all rows from sketches of parts: counts of equal buckets are added."""
    every = reduce(DataFrame.unionByName, [s.select(*keys, "bucket", "n") for s in sketches])
    return every.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentile_buckets(counts: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """For each key its row count ``n`` and bucket ``b0``, ``b1``... of each share.

    The p-percentile is the smallest value that at least p of the rows don't exceed. Ranks
    are counted in millionths, in integers.
    """
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = counts.select(*keys, "bucket", "n", upto.alias("upto"), F.sum("n").over(w).alias("total"))
    need = [f"greatest((total * {round(p * 1_000_000)} + 999999) div 1000000, 1)" for p in shares]
    return run.groupBy(*keys).agg(
        F.first("total").alias("n"),
        *[F.min(F.expr(f"if(upto >= {x}, bucket, null)")).alias(f"b{i}") for i, x in enumerate(need)],
    )


def percentiles(counts: DataFrame, keys: Sequence[str], shares: Sequence[float], per_octave: int = PER_OCTAVE) -> DataFrame:
    """Percentiles ``p0``, ``p1``... (double) of a sketch, each within :func:`relative_error` of the true one."""
    found = percentile_buckets(counts, keys, shares)
    return found.select(*keys, "n", *[value_of(F.col(f"b{i}"), per_octave).alias(f"p{i}") for i in range(len(shares))])


def at_least(bucket: Column, bound: int, per_octave: int = PER_OCTAVE) -> Column:
    """Whether values of a bucket reach ``bound``; exact, since ``bound`` must be a power of two, where a bucket begins."""
    if bound < 1 or bound & (bound - 1):
        raise ValueError("bound must be a positive power of two")
    return bucket >= F.lit((bound.bit_length() - 1 - FLOOR_EXPONENT) * per_octave)
