"""Times as whole numbers: (second, nanosecond) pairs, microseconds, and their display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without time zone, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.simpleString() != "timestamp_ntz":
        return F.unix_micros(c)
    minutes = F.unix_date(F.to_date(c)).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def later(second: Column, nano: Column, than_second: int, than_nano: int) -> Column:
    """Strictly later, by second, then nanosecond."""
    return (second > than_second) | ((second == than_second) & (nano > than_nano))


def split_nanos(nanos: Column) -> tuple[Column, Column]:
    """Second and nanosecond of nanoseconds since 1970, also before it."""
    rest = F.pmod(nanos, F.lit(1_000_000_000))
    whole = (nanos - rest).cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")
    return whole.cast("long"), rest


def join_nanos(second: Column, nano: Column) -> Column:
    """Nanoseconds since 1970; overflows only beyond the year 2262."""
    return second * 1_000_000_000 + nano


def show_time(second: Column) -> Column:
    """``Jan  2 2025 03:04`` in the session's time zone: the day padded with a blank."""
    t = F.timestamp_seconds(second)
    return F.concat(F.date_format(t, "MMM "), F.lpad(F.date_format(t, "d"), 2, " "), F.date_format(t, " yyyy HH:mm"))


def show_time_iso(second: Column) -> Column:
    return F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss")
