"""Sizes, counts and modes: parsing on the driver, display and arithmetic as Columns."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of sizes and counts, and the type bits of a mode.
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
COUNT_UNITS = ("", "k", "M", "G", "T", "P", "E")
SUFFIXES = "kmgtpe"
TYPE_BITS = {"b": 0o060000, "c": 0o020000, "d": 0o040000, "f": 0o100000, "l": 0o120000, "p": 0o010000, "s": 0o140000}
TYPE_MASK = 0o170000
PERM_MASK = 0o7777


def parse_bytes(text: str) -> int:
    """``10``, ``1.5k``, ``2KB``: a number, one unit letter (powers of 1024) and an optional b. Truncates; raises ValueError."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)([kmgtpe]?)(b?)", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    number, unit = m.group(1), m.group(2).lower()
    factor = 1024 ** (SUFFIXES.index(unit) + 1) if unit else 1
    whole, _, part = number.partition(".")
    value = int(whole or 0) * factor + int(part or 0) * factor // 10 ** len(part)
    if value >= 1 << 64:
        raise ValueError(f"too large: {text!r}")
    return value


def parse_bytes_col(text: Column) -> Column:
    """Column form of :func:`parse_bytes`, exact; null where the text isn't a size or passes bigint."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)([kKmMgGtTpPeE]?)[bB]?$"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.lit(1)
    for k, c in enumerate(SUFFIXES):
        factor = F.when(unit == c, F.lit(1024 ** (k + 1))).otherwise(factor)
    factor = factor.cast("decimal(19,0)")
    number = F.regexp_extract(text, pattern, 1)
    whole = F.substring_index(number, ".", 1)
    whole = F.when(whole == "", F.lit("0")).otherwise(whole).try_cast("decimal(19,0)")
    part = F.when(F.contains(number, F.lit(".")), F.substring_index(number, ".", -1)).otherwise(F.lit(""))
    # multiples of a unit's 1024^-6 have 60 digits at most, so 76 decide every floor; 19 at a time, last first
    digits, carry = F.rpad(part, 76, "0"), F.lit(0).cast("long")
    for g in range(3, -1, -1):
        carry = F.call_function("div", F.substring(digits, 19 * g + 1, 19).cast("decimal(19,0)") * factor + carry, F.lit(Decimal(10**19)))
    carry = F.when(part == "", F.lit(0).cast("long")).otherwise(carry)
    return F.when(text.rlike(pattern), (whole * factor + carry).try_cast("bigint"))


def _scaled(value: Column, step: float, units: tuple[str, ...], early: bool) -> tuple[Column, Column]:
    v = value.cast("double")
    number, unit = v, F.lit(units[0])
    for k in range(1, len(units)):
        # the unit k is used when the value passes k steps; sizes also change early, above 1000 of a unit
        bound = 1000.0 * step ** (k - 1) if early else step**k
        number = F.when(v > bound, v / step**k).otherwise(number)
        unit = F.when(v > bound, F.lit(units[k])).otherwise(unit)
    return number, unit


def scale_bytes(value: Column) -> tuple[Column, Column]:
    """Number and unit; a value above 1000 of a unit takes the next one, so 1001 bytes are in KiB."""
    return _scaled(value, 1024.0, SIZE_UNITS, early=True)


def scale_count(value: Column) -> tuple[Column, Column]:
    """Number and unit in steps of 1000, changing only above 1000."""
    return _scaled(value, 1000.0, COUNT_UNITS, early=False)


# scaled numbers are exact, so rounding halves to even prints what C prints
def show_bytes(value: Column, per_second: bool = False) -> Column:
    number, unit = scale_bytes(value)
    return F.when(value.isNotNull(), F.concat(F.format_string("%.3f ", F.bround(number, 3)), unit, F.lit("/s" if per_second else "")))


def show_count(value: Column) -> Column:
    """Three decimals and a unit in steps of 1000, in whole numbers; halves round up."""
    v = value.cast("long")
    out = F.concat(v.cast("string"), F.lit(".000"))
    for k in range(1, len(COUNT_UNITS)):
        small = 1000 ** (k - 1)
        thousandths = v - F.pmod(v, F.lit(small)) + F.when(F.pmod(v, F.lit(small)) * 2 >= small, small if k > 1 else 0).otherwise(0)
        thousandths = F.call_function("div", thousandths, F.lit(small))
        shown = F.concat(F.call_function("div", thousandths, F.lit(1000)).cast("string"), F.lit("."), F.lpad(F.pmod(thousandths, F.lit(1000)).cast("string"), 3, "0"), F.lit(f" {COUNT_UNITS[k]}"))
        out = F.when(v > 1000**k, shown).otherwise(out)
    return out


def show_size_2(value: Column) -> Column:
    """Two decimals and a unit, in steps of 1024."""
    number, unit = _scaled(value, 1024.0, SIZE_UNITS, early=False)
    return F.concat(F.format_string("%.2f ", F.bround(number, 2)), unit)


def show_mode(mode: Column) -> Column:
    """``drwxr-xr-x``: directories d, links l, all else -; no letters for set-id and sticky bits."""
    kind = mode.bitwiseAND(F.lit(TYPE_MASK))
    first = F.when(kind == TYPE_BITS["d"], F.lit("d")).when(kind == TYPE_BITS["l"], F.lit("l")).otherwise(F.lit("-"))
    bits = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, F.lit("rwx"[i % 3])).otherwise(F.lit("-")) for i in range(9)]
    return F.concat(first, *bits)


def perm(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(PERM_MASK))


def type_of_mode(mode: Column) -> Column:
    kind = mode.bitwiseAND(F.lit(TYPE_MASK))
    return (
        F.when(kind == TYPE_BITS["f"], F.lit("FILE")).when(kind == TYPE_BITS["d"], F.lit("DIR")).when(kind == TYPE_BITS["l"], F.lit("LINK")).otherwise(F.lit("UNKNOWN"))
    )


def round_up(size: Column, block: int = 512) -> Column:
    """The least multiple of ``block`` that holds ``size``, in whole numbers."""
    padded = size + (block - 1)
    return padded - F.pmod(padded, F.lit(block))


def even_share(total: int, parts: int, part: int) -> tuple[int, int]:
    """Start and count of part ``part`` when ``total`` items are split evenly; the first parts take the remainder."""
    each, rest = divmod(total, parts)
    return part * each + min(part, rest), each + (part < rest)
