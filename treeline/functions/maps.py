"""String maps with ordered keys, as Columns of type map<string,string>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty() -> Column:
    return F.create_map().cast("map<string,string>")


def put(m: Column, key: Column, value: Column) -> Column:
    """``m`` with one entry set, replacing one of the same key."""
    return merge(m, F.create_map(key, value))


def get(m: Column, key: Column) -> Column:
    """The value of a key, null without one."""
    return F.try_element_at(m, key)


def unset(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def merge(m: Column, over: Column) -> Column:
    """Entries of both; those of ``over`` win."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(over, k)), over)


def size(m: Column) -> Column:
    return F.size(m)


def ordered(m: Column) -> Column:
    """Entries as an array of structs (key, value), keys in byte order; explode it to iterate."""
    return F.array_sort(F.map_entries(m))


def first(m: Column) -> Column:
    return F.get(ordered(m), F.lit(0))


def last(m: Column) -> Column:
    return F.try_element_at(ordered(m), F.lit(-1))


def after(m: Column, key: Column) -> Column:
    """The entry with the least key above ``key``, null at the end."""
    return F.get(F.filter(ordered(m), lambda e: e["key"] > key), F.lit(0))


def before(m: Column, key: Column) -> Column:
    """The entry with the greatest key below ``key``, null at the start."""
    return F.try_element_at(F.filter(ordered(m), lambda e: e["key"] < key), F.lit(-1))
