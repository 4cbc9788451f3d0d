"""Find-like tests: each is a Column, a list of them is a conjunction."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import basename, below, components
from treeline.functions.patterns import basic_regex, glob_regex, matches_basic, wildcard_regex
from treeline.functions.scalars import TYPE_BITS, TYPE_MASK, parse_bytes

MINUTE, DAY = 60, 86_400


def now() -> tuple[int, int]:
    """The query's time, taken once by the driver: (second, nanosecond)."""
    return divmod(time.time_ns(), 1_000_000_000)


def parse_signed(text: str | int) -> tuple[str, str]:
    """``+N`` is more than N, ``-N`` less, ``N`` equal: the comparison and the rest of the text."""
    text = str(text).strip()
    return ({"+": ">", "-": "<"}[text[0]], text[1:]) if text[:1] in ("+", "-") else ("=", text)


def _number(text: str | int) -> tuple[str, int]:
    op, rest = parse_signed(text)
    if not re.fullmatch(r"\d+", rest):
        raise ValueError(f"not a whole number: {text!r}")
    return op, int(rest)


def _compare(c: Column, op: str, n: int) -> Column:
    return c > n if op == ">" else c < n if op == "<" else c == n


def type_is(letter: str) -> Column:
    """One of b c d f l p s, by the type bits of ``mode``."""
    if letter not in TYPE_BITS:
        raise ValueError(f"not a type: {letter!r}")
    return F.col("mode").bitwiseAND(F.lit(TYPE_MASK)) == TYPE_BITS[letter]


def name_like(glob: str) -> Column:
    return basename("name").rlike(glob_regex(glob))


def path_like(glob: str) -> Column:
    return F.col("name").rlike(glob_regex(glob))


def path_regex(pattern: str) -> Column:
    return F.col("name").rlike(basic_regex(pattern))


def uid(text: str | int) -> Column:
    return _compare(F.col("uid"), *_number(text))


def gid(text: str | int) -> Column:
    return _compare(F.col("gid"), *_number(text))


def user(name: str) -> Column:
    """Needs the column ``user`` of :func:`treeline.operators.aggregate.with_owner_names`."""
    return F.col("user") == name


def group(name: str) -> Column:
    return F.col("group") == name


def size(text: str) -> Column:
    """``+10k``, ``-1.5GB`` or an exact size, for items of every type. An unknown unit raises ValueError."""
    op, rest = parse_signed(text)
    return _compare(F.col("size"), op, parse_bytes(rest))


def age(field: str, text: str | int, unit: int, at: tuple[int, int]) -> Column:
    """Whole units that passed from the item's time to ``at``; 0 for times to come. All in whole numbers."""
    op, n = _number(text)
    late = F.col(f"{field}_nsec") > at[1]
    seconds = F.lit(at[0]) - F.col(field) - F.when(late, 1).otherwise(0)
    passed = F.greatest(seconds, F.lit(0))
    return _compare((passed - F.pmod(passed, F.lit(unit))) / unit, op, n)


def minutes(field: str, text: str | int, at: tuple[int, int]) -> Column:
    return age(field, text, MINUTE, at)


def days(field: str, text: str | int, at: tuple[int, int]) -> Column:
    return age(field, text, DAY, at)


def newer(field: str, second: int, nano: int) -> Column:
    """Strictly later than a reference's mtime."""
    return (F.col(field) > second) | ((F.col(field) == second) & (F.col(f"{field}_nsec") > nano))


def max_depth(n: int, root_depth: int = 0) -> Column:
    """At most ``n`` levels below a root of ``root_depth`` (an extension: elsewhere the option has no effect)."""
    return F.col("depth") <= root_depth + n


def find(df: DataFrame, *tests: Column) -> DataFrame:
    """Rows for which every test holds; a test that is null doesn't hold.

    Tests of detail on a list without detail raise ValueError when the columns are missing;
    rows whose detail is null never pass them.
    """
    try:
        return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
    except AnalysisException as e:
        if "UNRESOLVED_COLUMN" in str(e):
            raise ValueError(f"the list lacks a column that a test needs: {e}") from e
        raise


def filter_regex(df: DataFrame, pattern: str | None, *, exclude: bool = False, only_basename: bool = False) -> DataFrame:
    """Rows whose path (or last part) matches a basic regex, or doesn't; no pattern gives no rows."""
    if pattern is None:
        return df.limit(0)
    hit = matches_basic("name", pattern, only_basename=only_basename)
    return df.filter(~hit if exclude else hit)


def split_by_root(df: DataFrame, root: str, inclusive: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows below ``root``, and the rest."""
    inside = below("name", root, inclusive)
    return df.filter(inside), df.filter(~inside)


def child_like(df: DataFrame, root: str, wildcard: str) -> DataFrame:
    """Rows below ``root`` whose first part below it matches a wildcard; ``*`` is the only special character."""
    level = len([x for x in root.split("/") if x]) + 1
    return df.filter(below("name", root) & F.get(components("name"), F.lit(level)).rlike(wildcard_regex(wildcard)))


def under_any(df: DataFrame, roots: Iterable[str]) -> DataFrame:
    """Rows that are one of the roots or lie below one."""
    return df.filter(reduce(lambda a, b: a | b, [below("name", r, inclusive=True) for r in roots], F.lit(False)))


def purge_candidates(df: DataFrame, at: tuple[int, int], limit_days: int = 60) -> DataFrame:
    """Files and links neither read nor changed within ``limit_days``."""
    old = lambda f: F.lit(at[0]) - F.col(f) > limit_days * DAY
    return df.filter(F.col("type").isin("FILE", "LINK") & old("atime") & old("ctime"))


def passing_command(df: DataFrame, command: list[str]) -> DataFrame:
    """Rows for which a command exits with 0; ``{}`` in an argument is the item's name. Runs on the executors."""
    import subprocess

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [subprocess.run([a.replace("{}", n) for a in command], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, check=False).returncode == 0 for n in batch.column("name").to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def passing(df: DataFrame, test: Callable[[dict], bool | None]) -> DataFrame:
    """Rows for which a Python function of the row is true; for tests that no Column expresses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(test(r)) for r in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
