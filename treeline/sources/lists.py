"""Saved lists: the lite text form, and the binary forms of version 3 and 4."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeline.entries import DETAIL, SCHEMA, conform
from treeline.functions.scalars import scale_bytes, show_mode
from treeline.functions.times import show_time

# Fixed values of the formats: letters of types; numbers are 64 bits, most significant byte first. A file
# begins with its version, then (version 3 only) start and end of the walk, then count and width of users,
# of groups, and of items. A table of users and one of groups follow, a name padded with NULs and an id to
# each row; then the items, a padded name and ten numbers to each.
LETTERS = {"F": "FILE", "D": "DIR", "L": "LINK"}
NUMBERS = ("mode", "uid", "gid", "atime", "atime_nsec", "mtime", "mtime_nsec", "ctime", "ctime_nsec", "size")
RECORD, RECORD_SIZE = f">{len(NUMBERS)}Q", 8 * len(NUMBERS)


def read_lite(spark: SparkSession, path: str) -> DataFrame:
    """Entries of lite text lists. The letter stands after the **last** bar, so names may hold bars."""
    return parse_lite(spark.read.text(path, lineSep="\n"), "value")


def parse_lite(df: DataFrame, line: str) -> DataFrame:
    """Entries from lines ``name|letter``; a line without a bar, or with another letter, has type UNKNOWN."""
    c = F.regexp_replace(F.col(line), "\\r$", "")
    rows = df.select(c.alias("t")).filter("t <> ''")
    letter = F.substring_index("t", "|", -1)
    bar = F.contains("t", F.lit("|"))
    kind = F.lit("UNKNOWN")
    for k, v in LETTERS.items():
        kind = F.when(bar & (letter == k), F.lit(v)).otherwise(kind)
    name = F.when(bar, F.expr("left(t, length(t) - length(substring_index(t, '|', -1)) - 1)")).otherwise(F.col("t"))
    return conform(rows.select(name.alias("name"), kind.alias("type")))


def lite_lines(df: DataFrame) -> DataFrame:
    """``value``: the line of each entry."""
    letter = F.lit("U")
    for k, v in LETTERS.items():
        letter = F.when(F.col("type") == v, F.lit(k)).otherwise(letter)
    return df.select(F.concat("name", F.lit("|"), letter).alias("value"))


def write_lite(df: DataFrame, path: str) -> None:
    """A folder of text parts; an empty list gives an empty folder that reads as no rows."""
    lite_lines(df).write.mode("overwrite").text(path)


def text_lines(df: DataFrame, detail: bool = True) -> DataFrame:
    """``value``: the line people read. With detail the columns ``user`` and ``group`` are needed; a null detail is a minus."""
    if not detail:
        short = F.when(F.col("type") == "DIR", F.lit("DIR")).when(F.col("type") == "FILE", F.lit("REG")).when(F.col("type") == "LINK", F.lit("LNK")).otherwise(F.lit("UNK"))
        return df.select(F.concat(F.lit("Type="), short, F.lit(" File="), F.col("name")).alias("value"))
    number, unit = scale_bytes(F.col("size"))
    size = F.concat(F.format_string("%7.3f", F.bround(number, 3)), F.lit(" "), F.lpad(unit, 3, " "))
    parts = [F.when(F.col("mode").isNotNull(), show_mode(F.col("mode"))), F.col("user"), F.col("group"), F.when(F.col("size").isNotNull(), size), show_time(F.col("mtime"))]
    return df.select(F.concat_ws(" ", *[F.coalesce(p, F.lit("-")) for p in parts], F.col("name")).alias("value"))


def write_text(df: DataFrame, path: str, detail: bool = True) -> None:
    text_lines(df, detail).write.mode("overwrite").text(path)


def read_header(path: str) -> dict:
    """Counts, widths and places of a binary list, with its users and groups. Raises ValueError for other files."""
    with open(path, "rb") as f:
        start = f.read(8)
        version = struct.unpack(">Q", start)[0] if len(start) == 8 else 0
        if version not in (3, 4):
            raise ValueError(f"not a binary list of version 3 or 4: {path}")
        n = 8 if version == 3 else 6
        head = list(struct.unpack(f">{n}Q", f.read(8 * n)))
        out: dict[str, Any] = {"version": version}
        if version == 3:
            out["start"], out["end"] = head[:2]
            head = head[2:]
        users, user_width, groups, group_width, out["count"], out["width"] = head
        for key, count, width in (("users", users, user_width), ("groups", groups, group_width)):
            table = []
            for _ in range(count if width else 0):
                row = f.read(width + 8)
                table.append((struct.unpack(">Q", row[width:])[0], row[:width].split(b"\0")[0].decode("utf-8", "surrogateescape")))
            out[key] = table
        out["place"] = f.tell()
    return out


class _Range(InputPartition):
    def __init__(self, first: int, count: int) -> None:
        self.first, self.count = first, count


class ListReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        n = read_header(self.path)["count"]
        return [_Range(i, min(self.split, n - i)) for i in range(0, n, self.split)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        head = read_header(self.path)
        width, size = head["width"], head["width"] + RECORD_SIZE
        with open(self.path, "rb") as f:
            f.seek(head["place"] + part.first * size)
            for _ in range(part.count):
                row = f.read(size)
                name = row[:width].split(b"\0")[0].decode("utf-8", "replace")
                v = dict(zip(NUMBERS, struct.unpack(RECORD, row[width:]), strict=True))
                kind = {0o100000: "FILE", 0o040000: "DIR", 0o120000: "LINK"}.get(v["mode"] & 0o170000, "UNKNOWN")
                yield (name, name.count("/"), kind, *[v[c] for c in DETAIL])


class BinaryList(DataSource):
    """``spark.read.format("treeline_list").load(path)``: a binary list, split by ranges of records."""

    @classmethod
    def name(cls) -> str:
        return "treeline_list"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> ListReader:
        return ListReader(self.options["path"], int(self.options.get("split", 100_000)))


def read_binary(spark: SparkSession, path: str, split: int = 100_000) -> DataFrame:
    spark.dataSource.register(BinaryList)
    return spark.read.format("treeline_list").option("split", split).load(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A saved list of any form: binary of version 4 or 3, Parquet, else lite text."""
    import os

    if os.path.isdir(path) and any(n.endswith(".parquet") for n in os.listdir(path)):
        return conform(spark.read.parquet(path))
    if os.path.isfile(path):
        try:
            read_header(path)
            return read_binary(spark, path)
        except (ValueError, struct.error):
            pass
    return read_lite(spark, path)


def write_binary(df: DataFrame, path: str, users: list[tuple[int, str]] = (), groups: list[tuple[int, str]] = ()) -> int:
    """Write a version 4 list to a file system that all executors share; number of records.

    Offsets follow from the position in order of names, so tasks write their records at once.
    """
    from treeline.operators.order import positions
    from treeline.plans.lineage import cut

    # width, count and places must come from one and the same list
    df = cut(df.select("name", *NUMBERS))
    width = df.agg(F.coalesce(F.max(F.octet_length("name")), F.lit(0))).first()[0] + 1
    width += -width % 8
    tables = b""
    heads = []
    for table in (users, groups):
        w = max([len(n.encode()) for _, n in table], default=0) + 1 if table else 0
        w += -w % 8
        heads += [len(table), w]
        tables += b"".join(n.encode().ljust(w, b"\0") + struct.pack(">Q", i) for i, n in table)
    count = df.count()
    start = struct.pack(">7Q", 4, *heads, count, width) + tables
    size = width + RECORD_SIZE
    with open(path, "wb") as f:
        f.write(start)
        f.truncate(len(start) + count * size)
    begin = len(start)

    def place(rows: Iterator) -> None:
        with open(path, "r+b") as f:
            for r in rows:
                f.seek(begin + r["position"] * size)
                f.write(r["name"].encode().ljust(width, b"\0") + struct.pack(RECORD, *[(r[c] or 0) & (1 << 64) - 1 for c in NUMBERS]))

    positions(df, [F.asc("name")]).foreachPartition(place)
    return count
