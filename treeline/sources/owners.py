"""User and group tables of the machine, and the resolution of names and paths by the driver."""

from __future__ import annotations

import grp
import os
import pwd
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from treeline.functions.paths import reduce_text


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u.pw_uid, u.pw_name) for u in pwd.getpwall()], "id bigint, name string")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g.gr_gid, g.gr_name) for g in grp.getgrall()], "id bigint, name string")


def user_id(text: str) -> int:
    """The id of a user's name, or a number as it is. Raises ValueError."""
    try:
        return pwd.getpwnam(text).pw_uid
    except KeyError:
        if text.isdigit():
            return int(text)
        raise ValueError(f"no such user: {text!r}") from None


def group_id(text: str) -> int:
    try:
        return grp.getgrnam(text).gr_gid
    except KeyError:
        if text.isdigit():
            return int(text)
        raise ValueError(f"no such group: {text!r}") from None


@dataclass(frozen=True)
class PathArgument:
    """A path as given, reduced to an absolute one, and with its links resolved."""

    given: str
    path: str
    target: str
    exists: bool
    is_dir: bool

    @classmethod
    def of(cls, text: str) -> PathArgument:
        path = reduce_text(text if text.startswith("/") else os.path.join(os.getcwd(), text), True)
        return cls(text, path, os.path.realpath(path), os.path.lexists(path), os.path.isdir(path))

    def readable(self) -> bool:
        return os.access(self.path, os.R_OK)

    def writable(self) -> bool:
        return os.access(self.path, os.W_OK)
