"""Retargeting of symbolic links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import below, dirname, reduce_text, relative


def new_target(target: Column, name: Column, old: str, new: str, *, as_relative: bool = False) -> Column:
    """The target below ``new`` for an absolute target strictly below ``old``; null for others.

    With ``as_relative`` the result is seen from the link's directory, ``.`` for that directory itself.
    """
    old, new = reduce_text(old, True), reduce_text(new, True)
    moved = F.concat(F.lit(new.rstrip("/")), F.substr(target, F.lit(len(old.rstrip("/")) + 1)))
    return F.when(below(target, old), relative(moved, dirname(name)) if as_relative else moved)


def relink_plan(links: DataFrame, old: str, new: str, *, as_relative: bool = False) -> DataFrame:
    """``name``, ``target``, ``new_target`` of links that change; needs the column ``target``."""
    out = links.filter("type = 'LINK'").select("name", "target", new_target(F.col("target"), F.col("name"), old, new, as_relative=as_relative).alias("new_target"))
    return out.filter("new_target is not null and new_target <> target")
