"""Plans of operations that change trees: pure tables, which :mod:`treeline.operators.apply` can carry out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.modes import new_mode
from treeline.functions.paths import below, dirname, move_root
from treeline.functions.scalars import perm
from treeline.operators.predicates import filter_regex


def select_items(df: DataFrame, *, match: str | None = None, exclude: str | None = None, only_basename: bool = False) -> DataFrame:
    """Rows that match, or don't, a basic regex; at most one of the two is given."""
    if match and exclude:
        raise ValueError("match and exclude are given together")
    if match:
        return filter_regex(df, match, only_basename=only_basename)
    return filter_regex(df, exclude, exclude=True, only_basename=only_basename) if exclude else df


def copy_plan(df: DataFrame, roots: list[tuple[str, str]]) -> DataFrame:
    """``name``, ``type``, ``dest``, ``step``: directories shallow to deep, then links and files, then directories' metadata deep to shallow.

    Each item goes below the target of the first root that holds it, by whole parts of the path.
    """
    to = df.select("name", "type", "depth", "size", move_root("name", roots).alias("dest")).filter("dest is not null")
    deepest = F.lit(1_000_000)
    step = F.when(F.col("type") == "DIR", F.col("depth")).otherwise(deepest)
    made = to.withColumn("step", step).withColumn("action", F.when(F.col("type") == "DIR", F.lit("mkdir")).when(F.col("type") == "LINK", F.lit("symlink")).otherwise(F.lit("copy")))
    meta = to.filter("type = 'DIR'").withColumn("step", 2 * deepest - F.col("depth")).withColumn("action", F.lit("metadata"))
    return made.filter("type in ('DIR', 'LINK', 'FILE')").unionByName(meta).select("name", "type", "size", "dest", "action", "step")


def check_copy(sources: list[str], dest: str, dest_is_dir: bool, dest_exists: bool) -> None:
    """Several sources need a directory to go to. Raises ValueError."""
    if not sources:
        raise ValueError("nothing to copy")
    if len(sources) > 1 and not (dest_exists and dest_is_dir):
        raise ValueError("several sources need an existing directory as destination")


def remove_plan(df: DataFrame) -> DataFrame:
    """``name``, ``action``, ``step``: everything but directories first, then directories deepest first."""
    top = F.lit(1_000_000)
    is_dir = F.col("type") == "DIR"
    return df.select("name", "type", F.when(is_dir, F.lit("rmdir")).otherwise(F.lit("unlink")).alias("action"), F.when(is_dir, top - F.col("depth")).otherwise(F.lit(0)).alias("step"))


def traceless_parents(df: DataFrame) -> DataFrame:
    """Distinct parents that stay, whose times are put back after a removal without traces: ``name``."""
    gone = df.filter("type = 'DIR'").select("name")
    return df.select(dirname("name").alias("name")).filter("name <> ''").distinct().join(gone, "name", "left_anti")


def chmod_plan(df: DataFrame, mode: str | None = None, *, uid: int | None = None, gid: int | None = None, umask: int = 0o022, force: bool = False, only_owner: int | None = None) -> DataFrame:
    """``name``, ``new_mode``, ``new_uid``, ``new_gid``, ``outcome`` of each item.

    ``skip`` for links, for items that wouldn't change (unless ``force``), and for those that
    ``only_owner`` (the caller) doesn't own; ``change`` for the others.
    """
    m: Column = new_mode(F.col("mode"), F.col("type"), mode, umask) if mode else F.col("mode")
    u = F.lit(uid).cast("long") if uid is not None else F.col("uid")
    g = F.lit(gid).cast("long") if gid is not None else F.col("gid")
    same = perm(m).eqNullSafe(perm(F.col("mode"))) & u.eqNullSafe(F.col("uid")) & g.eqNullSafe(F.col("gid"))
    skip = F.col("type").eqNullSafe("LINK") | (F.lit(False) if force else same)
    if only_owner is not None:
        skip |= ~F.col("uid").eqNullSafe(F.lit(only_owner))
    return df.select("name", m.alias("new_mode"), u.alias("new_uid"), g.alias("new_gid"), F.when(skip, F.lit("skip")).otherwise(F.lit("change")).alias("outcome"))


def restripe_report(df: DataFrame, count: int, width: int, min_size: int = 0) -> DataFrame:
    """Files of at least ``min_size`` whose ``stripe_count`` or ``stripe_size`` isn't the wanted one."""
    return df.filter((F.col("type") == "FILE") & (F.col("size") >= min_size) & ~(F.col("stripe_count").eqNullSafe(count) & F.col("stripe_size").eqNullSafe(width)))


def below_roots(df: DataFrame, roots: list[str]) -> DataFrame:
    """Items of a saved list that a copy of ``roots`` takes in."""
    hit = F.lit(False)
    for r in roots:
        hit |= below("name", r, inclusive=True)
    return df.filter(hit)
