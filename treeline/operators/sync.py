"""What must be done to make a destination tree equal to a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import compare

#: Effects take place in this order.
ORDER = ("remove", "copy", "overwrite", "link", "refresh")


#: Fields a plan looks at.
FIELDS = ("EXIST", "TYPE", "SIZE", "UID", "GID", "PERM", "ATIME", "MTIME", "CONTENT")


class EmptySourceError(ValueError):
    """The source has no items at all, not even its root."""


def sync_plan(
    src: DataFrame, dst: DataFrame, src_root: str, dst_root: str, *, delete: bool = False, contents: bool = False, content: str | None = None,
    target: str | None = None, link_dest: DataFrame | None = None, link_root: str | None = None, nanoseconds: bool = True, walk_errors: bool = False, unlike: DataFrame | None = None, unlike_link: DataFrame | None = None,
) -> DataFrame:
    """``rel``, ``action``, ``step``: what to do with each path; nothing for paths that agree.

    Source only: copy. Destination only: remove, if ``delete`` and no ``walk_errors``. Other
    type, other link target, other size, or (without ``contents``) other mtime: remove and
    copy. With ``contents``, the same size and other ``content``: overwrite, or remove and copy
    when a ``link_dest`` tree is given. Any of uid, gid, permissions, atime, mtime other
    (times in whole seconds): refresh. A file to be copied that has the same content in
    ``link_dest`` (size and mtime, or content with ``contents``) is linked instead. With
    ``contents``, ``unlike`` (and ``unlike_link``) give the paths whose bytes differ, in place
    of a column ``content``.
    """
    columns = compare.columns_for(FIELDS, content, target)
    both = compare.states(compare.with_unlike(compare.sides(src, dst, src_root, dst_root, columns), unlike), FIELDS, lite=not contents, content=content, target=target, nanoseconds=nanoseconds)
    s, d = F.col("s"), F.col("d")
    common = F.col("EXIST") == "COMMON"
    type_same = F.coalesce(F.col("TYPE") == "COMMON", F.lit(False))
    regular = s["type"] == "FILE"
    same_size = s["size"].eqNullSafe(d["size"])
    content_differs = F.coalesce(F.col("CONTENT") == "DIFFER", F.lit(False))
    in_place = common & type_same & regular & same_size & content_differs & F.lit(contents and link_dest is None)
    replace = common & content_differs & ~in_place
    seconds = lambda c: ~s[c].eqNullSafe(d[c])
    meta = F.lit(False)
    for f in ("UID", "GID", "PERM"):
        meta |= F.col(f) == "DIFFER"
    meta = common & (meta | seconds("atime") | seconds("mtime"))
    act = lambda when, what: F.when(when, F.lit(what))
    gone = (F.col("EXIST") == "ONLY_DEST") & F.lit(delete and not walk_errors)
    copied = (F.col("EXIST") == "ONLY_SRC") | replace
    actions = F.array_compact(F.array(act(gone | replace, "remove"), act(copied, "copy"), act(in_place, "overwrite"), act(meta, "refresh")))
    plan = both.select("rel", F.col("s.type").alias("kind"), F.explode(actions).alias("action"))
    if link_dest is not None:
        linked = link_candidates(src, link_dest, src_root, link_root, contents=contents, content=content, nanoseconds=nanoseconds, unlike=unlike_link)
        plan = plan.join(linked.select("rel", F.lit(True).alias("same")), "rel", "left").withColumn(
            "action", F.when((F.col("action") == "copy") & (F.col("kind") == "FILE") & F.col("same"), F.lit("link")).otherwise(F.col("action"))
        )
    step = F.array_position(F.array(*map(F.lit, ORDER)), F.col("action")).cast("int")
    return plan.select("rel", "action", step.alias("step"))


def link_candidates(
    src: DataFrame, link_dest: DataFrame, src_root: str, link_root: str, *, contents: bool = False, content: str | None = None, nanoseconds: bool = True, unlike: DataFrame | None = None
) -> DataFrame:
    """``rel`` of source files with the same content in a third tree."""
    fields = ["EXIST", "TYPE", "CONTENT"]
    pairs = compare.states(compare.with_unlike(compare.sides(src, link_dest, src_root, link_root, compare.columns_for(fields, content)), unlike), fields, lite=not contents, content=content, nanoseconds=nanoseconds)
    return pairs.filter("EXIST = 'COMMON' and TYPE = 'COMMON' and CONTENT = 'COMMON' and s.type = 'FILE'").select("rel")


def only_in(dst: DataFrame, src: DataFrame, dst_root: str, src_root: str) -> DataFrame:
    """Rows of ``dst`` whose relative path ``src`` doesn't have."""
    from treeline.functions.paths import strip_root

    rel = src.select(strip_root("name", src_root).alias("rel")).filter("rel is not null")
    return dst.withColumn("rel", strip_root("name", dst_root)).join(rel, "rel", "left_anti").drop("rel")


def check_source(src: DataFrame) -> None:
    """Raises :class:`EmptySourceError` for a source without any item: syncing it would empty the destination."""
    if src.limit(1).isEmpty():
        raise EmptySourceError("the source list is empty")
