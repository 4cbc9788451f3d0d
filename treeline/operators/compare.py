"""Comparison of two trees by relative path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import strip_root
from treeline.functions.scalars import TYPE_MASK, perm
from treeline.operators import exprs

DEFAULT_OUTPUTS = (
    "EXIST=COMMON", "EXIST=DIFFER", "EXIST=COMMON@TYPE=COMMON", "EXIST=COMMON@TYPE=DIFFER",
    "EXIST=COMMON@CONTENT=COMMON", "EXIST=COMMON@CONTENT=DIFFER",
)
TIMES = {"ATIME": "atime", "MTIME": "mtime", "CTIME": "ctime"}


def _state(same: Column) -> Column:
    return F.when(same, F.lit("COMMON")).otherwise(F.lit("DIFFER"))


#: The columns behind each field; only those of fields that are compared are read and shuffled.
COLUMNS = {
    "EXIST": (), "TYPE": ("mode", "type"), "SIZE": ("size", "type"), "UID": ("uid",), "GID": ("gid",), "PERM": ("mode",), "ACL": (),
    "CONTENT": ("mode", "type", "size", "mtime", "mtime_nsec"), **{f: (c, f"{c}_nsec") for f, c in TIMES.items()},
}


def columns_for(fields: Iterable[str], *extra: str | None) -> list[str]:
    """``name``, ``type``, what the fields need, and the extra columns."""
    return list(dict.fromkeys(["name", "type", *[c for f in exprs.FIELDS if f in set(fields) for c in COLUMNS[f]], *[c for c in extra if c]]))


def sides(src: DataFrame, dst: DataFrame, src_root: str, dst_root: str, columns: list[str] | None = None) -> DataFrame:
    """The full outer join of two trees: ``rel`` and the structs ``s`` and ``d`` (null where missing).

    The root itself has an empty ``rel``; rows outside their root are left out. The structs hold
    all columns, or the given ones.
    """
    s = src.select(strip_root("name", src_root).alias("rel"), F.struct(*(columns or src.columns)).alias("s")).filter("rel is not null")
    d = dst.select(strip_root("name", dst_root).alias("rel"), F.struct(*(columns or dst.columns)).alias("d")).filter("rel is not null")
    return s.join(d, "rel", "full_outer")


def states(joined: DataFrame, fields: Iterable[str] = exprs.FIELDS, *, lite: bool = True, content: str | None = None, target: str | None = None, acl: str | None = None, nanoseconds: bool = True) -> DataFrame:
    """One state column for each field: COMMON, DIFFER, or null where it wasn't compared.

    EXIST is COMMON, ONLY_SRC or ONLY_DEST. Other fields are compared for common items only:
    the type by the type bits; where it differs so does the content. Items neither regular nor
    links have common content; links are compared by their whole ``target`` column; regular
    items of other size differ; of the same size they are compared by mtime and nanosecond
    (``lite``), else by the column ``content``, or by the column ``unlike`` of :func:`with_unlike`
    if the join has one. The size of directories is always common.
    Only the fields asked for, and what they need, are computed.
    """
    fields = set(fields)
    s, d = F.col("s"), F.col("d")
    common = s.isNotNull() & d.isNotNull()
    same = lambda c: s[c].eqNullSafe(d[c])
    kind = lambda t: t["mode"].bitwiseAND(F.lit(TYPE_MASK))
    time = lambda c: same(c) & same(f"{c}_nsec") if nanoseconds else same(c)
    type_same = F.when(s["mode"].isNull() | d["mode"].isNull(), same("type")).otherwise(kind(s) == kind(d))
    size_same = (s["type"] == "DIR") & (d["type"] == "DIR") | same("size")
    out: dict[str, Column] = {
        "EXIST": F.when(common, F.lit("COMMON")).when(d.isNull(), F.lit("ONLY_SRC")).otherwise(F.lit("ONLY_DEST"))
    }
    tests = {"SIZE": size_same, "UID": same("uid"), "GID": same("gid"), "PERM": perm(s["mode"]).eqNullSafe(perm(d["mode"]))}
    tests |= {f: time(c) for f, c in TIMES.items()}
    if acl:
        tests["ACL"] = same(acl)
    for f, test in tests.items():
        if f in fields:
            out[f] = F.when(common, _state(test))
    if fields & {"TYPE", "CONTENT"}:
        out["TYPE"] = F.when(common, _state(type_same))
    if "CONTENT" in fields:
        by_bytes = F.col("unlike").isNull() if "unlike" in joined.columns else time("mtime") if lite or content is None else same(content)
        link = same(target) if target else time("mtime")
        regular, is_link = s["type"] == "FILE", s["type"] == "LINK"
        equal = type_same & F.when(is_link, link).when(regular, same("size") & by_bytes).otherwise(F.lit(True))
        out["CONTENT"] = F.when(common, _state(equal))
    return joined.select("rel", "s", "d", *[out.get(f, F.lit(None).cast("string")).alias(f) for f in exprs.FIELDS])


def file_pairs(joined: DataFrame) -> DataFrame:
    """``rel``, ``a``, ``b``, ``size`` of regular files on both sides of the same size, the only ones whose bytes need reading."""
    both = joined.filter("s.type = 'FILE' and d.type = 'FILE' and s.size = d.size and s.size > 0")
    return both.select("rel", F.col("s.name").alias("a"), F.col("d.name").alias("b"), F.col("s.size").alias("size"))


def with_unlike(joined: DataFrame, unlike: DataFrame | None) -> DataFrame:
    """A join with the mark ``unlike`` at paths of which a section differs (``rel`` of :func:`treeline.operators.chunks.unlike_sections`)."""
    return joined if unlike is None else joined.join(unlike.select("rel").distinct().withColumn("unlike", F.lit(True)), "rel", "left")


def compare(src: DataFrame, dst: DataFrame, src_root: str, dst_root: str, expressions: Iterable[str] = DEFAULT_OUTPUTS, *, unlike: DataFrame | None = None, **options) -> DataFrame:
    """States of every path of either tree; only fields that the expressions need are compared.

    ``unlike`` names the paths whose bytes were found to differ; without it contents of files
    are compared by time or by a column, as :func:`states` tells.
    """
    need = set().union(*[exprs.needed(exprs.parse(e)) for e in expressions])
    columns = columns_for(need, *(options.get(k) for k in ("content", "target", "acl")))
    return states(with_unlike(sides(src, dst, src_root, dst_root, columns), unlike), need, **options)


def matching(compared: DataFrame, expression: str) -> DataFrame:
    """``side``, ``clause``, ``rel`` and the entry of rows of **both** trees that match; the first clause that holds counts."""
    hit = compared.withColumn("clause", exprs.first_clause(exprs.parse(expression))).filter("clause is not null")
    rows = F.array_compact(F.array(
        F.when(F.col("s").isNotNull(), F.struct(F.lit("src").alias("side"), F.col("s.name").alias("name"))),
        F.when(F.col("d").isNotNull(), F.struct(F.lit("dest").alias("side"), F.col("d.name").alias("name"))),
    ))
    return hit.select("rel", "clause", F.explode(rows).alias("r")).select("r.side", "clause", "rel", "r.name")


def counts(compared: DataFrame, expressions: Iterable[str]) -> DataFrame:
    """``output``, ``clause``, ``n_src``, ``n_dest`` for each clause of each expression, from one pass."""
    parsed = [(e, exprs.parse(e)) for e in expressions]
    hits = F.array_compact(F.array(*[
        F.when(exprs.first_clause(c).isNotNull(), F.struct(F.lit(i).alias("i"), exprs.first_clause(c).alias("clause"))) for i, (_, c) in enumerate(parsed)
    ]))
    found = compared.select("s", "d", F.explode(hits).alias("h")).groupBy("h.i", "h.clause").agg(
        F.count(F.when(F.col("s").isNotNull(), 1)).alias("n_src"), F.count(F.when(F.col("d").isNotNull(), 1)).alias("n_dest")
    )
    rows = [(i, e, k) for i, (e, c) in enumerate(parsed) for k in range(1, len(c) + 1)]
    every = compared.sparkSession.createDataFrame(rows, "i int, output string, clause int")
    return F.broadcast(every).join(found, ["i", "clause"], "left").fillna(0).select("output", "clause", "n_src", "n_dest")


def show_counts(n_src: Column, n_dest: Column) -> Column:
    """One number if both sides agree, else ``N/A (Src: a Dest: b)``."""
    return F.when(n_src == n_dest, n_src.cast("string")).otherwise(F.format_string("N/A (Src: %d Dest: %d)", n_src, n_dest))


def content_by_chunks(src_chunks: DataFrame, dst_chunks: DataFrame) -> DataFrame:
    """``rel``, ``differs``: whether any chunk (``rel``, ``offset``, ``digest``) differs or is missing on a side."""
    a, b = src_chunks.select("rel", "offset", F.col("digest").alias("x")), dst_chunks.select("rel", "offset", F.col("digest").alias("y"))
    pair = a.join(b, ["rel", "offset"], "full_outer")
    return pair.groupBy("rel").agg(F.bool_or(~F.col("x").eqNullSafe(F.col("y"))).alias("differs"))
