"""Path arithmetic as Column expressions. Paths are compared byte for byte."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(name: Column | str) -> Column:
    """What follows the last slash; the whole name when it has none."""
    return F.substring_index(_col(name), "/", -1)


def dirname(name: Column | str) -> Column:
    """What precedes the last slash, without it; empty when there is no slash or only a leading one."""
    name = _col(name)
    return F.substr(name, F.lit(1), F.greatest(F.length(name) - F.length(basename(name)) - 1, F.lit(0)))


def depth(name: Column | str) -> Column:
    """Number of slashes."""
    name = _col(name)
    return (F.length(name) - F.length(F.replace(name, F.lit("/"), F.lit("")))).cast("int")


def components(name: Column | str) -> Column:
    """The parts between slashes; the first is empty for an absolute path."""
    return F.split(_col(name), "/", -1)


def component(name: Column | str, k: int) -> Column:
    """Part ``k`` counted from 0, null when there is none; negative ``k`` counts from the end."""
    return F.get(components(name), F.lit(k)) if k >= 0 else F.try_element_at(components(name), F.lit(k))


def n_components(name: Column | str) -> Column:
    """Number of parts, without the empty one before a leading slash."""
    return F.size(F.filter(components(name), lambda x: x != ""))


def slice_path(name: Column | str, start: int, count: int | None = None) -> Column:
    """Parts ``start`` up to ``start + count`` joined again; negative starts count from the end."""
    parts = F.filter(components(name), lambda x: x != "")
    n = F.size(parts)
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    size = F.greatest(n - first, F.lit(0)) if count is None else F.lit(count)
    return F.array_join(F.slice(parts, first + 1, size), "/")


def cut_path(name: Column | str, at: int) -> tuple[Column, Column]:
    """The path before part ``at`` and from it on."""
    return slice_path(name, 0, at), slice_path(name, at)


def insert(name: Column | str, at: int, text: str) -> Column:
    """The path with the parts of ``text`` put in before part ``at`` (0 prepends, negative appends)."""
    parts = F.filter(components(name), lambda x: x != "")
    new = F.array(*[F.lit(x) for x in text.split("/") if x])
    at_ = F.size(parts) if at < 0 else F.lit(at)
    lead = F.when(_col(name).startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(lead, F.array_join(F.concat(F.slice(parts, F.lit(1), at_), new, F.slice(parts, at_ + 1, F.size(parts) + 1)), "/"))


def join(folder: Column | str, item: Column | str) -> Column:
    """``folder`` and ``item`` with exactly one slash between."""
    folder = _col(folder)
    return F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), _col(item))


def is_absolute(name: Column | str) -> Column:
    return _col(name).startswith("/")


def below(name: Column | str, root: str, inclusive: bool = False) -> Column:
    """Whether ``name`` lies strictly below ``root`` by whole components (``/a/b`` isn't above ``/a/bc``)."""
    name, root = _col(name), root.rstrip("/")
    inside = name.startswith(root + "/") & (name != root + "/")
    return inside | (name == (root or "/")) if inclusive else inside


def relation(name: Column | str, other: Column | str) -> Column:
    """EQUAL, CHILD (``name`` below ``other``), PARENT or DIFF; both are reduced paths."""
    a, b = _col(name), _col(other)
    under = lambda x, y: F.when(y == "/", (x != "/") & x.startswith("/")).otherwise(F.startswith(x, F.concat(y, F.lit("/"))))
    return F.when(a == b, F.lit("EQUAL")).when(under(a, b), F.lit("CHILD")).when(under(b, a), F.lit("PARENT")).otherwise(F.lit("DIFF"))


def strip_root(name: Column | str, root: str) -> Column:
    """``name`` without a leading ``root``; it starts with a slash, and is empty for the root itself.

    Names outside the root give null.
    """
    name, root = _col(name), root.rstrip("/")
    return F.when((name == root) | name.startswith(root + "/"), F.substr(name, F.lit(len(root) + 1)))


def move_root(name: Column | str, roots: list[tuple[str, str]]) -> Column:
    """Names below one of the source roots moved below its target; the first root that holds wins, else null."""
    out = F.lit(None).cast("string")
    for old, new in reversed(roots):
        out = F.when(below(name, old, inclusive=True), F.concat(F.lit(new.rstrip("/")), strip_root(name, old))).otherwise(out)
    return out


def reduce_text(path: str, absolute: bool = False) -> str:
    """A path without empty and ``.`` parts, with ``..`` resolved.

    ``..`` vanishes at the root, and stays at the front of a relative path.
    """
    if absolute and not path.startswith("/"):
        path = "/" + path
    rooted, kept = path.startswith("/"), []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part != "..":
            kept.append(part)
        elif kept and kept[-1] != "..":
            kept.pop()
        elif not rooted:
            kept.append(part)
    return "/" * rooted + "/".join(kept) or ("/" if rooted else ".")


def reduce(name: Column | str) -> Column:
    """Column form of :func:`reduce_text`: one fold over the parts, inside the JVM."""
    name = _col(name)
    rooted = name.startswith("/")
    parts = F.filter(components(name), lambda x: (x != "") & (x != "."))

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        removable = last.isNotNull() & (last != "..")
        return (
            F.when(part != "..", F.concat(acc, F.array(part)))
            .when(removable, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    body = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def relative_text(path: str, start: str) -> str:
    """``path`` as seen from the folder ``start``; both absolute."""
    return posixpath.relpath(reduce_text(path), reduce_text(start))


def relative(name: Column | str, start: Column | str) -> Column:
    """Column form of :func:`relative_text` for absolute reduced paths."""
    a = F.filter(components(name), lambda x: x != "")
    b = F.filter(components(start), lambda x: x != "")
    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    differs = F.transform(both, lambda p, i: F.when(p["x"].eqNullSafe(p["y"]), F.lit(None)).otherwise(i))
    common = F.coalesce(F.array_min(differs), F.size(both))
    common = F.least(common, F.size(a), F.size(b))
    up = F.array_repeat(F.lit(".."), F.size(b) - common)
    out = F.array_join(F.concat(up, F.slice(a, common + 1, F.size(a) + 1)), "/")
    return F.when(out == "", F.lit(".")).otherwise(out)
