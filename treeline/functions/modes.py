"""The algebra of permission changes: ``755``, ``u+rwX,g-w``, ``g=u``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.scalars import PERM_MASK, TYPE_MASK

# How far the bits of user, group and other stand to the left.
SHIFT = {"u": 6, "g": 3, "o": 0}
BIT = {"r": 4, "w": 2, "x": 1}


@dataclass(frozen=True)
class Clause:
    who: str  # of "ugo"
    op: str  # "+", "-" or "="
    perms: str  # of "rwxX"; for "=", the source of "ugo"
    masked: bool  # nobody was named, so the umask holds some bits


def parse_mode(text: str) -> int | list[Clause]:
    """Up to four octal digits, or clauses separated by commas. Raises ValueError."""
    if re.fullmatch(r"[0-7]{1,4}", text):
        return int(text, 8)
    clauses = []
    for part in text.split(","):
        m = re.fullmatch(r"([ugoa]*)(?:([+-])([rwxX]+)|(=)([ugo]))", part)
        if not m:
            raise ValueError(f"not a mode: {text!r}")
        who = "ugo" if not m[1] or "a" in m[1] else "".join(w for w in "ugo" if w in m[1])
        clauses.append(Clause(who, m[2] or m[4], m[3] or m[5], not m[1]))
    return clauses


def new_mode(mode: Column, kind: Column, change: str, umask: int = 0o022) -> Column:
    """``mode`` after ``change``; its type bits stay. ``kind`` is the item's type (DIR counts for X).

    ``u+X`` and ``u-X`` touch directories only; ``g+X`` and ``o+X`` need a directory or the
    user's x; ``g-X`` and ``o-X`` always clear. ``g=u`` copies r, w and x. Without u, g, o or a,
    + and - leave the bits of the umask as they were.
    """
    parsed = parse_mode(change)
    if isinstance(parsed, int):
        return mode.bitwiseAND(F.lit(TYPE_MASK)).bitwiseOR(F.lit(parsed)).cast("long")
    is_dir, out = kind == "DIR", mode.cast("long")
    on = lambda m, b: m.bitwiseOR(F.lit(b).cast("long"))
    off = lambda m, b: m.bitwiseAND(F.lit(~b).cast("long"))
    for c in parsed:
        before = out
        if c.op == "=":
            bits = F.shiftright(before, SHIFT[c.perms]).bitwiseAND(F.lit(7).cast("long"))
            for w in c.who:
                out = off(out, 7 << SHIFT[w]).bitwiseOR(F.shiftleft(bits, SHIFT[w]))
            continue
        for w in c.who:
            plain = sum(BIT[p] for p in set(c.perms) - {"X"}) << SHIFT[w]
            out = on(out, plain) if c.op == "+" else off(out, plain)
            if "X" in c.perms:
                x = 1 << SHIFT[w]
                when = is_dir if w == "u" else F.lit(True) if c.op == "-" else is_dir | (out.bitwiseAND(F.lit(0o100)) != 0)
                out = F.when(when, on(out, x) if c.op == "+" else off(out, x)).otherwise(out)
        if c.masked:
            out = off(out, umask).bitwiseOR(before.bitwiseAND(F.lit(umask).cast("long")))
    return out.bitwiseAND(F.lit(TYPE_MASK | PERM_MASK).cast("long"))


def opens_directories(change: str) -> bool:
    """Whether a change gives the user r and x, so that directories must be changed before they can be listed."""
    parsed = parse_mode(change)
    if isinstance(parsed, int):
        return parsed & 0o500 == 0o500
    given = {p.lower() for c in parsed if c.op == "+" and "u" in c.who for p in c.perms}
    return {"r", "x"} <= given
