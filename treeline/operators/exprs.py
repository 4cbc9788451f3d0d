"""Boolean expressions over comparison states: ``EXIST=COMMON@TYPE=DIFFER,EXIST=ONLY_SRC``.

A comma is OR, ``@`` is AND and binds tighter; empty terms are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("EXIST", "TYPE", "SIZE", "UID", "GID", "ATIME", "MTIME", "CTIME", "PERM", "ACL", "CONTENT")
STATES = ("COMMON", "DIFFER", "ONLY_SRC", "ONLY_DEST")
#: What must be compared to know a field.
NEEDS = {"CONTENT": ("EXIST", "TYPE", "SIZE", "CONTENT"), "EXIST": ("EXIST",)}


@dataclass(frozen=True)
class Term:
    field: str
    state: str

    def holds(self) -> Column:
        c = F.col(self.field)
        if self.field == "EXIST" and self.state == "DIFFER":
            return c.isin("ONLY_SRC", "ONLY_DEST")
        return F.coalesce(c == self.state, F.lit(False))


Clause = tuple[Term, ...]


def parse(text: str) -> tuple[Clause, ...]:
    """The clauses of an expression. Raises ValueError for an unknown field or state, or a state the field can't have."""
    clauses = []
    for part in text.split(","):
        terms = []
        for t in part.split("@"):
            if not t:
                continue
            field, eq, state = t.partition("=")
            if not eq or field not in FIELDS or state not in STATES:
                raise ValueError(f"not a term: {t!r}")
            if state.startswith("ONLY_") and field != "EXIST":
                raise ValueError(f"{state} is a state of EXIST only")
            terms.append(Term(field, state))
        if terms:
            clauses.append(tuple(terms))
    if not clauses:
        raise ValueError("the expression is empty")
    return tuple(clauses)


def parse_output(text: str) -> tuple[tuple[Clause, ...], str | None]:
    """``EXPR:FILE``: the clauses, and the file (None without one)."""
    expr, _, file = text.partition(":")
    return parse(expr), file or None


def needed(clauses: tuple[Clause, ...]) -> set[str]:
    """Fields that must be compared for these clauses."""
    return {f for c in clauses for t in c for f in NEEDS.get(t.field, ("EXIST", t.field))}


def clause_holds(clause: Clause) -> Column:
    out = F.lit(True)
    for t in clause:
        out &= t.holds()
    return out


def first_clause(clauses: tuple[Clause, ...]) -> Column:
    """The number, from 1, of the first clause that holds; null if none does."""
    out = F.when(clause_holds(clauses[0]), F.lit(1))
    for i, c in enumerate(clauses[1:], 2):
        out = out.when(clause_holds(c), F.lit(i))
    return out
