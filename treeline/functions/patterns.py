"""Shell globs and POSIX basic regular expressions, translated for the JVM's engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.paths import basename

# POSIX classes and what the JVM calls them.
CLASSES = {
    "alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "\\p{Digit}", "graph": "\\p{Graph}",
    "lower": "\\p{Lower}", "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\p{Space}", "upper": "\\p{Upper}", "xdigit": "\\p{XDigit}",
}
_SPECIAL = set("\\^$.|?*+()[]{}&-~#")


def _quote(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _bracket(text: str, at: int, negators: str, escapes: bool) -> tuple[str, int] | None:
    """The JVM's form of the bracket expression that opens at ``at``, and the place after it; None if it never closes."""
    i, out = at + 1, "["
    if i < len(text) and text[i] in negators:
        out, i = "[^", i + 1
    first = True
    while i < len(text):
        c = text[i]
        if c == "]" and not first:
            return out + "]", i + 1
        if text.startswith("[:", i) and (end := text.find(":]", i + 2)) > 0 and text[i + 2 : end] in CLASSES:
            out, i = out + CLASSES[text[i + 2 : end]], end + 2
        else:
            if escapes and c == "\\" and i + 1 < len(text):
                i += 1
                c = text[i]
            between = c == "-" and not first and i + 1 < len(text) and text[i + 1] != "]"
            out, i = out + ("-" if between else _quote(c)), i + 1
        first = False
    return None


def glob_regex(glob: str) -> str:
    """A regex that matches what a shell glob matches, as a whole.

    ``*`` and ``?`` cross slashes; a leading dot must be matched by a dot; a backslash quotes;
    a bracket that never closes is an ordinary character.
    """
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += _quote(glob[i])
        elif c == "[" and (b := _bracket(glob, i, "!^", True)):
            out, i = out + b[0], b[1] - 1
        else:
            out += _quote(c)
        i += 1
    hidden = "(?!\\.)" if glob[:1] in ("*", "?", "[") else ""
    return f"(?s)\\A{hidden}{out}\\z"


def basic_regex(pattern: str) -> str:
    """A POSIX basic regular expression in the JVM's syntax, for an unanchored search.

    Plain ``+ ? | ( ) { }`` are ordinary characters and act when they follow a backslash; ``*``
    is ordinary where nothing precedes it; ``^`` and ``$`` are anchors at the ends of the
    expression or of a group only. Raises ValueError for an unclosed bracket, group or count.
    """
    out, i, opened = "", 0, 0
    start = True  # nothing to repeat before this place
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            if len(two) < 2:
                raise ValueError("a backslash ends the expression")
            d, i = two[1], i + 2
            if d == "(":
                out, opened, start = out + "(", opened + 1, True
                continue
            if d == ")":
                if not opened:
                    raise ValueError("a group closes that never opened")
                out, opened = out + ")", opened - 1
            elif d == "{":
                end = pattern.find("\\}", i)
                if end < 0 or not re.fullmatch(r"\d+(,\d*)?|,\d+", pattern[i:end]):
                    raise ValueError("a count isn't closed or isn't a count")
                count = pattern[i:end]
                out, i = out + "{" + ("0" + count if count[0] == "," else count) + "}", end + 2
            elif d == "|":
                out, start = out + "|", True
                continue
            elif d in "+?":
                out += d if not start else "\\" + d
            elif d in "123456789wWsSbB":
                out += "\\" + d
            elif d in "<>":
                out += "\\b"
            else:
                out += _quote(d)
            start = False
            continue
        i += 1
        if c == "*":
            out += "\\*" if start else "*"
            start = False
        elif c == "^" and start:
            out += "\\A"
            continue
        elif c == "$" and (i == len(pattern) or pattern[i : i + 2] in ("\\)", "\\|")):
            out += "\\z"
        elif c == ".":
            out, start = out + ".", False
        elif c == "[":
            b = _bracket(pattern, i - 1, "^", False)
            if b is None:
                raise ValueError("a bracket isn't closed")
            out, i, start = out + b[0], b[1], False
        else:
            out, start = out + _quote(c), False
    if opened:
        raise ValueError("a group isn't closed")
    return f"(?s){out}"


def wildcard_regex(text: str) -> str:
    """``*`` matches anything, all else stands for itself; anchored at both ends."""
    return "(?s)\\A" + ".*".join("".join(map(_quote, part)) for part in text.split("*")) + "\\z"


def matches_glob(c: Column, glob: str) -> Column:
    return c.rlike(glob_regex(glob))


def matches_basic(name: Column | str, pattern: str, *, only_basename: bool = False) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return (basename(name) if only_basename else name).rlike(basic_regex(pattern))
