"""Glob patterns as regular expressions, made on the driver so that plans only hold constants."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column

WILDCARDS = "*?[{"


def has_wildcard(pattern: str) -> bool:
    return any(c in pattern for c in WILDCARDS)


def normalize_path(path: str) -> str:
    """Forward slashes, no ``.`` segments, ``..`` resolved, no leading ``./`` and no trailing slash."""
    out: list[str] = []
    path = path.strip().replace("\\", "/")
    for part in path.split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(out)


def to_regex(pattern: str, dialect: str = "path") -> str:
    """An anchored regular expression.

    path: ``*`` stays within a segment, ``**`` crosses, ``{a,b}`` are choices. flat: the same, but ``*`` crosses
    too. segment: only ``*``, ``?`` and classes, within a segment. star: ``*`` alone is special.
    """
    if dialect == "star":
        return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"
    one = "." if dialect == "flat" else "[^/]"
    braces = dialect != "segment"
    out, i, depth = ["^"], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            double = pattern[i : i + 2] == "**" and dialect != "segment"
            out.append(".*" if double or dialect == "flat" else "[^/]*")
            i += 1 + double
            continue
        if c == "?":
            out.append(one)
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 2) if "]" in pattern[i + 2 :] else pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] in ("!", "^") else body).replace("\\", "\\\\").replace("&&", "&\\&") + "]")
            i = end
        elif c == "{" and braces:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + "$"


def fits(regex: str) -> Callable[[Column], Column]:
    """A test of one column, for functions over arrays; a lambda's default would count as a second argument there."""
    return lambda value: value.rlike(regex)
