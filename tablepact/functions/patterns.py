"""Contract regex patterns: validity and Python -> Java dialect.

Patterns are contract metadata (a handful per contract), so checking them on
the driver is bounded work.  A pattern that does not compile must never reach
an executor: Spark raises on an invalid regex instead of returning null.  A
pattern is usable if Python accepts it and Spark accepts what it is translated to.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tablepact.functions.values import lit

_NAME = re.compile(r"\(\?P(<|=)(\w+)(>|\))")
_OPEN_REPEAT = re.compile(r"\{,([0-9]+)\}")


def to_java(pattern: str) -> str:
    """Full-match Java regex equivalent to ``re.fullmatch(pattern, text)``.

    ``(?U)`` makes ``\\w \\d \\s`` Unicode-aware as in Python 3, ``(?d)`` lets
    ``.`` exclude and ``$`` see only the line feed; ``\\A..\\z`` anchors the whole input.
    """
    out: list[str] = []
    names: dict[str, str] = {}
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(_escape(pattern[i : i + 2], pattern[i + 2 : i + 10], in_class))
            i += 10 if pattern[i + 1 : i + 2] == "U" else 2
        elif in_class:
            first = out[-1] in ("[", "[^")
            if c == "]" and not first:
                in_class = False
                out.append(c)
            else:
                out.append("\\" + c if c in "[]&" else c)  # no nested classes or intersections in Python
            i += 1
        elif c == "[":
            in_class = True
            out.append("[^" if pattern[i + 1 : i + 2] == "^" else "[")
            i += len(out[-1])
        elif m := _NAME.match(pattern, i):
            name = names.setdefault(m[2], f"g{len(names)}")  # Java's names are letters and digits
            out.append(f"(?<{name}>" if m[1] == "<" else f"\\k<{name}>")
            i = m.end()
        elif m := _OPEN_REPEAT.match(pattern, i):
            out.append(f"{{0,{m[1]}}}")
            i = m.end()
        else:
            out.append(c)
            i += 1
    return r"(?Ud)\A(?:" + "".join(out) + r")\z"


def _escape(pair: str, rest: str, in_class: bool) -> str:
    """Java's form of an escape that Python reads differently."""
    match pair:
        case "\\Z":
            return r"\z"
        case "\\v":
            return r"\x0B"
        case "\\U":
            return rf"\x{{{rest}}}"
        case "\\b" if in_class:
            return r"\x08"
        case "\\0" if not rest[:1].isdigit():
            return r"\x00"
    return pair


def pattern_errors(spark: SparkSession, patterns: Sequence[str]) -> dict[str, str | None]:
    """Per pattern the text of its error, None when it is usable."""
    errors: dict[str, str | None] = {}
    for p in dict.fromkeys(patterns):
        try:
            re.compile(p)
            errors[p] = None
        except re.error as exc:
            errors[p] = str(exc)
    usable = [p for p, e in errors.items() if e is None]
    if usable and _spark_error(spark, usable) is not None:
        for p in usable:
            errors[p] = _spark_error(spark, [p])
    return errors


def _spark_error(spark: SparkSession, patterns: Sequence[str]) -> str | None:
    """Let Spark fold the matches of an empty text: no data, no job."""
    try:
        spark.sql("SELECT " + ", ".join(f"'' RLIKE {lit(to_java(p))}" for p in patterns)).collect()
    except PySparkException as exc:
        return str(exc).split("\n")[0]
    return None


def full_match(text: str, pattern: str) -> str:
    """SQL text: ``text`` fully matches the contract pattern."""
    return f"({text} RLIKE {lit(to_java(pattern))})"
