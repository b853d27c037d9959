"""Python-compatible string primitives as Spark Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qalam.functions.regex import NOT_S, S

# Python's whitespace characters, spelled out for ``trim(BOTH chars FROM s)``.
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                  + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: removes Python whitespace at both ends.

    ``trim`` with an explicit character set: linear, no regex (a regex
    ``\\s+$`` is quadratic on long whitespace runs)."""
    return F.trim(col_(c), F.lit(PY_SPACE_CHARS))


def py_split(c: Column | str) -> Column:
    """``str.split()`` with no argument: whitespace runs, no empty tokens.

    After the strip, only an empty string yields an empty token, so one
    ``when`` replaces a per-token filter."""
    s = py_strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{S}+"))


def py_splitlines_pattern() -> str:
    """Line separators of ``str.splitlines()``."""
    return "\\r\\n|[\\n\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"


NON_SPACE = NOT_S
