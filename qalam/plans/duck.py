"""Helpers that spell the same checks in DuckDB SQL (RE2 regex, no lookaround).

Used only to build oracle strings; the Spark side never reads these.
"""

from __future__ import annotations

from qalam.plans import patterns as p


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + p.S + '+|' + p.S + '+' + chr(92) + 'z')}, '', 'g')"


def sub(x: str, pattern: str, repl: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({strip(x)}, {q(p.S + '+')}), lambda t: t <> '')"


def share(toks: str, pred_on_t: str) -> str:
    return (f"CASE WHEN len({toks}) = 0 THEN 0.0 ELSE "
            f"len(list_filter({toks}, lambda t: {pred_on_t})) / len({toks}) END")


def py_word_ascii(x: str) -> str:
    """Map non-ASCII letters and numbers to '_' so RE2's ASCII ``\\b`` equals
    Python's Unicode ``\\b`` for patterns that only match ASCII characters."""
    return sub(sub(x, "[^\\x00-\\x7F\\PL]", "_"), "[^\\x00-\\x7F\\PN]", "_")
