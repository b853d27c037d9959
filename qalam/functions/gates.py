"""Row gates G1–G10 as boolean Column expressions (True = the row is dropped)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qalam.functions import clean as cl
from qalam.functions import regex as rx
from qalam.functions.text import PY_SPACE_CHARS, py_strip

PLACEHOLDER = (f"(?i)^{rx.S}*\\[?(?:deleted|removed|AutoModerator)\\]?{rx.S}*\\z")
EMOJI_ONLY = (f"^[{rx.SPACE_BODY}{rx.body(*rx.HEARTS)}{rx.body(*rx.EMOJI_COMMENT)}]+\\z")
# Reference: ^\s*[\d\s.,\-+()\u0660-\u0669]+\s*$ ; whitespace is in the class,
# so the outer \s* are redundant and dropping them avoids backtracking.
NUMBERS_ONLY_FORUM = (f"^[{rx.D}{rx.SPACE_BODY}\\.,\\-\\+\\(\\)"
                      f"{rx.body(*rx.ARABIC_INDIC_DIGITS)}]+\\z")
NOT_NUMBER_CHAR_COMMENT = f"[^{rx.D}{rx.SPACE_BODY}.,\\-+\\(\\){rx.body(*rx.DIACRITICS)}]"


def is_blank(c: Column) -> Column:
    """G1: null or only whitespace."""
    return c.isNull() | (py_strip(c) == "")


def is_placeholder(c: Column) -> Column:
    """Forum placeholders such as ``[deleted]``."""
    return c.rlike(PLACEHOLDER)


def is_emoji_only(c: Column) -> Column:
    """Only whitespace, hearts and emoji (judged on the stripped raw text)."""
    return py_strip(c).rlike(EMOJI_ONLY)


def _share(c: Column, token: str) -> Column:
    """Tokens that match over all tokens; 0 for no tokens.  Neither is listed, only counted."""
    n = F.length(F.regexp_replace(F.regexp_replace(c, cl.TOKEN, "x"), f"{rx.S}++", ""))
    return cl.count_matches(c, token) / F.greatest(n, F.lit(1))


def token_shape(c: Column) -> Column:
    """The text with every token of two or more characters as one ``0``: a short string
    from which tokens and single characters are counted."""
    return F.regexp_replace(c, f"{rx.NOT_S}{{2,}}+", "0")


def is_spaced_words(c: Column) -> Column:
    """G5 on a text whose white space is spaces only."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    n = F.size(words)
    singles = F.size(F.filter(words, lambda w: (F.length(w) == 1) & w.rlike(cl.SINGLE_ARABIC)))
    return (n >= 6) & (singles * 2 > n)


def is_spaced_shape(shape: Column) -> Column:
    """G5 on a ``token_shape``."""
    n = F.length(F.regexp_replace(shape, f"{rx.S}++", ""))
    singles = F.length(shape) - F.length(F.regexp_replace(shape, cl.SINGLE_ARABIC, ""))
    return (n >= 6) & (singles * 2 > n)


def foreign_share(c: Column) -> Column:
    """G4 measure: share of tokens with a foreign-script char and no Arabic char."""
    words = F.filter(F.split(F.translate(c, PY_SPACE_CHARS, " " * len(PY_SPACE_CHARS)), " "), lambda w: w != "")
    # most words hold an Arabic character, most often the first one: asked first
    found = F.filter(words, lambda w: ~w.rlike(cl.ARABIC_BLOCK) & w.rlike(cl.FOREIGN))
    return F.when(c.isNotNull(), F.size(found) / F.greatest(F.size(words), F.lit(1)))


def is_spaced_arabic(c: Column) -> Column:
    """At least 6 tokens and more than half are single Arabic letters."""
    return is_spaced_shape(token_shape(c))


def has_no_arabic(c: Column) -> Column:
    """No character of the Arabic blocks left."""
    return ~c.rlike(cl.ARABIC_BLOCK)


def arabic_share(c: Column, arabic_token: str) -> Column:
    """G7 measure: share of tokens containing an Arabic character (``clean.ARABIC_*_TOKEN``)."""
    return _share(c, arabic_token)


def is_too_short(c: Column, min_chars: int) -> Column:
    """Fewer than ``min_chars`` code points."""
    return F.length(c) < min_chars


def is_numbers_only_forum(c: Column) -> Column:
    """G9 (forum): digits, whitespace and . , - + ( ) and Arabic-Indic digits only."""
    return py_strip(c).rlike(NUMBERS_ONLY_FORUM)


def is_numbers_only_comment(c: Column) -> Column:
    """G9 (comment): no character outside digits, whitespace, . , - + ( ) and harakat."""
    return ~py_strip(c).rlike(NOT_NUMBER_CHAR_COMMENT)


def web_arabic_share(c: Column) -> Column:
    """G10 measure: Arabic chars over non-space chars (denominator at least 1)."""
    arabic = F.length(c) - F.length(F.regexp_replace(c, f"{cl.WEB_ARABIC}+", ""))
    return arabic / F.greatest(
        F.length(F.regexp_replace(c, " ", "")), F.lit(1))
