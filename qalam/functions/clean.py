"""Cleaning profiles (C1–C20) as chains of Column expressions.

Each profile is a flat list of ``(name, Column -> Column, taps)`` stages.
``qalam.operators.cleaning`` applies them as successive projections, so an
intermediate string that is both counted and rewritten, or guarded, is
computed once (Catalyst does not collapse a projection whose non-cheap
expression is used twice), and the chain stays in one whole-stage-codegen
span.  ``clean_forum_text`` / ``clean_comment_text`` give the same rewrite as
one nested Column expression for ad-hoc use.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from qalam.functions import regex as rx
from qalam.functions.text import py_strip

# --- Fixed values: patterns of the profiles (Java syntax, Python semantics) ---
# Repeated groups are possessive: Java runs them as a loop, other groups of varying
# length by recursion, which a long text turns into a stack overflow.

URL = f"(?i)https?://{rx.NOT_S}+|www\\.{rx.NOT_S}+"
MENTION = f"@{rx.W}+"
FORUM_REF = f"r/{rx.W}+|u/{rx.W}+"
HASHTAG = f"#{rx.W}+"
HTML_ENTITY = f"(?i)&{rx.S}*#?{rx.S}*[a-zA-Z0-9][{rx.SPACE_BODY}a-zA-Z0-9]*{rx.S}*;"
HTML_TAG = "<[^>]+>"
# before a letter or digit a word boundary is simply "no word character before"
ENGLISH_WORD = f"(?<!{rx.W})[A-Za-z][A-Za-z0-9'-]*{rx.B}"
CLOCK_TIME = f"(?<!{rx.W}){rx.D}{{1,2}}:{rx.D}{{2}}(?::{rx.D}{{2}})?(?!{rx.W})"
DIVIDER = "(?:[-_=*~#][ \\t]*+){3,}+"
NEWLINE_RUN = f"{rx.S}*\\n{rx.S}*"
# Same matches as NEWLINE_RUN (a whitespace run that holds a newline, whole),
# but tried only at run starts: linear instead of quadratic on long runs.
NEWLINE_RUN_LINEAR = f"(?<!{rx.S})(?=[{rx.SPACE_BODY}&&[^\\n]]*+\\n){rx.S}++"

QURANIC = rx.within("\\x{0}-\\x{5FF}\\x{61B}-\\x{66F}", rx.body(*rx.QURANIC))
BIDI = rx.cls(*rx.BIDI_CONTROLS)
EMOJI_FORUM = rx.cls(*rx.EMOJI_FORUM) + "+"
EMOJI_COMMENT = rx.cls(*rx.EMOJI_COMMENT) + "+"

_A3 = rx.body("0600-06FF", "0750-077F", "08A0-08FF")
SPACED_PUNCT_FORUM = f"(?:[^\\p{{L}}\\p{{N}}_{rx.SPACE_BODY}{rx.body('0600-06FF')}][ \\t]*+){{3,}}+"
SPACED_PUNCT_COMMENT = f"(?:[^\\p{{L}}\\p{{N}}_{rx.SPACE_BODY}{_A3}][ \\t]*+){{3,}}+"
SPACED_ARABIC_SPAN = f"(?:(?:[{_A3}] ){{5,}}[{_A3}])"
# tokens (runs without white space) counted in one scan of the text
TOKEN = f"{rx.NOT_S}++"
SINGLE_ARABIC = f"[{_A3}]"

_QUOTES = "\\(\\[\\x{AB}\"'"
_AR06 = f"[{rx.body('0600-06FF')}]"


def _leading_punct(allowed_body: str) -> tuple[str, str]:
    """A run of punctuation after whitespace (or at the start) that is
    followed by an Arabic-block character is deleted.

    Reference form: ``(?:(?<=\\s)|^)X+(?=[\\u0600-\\u06FF])`` with X the class
    below, which includes whitespace.  Tried at every position it is
    quadratic on long runs of X.  Within one maximal run of X only the first
    candidate start can match (later starts see a subset of the same run),
    so the linear form tries the run start (string start) or the position after
    the run's first whitespace, and keeps that prefix via ``$1``.
    Returns (linear pattern, replacement)."""
    x = f"[^\\p{{L}}\\p{{N}}_{allowed_body}{_QUOTES}]"
    y = f"[^\\p{{L}}\\p{{N}}_{allowed_body}{_QUOTES}{rx.SPACE_BODY}]"   # X minus whitespace
    return f"(?:^|(?<!{x})({y}*+{rx.S})){x}+(?={_AR06})", "$1"


LEADING_PUNCT_FORUM, LEADING_PUNCT_REPL = _leading_punct(rx.LETTERS_BODY)
LEADING_PUNCT_COMMENT, _ = _leading_punct(rx.AR_BODY)

LETTER = rx.cls(*rx.ARABIC_LETTERS)
BOUNDARY_FIX = f"(?<={LETTER})[^{rx.LETTERS_BODY}{rx.SPACE_BODY}]+(?={LETTER})"
# One space per run instead of per character: the collapse of spaces that
# follows makes the two identical, and runs mean far fewer replacements.
KEEP_ONLY_ARABIC = f"[^{rx.body(*rx.ARABIC_LETTERS_KEEP)}{rx.SPACE_BODY}]+"
# The boundary fix differs from keep-only + collapse only when the run holds a
# kept non-letter (Extended-A 08B6-08BD); elsewhere it is skipped.
BOUNDARY_NEEDLE = ("re:" + rx.cls("08B6-08BD"),)

ARABIC_ANY = rx.cls(*rx.ARABIC_BLOCKS, *rx.ARABIC_MATH)   # forum "has Arabic" (ratio)
ARABIC_BLOCK = rx.cls(*rx.ARABIC_BLOCKS)                  # "no Arabic left" gates
FOREIGN = rx.cls(*rx.FOREIGN)
_AR, _FO = rx.body(*rx.ARABIC_BLOCKS), rx.body(*rx.FOREIGN)
FOREIGN_TOKEN = (f"(?<!{rx.NOT_S})[^{rx.SPACE_BODY}{_AR}{_FO}]*+[{_FO}][^{rx.SPACE_BODY}{_AR}]*+(?!{rx.NOT_S})")


def token_with(body: str) -> str:
    """Tokens that hold a character of the class body."""
    return f"(?<!{rx.NOT_S})[^{rx.SPACE_BODY}{body}]*+[{body}]"


ARABIC_ANY_TOKEN = token_with(rx.body(*rx.ARABIC_BLOCKS, *rx.ARABIC_MATH))
ARABIC_BLOCK_TOKEN = token_with(_AR)

# Letter normalisation (C14) — alef forms to bare alef,
# taa marbuta to haa, alef maqsura to yaa.
NORM_FROM = "إأآاةى"
NORM_TO = "ااااهي"
DIACRITICS_AND_TATWEEL = rx.cls(*rx.DIACRITICS, rx.TATWEEL)


def normalise_arabic(c: Column) -> Column:
    """C14: unify alef/taa/yaa forms, drop harakat and tatweel."""
    return F.regexp_replace(F.translate(c, NORM_FROM, NORM_TO), DIACRITICS_AND_TATWEEL, "")


def guarded(c: Column, pattern: str, repl: str, *needles: str) -> Column:
    """``regexp_replace`` only on strings that contain one of ``needles``.

    Every match of ``pattern`` contains one of the needles, so the result is
    unchanged; strings without them skip the regex scan and the UTF-8 →
    UTF-16 → UTF-8 round trip ``regexp_replace`` pays even when nothing
    matches.  ``c`` is referenced three times: pass a column, not a chain.
    """
    cond = None
    for n in needles:
        x = c.contains(n) if not n.startswith("re:") else c.rlike(n[3:])
        cond = x if cond is None else (cond | x)
    return F.when(cond, F.regexp_replace(c, pattern, repl)).otherwise(c)


def _step(pattern: str, repl: str = " ", needles: tuple = (), guard: bool = True):
    if guard and needles:
        return lambda c: guarded(c, pattern, repl, *needles)
    return lambda c: F.regexp_replace(c, pattern, repl)


def _count(pattern: str, needles: tuple = ()):
    """Matches of ``pattern``; 0 without scanning when no needle occurs."""
    def f(c: Column) -> Column:
        n = F.regexp_count(c, F.lit(pattern))
        if not needles:
            return n
        cond = None
        for x in needles:
            y = c.contains(x) if not x.startswith("re:") else c.rlike(x[3:])
            cond = y if cond is None else (cond | y)
        return F.when(c.isNull(), F.lit(None)).when(cond, n).otherwise(F.lit(0))
    return f


#: Stands for a counted match until it is blanked; private use, so never kept by C15.
MARK = "\ue000"


def count_marks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(MARK), F.lit("")))


def count_matches(c: Column, pattern: str) -> Column:
    """Matches of ``pattern`` without an array of them: each becomes one mark, all else goes.

    ``c`` is read up to three times: pass a column, not a chain."""
    marked = F.regexp_replace(F.regexp_replace(c, pattern, MARK), f"[^{MARK}]++", "")
    return F.when(c.contains(MARK), F.regexp_count(c, F.lit(pattern))).otherwise(F.length(marked))


URL_NEEDLES = ("://", "ww.", "wW.", "Ww.", "WW.")          # every URL match holds "://" or "www."
LATIN = ("re:[A-Za-z]",)


def _letters_only_steps(guard: bool):
    """Flatten newlines, break at non-letters between letters, keep Arabic
    letters and whitespace, collapse spaces, strip."""
    return [
        ("newlines", _step(NEWLINE_RUN_LINEAR, " ", ("\n",), guard), {}),
        ("boundary", _step(BOUNDARY_FIX, " ", BOUNDARY_NEEDLE, guard), {}),
        ("letters", lambda c: py_strip(F.regexp_replace(F.regexp_replace(
            c, KEEP_ONLY_ARABIC, " "), " {2,}", " ")), {}),
    ]


# The noise steps (emoji, C10-C13, boundary fix) turn what is no Arabic letter into
# spaces, which the letters-only step does as well.  They make a difference in
# three cases only, and texts without them skip the steps: white space other than
# space and newline; characters at U+08B5 to U+08FF (kept non-letters, marks); and,
# in the forum profile, four single Arabic characters in a row, without which no
# run of spaced letters (C12) can stand in the text, whatever becomes a space.
_ODD = f"[{rx.body('0009', '000B-000D', '001C-001F', '0085', '00A0', '1680', '2000-200A', '2028', '2029', '202F', '205F', '3000', '08B5-08FF')}]"
_ODD = rx.within("\\x{20}-\\x{7E}\\x{600}-\\x{6FF}", _ODD[1:-1])
_IS_AR, _NO_AR = (f"[{neg}\\x{{0600}}-\\x{{06FF}}[{_A3}]]" for neg in ("", "^"))
_SINGLE = f"{_IS_AR}(?!{_IS_AR})"          # the last character of a run; the first one's run is that character alone
# asked where a run ends, which one small class tells for most characters: large classes cost Java far more
_MOST_AR = "[\\x{0600}-\\x{06FF}]"
_SINGLES = (f"(?<!{_MOST_AR}{{2}})(?!{_MOST_AR})"
            f"(?={_NO_AR})(?<={_IS_AR})(?<!{_IS_AR}{{2}}){_NO_AR}++(?:{_IS_AR}{_NO_AR}++){{2}}{_SINGLE}")
NOISE_MATTERS_FORUM = f"{_ODD}|{_SINGLES}"
NOISE_MATTERS_COMMENT = _ODD


def runs_without(common: str, ranges: str) -> str:
    """Runs of characters outside a class (its most common ranges, and all of them), but for a single space:
    what one space replaces."""
    out = f"[^{common}{rx.within(common + '\\x{0}-\\x{100}', ranges)}]"
    return f"{out}(?:{out}++|(?<! ))"


# newlines are spaces then, and one pass collapses and keeps letters only
_COMMON = "\\x{0621}-\\x{063A}\\x{0641}-\\x{064A}"
# most places are a letter, or one space before a letter: no run begins there, and one small class tells
_IS_COMMON = "[\\x{0641}-\\x{064A}\\x{0621}-\\x{063A}]"
NOT_LETTERS_OR_WIDE = f"(?!{_IS_COMMON}| (?={_IS_COMMON}))" + runs_without(_COMMON, rx.body(*rx.ARABIC_LETTERS_KEEP))
_DROPPED = "".join(map(chr, range(0x64B, 0x660))) + "\u0640"


#: Whether the noise steps matter for a text; after them its white space is spaces only if they do not.
NOISY = "__noisy"


def _noise(full: list, spaced: int = 0):
    """The steps from the noise to the letters, by the short way where it gives the same text.

    Without odd characters only the first ``spaced`` steps, up to the runs of spaced letters, matter."""
    def rewrite(c: Column) -> Column:
        long = first = c
        for step in full:
            long = step(long)
        for step in full[:spaced]:
            first = step(first)
        odd = F.col(NOISY) & c.rlike(_ODD)
        short = F.when(F.col(NOISY) & ~odd, first).otherwise(c) if spaced else c
        short = F.translate(short, "\n" + NORM_FROM + _DROPPED, " " + NORM_TO)
        short = F.regexp_replace(short, NOT_LETTERS_OR_WIDE, " ")
        return py_strip(F.when(odd, long).otherwise(short))
    return rewrite


# A profile is a flat list of stages (name, rewrite, taps); taps are counters
# computed on the stage's *input*.  Each stage reads the previous stage's
# column, so a guarded step never duplicates a chain.
def _english(guard: bool) -> list:
    """English words, counted by the marks that replace them."""
    if not guard:
        return [("english", _step(ENGLISH_WORD), {})]
    # a mark that the text brought along becomes another private sign, which no step treats differently
    return [("own marks", lambda c: F.replace(c, F.lit(MARK), F.lit("\ue001")), {}),
            ("english", _step(ENGLISH_WORD, MARK, LATIN), {"n_english": "marks"}),
            ("blank", lambda c: F.replace(c, F.lit(MARK), F.lit(" ")), {})]


def forum_stages(remove_emojis: bool = True, strip_english: bool = True, guard: bool = True):
    """``guard=False``: every step of the profile in its order, as the specification has it."""
    st = [
        ("quran", _step(QURANIC, "", ("re:" + QURANIC,), guard), {"n_quran": None}),
        ("url", _step(URL, " ", URL_NEEDLES, guard), {"n_urls": _count(URL, URL_NEEDLES)}),
        ("mention", _step(MENTION, " ", ("@",), guard), {}),
        ("forum_ref", _step(FORUM_REF, " ", ("/",), guard), {}),
        ("hashtag", _step(HASHTAG, " ", ("#",), guard), {}),
        ("entity", _step(HTML_ENTITY, " ", ("&",), guard), {}),
        ("tag", _step(HTML_TAG, " ", ("<",), guard), {}),
    ]
    noise = [_step(DIVIDER), _step(SPACED_PUNCT_FORUM), _step(SPACED_ARABIC_SPAN),
             _step(LEADING_PUNCT_FORUM, LEADING_PUNCT_REPL), normalise_arabic,
             *(s for _, s, _t in _letters_only_steps(False))]
    return st + _from_emoji(_step(EMOJI_FORUM) if remove_emojis else None, noise, strip_english, guard, (_ODD, _SINGLES), 3)


def _from_emoji(emoji, noise: list, strip_english: bool, guard: bool, matters: tuple[str, ...], spaced: int = 0) -> list:
    """Emoji, English words and noise; as no English word holds or borders on an emoji in
    another way than on a space, the two may change places."""
    english = _english(guard) if strip_english else []
    emojis = [emoji] if emoji else []
    if guard:
        return english + [("noisy", lambda c: c, {NOISY: lambda c: functools.reduce(lambda a, b: a | b, [c.rlike(m) for m in matters])}), ("noise", _noise(emojis + noise, spaced and spaced + len(emojis)), {})]
    return [("emoji", e, {}) for e in emojis] + english + [("noise", s, {}) for s in noise]


def comment_stages(remove_emojis: bool = True, strip_english: bool = True, guard: bool = True):
    st = [
        ("bidi", _step(BIDI, ""), {}),
        ("quran", _step(QURANIC, "", ("re:" + QURANIC,), guard), {"n_quran": None}),
        ("url", _step(URL, " ", URL_NEEDLES, guard), {"n_urls": _count(URL, URL_NEEDLES)}),
        ("time", _step(CLOCK_TIME, " ", (":",), guard), {"n_times": _count(CLOCK_TIME, (":",))}),
        ("mention", _step(MENTION, " ", ("@",), guard), {}),
        ("hashtag", _step(HASHTAG, " ", ("#",), guard), {}),
        ("entity", _step(HTML_ENTITY, " ", ("&",), guard), {}),
        ("tag", _step(HTML_TAG, " ", ("<",), guard), {}),
    ]
    noise = [_step(DIVIDER), _step(SPACED_PUNCT_COMMENT), _step(LEADING_PUNCT_COMMENT, LEADING_PUNCT_REPL), normalise_arabic,
             *(s for _, s, _t in _letters_only_steps(False))]
    return st + _from_emoji(_step(EMOJI_COMMENT) if remove_emojis else None, noise, strip_english, guard, (_ODD,))


def letters_only(c: Column) -> Column:
    """C15 as one Column expression."""
    for _, rewrite, _t in _letters_only_steps(False):
        c = rewrite(c)
    return c


def clean_expr(c: Column, stages) -> Column:
    """Whole chain as one nested expression (no counters); for ad-hoc use."""
    for _, rewrite, _taps in stages:
        c = rewrite(c)
    return c


def clean_forum_text(c: Column, remove_emojis: bool = True, strip_english: bool = True) -> Column:
    """Forum profile text rewrite C1–C15 as a Column -> Column function."""
    return clean_expr(c, forum_stages(remove_emojis, strip_english, guard=False))


def clean_comment_text(c: Column, remove_emojis: bool = True, strip_english: bool = True) -> Column:
    """Comment profile text rewrite C16–C19 (+ shared steps) as Column -> Column."""
    return clean_expr(c, comment_stages(remove_emojis, strip_english, guard=False))


# --- web profile (C20) -----------------------------------------------------

WEB_MARKS = "".join(map(chr, (*range(0x64B, 0x660), 0x670)))      # WEB_DIACRITICS of the profile
WEB_NOT_KEPT = runs_without("\\x{0620}-\\x{06B0}", rx.body(*rx.WEB_KEEP))
WEB_ARABIC = f"[\\x{{0620}}-\\x{{06B0}}[{rx.body(*rx.WEB_ARABIC)}]]"


def clean_web_text(c: Column) -> Column:
    """C20 rewrite without the gates: Latin runs out, keep Arabic letters and
    Arabic-Indic digits, drop harakat, collapse whitespace, strip."""
    # neither Latin letters nor white space are kept: all is one replacement of runs by a space.
    # Harakat are among the kept, so they end no such run, and may go before.
    return py_strip(F.regexp_replace(F.translate(c, WEB_MARKS, ""), WEB_NOT_KEPT, " "))
