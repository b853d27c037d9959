"""Character classes and Python-``re`` compatibility shims for Java regex.

The cleaning profiles were specified against Python's Unicode-aware ``re``.
Java's ``java.util.regex`` differs for ``\\w``, ``\\s``, ``\\b``, ``\\d``, ``$`` and
``str.strip``; the shims below restore Python's meaning.  Every non-ASCII
character is written as a ``\\x{…}`` escape, which both Java and RE2 accept.
"""

from __future__ import annotations


def cls(*ranges: str, negate: bool = False, extra: str = "") -> str:
    """Build a bracket class from ``"0600-06FF"`` / ``"0671"`` code-point items."""
    parts = []
    for r in ranges:
        if "-" in r:
            lo, hi = r.split("-")
            parts.append(f"\\x{{{lo}}}-\\x{{{hi}}}")
        else:
            parts.append(f"\\x{{{r}}}")
    return "[" + ("^" if negate else "") + extra + "".join(parts) + "]"


def within(common: str, ranges: str) -> str:
    """The class body ``ranges`` as a nested class behind ``common``, characters that no range holds: Java asks a
    union's ranges last to first, one call in another, so a long class is slow for each character outside it."""
    return f"[[^{common}]&&[{ranges}]]"


# ---------------------------------------------------------------------------
# Unicode ranges the cleaning profiles must use verbatim.
# ---------------------------------------------------------------------------

# Arabic blocks (forum profile "Arabic present"): Arabic, Supplement, Extended-A,
# Presentation Forms A and B, Mathematical Alphabetic Symbols.
ARABIC_BLOCKS = ("0600-06FF", "0750-077F", "08A0-08FF", "FB50-FDFF", "FE70-FEFF")
ARABIC_MATH = ("1EE00-1EEFF",)

# Quranic / Uthmanic marks deleted by C1 (both profiles use the same set).
QURANIC = ("0671", "0615", "0670", "06D6-06ED", "08D4-08FF", "FBB2-FBC1",
           "0600-0605", "0610-061A")

# Arabic letters kept by the final "letters only" step.
ARABIC_LETTERS = ("0621-063A", "0641-064A", "066E-06D3", "06D5", "06EE-06EF",
                  "06FA-06FC", "06FF", "0750-077F", "08A0-08B4", "FB50-FBB1",
                  "FBD3-FD3D", "FD50-FD8F", "FD92-FDC7", "FDF0-FDFB", "FE70-FE74",
                  "FE76-FEFC")
# The keep-only class additionally keeps Extended-A 08B6-08BD.
ARABIC_LETTERS_KEEP = ARABIC_LETTERS + ("08B6-08BD",)

# Harakat (tashkeel) removed by normalisation, and the tatweel.
DIACRITICS = ("064B-065F",)
TATWEEL = "0640"

# Emoji ranges: forum profile (C8) and comment profile.
EMOJI_FORUM = ("1F600-1F64F", "1F300-1F5FF", "1F680-1F6FF", "1F1E0-1F1FF",
               "2700-27BF", "1F900-1F9FF", "2600-26FF")
EMOJI_COMMENT = ("1F600-1F64F", "1F300-1F5FF", "1F680-1F6FF", "1F1E0-1F1FF",
                 "2702-27B0", "1F900-1F9FF", "2600-26FF", "1FA00-1FAFF",
                 "2300-23FF")
HEARTS = ("2764", "2665")

# Zero-width and bidi controls stripped first by the comment profile.
BIDI_CONTROLS = ("200B-200F", "202A-202E", "2066-206F", "FEFF")

# Foreign scripts for the comment profile's G4 gate.  The Latin range is the
# literal "A-z", which also covers the six signs U+005B..U+0060.
FOREIGN = ("0041-007A", "00C0-024F", "0400-04FF", "0900-097F", "0980-09FF",
           "4E00-9FFF", "0590-05FF", "0370-03FF", "AC00-D7AF", "3040-30FF")

# Web profile (C20): Arabic share class and the kept class.
WEB_ARABIC = ("0620-06B0", "06BA-06BF", "06CC-06D3", "0750-077F", "08A0-08FF")
WEB_KEEP = ("0620-06B0", "06BA-06BF", "06CC-06D3", "0660-0669", "0750-077F",
            "08A0-08FF")
WEB_DIACRITICS = ("064B-065F", "0670")

# Arabic-Indic digits accepted by the forum "numbers only" gate.
ARABIC_INDIC_DIGITS = ("0660-0669",)

# Python's Unicode whitespace (str.split / str.strip / \s).
PY_SPACE_ITEMS = ("0009-000D", "001C-0020", "0085", "00A0", "1680", "2000-200A",
                  "2028", "2029", "202F", "205F", "3000")

# ---------------------------------------------------------------------------
# Derived Java-regex fragments.
# ---------------------------------------------------------------------------

S = cls(*PY_SPACE_ITEMS)                 # Python \s
NOT_S = cls(*PY_SPACE_ITEMS, negate=True)
W = "[\\p{L}\\p{N}_]"                    # Python \w (letters, numbers, underscore)
NOT_W = "[^\\p{L}\\p{N}_]"
# Python \b: a position between a \w and a non-\w character.
B = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
D = "\\p{Nd}"                            # Python \d

# Bare range bodies (no brackets) for composing classes.
def body(*ranges: str) -> str:
    return cls(*ranges)[1:-1]


AR_BODY = body(*ARABIC_BLOCKS)
LETTERS_BODY = body(*ARABIC_LETTERS)
SPACE_BODY = body(*PY_SPACE_ITEMS)
