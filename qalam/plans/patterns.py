"""The cleaning profiles' patterns as the oracle's SQL (RE2) states them.

Spelled out on their own: the engine's patterns and character tables are not read here.
"""

S = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_S = r"[^\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPACE = S[1:-1]
W = r"[\p{L}\p{N}_]"

URL = rf"(?i)https?://{NOT_S}+|www\.{NOT_S}+"
MENTION = f"@{W}+"
FORUM_REF = f"r/{W}+|u/{W}+"
HASHTAG = f"#{W}+"
HTML_ENTITY = rf"(?i)&{S}*#?{S}*[a-zA-Z0-9][{_SPACE}a-zA-Z0-9]*{S}*;"
HTML_TAG = "<[^>]+>"
DIVIDER = r"(?:[-_=*~#][ \t]*){3,}"
SPACED_PUNCT_FORUM = rf"(?:[^\p{{L}}\p{{N}}_{_SPACE}\x{{0600}}-\x{{06FF}}][ \t]*){{3,}}"
SPACED_PUNCT_COMMENT = (rf"(?:[^\p{{L}}\p{{N}}_{_SPACE}\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{08A0}}-\x{{08FF}}]"
                        r"[ \t]*){3,}")
SPACED_ARABIC_SPAN = (r"(?:[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}] ){5,}"
                      r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]")
SINGLE_ARABIC = r"^[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]\z"
ENGLISH_WORD = r"\b[A-Za-z][A-Za-z0-9'-]*\b"
CLOCK_TIME = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
NEWLINE_RUN = rf"{S}*\n{S}*"

QURANIC = (r"[\x{0671}\x{0615}\x{0670}\x{06D6}-\x{06ED}\x{08D4}-\x{08FF}\x{FBB2}-\x{FBC1}\x{0600}-\x{0605}"
           r"\x{0610}-\x{061A}]")
BIDI = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{206F}\x{FEFF}]"
EMOJI_FORUM = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2700}-\x{27BF}"
               r"\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}]+")
EMOJI_COMMENT = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}"
                 r"\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}\x{1FA00}-\x{1FAFF}\x{2300}-\x{23FF}]+")
NORM_FROM, NORM_TO = "إأآاةى", "ااااهي"
MARKS_AND_TATWEEL = r"[\x{064B}-\x{065F}\x{0640}]"
NOT_ARABIC_LETTERS = (r"[^\x{0621}-\x{063A}\x{0641}-\x{064A}\x{066E}-\x{06D3}\x{06D5}\x{06EE}-\x{06EF}\x{06FA}-\x{06FC}"
                      r"\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08B4}\x{FB50}-\x{FBB1}\x{FBD3}-\x{FD3D}\x{FD50}-\x{FD8F}"
                      r"\x{FD92}-\x{FDC7}\x{FDF0}-\x{FDFB}\x{FE70}-\x{FE74}\x{FE76}-\x{FEFC}\x{08B6}-\x{08BD}"
                      rf"{_SPACE}]+")
ARABIC_BLOCK = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
ARABIC_ANY = (r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
              r"\x{1EE00}-\x{1EEFF}]")
FOREIGN = (r"[\x{0041}-\x{007A}\x{00C0}-\x{024F}\x{0400}-\x{04FF}\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{4E00}-\x{9FFF}"
           r"\x{0590}-\x{05FF}\x{0370}-\x{03FF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]")

PLACEHOLDER = rf"(?i)^{S}*\[?(?:deleted|removed|AutoModerator)\]?{S}*\z"
EMOJI_ONLY = (rf"^[{_SPACE}\x{{2764}}\x{{2665}}\x{{1F600}}-\x{{1F64F}}\x{{1F300}}-\x{{1F5FF}}\x{{1F680}}-\x{{1F6FF}}"
              r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}\x{1FA00}-\x{1FAFF}"
              r"\x{2300}-\x{23FF}]+\z")
NUMBERS_ONLY_FORUM = rf"^[\p{{Nd}}{_SPACE}\.,\-\+\(\)\x{{0660}}-\x{{0669}}]+\z"
NOT_NUMBER_COMMENT = rf"[^\p{{Nd}}{_SPACE}.,\-+\(\)\x{{064B}}-\x{{065F}}]"

WEB_LATIN = "[a-zA-Z]+"
WEB_NOT_KEPT = (r"[^\x{0620}-\x{06B0}\x{06BA}-\x{06BF}\x{06CC}-\x{06D3}\x{0660}-\x{0669}\x{0750}-\x{077F}"
                rf"\x{{08A0}}-\x{{08FF}}{_SPACE}]")
WEB_MARKS = r"[\x{064B}-\x{065F}\x{0670}]"
WEB_ARABIC = r"[\x{0620}-\x{06B0}\x{06BA}-\x{06BF}\x{06CC}-\x{06D3}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"

TAG_ONLY = rf"^(?:\[[^\]]*\]{S}*)+\z"
SOUND_TAG = r"\[[^\]]*\]"
INLINE_TIME = r"<\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}\.\p{Nd}+>"
CAPTION_TAG = "</?c>"
SPEAKER = f"^>>{S}*"
ANY_TAG = "<[^>]+>"
