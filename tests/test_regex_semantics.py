"""Spark (Java regex + shims) against Python ``re`` as the specification."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qalam.functions import clean as cl
from qalam.functions.text import py_split, py_strip
from tests.conftest import one_col

ALPHABET = list(" \t\n\r\x0b\x0c\xa0 ,.;:!?-_'\"()[]«#&@/abcXYZé٣٤") + ["سلام", "ا", "ب", "َ", "،", "😀"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join)

# The reference patterns, in Python syntax, used as the spec.
PY_NEWLINE = re.compile(r"\s*\n\s*")
PY_ENGLISH = re.compile(r"\b[A-Za-z][A-Za-z0-9'-]*\b")
# Fixed value: the Arabic letters of the letters-only step.
LETTERS = "ء-غف-يٮ-ۓەۮ-ۯۺ-ۼۿݐ-ݿࢠ-ࢴﭐ-ﮱﯓ-ﴽﵐ-ﶏﶒ-ﷇﷰ-ﷻﹰ-ﹴﹶ-ﻼ"
PY_LEADING = re.compile("(?:(?<=\\s)|^)[^\\w" + LETTERS + "\\(\\[«\"']+(?=[؀-ۿ])")


def _spark_map(spark, values, fn):
    df = one_col(spark, values).select(F.col("t"), fn(F.col("t")).alias("o"))
    return {r["t"]: r["o"] for r in df.collect()}


@settings(max_examples=25, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40))
def test_shims_match_python(spark, values):
    got = _spark_map(spark, values, lambda c: F.struct(
        F.regexp_replace(c, cl.NEWLINE_RUN_LINEAR, " ").alias("nl"),
        F.regexp_replace(c, cl.ENGLISH_WORD, " ").alias("en"),
        F.regexp_count(c, F.lit(cl.ENGLISH_WORD)).alias("n_en"),
        F.regexp_replace(c, cl.LEADING_PUNCT_FORUM, cl.LEADING_PUNCT_REPL).alias("lp"),
        py_strip(c).alias("strip"),
        py_split(c).alias("split")))
    for v in values:
        o = got[v]
        assert o["nl"] == PY_NEWLINE.sub(" ", v), repr(v)
        assert o["en"] == PY_ENGLISH.sub(" ", v), repr(v)
        assert o["n_en"] == len(PY_ENGLISH.findall(v)), repr(v)
        assert o["lp"] == PY_LEADING.sub("", v), repr(v)
        assert o["strip"] == v.strip(), repr(v)
        assert list(o["split"]) == v.split(), repr(v)


def test_long_runs_stay_linear(spark):
    import time
    v = ("word, " * 20000) + "سلام"
    t = time.time()
    out = _spark_map(spark, [v], lambda c: F.regexp_replace(F.regexp_replace(c, cl.LEADING_PUNCT_FORUM,
                                                                             cl.LEADING_PUNCT_REPL),
                                                            cl.NEWLINE_RUN_LINEAR, " "))
    assert time.time() - t < 20
    assert out[v] == PY_NEWLINE.sub(" ", PY_LEADING.sub("", v))


# Worked by hand: the letters-only step keeps Arabic letters and white space, turns the rest into
# spaces, joins spaces and strips.
WORKED = {
    "بس": "بس",
    " بس ": "بس",
    "ب.س": "ب س",
    "ب،  س": "ب س",
    "بx9_!س": "ب س",
    "ب\n\nس": "ب س",
    "ب \n س": "ب س",
    "بَس": "ب س",
    "بـس": "ب س",
    "ب-س-ب": "ب س ب",
    "...ب": "ب",
    "ب...": "ب",
    "x9": "",
    "": "",
    "   ": "",
    "ب٣س": "ب س",
    "ࢶ": "ࢶ",
    "بࢶس": "ب س",
    "ب ࢽ س": "ب ࢽ س",
    "بࢽ": "بࢽ",
    "ب\tس": "ب\tس",
}


def test_letters_only_worked_by_hand(spark):
    from qalam.operators.cleaning import _run_stages
    df = _run_stages(one_col(spark, list(WORKED)), F.col("t"), cl._letters_only_steps(True), "o")
    assert {r["t"]: r["o"] for r in df.collect()} == WORKED


C15_ALPHABET = list(" \t\n,.!-_x9٣") + ["ب", "س", "ࢶ", "ࢽ", "َ", "ـ", "، "]
KEPT = set("بسࢶࢽ \t")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(C15_ALPHABET), max_size=25).map("".join), min_size=1, max_size=40))
def test_letters_only_properties(spark, values):
    """Only letters and white space stay, no letter between spaces is lost, and a second run changes nothing."""
    from qalam.operators.cleaning import _run_stages
    once = _run_stages(one_col(spark, values), F.col("t"), cl._letters_only_steps(True), "o")
    twice = _run_stages(once.select("t", F.col("o").alias("p")), F.col("p"), cl._letters_only_steps(True), "q")
    for r in twice.collect():
        assert set(r["p"]) <= KEPT and "  " not in r["p"] and r["p"] == r["p"].strip() and r["q"] == r["p"]
        assert [c for c in r["p"] if c in "بس"] == [c for c in r["t"] if c in "بس"]


PARTS = ["ا", "ب ", "كلمة ", " ", "\n", "ـ", "ٌ", "،", "...", "- ", "ا - ب - ", "س ل ا م ", "ا.ب.ت.ث.ج.ح ", "😀", "abc ", "don't-", "A", "\t",
         "ࢶ", "ࣔ", "ࣃ", "ۗ", "إ", "1 ", "٣", "(", "«", "'", "_", "#", "@u ", "&amp;", "<b>", "http://x ", "", "é", "漢", " ", "﷐", "ݐ",
         "ࢠ", "=== ", "، ، ، ", "ا ", "ى ", "12:30 "]


def test_the_short_way_gives_the_text_of_every_step(spark):
    import random
    from qalam.operators.cleaning import _run_stages
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, n))) for n in (5, 12, 30) for _ in range(3000)]
    for stages, plain, matters in ((cl.forum_stages, cl.clean_forum_text, cl.NOISE_MATTERS_FORUM),
                                   (cl.comment_stages, cl.clean_comment_text, cl.NOISE_MATTERS_COMMENT)):
        df = _run_stages(one_col(spark, texts).repartition(8), F.col("t"), stages(), "fast")
        rows = df.select("t", "fast", plain(F.col("t")).alias("slow"), F.col("t").rlike(matters).alias("m")).collect()
        bad = [(ascii(r.t), ascii(r.fast), ascii(r.slow)) for r in rows if r.fast != r.slow]
        assert not bad, bad[:3]
        assert sum(not r.m for r in rows) > 500 and sum(r.m for r in rows) > 500


def test_english_words_are_counted_by_marks(spark):
    from qalam.operators.cleaning import _run_stages
    want = {"one two": 2, "\ue000one\ue000two\ue000": 2, "لا شيء": 0, "a-b c'd ا": 2, "": 0}
    got = {r.t: r.n_english for r in _run_stages(one_col(spark, list(want)), F.col("t"), cl.forum_stages(), "o").collect()}
    assert got == want
