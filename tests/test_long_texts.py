"""No text may end the JVM: long runs of every kind through every profile."""

import pytest
from pyspark.sql import functions as F

from qalam.functions.clean import clean_comment_text, clean_forum_text, clean_web_text
from qalam.operators.cleaning import clean_comment, clean_forum, clean_web
from qalam.operators.transcripts import transcripts_to_docs
from tests.conftest import one_col

N = 30_000
UNITS = ["- ", "= =\t", ". ", "! ?  ", "[a] ", "[tag]", "a-", "a'b ", "ا ب ", "ا.", "&", "& # 2 ;", "<a>", "<", "@a ", "r/", "#",
         "😀 ", " \n", "\n", "1:23 ", "12:34:56 ", "كلمة ", "​", "ـ", "http://", "www.", "ࢶ.", "Aé"]
TEXTS = [u * N for u in UNITS] + ["سلام " + u * N + " عليكم" for u in UNITS]


@pytest.mark.parametrize("clean", [clean_forum_text, clean_comment_text, clean_web_text])
def test_long_runs_pass_every_rewrite(spark, clean):
    rows = one_col(spark, TEXTS).select(F.length(clean(F.col("t"))).alias("n")).collect()
    assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("profile", [clean_forum, clean_comment, clean_web])
def test_long_runs_pass_every_gate(spark, profile):
    assert len(profile(one_col(spark, TEXTS, "text"), "text").collect()) == len(TEXTS)


def test_repeated_groups_take_whole_runs(spark):
    texts = ["ا - - - ب", "ا -- ب", "ا . . . ب", "ا ..ب", "ا - - -", "ا ===\t==ب", "ا !؟ !! ب"]
    got = {r.t: r.o for r in one_col(spark, texts).select("t", clean_forum_text(F.col("t")).alias("o")).collect()}
    assert set(got.values()) == {"ا ب", "ا"}


def test_long_transcript_lines(spark):
    tags = "[a] " * N
    files = spark.createDataFrame([("a", tags + "\n" + tags + "words\nplain words"), ("b", ">>" * N + "\n" + "<c>x</c>" * N)],
                                  "path string, content string")
    got = {r.path: r.text for r in transcripts_to_docs(files).collect()}
    assert got["a"] == "words plain words" and got["b"].endswith("x" * N)
