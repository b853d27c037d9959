"""Registered queries for the cleaning profiles, gates and funnel (C, G, A1, A2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalam.operators.cleaning import clean_comment, clean_forum, clean_web, kept
from qalam.operators.funnel import funnel, funnel_long
from qalam.plans import duck as d
from qalam.plans import patterns as p
from qalam.plans.registry import query
from qalam.sources.fixtures import fixture, fixture_sql

# The parameters of the cleaning runs.
FORUM_ARGS = dict(min_arabic_ratio=0.50, min_chars=50)
COMMENT_ARGS = dict(min_arabic_ratio=0.20, min_chars=50, max_foreign_ratio=0.20)
WEB_ARGS = dict(min_chars=20, arabic_threshold=0.4)


def forum_flagged(spark, sf_dir):
    return clean_forum(fixture(spark, sf_dir, "posts"), "text", **FORUM_ARGS)


def comment_flagged(spark, sf_dir):
    return clean_comment(fixture(spark, sf_dir, "posts"), "text", **COMMENT_ARGS)


def clean_to_table(flagged):
    """Flagged rows written once: the cleaning runs a single time for kept rows and counts."""
    from qalam.plans.session import materialize
    return materialize(flagged)


def web_flagged(spark, sf_dir):
    return clean_web(fixture(spark, sf_dir, "posts"), "text", **WEB_ARGS)


# ---------------------------------------------------------------------------
# DuckDB oracle: the same chains with RE2.  Lookaround steps (English-word and
# clock-time rewrites, leading punctuation, the boundary fix) only turn
# non-letters into spaces ahead of the letters-only step, so the oracle leaves
# them out of the text and keeps them in the counts.
# ---------------------------------------------------------------------------

def _refs(x: str, forum: bool) -> str:
    x = d.sub(x, p.MENTION)
    if forum:
        x = d.sub(x, p.FORUM_REF)
    x = d.sub(x, p.HASHTAG)
    x = d.sub(x, p.HTML_ENTITY)
    return d.sub(x, p.HTML_TAG)


def _tail(x: str, forum: bool) -> str:
    x = d.sub(x, p.DIVIDER)
    x = d.sub(x, p.SPACED_PUNCT_FORUM if forum else p.SPACED_PUNCT_COMMENT)
    if forum:
        x = d.sub(x, p.SPACED_ARABIC_SPAN)
    x = f"translate({x}, {d.q(p.NORM_FROM)}, {d.q(p.NORM_TO)})"
    x = d.sub(x, p.MARKS_AND_TATWEEL, "")
    x = d.sub(x, p.NEWLINE_RUN)
    x = d.sub(x, p.NOT_ARABIC_LETTERS)
    x = d.sub(x, " {2,}")
    return d.strip(x)


def forum_flagged_sql(posts_sql: str | None = None) -> str:
    """Forum chain over ``posts(id, source, text)`` (default: the posts recipe)."""
    toks = d.tokens("clean")
    return f"""
WITH posts AS ({posts_sql or fixture_sql('posts')}),
f0 AS (SELECT *, CASE WHEN text IS NULL OR {d.strip('text')} = '' THEN 'empty'
                      WHEN {d.rlike('text', p.PLACEHOLDER)} THEN 'deleted' END AS pre FROM posts),
f1 AS (SELECT *, CASE WHEN pre IS NULL THEN text END AS t0 FROM f0),
f2 AS (SELECT *, {d.sub('t0', p.QURANIC, '')} AS t1 FROM f1),
f3 AS (SELECT *, length(t0) - length(t1) AS n_quran, {d.count('t1', p.URL)} AS n_urls,
              {_refs(d.sub('t1', p.URL), True)} AS t2 FROM f2),
f4 AS (SELECT *, {d.sub('t2', p.EMOJI_FORUM)} AS t3 FROM f3),
f5 AS (SELECT *, {d.count(d.py_word_ascii('t3'), p.ENGLISH_WORD)} AS n_english,
              {_tail('t3', True)} AS clean FROM f4),
f6 AS (SELECT *, coalesce(pre, CASE
    WHEN len({toks}) >= 6 AND {d.share(toks, d.rlike('t', p.SINGLE_ARABIC))} > 0.5 THEN 'spaced_arabic'
    WHEN NOT {d.rlike('clean', p.ARABIC_BLOCK)} THEN 'no_arabic'
    WHEN {d.share(toks, d.rlike('t', p.ARABIC_ANY))} < {FORUM_ARGS['min_arabic_ratio']} THEN 'low_arabic'
    WHEN length(clean) < {FORUM_ARGS['min_chars']} THEN 'too_short'
    WHEN {d.rlike(d.strip('clean'), p.NUMBERS_ONLY_FORUM)} THEN 'numbers_only' END) AS drop_reason
  FROM f5)
"""


def comment_flagged_sql() -> str:
    toks = d.tokens("clean")
    raw_toks = d.tokens("text")
    return f"""
WITH posts0 AS ({fixture_sql('posts')}),
posts AS (SELECT id, source, text AS text_in, coalesce(text, '') AS text FROM posts0),
f0 AS (SELECT *, CASE WHEN {d.strip('text')} = '' THEN 'empty'
                      WHEN {d.rlike(d.strip('text'), p.EMOJI_ONLY)} THEN 'emoji_only'
                      WHEN {d.share(raw_toks, d.rlike('t', p.FOREIGN) + ' AND NOT ' + d.rlike('t', p.ARABIC_BLOCK))}
                           > {COMMENT_ARGS['max_foreign_ratio']} THEN 'foreign' END AS pre FROM posts),
f1 AS (SELECT *, CASE WHEN pre IS NULL THEN {d.sub('text', p.BIDI, '')} END AS t0 FROM f0),
f2 AS (SELECT *, {d.sub('t0', p.QURANIC, '')} AS t1 FROM f1),
f3 AS (SELECT *, length(t0) - length(t1) AS n_quran, {d.count('t1', p.URL)} AS n_urls,
              {d.sub('t1', p.URL)} AS t2 FROM f2),
f4 AS (SELECT *, {d.count(d.py_word_ascii('t2'), p.CLOCK_TIME)} AS n_times,
              {d.sub(_refs('t2', False), p.EMOJI_COMMENT)} AS t3 FROM f3),
f5 AS (SELECT *, {d.count(d.py_word_ascii('t3'), p.ENGLISH_WORD)} AS n_english,
              {_tail('t3', False)} AS clean FROM f4),
f6 AS (SELECT *, coalesce(pre, CASE
    WHEN NOT {d.rlike('clean', p.ARABIC_BLOCK)} THEN 'no_arabic'
    WHEN {d.share(toks, d.rlike('t', p.ARABIC_BLOCK))} < {COMMENT_ARGS['min_arabic_ratio']} THEN 'low_arabic'
    WHEN length(clean) < {COMMENT_ARGS['min_chars']} THEN 'too_short'
    WHEN NOT {d.rlike(d.strip('clean'), p.NOT_NUMBER_COMMENT)} THEN 'numbers_only' END) AS drop_reason
  FROM f5)
"""


def web_flagged_sql() -> str:
    m = WEB_ARGS["min_chars"]
    c = d.strip(d.sub(d.sub(d.sub(d.sub("text", p.WEB_LATIN), p.WEB_NOT_KEPT), p.WEB_MARKS, ""),
                      p.S + "+"))
    return f"""
WITH posts AS ({fixture_sql('posts')}),
w0 AS (SELECT *, text IS NULL OR length(text) < {m} AS early FROM posts),
w1 AS (SELECT *, CASE WHEN NOT early THEN {c} END AS c FROM w0),
w2 AS (SELECT *, CASE WHEN early THEN 'too_short_raw'
                      WHEN length(c) < {m} THEN 'too_short_clean'
                      WHEN {d.count('c', p.WEB_ARABIC)} / greatest(length(replace(c, ' ', '')), 1)
                           < {WEB_ARGS['arabic_threshold']} THEN 'low_arabic' END AS drop_reason FROM w1),
f6 AS (SELECT *, CASE WHEN drop_reason IS NULL THEN c END AS clean FROM w2)
"""


def _funnel_sql(flagged_sql: str, reasons: list[tuple[str, str]], counters: list[str],
                text_col: str = "text") -> str:
    cols = ["CAST(count(*) AS BIGINT) AS total_raw"]
    cols += [f"CAST(count(*) FILTER (WHERE drop_reason = '{r}') AS BIGINT) AS {n}" for r, n in reasons]
    cols += ["CAST(count(*) FILTER (WHERE drop_reason IS NULL) AS BIGINT) AS final_clean",
             f"CAST(coalesce(sum(length({text_col})), 0) AS BIGINT) AS chars_before",
             "CAST(coalesce(sum(CASE WHEN drop_reason IS NULL THEN length(clean) END), 0) AS BIGINT) AS chars_after"]
    names = {"n_english": "english_words_removed", "n_urls": "urls_removed",
             "n_times": "timestamps_removed", "n_quran": "quran_chars_removed"}
    cols += [f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {names[c]}" for c in counters]
    return flagged_sql + ", fun AS (SELECT " + ",\n  ".join(cols) + """ FROM f6)
SELECT *, total_raw - final_clean AS total_removed, final_clean / greatest(total_raw, 1) AS kept_share,
  chars_after / greatest(chars_before, 1) AS char_retention FROM fun"""


def _steps_sql(flagged_sql: str, reasons: list[str]) -> str:
    labels = ["kept"] + reasons
    vals = ", ".join(f"({i}, '{r}')" for i, r in enumerate(labels))
    return flagged_sql + f""", steps(step, drop_reason) AS (VALUES {vals})
SELECT s.step, s.drop_reason, CAST(count(f.id) AS BIGINT) AS n_rows
FROM steps s LEFT JOIN f6 f ON coalesce(f.drop_reason, 'kept') = s.drop_reason
GROUP BY s.step, s.drop_reason"""


_FORUM_R = [("empty", "removed_empty"), ("deleted", "removed_deleted"),
            ("spaced_arabic", "removed_spaced_ar"), ("no_arabic", "removed_no_arabic"),
            ("low_arabic", "removed_low_ar"), ("too_short", "removed_short"),
            ("numbers_only", "removed_numbers")]
_COMMENT_R = [("empty", "removed_empty"), ("emoji_only", "removed_emoji_only"),
              ("foreign", "removed_foreign"), ("no_arabic", "removed_no_arabic"),
              ("low_arabic", "removed_low_ar"), ("too_short", "removed_short"),
              ("numbers_only", "removed_numbers")]
_WEB_R = [("too_short_raw", "removed_short_raw"), ("too_short_clean", "removed_short_clean"),
          ("low_arabic", "removed_low_ar")]


@query("forum_funnel", _funnel_sql(forum_flagged_sql(), _FORUM_R, ["n_english", "n_urls", "n_quran"]))
def forum_funnel(spark, sf_dir):
    """E1 flagship: forum profile funnel."""
    return funnel(forum_flagged(spark, sf_dir), "forum", "text")


@query("forum_funnel_steps", _steps_sql(forum_flagged_sql(), [r for r, _ in _FORUM_R]))
def forum_funnel_steps(spark, sf_dir):
    """A1 long form: rows per gate in gate order, zeros included."""
    return funnel_long(forum_flagged(spark, sf_dir), "forum")


@query("forum_kept", forum_flagged_sql() + "SELECT id, source, clean AS text FROM f6 WHERE drop_reason IS NULL")
def forum_kept(spark, sf_dir):
    """C1–C15 by value: the cleaned text of every kept forum post."""
    return kept(forum_flagged(spark, sf_dir)).select("id", "source", F.col("clean").alias("text"))


@query("comment_funnel", _funnel_sql(comment_flagged_sql(), _COMMENT_R,
                                     ["n_english", "n_urls", "n_times", "n_quran"], "text_in"))
def comment_funnel(spark, sf_dir):
    """Comment profile funnel."""
    return funnel(comment_flagged(spark, sf_dir), "comment", "text")


@query("comment_kept", comment_flagged_sql() + "SELECT id, source, clean AS text FROM f6 WHERE drop_reason IS NULL")
def comment_kept(spark, sf_dir):
    """C16–C19 by value: the cleaned text of every kept comment."""
    return kept(comment_flagged(spark, sf_dir)).select("id", "source", F.col("clean").alias("text"))


@query("web_funnel", _funnel_sql(web_flagged_sql(), _WEB_R, []))
def web_funnel(spark, sf_dir):
    """Web profile (C20, G10) funnel."""
    return funnel(web_flagged(spark, sf_dir), "web", "text")


@query("web_kept", web_flagged_sql() + "SELECT id, source, clean AS text FROM f6 WHERE drop_reason IS NULL")
def web_kept(spark, sf_dir):
    """C20 by value: the cleaned text of every kept web document."""
    return kept(web_flagged(spark, sf_dir)).select("id", "source", F.col("clean").alias("text"))


# E1 end to end: scraped posts (every arabised post) and a base corpus (the
# posts of labelled documents) → new rows by anti join → union by name →
# post text → forum profile → funnel.
_E1_POSTS = f"""
WITH p AS ({fixture_sql('posts')}),
scraped AS (SELECT CAST(id AS VARCHAR) AS id, text AS selftext, source AS title FROM p),
base AS (SELECT CAST(p.id AS VARCHAR) AS id, p.text AS selftext FROM p JOIN labels l ON p.id = l.doc_id),
merged AS (SELECT id, selftext, title FROM scraped s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id IS NOT DISTINCT FROM s.id)
           UNION ALL SELECT id, selftext, NULL FROM base)
SELECT id, title AS source, {d.strip("concat(coalesce(selftext, ''), ' ', coalesce(title, ''))")} AS text FROM merged
"""


@query("merged_forum_funnel", _funnel_sql(forum_flagged_sql(_E1_POSTS), _FORUM_R, ["n_english", "n_urls", "n_quran"]))
def merged_forum_funnel(spark, sf_dir):
    """Merge scraped and base posts (J1, U2, post text), clean with the
    forum profile and report the funnel (A1, A2)."""
    from qalam.operators.merge import new_rows, post_text, union_sources
    from qalam.sources.tables import read_table
    posts = fixture(spark, sf_dir, "posts")
    labels = read_table(spark, sf_dir, "labels")
    scraped = posts.select(F.col("id").cast("string").alias("id"), F.col("text").alias("selftext"),
                       F.col("source").alias("title"))
    base = (posts.join(labels, posts["id"] == labels["doc_id"], "left_semi")
             .select(F.col("id").cast("string").alias("id"), F.col("text").alias("selftext")))
    merged = union_sources(new_rows(scraped, base, "id"), base)
    posts = merged.select("id", F.col("title").alias("source"), post_text().alias("text"))
    return funnel(clean_forum(posts, "text", **FORUM_ARGS), "forum", "text")
