"""Test inputs derived from the given tables, as SQL both engines run unchanged.

The driver's documents hold Latin-script prose only, so Arabic text is made
with ``translate``.  Each recipe is valid in Spark SQL and DuckDB; Spark runs
it with DataFrame parameters (``{documents}``), DuckDB against its views.
The recipe outputs grow with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qalam.sources.tables import read_table

# Fixed value: the letter map used to write Arabic text from Latin prose.
LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنه"
AR = f"translate(lower(text),'{LATIN}','{ARABIC}')"

# Whole texts with what the cleaning steps look for, and for every document one
# short row (placeholder, blank, emoji, numbers, spaced letters) beside it.
POSTS = f"""
SELECT doc_id AS id, source, CASE doc_id % 12
  WHEN 0 THEN text
  WHEN 1 THEN concat({AR}, ' ', 'ۗ۠۩', ' ', {AR})
  WHEN 2 THEN concat('/u/someone r/place ', {AR}, ' u/other_1')
  WHEN 3 THEN concat('.. ', {AR}, ' -- سلام ، ... عليكم')
  WHEN 4 THEN concat({AR}, ' https://ex.org/a?b=1 @user #tag ok')
  WHEN 5 THEN concat('<b> ', {AR}, ' </b> &amp; 😀😀 12:30 !!!')
  WHEN 6 THEN concat('‏', {AR}, '‎ ‫سلام‬')
  WHEN 7 THEN concat('إلى مدرسةٌ كِتابـــ ', {AR})
  WHEN 8 THEN concat(text, ' ', {AR})
  WHEN 9 THEN concat({AR}, chr(10), '-----', chr(10), '... س ل ا م ع ل ي ك م ...')
  ELSE {AR} END AS text
FROM {{documents}}
UNION ALL
SELECT -1 - doc_id AS id, source, CASE doc_id % 7
  WHEN 0 THEN '[deleted]'
  WHEN 1 THEN NULL
  WHEN 2 THEN '   '
  WHEN 3 THEN 'سلام عليكم'
  WHEN 4 THEN '😀 😀 ❤'
  WHEN 5 THEN '123 456 - 789'
  ELSE 'س ل ا م كتاب ع ل ي ك باب و ر ح م ماء ا ل ل ه دار ب ر ك ا نور س ل ا م كتاب ع ل ي ك باب' END AS text
FROM {{documents}}
"""

TRANSCRIPTS = """
SELECT concat('dir', CAST(doc_id % 3 AS VARCHAR(20)), '/f', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR(20)), '.vtt') AS path,
  concat('f', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR(20)), '.vtt') AS file_name,
  concat('WEBVTT', chr(10), 'Kind: captions', chr(10), 'Language: ar', chr(10), chr(10),
    '00:00:01.000 --> 00:00:02.000', chr(10), '>> ', replace(text, '. ', concat('.', chr(10))), chr(10),
    '[music] [noise]', chr(10), 'x<00:00:01.500><c> tail</c> [fx] end', chr(10), 'x<00:00:01.500><c> tail</c> [fx] end', chr(10), 'z') AS content
FROM {documents}
"""

PARALLEL_LONG = f"""
SELECT CAST(floor(doc_id / 4) AS BIGINT) AS sent_id,
  CASE doc_id % 4 WHEN 0 THEN 'MSA' WHEN 1 THEN 'ALX' WHEN 2 THEN 'CAI' ELSE 'BEI' END AS lang,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {AR} END AS sent
FROM {{documents}}
"""

# The same with many sentences: every text in sixteen consecutive parts, one null in fourteen.
PARALLEL_SENTENCES = f"""
SELECT CAST(floor(doc_id / 4) AS BIGINT) * 16 + k AS sent_id,
  CASE doc_id % 4 WHEN 0 THEN 'MSA' WHEN 1 THEN 'ALX' WHEN 2 THEN 'CAI' ELSE 'BEI' END AS lang,
  CASE WHEN doc_id % 7 = 0 AND k % 2 = 0 THEN NULL ELSE translate(lower(substr(text, CAST(floor(length(text) * k / 16) AS INT) + 1,
    CAST(floor(length(text) * (k + 1) / 16) AS INT) - CAST(floor(length(text) * k / 16) AS INT))), '{LATIN}', '{ARABIC}') END AS sent
FROM {{documents}} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) AS v(k)
"""

PREDICTIONS = """
SELECT c.k AS checkpoint, e.vec_id,
  e.label AS target,
  CASE WHEN (e.vec_id + c.k) % 3 = 0 THEN (e.label + 1) % 10 WHEN e.vec_id % 11 = c.k THEN 0 ELSE e.label END AS pred
FROM {embeddings} e CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) c
"""

RUN_LOG = """
SELECT event_id, CASE WHEN event_id % 50 = 7 THEN 'saving model' WHEN event_id % 100 = 0
  THEN concat(CAST(event_id AS VARCHAR(20)), ' val ', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), '.5')
  ELSE concat(CAST(event_id AS VARCHAR(20)), ' train ', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), '.25') END AS line
FROM {events}
"""

LOSSES = """
SELECT event_type AS dialect, event_id, abs(value) % 10 AS loss, user_id % 50 AS n_tokens FROM {events}
"""

RECIPES = {
    "posts": (POSTS, ("documents",)),
    "transcripts": (TRANSCRIPTS, ("documents",)),
    "parallel_long": (PARALLEL_LONG, ("documents",)),
    "parallel_sentences": (PARALLEL_SENTENCES, ("documents",)),
    "predictions": (PREDICTIONS, ("embeddings",)),
    "run_log": (RUN_LOG, ("events",)),
    "losses": (LOSSES, ("events",)),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run a recipe in Spark over the tables of ``sf_dir``.

    The base tables are spread over the task slots first when they scan as
    fewer partitions (uneven row groups), so the recipe's own string work is
    parallel; at scale this is a no-op."""
    from qalam.plans.session import spread
    sql, tables = RECIPES[name]
    return spark.sql(sql, **{t: spread(read_table(spark, sf_dir, t)) for t in tables})


def fixture_sql(name: str) -> str:
    """The same recipe for DuckDB, reading its pre-registered views."""
    sql, tables = RECIPES[name]
    return sql.format(**{t: t for t in tables})
