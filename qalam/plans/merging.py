"""Registered queries: merge, describe, sample, corpus lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalam.operators.merge import describe_text, hash_sample, new_rows, post_text, union_sources, value_counts
from qalam.plans import duck as d
from qalam.plans.cleaning import forum_flagged, forum_flagged_sql
from qalam.plans.registry import query
from qalam.sources.files import pick_text_column, write_corpus_lines
from qalam.sources.tables import read_table

# Scraped posts: every document (id, selftext, title); the base corpus: the
# documents that already carry labels (id, selftext, quality).
MERGE_SQL = f"""
WITH scraped AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS selftext, source AS title, lang FROM documents),
base AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS selftext, l.quality
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
fresh AS (SELECT * FROM scraped s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id IS NOT DISTINCT FROM s.id)),
merged AS (SELECT id, selftext, title, lang, NULL AS quality FROM fresh
           UNION ALL SELECT id, selftext, NULL AS title, NULL AS lang, quality FROM base)
"""


def merged_posts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    scraped = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("selftext"),
                          F.col("source").alias("title"), "lang")
    base = (docs.join(labels, "doc_id")
                .select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("selftext"), "quality"))
    return union_sources(new_rows(scraped, base, "id"), base)


@query("merge_sources", MERGE_SQL + f"""
SELECT id, title, lang, CAST(quality AS BIGINT) AS quality,
  {d.strip("concat(coalesce(selftext, ''), ' ', coalesce(title, ''))")} AS text FROM merged""")
def merge_sources(spark, sf_dir):
    """J1 + U2 + post text: new scraped rows, union by name with the base."""
    m = merged_posts(spark, sf_dir)
    return m.select("id", "title", "lang", F.col("quality").cast("long").alias("quality"),
                    post_text().alias("text"))


@query("describe_merged_text", MERGE_SQL + f""",
t AS (SELECT {d.strip("concat(coalesce(selftext, ''), ' ', coalesce(title, ''))")} AS text FROM merged),
c AS (SELECT text, count(*) AS n FROM t WHERE text IS NOT NULL GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS unique,
  arg_min(text, (-n, text)) AS top, CAST(max(n) AS BIGINT) AS freq FROM c""")
def describe_merged_text(spark, sf_dir):
    """A3 on the merged post text."""
    return describe_text(merged_posts(spark, sf_dir).select(post_text().alias("text")), "text")


@query("rows_per_source", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source")
def rows_per_source(spark, sf_dir):
    """A4: row counts per source, descending."""
    return value_counts(read_table(spark, sf_dir, "documents"), "source", "n")


@query("rows_per_drop_reason", forum_flagged_sql() + """
SELECT coalesce(drop_reason, 'kept') AS drop_reason, CAST(count(*) AS BIGINT) AS n FROM f6 GROUP BY 1""")
def rows_per_drop_reason(spark, sf_dir):
    """A4 on the forum funnel's reasons (value counts of a derived column)."""
    fl = forum_flagged(spark, sf_dir).select(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"))
    return value_counts(fl, "drop_reason", "n")


@query("sample_kept_posts", forum_flagged_sql() + """
SELECT id, clean AS text FROM f6 WHERE drop_reason IS NULL
ORDER BY md5(concat('42:', CAST(id AS VARCHAR))) LIMIT 500""")
def sample_kept_posts(spark, sf_dir):
    """L3: reproducible 500-row sample of the kept forum posts (the sample is the feature)."""
    from qalam.operators.cleaning import kept
    k = kept(forum_flagged(spark, sf_dir)).select("id", F.col("clean").alias("text"))
    return hash_sample(k, 500, "id", seed=42)


@query("corpus_lines", f"""
WITH t AS (SELECT {d.strip('text')} AS line FROM documents WHERE text IS NOT NULL)
SELECT unnest(string_split(line, chr(10))) AS line FROM t WHERE line <> ''""")
def corpus_lines(spark, sf_dir):
    """S7 + S8: pick the text column by candidate order, write one text per line."""
    docs = read_table(spark, sf_dir, "documents")
    col = pick_text_column(docs, ["body", "comment_text", "text", "selftext"])
    return write_corpus_lines(docs, col)


@query("tagged_sources", f"""
WITH u AS (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS doc, text FROM documents
           UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text FROM conversations)
SELECT source, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len({d.tokens('text')})) AS BIGINT) AS n_words FROM u GROUP BY source""")
def tagged_sources(spark, sf_dir):
    """Several sources concatenated with a source tag (packed per tag downstream)."""
    from qalam.functions.text import py_split
    from qalam.operators.merge import tag_sources
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    conv = read_table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc"), "text")
    u = tag_sources({"documents": docs, "conversations": conv})
    return u.groupBy("source").agg(F.count(F.lit(1)).cast("long").alias("n_docs"),
                                   F.sum(F.size(py_split(F.col("text")))).cast("long").alias("n_words"))
