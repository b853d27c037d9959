"""Registered queries for the file sources and sinks.

Each writes data derived from the given tables into the session's shared
checkpoint folder with a library sink, then reads it back with the matching
library source; the result is checked against SQL over the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from qalam.operators.pack import shard_manifest, write_shards
from qalam.operators.transcripts import first_file_per_name, transcripts_to_docs
from qalam.plans import duck as d
from qalam.plans import scoring, transcripts  # noqa: F401  (their oracles are reused)
from qalam.plans.packing import STREAM_SQL, _pieces
from qalam.plans.registry import ORACLES, query
from qalam.sources.files import (read_glob_csv, read_parallel_tsv, read_paragraphs, read_run_log, read_transcripts,
                                 scratch_path, write_files, write_paragraphs, write_table)
from qalam.sources.fixtures import fixture, fixture_sql
from qalam.sources.tables import read_table


@query("csv_families", """
SELECT CAST(doc_id AS VARCHAR) AS id, text AS selftext, source AS title, lang, NULL::VARCHAR AS quality FROM documents
UNION ALL
SELECT CAST(d.doc_id AS VARCHAR), d.text, NULL, NULL, CAST(l.quality AS VARCHAR) FROM documents d JOIN labels l USING (doc_id)""")
def csv_families(spark, sf_dir):
    """S10 → S1: two CSV families written, read back by glob, unioned by name."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    root = scratch_path(spark, "s1-csv")
    write_table(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("selftext"),
                            F.col("source").alias("title"), "lang"), f"{root}/scraped", fmt="csv")
    write_table(docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("id"),
                                                    F.col("text").alias("selftext"),
                                                    F.col("quality").cast("string").alias("quality")),
                f"{root}/base", fmt="csv")
    df = read_glob_csv(spark, [f"{root}/scraped/*.csv", f"{root}/base/*.csv"])
    return df.select("id", "selftext", "title", "lang", "quality")


_TSV_SPLIT = "CASE sent_id % 10 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END"


@query("parallel_tsv", f"""WITH pl AS ({fixture_sql('parallel_long')})
SELECT sent_id, {_TSV_SPLIT} AS split, lang, regexp_replace(sent, '[\\t\\n\\r]', ' ', 'g') AS sent
FROM pl WHERE sent IS NOT NULL""")
def parallel_tsv(spark, sf_dir):
    """The long parallel table written as TSV (one text column per row's
    ``lang``), read back as one table; rows without a sentence drop out."""
    pl = fixture(spark, sf_dir, "parallel_long")
    out = pl.select(F.col("sent_id").cast("string").alias("sentID.BTEC"),
                    F.expr(_TSV_SPLIT).alias("split"), "lang",
                    F.regexp_replace("sent", "[\\t\\n\\r]", " ").alias("sent"))
    root = scratch_path(spark, "s2-tsv")
    write_table(out, root, fmt="csv", sep="\t")
    return read_parallel_tsv(spark, root)


@query("paragraphs", f"""WITH p AS (SELECT unnest(string_split(text, chr(10) || chr(10))) AS t FROM documents),
c AS (SELECT {d.strip("replace(t, chr(10), ' ')")} AS text FROM p)
SELECT text FROM c WHERE text <> ''""")
def paragraphs(spark, sf_dir):
    """S9 → S3: documents joined by blank lines, read back one per block."""
    root = scratch_path(spark, "s3-par")
    write_paragraphs(read_table(spark, sf_dir, "documents"), "text", root)
    return read_paragraphs(spark, root)


@query("run_log_file", ORACLES["run_log"])
def run_log_file(spark, sf_dir):
    """Log lines written as a text file and parsed by the file reader."""
    root = scratch_path(spark, "s5-log")
    fixture(spark, sf_dir, "run_log").select("line").write.mode("overwrite").text(root)
    return read_run_log(spark, root)


@query("shard_files", STREAM_SQL + f"""
SELECT source, split, CAST(shard_index AS BIGINT) AS shard_index, CAST(count(*) AS BIGINT) AS n_tokens,
  CAST(4 * count(*) AS BIGINT) AS n_bytes, printf('%s_%s_%06d', source, split, shard_index) AS name
FROM shards GROUP BY ALL""")
def shard_files(spark, sf_dir):
    """Pieces written partitioned by source/split/shard, manifest from the files."""
    root = scratch_path(spark, "s11-shards")
    write_shards(_pieces(spark, sf_dir), root)
    back = spark.read.parquet(root).withColumn("shard_index", F.col("shard_index").cast("long"))
    return shard_manifest(back).select("source", "split", "shard_index", "n_tokens", "n_bytes", "name")


@query("transcript_files_read", ORACLES["transcript_docs"])
def transcript_files_read(spark, sf_dir):
    """Subtitle files written one per path, read back recursively as
    binary files, decoded, and turned into documents."""
    root = scratch_path(spark, "s4-vtt")
    write_files(fixture(spark, sf_dir, "transcripts"), "path", "content", root)
    files = read_transcripts(spark, root)
    orig = F.url_decode(F.regexp_extract("path", "/[0-9]+-([^/]+)$", 1))
    files = files.select(orig.alias("path"), F.element_at(F.split(orig, "/"), -1).alias("file_name"), "content")
    pick = first_file_per_name(files).select("path")
    return transcripts_to_docs(files.join(pick, "path", "left_semi"))


@query("first_documents", "SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 100")
def first_documents(spark, sf_dir):
    """S6 + L5: a bounded corpus read — the first 100 documents by doc_id (the
    limit is the feature; planned as a top-k, no full sort)."""
    from qalam.sources.files import read_corpus
    df = read_corpus(spark, f"{sf_dir.rstrip('/')}/documents.parquet", limit=100, order_col="doc_id")
    return df.select("doc_id", "source", "text")
