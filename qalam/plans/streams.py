"""Registered streaming queries (T1, T2): documents read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalam.operators.pack import shard_manifest
from qalam.operators.vocab import encode_words, word_vocabulary
from qalam.operators.cleaning import clean_web, kept
from qalam.plans.cleaning import FORUM_ARGS, WEB_ARGS, forum_flagged_sql, web_flagged_sql
from qalam.plans.packing import SHARD, STREAM_SQL, _possum
from qalam.plans.registry import query
from qalam.sources.files import read_corpus, scratch_path
from qalam.sources.fixtures import POSTS
from qalam.sources.tables import read_table, stream_table, table_glob
from qalam.streaming.clean_stream import clean_stream, run_to_table
from qalam.streaming.pack_state import open_pieces, pack_state_stream
from qalam.streaming.pack_stream import pack_stream


@query("stream_clean_kept", forum_flagged_sql() + "SELECT id, source, clean AS text FROM f6 WHERE drop_reason IS NULL")
def stream_clean_kept(spark, sf_dir):
    """Forum cleaning on a file stream of documents; kept rows."""
    docs = stream_table(spark, sf_dir, "documents")
    posts = spark.sql(POSTS, documents=docs)
    kept = clean_stream(posts, "text", **FORUM_ARGS).select("id", "source", F.col("clean").alias("text"))
    return spark.read.parquet(run_to_table(spark, kept, "t1-clean"))


@query("stream_web_kept", web_flagged_sql() + "SELECT id, source, clean AS text FROM f6 WHERE drop_reason IS NULL")
def stream_web_kept(spark, sf_dir):
    """Web cleaning on a file stream of documents; kept rows."""
    docs = stream_table(spark, sf_dir, "documents")
    web = kept(clean_web(spark.sql(POSTS, documents=docs), "text", **WEB_ARGS)).select("id", "source", F.col("clean").alias("text"))
    return spark.read.parquet(run_to_table(spark, web, "t1-web"))


@query("stream_corpus_read", "SELECT page_id, html AS text FROM pages")
def stream_corpus_read(spark, sf_dir):
    """S6 streamed: a corpus whose text column has another name, drained into a table."""
    schema = read_table(spark, sf_dir, "pages").schema
    pages = read_corpus(spark, table_glob(sf_dir, "pages"), text_col="html", streaming=True, schema=schema)
    return spark.read.parquet(run_to_table(spark, pages.select("page_id", "text"), "s6-stream"))


@query("stream_pack_manifest", STREAM_SQL + """
SELECT source, split, CAST(shard_index AS BIGINT) AS shard_index, CAST(count(*) AS BIGINT) AS n_tokens
FROM shards GROUP BY ALL""")
def stream_pack_manifest(spark, sf_dir):
    """Packing in foreachBatch with committed per-source offsets; the
    manifest equals the batch packer's."""
    docs_b = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    vocab = word_vocabulary(docs_b)            # fixed vocabulary learned beforehand
    schema = read_table(spark, sf_dir, "documents").schema
    # the documents arrive in three lots by id; after each the query runs on with its checkpoint
    files = scratch_path(spark, "t2-files")
    docs_t = read_table(spark, sf_dir, "documents")
    cuts = docs_t.approxQuantile("doc_id", [1 / 3, 2 / 3], 0.01)

    def enc(batch):
        return encode_words(batch, vocab, ["doc_id", "source"]).withColumn("n_tokens", F.size("ids"))

    out = scratch_path(spark, "t2-pack")
    low, high = cuts
    for lot in (F.col("doc_id") <= low, (F.col("doc_id") > low) & (F.col("doc_id") <= high), F.col("doc_id") > high):
        docs_t.filter(lot).write.mode("append").parquet(files)
        stream = spark.readStream.schema(schema).parquet(files).select("doc_id", "source", "text")
        pack_stream(spark, stream, enc, SHARD, out).awaitTermination()
    pieces = spark.read.parquet(out + "/pieces")
    assert pieces.select("batch_id").distinct().count() > 1
    return shard_manifest(pieces).select("source", "split", F.col("shard_index").cast("long"), "n_tokens")


@query("stream_state_manifest", STREAM_SQL + """
SELECT source, split, CAST(shard_index AS BIGINT) AS shard_index, CAST(count(*) AS BIGINT) AS n_tokens,
  CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(id * q) AS BIGINT) AS id_possum
FROM shards GROUP BY ALL""")
def stream_state_manifest(spark, sf_dir):
    """T2 in Spark's state: twelve micro-batches, a restart after the first six; full blocks from the
    sink and the open shards from the state make the batch packer's shards, ids included."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    vocab = word_vocabulary(docs)
    encoded = encode_words(docs, vocab, ["doc_id", "source"])
    schema = encoded.schema
    files, out = scratch_path(spark, "t2s-files"), scratch_path(spark, "t2s-pack")
    cuts = encoded.select("doc_id").approxQuantile("doc_id", [k / 12 for k in range(1, 12)], 0.001)
    lot = sum((F.col("doc_id") > c).cast("int") for c in cuts)
    encoded.withColumn("lot", lot).repartition("lot").write.partitionBy("lot").parquet(f"{files}/all")
    lots = spark.read.parquet(f"{files}/all")
    for half in (range(0, 6), range(6, 12)):
        for k in half:       # files in the order of the lots
            lots.filter(F.col("lot") == k).drop("lot").coalesce(1).write.mode("append").parquet(f"{files}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{files}/in")
        pack_state_stream(stream, SHARD, out).awaitTermination()
    pieces = spark.read.parquet(f"{out}/pieces").unionByName(open_pieces(spark, out, SHARD))
    man = shard_manifest(pieces, extra=[
        F.sum(F.aggregate("piece", F.lit(0).cast("long"), lambda a, x: a + x)).cast("long").alias("id_sum"),
        F.sum(_possum("piece", F.col("pos"))).cast("long").alias("id_possum")])
    return man.select("source", "split", F.col("shard_index").cast("long"), "n_tokens", "id_sum", "id_possum")


FIRST = 100


@query("stream_first_documents", f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {FIRST}")
def stream_first_documents(spark, sf_dir):
    """S6/L5 on a stream: the first 100 documents over three batches (the limit is the feature)."""
    docs = read_table(spark, sf_dir, "documents")
    files = scratch_path(spark, "s6-first")
    for lot in (F.col("doc_id") < 40, F.col("doc_id").between(40, 79), F.col("doc_id") >= 80):
        docs.filter(lot).coalesce(1).sortWithinPartitions("doc_id").write.mode("append").parquet(files)
    stream = read_corpus(spark, files, limit=FIRST, streaming=True, schema=docs.schema, max_files=1)
    return spark.read.parquet(run_to_table(spark, stream.select("doc_id", "text"), "s6-first-out"))
