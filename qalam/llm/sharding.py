"""Sharding by proportional stratified interleaving (operator 1, native).

Rows of each source are shuffled by a seeded key and ranked; the rank divided
by the source's size (the fractional rank) spreads every source evenly over
the unit interval.  Sorting all rows by it and cutting the order into equal
runs gives shards that all match the mixture of sources.

Both rankings are two-level: rows are ranked inside small buckets and each
bucket adds the number of rows in the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalam.llm.common import buckets_for, key_bucket, running_offsets, seeded_key, source_key

ROWS_PER_BUCKET = 256


def shard_rows(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source",
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source``.

    The law is ``rows``: shard sizes differ by one row at most.  ``size`` is the
    text's UTF-8 bytes plus 1 (a null text has none: size 1, CRC 0).  A null
    source is a source of its own; a null id is shuffled like any other.
    Repeated rows each get their own slot, ties are broken by size and CRC
    (rows equal in all of these are interchangeable).  ``slot`` is gapless from
    0 within the shard.  An empty table gives an empty result; other columns
    are ignored.
    """
    n = docs.count()
    k = buckets_for(n, rows_per_bucket)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = (rows.withColumn("src", source_key(F.col("source")))
            .withColumn("key", seeded_key(seed, F.col("doc_id"))).withColumn("b", key_bucket(F.col("key"), k)))
    tie = ["key", F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]

    per = rows.groupBy("src", "b").agg(F.count(F.lit(1)).alias("rows"))
    total = per.groupBy("src").agg(F.sum("rows").alias("of"))
    offsets = running_offsets(per, ["src"], "b", "rows", "before").join(total, "src").drop("rows")
    ranked = (rows.withColumn("r", F.row_number().over(Window.partitionBy("src", "b").orderBy(*tie)))
              .join(offsets, ["src", "b"]).withColumn("rank", F.col("before") + F.col("r"))
              .withColumn("frac", (F.col("rank") - F.lit(0.5)) / F.col("of")).drop("r", "b", "before", "rank", "of")
              .withColumn("f", F.floor(F.col("frac") * F.lit(float(k))).cast("long")))

    cells = running_offsets(ranked.groupBy("f").agg(F.count(F.lit(1)).alias("rows")), [], "f", "rows", "before")
    placed = (ranked.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy("frac", "src", *tie)))
              .join(cells.drop("rows"), "f").withColumn("pos", F.col("before") + F.col("r") - 1))
    shard = F.expr(f"(pos * {shards}) div {max(1, n)}")
    return (placed.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.expr(f"pos - (cast(shard as bigint) * {n} + {shards - 1}) div {shards}").cast("long"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "source"))
