"""Streaming packing with a running per-source offset.

Each micro-batch (``foreachBatch``) encodes its documents, computes offsets
inside the batch (two-level prefix sum), adds the per-source offsets
committed by earlier batches, cuts shard pieces and writes them under
``batch_id=<n>``, then commits its own end offsets under the same batch id.
A replayed batch overwrites exactly its own partition and offsets, so the
output is idempotent; offsets only come from batches with a smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalam.operators.pack import cut_shards, doc_offsets
from qalam.plans.session import materialize


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, on whatever storage the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def pack_batch(spark: SparkSession, batch: DataFrame, batch_id: int, encode_fn, shard_size: int, out_dir: str,
               part_col: str = "source", order_col: str = "doc_id") -> None:
    """One micro-batch: encode, place after the offsets committed by earlier
    batches, cut, write pieces and end offsets under ``batch_id`` (replays
    overwrite only their own partition)."""
    pieces_dir, offs_dir = f"{out_dir}/pieces", f"{out_dir}/offsets"
    enc = encode_fn(batch)
    # only a missing folder means that no batch is committed; any other failure to read stops the query
    if path_exists(spark, offs_dir):
        prior = (spark.read.parquet(offs_dir).filter(F.col("batch_id") < batch_id)
                      .groupBy(F.col(part_col).alias("__p")).agg(F.max("end_offset").alias("base")))
    else:
        prior = spark.createDataFrame([], "__p string, base long")
    local = doc_offsets(materialize(enc), "n_tokens", order_col, part_col)
    placed = materialize(local.join(prior, local[part_col].eqNullSafe(F.col("__p")), "left").drop("__p")
                         .withColumn("base", F.coalesce("base", F.lit(0)))
                         .withColumn("start", F.col("start") + F.col("base"))
                         .withColumn("end", F.col("end") + F.col("base")))
    pieces = cut_shards(placed, "ids", shard_size, part_col).withColumn("batch_id", F.lit(batch_id))
    (pieces.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("batch_id").parquet(pieces_dir))
    ends = placed.groupBy(part_col).agg(F.max("end").alias("end_offset")).withColumn("batch_id", F.lit(batch_id))
    (ends.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(offs_dir))


def pack_stream(spark: SparkSession, stream: DataFrame, encode_fn, shard_size: int, out_dir: str,
                part_col: str = "source", order_col: str = "doc_id"):
    """Start the packing query; returns the StreamingQuery.

    ``encode_fn(batch_df) -> DataFrame(order_col, part_col, ids, n_tokens)``.
    Pieces land in ``out_dir/pieces``, offsets in ``out_dir/offsets``.
    Documents of a later batch must come later in ``order_col`` order.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        pack_batch(spark, batch, batch_id, encode_fn, shard_size, out_dir, part_col, order_col)

    return (stream.writeStream.foreachBatch(handle)
                  .option("checkpointLocation", f"{out_dir}/_ckpt").trigger(availableNow=True).start())
