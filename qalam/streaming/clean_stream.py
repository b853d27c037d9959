"""Stateless streaming cleaning — the batch column functions on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qalam.operators.cleaning import clean_forum, kept
from qalam.sources.files import scratch_path


def clean_stream(stream: DataFrame, text_col: str = "text", **forum_args) -> DataFrame:
    """Kept rows of the forum profile on a streaming DataFrame (no state)."""
    return kept(clean_forum(stream, text_col, **forum_args))


def run_to_table(spark: SparkSession, stream: DataFrame, tag: str, partition_by=None) -> str:
    """Drain a stream (available-now trigger) into Parquet under the shared
    checkpoint folder; the query's own checkpoint makes a restart resume."""
    out = scratch_path(spark, tag)
    w = (stream.writeStream.format("parquet").option("path", out + "/data")
               .option("checkpointLocation", out + "/_ckpt").trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()
    return out + "/data"
