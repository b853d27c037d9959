"""Reading the given parquet tables (column pruning and filters reach the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_glob(sf_dir: str, name: str) -> str:
    """A table's path as a pattern: a file stream takes a single file as well as a folder of part files from it."""
    return f"{sf_dir.rstrip('/')}/{name}.parque[t]"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table as a file stream."""
    return spark.readStream.schema(read_table(spark, sf_dir, name).schema).parquet(table_glob(sf_dir, name))
