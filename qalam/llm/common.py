"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qalam.plans.session import ensure_checkpoint_dir, materialize, ship_package  # noqa: F401
from qalam.sources.tables import read_table

#: Words are runs of characters other than these (space, tab, line feed to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def count_words(text: Column) -> Column:
    """Words of a text that is not null, without an array of them: runs of space between words, and one."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    joined = F.regexp_replace(inner, r"[\x20\x09-\x0D]+", " ")
    gaps = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(" "), F.lit("")))
    return (gaps + (inner != "").cast("int")).cast("long")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex[:16]}"


def source_key(col: Column) -> Column:
    """A non-null grouping key that keeps null apart from every string."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col.cast("string")))


def buckets_for(rows: int, rows_per_bucket: int, most: int = 1 << 22) -> int:
    """Number of buckets so that each holds about ``rows_per_bucket`` rows."""
    return int(max(1, min(most, -(-rows // max(1, rows_per_bucket)))))


def seeded_key(seed: int, *cols: Column) -> Column:
    """Hex MD5 of the seed and the columns: a shuffle order every engine computes alike."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def spread_key(seed: int, id_col: Column, text: Column, row: Column) -> Column:
    """``seeded_key`` of the id; rows without an id take their text and row number in its
    place, so that many of them spread like others."""
    return F.when(id_col.isNull(), seeded_key(seed, F.lit("null"), F.xxhash64(text), row)).otherwise(seeded_key(seed, id_col))


def key_bucket(key: Column, n: int) -> Column:
    """Bucket 0..n-1 of a hex MD5 key; buckets follow the order of the keys."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(head * F.lit(n) / F.lit(float(1 << 32))).cast("long")


def running_offsets(buckets: DataFrame, part: list[str], bucket: str, value: str, out: str,
                    fan: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier buckets of the same ``part``.

    ``buckets`` has one row per (part, bucket).  Two levels: sums of ``fan``
    neighbouring buckets get the running sum first, then each bucket adds its
    own, so no task sees all buckets of a hot part."""
    b = buckets.withColumn("__hi", F.floor(F.col(bucket) / fan))
    hi = b.groupBy(*part, "__hi").agg(F.sum(value).alias("__hv"))
    whole = Window.partitionBy(*(part or [F.lit(0)])).orderBy("__hi").rowsBetween(Window.unboundedPreceding, -1)
    hi = hi.withColumn("__ho", F.coalesce(F.sum("__hv").over(whole), F.lit(0))).drop("__hv")
    inner = Window.partitionBy(*part, "__hi").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (b.withColumn("__lo", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(hi, [*part, "__hi"])
            .withColumn(out, F.col("__ho") + F.col("__lo")).drop("__ho", "__lo", "__hi"))
