"""Rows numbered by sampled key ranges: the base of offsets and global ranks.

Spark's range partitioning samples the keys, so ranges hold about equally many
rows whatever the key's type and however its values are spread; a hot group is
split over many ranges.  The range number is written out with the row, so that
every later pass sees the same ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.plans.session import materialize

MOST_RANGES = 20_000      # bounds the table of ranges; beyond it ranges grow


def range_numbered(df: DataFrame, order: list, rows: int = 4096) -> DataFrame:
    """``df`` with ``__r``, the number of its key range, rising in ``order``."""
    n = max(1, min(MOST_RANGES, -(-df.count() // max(1, rows))))
    return materialize(df.repartitionByRange(n, *order).withColumn("__r", F.spark_partition_id()))
