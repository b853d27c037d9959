"""Merging scraped sources and describing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalam.functions.text import py_strip


def new_rows(scraped: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """Scraped rows whose key is not in ``base`` (null matches null, as
    ``isin`` does).  Anti join: Catalyst/AQE broadcast the base only when it is
    small by statistics; otherwise both sides shuffle on the key."""
    b = base.select(F.col(key).alias("__k"))
    return scraped.join(b, scraped[key].eqNullSafe(b["__k"]), "left_anti")


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Union all by column name; columns missing from a source are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def tag_sources(named: dict[str, DataFrame], tag_col: str = "source") -> DataFrame:
    """Concatenate several sources with a source tag column."""
    return union_sources(*[d.withColumn(tag_col, F.lit(k)) for k, d in named.items()])


def post_text(selftext: str = "selftext", title: str = "title") -> Column:
    """``strip(coalesce(selftext,'') || ' ' || coalesce(title,''))``."""
    return py_strip(F.concat(F.coalesce(F.col(selftext), F.lit("")), F.lit(" "),
                             F.coalesce(F.col(title), F.lit(""))))


def describe_text(df: DataFrame, col: str) -> DataFrame:
    """A3: count, unique, top, freq of a text column (exact; ties: smallest text).

    Counted by a 32-byte digest with map-side partial aggregation; only the
    digests with the highest count are joined back to find the smallest text.
    """
    t = F.col(col)
    rows = df.where(t.isNotNull()).select(t.alias("t"), F.unhex(F.sha2(t, 256)).alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("long").alias("count"), F.count(F.lit(1)).cast("long").alias("unique"),
                       F.max("n").cast("long").alias("freq"))
    top = counts.join(total.select(F.col("freq").alias("n")), "n", "left_semi").select("h")
    least = rows.join(top, "h", "left_semi").agg(F.min("t").alias("top"))
    # two one-row tables
    return (total.withColumn("__k", F.lit(1)).join(least.withColumn("__k", F.lit(1)), "__k")
                 .select("count", "unique", "top", "freq"))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A4: rows per value, descending."""
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias(name)).orderBy(F.desc(name), col)


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """L3: a reproducible sample of ``n`` rows: the ``n`` smallest
    ``md5(seed:key)`` (a top-k, planned as TakeOrderedAndProject, no full sort)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("__h", h).orderBy("__h").limit(n).drop("__h")
