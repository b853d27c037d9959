"""Parallel corpus reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def widen(long: DataFrame, langs, key: str = "sent_id", lang_col: str = "lang",
          text_col: str = "sent") -> DataFrame:
    """One text column per language — the N-way outer merge on sentence id
    as one shuffle (``groupBy(key).pivot``) instead of N-1 chained joins.
    A key with two rows of one language is an error, as a merge would multiply it."""
    one = long.groupBy(key, lang_col).agg(F.max(text_col).alias("__t"), F.count(F.lit(1)).alias("__n"))
    text = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("two sentences for key "), F.col(key).cast("string"))))
    one = one.withColumn("__t", F.coalesce(text.cast("string"), F.col("__t")))
    return one.groupBy(key).pivot(lang_col, list(langs)).agg(F.first("__t"))


def duplicate_keys(long: DataFrame, key: str = "sent_id", lang_col: str = "lang") -> DataFrame:
    """Keys that break the pivot/merge equivalence (empty when the widening is exact)."""
    return long.groupBy(key, lang_col).count().filter(F.col("count") > 1)


def unpivot_texts(wide: DataFrame, langs, key: str = "sent_id") -> DataFrame:
    """Wide table → ``(key, lang, text)`` labelled examples, nulls dropped."""
    return (wide.unpivot([key], list(langs), "lang", "text").filter(F.col("text").isNotNull()))


def drop_all_null(wide: DataFrame, cols) -> DataFrame:
    """L2: drop rows whose text columns are all null."""
    return wide.dropna(how="all", subset=list(cols))


def first_n_per_group(df: DataFrame, n: int, group_col: str, order_col: str) -> DataFrame:
    """L1: first ``n`` rows per group (row_number ≤ n; Spark plans a per-task
    group limit before the shuffle, so a hot group is cut early)."""
    w = Window.partitionBy(group_col).orderBy(order_col)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def first_pairs(wide: DataFrame, src: str, tgt: str, n: int, key: str = "sent_id") -> DataFrame:
    """L1, pair form: the first ``n`` rows by key with both texts (a top-k, no full sort)."""
    both = wide.filter(F.col(src).isNotNull() & F.col(tgt).isNotNull())
    return both.orderBy(key).limit(n).select(key, F.col(src).alias("src"), F.col(tgt).alias("tgt"))


def row_argmax(cols) -> F.Column:
    """Name of the column with the largest value; first maximum wins,
    nulls skipped; null when all are null."""
    cands = F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("neg_idx"), F.lit(c).alias("name"))
                      for i, c in enumerate(cols)])
    best = F.array_max(F.filter(cands, lambda s: s["v"].isNotNull()))
    return best["name"]
