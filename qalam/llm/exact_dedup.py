"""Exact deduplication by skew-safe combining (operator 6, native).

1. Rows are grouped by (digest, text) inside each task: Spark's partial
   aggregation, the local deduplication.
2. Rows of hot digests get a salt and are merged per (digest, salt, text).
3. The salt winners are combined per (digest, text).

The whole text is a grouping key at every stage, so equal digests of different
texts never merge.  Only the rows of hot digests pass through stage 3; the
hot digests are at most ``1 / hot_share`` by construction, so their broadcast
is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalam.llm.common import materialize

HOT_SHARE = 1e-4
HOT_ROWS = 256
SALTS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS,
                digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays.  A null text counts as
    the empty text.  A null id never wins over another id; a group of null ids
    only has a null ``keep_id`` and keeps its rows.  Repeated rows (same id and
    text) count in ``group_size`` and share one decision.  An empty table gives
    an empty result; other columns of ``docs`` are ignored.

    ``digest`` maps the SHA-256 column to the grouping digest (tests use a
    short one to force collisions).
    """
    digest = digest or (lambda sha: sha)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")) \
        .withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = rows.withColumn("digest", digest(F.col("sha")))
    keys = materialize(rows.select("id", "sha", "digest"))

    sizes = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    least = max(hot_rows, int(keys.count() * hot_share))
    hot = materialize(sizes.filter(F.col("rows") > least).select("digest"))   # <= 1 / hot_share rows

    def best(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))

    content = rows.select("id", "digest", "text")
    cold_groups = best(content.join(F.broadcast(hot), "digest", "left_anti"), "digest", "text")
    salted = content.join(F.broadcast(hot), "digest", "left_semi") \
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    hot_groups = best(salted, "digest", "salt", "text").groupBy("digest", "text") \
        .agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))

    def classes(groups: DataFrame) -> DataFrame:
        """Per digest its class, and whether different texts share the digest."""
        return groups.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"),
                                            (F.count(F.lit(1)) > 1).alias("shared"))

    cold, warm = materialize(classes(cold_groups)), materialize(classes(hot_groups))
    decided = (keys.join(F.broadcast(hot), "digest", "left_anti").join(cold.filter("not shared"), "digest")
               .unionByName(keys.join(F.broadcast(warm.filter("not shared")), "digest"))
               .select("id", "sha", "keep", "n"))
    shared = cold.unionByName(warm).filter("shared").select("digest")
    if not shared.isEmpty():   # one digest, different texts: assign by the text itself
        among = rows.join(shared, "digest", "left_semi")
        texts = cold_groups.unionByName(hot_groups).join(shared, "digest", "left_semi")
        decided = decided.unionByName(among.join(texts, ["digest", "text"]).select("id", "sha", "keep", "n"))
    return decided.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
