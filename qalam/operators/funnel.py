"""A1/A2: the cleaning funnel and counters as a single aggregation pass.

The reference filters one gate at a time (a frame copy per gate).  Here the
flagged frame carries one ``drop_reason`` and the whole funnel is one
``agg`` with conditional counts: a map-side partial aggregate per task and a
one-row final merge, so it scales with the input and never shuffles rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.operators.cleaning import COMMENT_REASONS, FORUM_REASONS, WEB_REASONS

_FORUM_COLS = {"empty": "removed_empty", "deleted": "removed_deleted",
               "spaced_arabic": "removed_spaced_ar", "no_arabic": "removed_no_arabic",
               "low_arabic": "removed_low_ar", "too_short": "removed_short",
               "numbers_only": "removed_numbers"}
_COMMENT_COLS = {"empty": "removed_empty", "emoji_only": "removed_emoji_only",
                 "foreign": "removed_foreign", "no_arabic": "removed_no_arabic",
                 "low_arabic": "removed_low_ar", "too_short": "removed_short",
                 "numbers_only": "removed_numbers"}
_WEB_COLS = {"too_short_raw": "removed_short_raw", "too_short_clean": "removed_short_clean",
             "low_arabic": "removed_low_ar"}

PROFILES = {
    "forum": (FORUM_REASONS, _FORUM_COLS, ["n_english", "n_urls", "n_quran"]),
    "comment": (COMMENT_REASONS, _COMMENT_COLS, ["n_english", "n_urls", "n_times", "n_quran"]),
    "web": (WEB_REASONS, _WEB_COLS, []),
}
_COUNTER_NAMES = {"n_english": "english_words_removed", "n_urls": "urls_removed",
                  "n_times": "timestamps_removed", "n_quran": "quran_chars_removed"}


def funnel(flagged: DataFrame, profile: str, text_col: str) -> DataFrame:
    """One-row funnel: rows removed per gate in gate order, totals, shares, counters.

    ``chars_before`` counts every input row (null counts 0), counters count
    every row that reached cleaning, ``chars_after`` the kept rows.
    """
    reasons, names, counters = PROFILES[profile]
    r = F.col("drop_reason")
    aggs = [F.count(F.lit(1)).alias("total_raw")]
    aggs += [F.count_if(r == name).alias(names[name]) for name in reasons]
    aggs += [F.count_if(r.isNull()).alias("final_clean"),
             F.coalesce(F.sum(F.length(F.col(text_col))), F.lit(0)).cast("long").alias("chars_before"),
             F.coalesce(F.sum(F.when(r.isNull(), F.length("clean"))), F.lit(0))
              .cast("long").alias("chars_after")]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(_COUNTER_NAMES[c]) for c in counters]
    out = flagged.agg(*aggs)
    total, kept = F.col("total_raw"), F.col("final_clean")
    return (out.withColumn("total_removed", total - kept)
               .withColumn("kept_share", kept / F.greatest(total, F.lit(1)))
               .withColumn("char_retention", F.col("chars_after") / F.greatest(F.col("chars_before"), F.lit(1))))


def funnel_long(flagged: DataFrame, profile: str) -> DataFrame:
    """A1 in long form: ``(step, drop_reason, n_rows)`` for every gate in
    order, zeros included, plus step 0 = kept.  One aggregation pass, then an
    unpivot of the one-row result (no join, no driver round trip)."""
    reasons, _names, _ = PROFILES[profile]
    r = F.col("drop_reason")
    wide = flagged.agg(F.count_if(r.isNull()).alias("s0"),
                       *[F.count_if(r == name).alias(f"s{i}") for i, name in enumerate(reasons, 1)])
    labels = ["kept"] + reasons
    return (wide.unpivot([], [f"s{i}" for i in range(len(labels))], "step_key", "n_rows")
                .withColumn("step", F.substring("step_key", 2, 3).cast("int"))
                .withColumn("drop_reason", F.element_at(F.array(*[F.lit(x) for x in labels]),
                                                        F.col("step") + 1))
                .select("step", "drop_reason", F.col("n_rows").cast("long").alias("n_rows")))
