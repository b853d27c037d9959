"""Document fingerprints by one-permutation MinHash (operator 4, native).

The hash of every word 5-gram falls into the bin of its top bits; each bin keeps
its smallest hash.  Empty bins are filled by optimal densification: bin ``b``
borrows from the first non-empty bin in an order of its own.  The fingerprint
packs the low 8 bits of every bin.  Two fingerprints agree in a bin by chance
once in 256, which the likeness corrects for.

Everything is DataFrame functions; a document's hashes stay in its row (a sorted
array), so nothing is exploded or shuffled for a fingerprint.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW = 8
RANGES = 1024              # id ranges with sampled bounds
ROWS_PER_BUCKET = 128


def borrowing_orders(bins: int = BINS, seed: int = 71) -> list[list[int]]:
    """For each bin the order in which it looks for a non-empty one."""
    rng = random.Random(seed)
    return [rng.sample(range(bins), bins) for _ in range(bins)]


def with_fingerprint(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """Adds ``out``: an array of ``BINS`` ints, empty for a text without words.  A text of
    fewer words than ``words`` has one gram, the whole sequence."""
    orders = "array(" + ",".join("array(" + ",".join(map(str, o)) + ")" for o in borrowing_orders()) + ")"
    df = df.withColumn("__w", F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
                                          lambda w: F.xxhash64(w)))
    grams = F.transform(F.sequence(F.lit(0), F.size("__w") - words),
                        lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(words)]))
    df = df.withColumn("__g", F.sort_array(F.when(F.size("__w") >= words, grams).when(
        F.size("__w") > 0, F.array(F.xxhash64("__w"))).otherwise(F.expr("cast(array() as array<bigint>)"))))
    shift = 64 - BIN_BITS
    first = F.filter("__g", lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get("__g", i - 1), shift)))
    df = df.withColumn("__f", first).drop("__w", "__g")
    df = df.withColumn("__b", F.transform("__f", lambda x: (F.shiftright(x, shift) + BINS // 2).cast("int")))

    def value(b: Column) -> Column:
        own = F.array_position("__b", b)
        other = F.array_position("__b", F.get(F.array_intersect(F.get(F.expr(orders), b), "__b"), F.lit(0)))
        at = F.when(own > 0, own).otherwise(other)
        return F.get("__f", (at - 1).cast("int")).bitwiseAND((1 << LOW) - 1).cast("int")

    filled = F.when(F.size("__f") > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)) \
        .otherwise(F.expr("cast(array() as array<int>)"))
    return df.withColumn(out, filled).drop("__f", "__b")


def packed(values: Column) -> Column:
    """Two hex digits a bin."""
    return F.concat_ws("", F.transform(values, lambda v: F.substring(F.hex(v + 256), 2, 2)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the gram sets, 0 to 1; texts without words are
    like each other and unlike all others."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << LOW)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), estimate).otherwise(
        (F.size(a) == F.size(b)).cast("double"))


def _bucketed(rows: DataFrame, id_col: str, per_bucket: int) -> DataFrame:
    """Adds ``r`` (id range) and ``b`` (bucket), both rising with the id and holding about
    equally many rows: sampled bounds cut the ids into ranges, a range is cut evenly.  Null ids
    come below all others, bucketed by their text's hash."""
    ids = rows.select(F.col(id_col).cast("double").alias("id")).filter("id is not null")
    n, known = rows.count(), ids.count()
    ranges = max(1, min(RANGES, known // per_bucket))
    sub = max(1, -(-known // (ranges * per_bucket)))
    fine = 1 << max(0, (ranges - 1).bit_length() // 2)
    cuts = sorted(set(ids.approxQuantile("id", [i / ranges for i in range(ranges + 1)], 0.2 / ranges))) if known else [0.0]
    groups = [cuts[i:i + fine] for i in range(0, len(cuts), fine)]

    def array(values) -> Column:
        return F.expr("array(" + ",".join(f"{v!r}D" for v in values) + ")")

    x = F.col(id_col).cast("double")
    g = F.greatest(F.size(F.filter(array([c[0] for c in groups]), lambda c: c <= x)), F.lit(1))
    inner = F.get(F.expr("array(" + ",".join("array(" + ",".join(f"{v!r}D" for v in c) + ")" for c in groups) + ")"), g - 1)
    r = (g - 1) * fine + F.greatest(F.size(F.filter(inner, lambda c: c <= x)), F.lit(1)) - 1
    lo, hi = F.get(array(cuts), F.col("r")), F.get(array([*cuts[1:], cuts[-1]]), F.col("r"))
    part = F.when(hi > lo, F.floor((x - lo) / (hi - lo) * sub)).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.lit(sub - 1), part))
    nulls = max(1, (n - known) // per_bucket)
    return (rows.withColumn("r", F.when(x.isNull(), -1).otherwise(r).cast("int"))
            .withColumn("b", F.when(x.isNull(), F.pmod(F.xxhash64("text"), F.lit(nulls)) - nulls)
                        .otherwise(F.col("r").cast("long") * sub + part).cast("long")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``doc_id, text, next_text, fp, next_fp``: each document with the next one in
    descending id order (after the last: the first) and both fingerprints.

    Texts are shuffled once, by buckets of the id; the last row of a bucket gets the
    first of the next bucket.  Equal ids follow each other by text, null ids come
    last.  A null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _bucketed(rows, "doc_id", per_bucket)
    buckets = rows.groupBy("r", "b").agg(F.count(F.lit(1)).alias("n"))
    # the next lower bucket that has rows: inside the range, else the highest of the range below, else the very highest
    inside = F.lag("b").over(Window.partitionBy("r").orderBy("b"))
    tops = buckets.groupBy("r").agg(F.max("b").alias("top"))          # <= RANGES + 1 rows
    every = Window.partitionBy(F.lit(0))
    below = F.coalesce(F.lag("top").over(every.orderBy("r")), F.max("top").over(every))
    follows = (buckets.withColumn("inside", inside).join(tops.select("r", below.alias("below")), "r")
               .select(F.col("b").alias("from_b"), F.coalesce("inside", "below").alias("to_b")))

    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    w = Window.partitionBy("b").orderBy(*order)
    seen = rows.select("b", "doc_id", "text").select(
        "*", F.lead("text").over(w).alias("lead_text"), F.lag(F.lit(1)).over(w).isNull().alias("head"))
    heads = with_fingerprint(seen.filter("head").select(F.col("b").alias("to_b"), F.col("text").alias("head_text")),
                             "head_text", "head_fp")
    heads = heads.join(follows, "to_b").select(F.col("from_b").alias("b"), "head_text", "head_fp")
    joined = seen.join(heads, "b", "left")
    joined = joined.select("b", "doc_id", "text", F.coalesce("lead_text", "head_text").alias("next_text"),
                           F.when(F.col("lead_text").isNull(), F.col("head_fp")).alias("head_fp"))
    joined = with_fingerprint(joined, "text", "fp")
    return joined.withColumn("next_fp", F.coalesce("head_fp", F.lead("fp").over(w))).drop("b", "head_fp")


def fingerprint_edits(docs: DataFrame, **options) -> DataFrame:
    """Fingerprints of every document and of its edited text (the last half of its code
    points replaced by the first as many of the next document), and the likeness of
    the document to its edited text and to the next document.

    One row per input row; an empty table gives an empty result; other columns are
    ignored; see ``with_next`` for nulls and repeated ids."""
    rows = with_next(docs, **options).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
                      F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"), packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
