"""Filter interaction audit by incremental retraction streaming (operator 11).

Five filters are asked of every text: how many documents each removes depends
on the order in which they run.  All orders follow from one small table, the
number of documents per part, labels and mask of failed filters.

The files arrive as available-now micro-batches.  Filters A to D look at a text
alone.  E fails when a smaller id has the same text, which later files may still
bring: state keyed by the text's SHA-256 holds the rows with the smallest id so
far; they count as passing E.  When a smaller id arrives, the state retracts
their masks from the part counters, adds them again with E, and holds the new
rows.  The counters are a table of differences, summed at the end.

A hot text does not reach one task row by row: each Arrow batch first settles
the rows that a smaller id in the same batch already fails, whatever the state
holds, and sends on sums and its smallest ids only.  State is kept by groups of
texts, so that a group's rows are merged in one step.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qalam.llm.common import fresh_folder

FILTERS = "ABCDE"
_E = 1 << FILTERS.index("E")
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
BATCHES = 4                       # micro-batches, about: each takes this share of the input's bytes
BYTES_PER_GROUP = 4 << 20         # of input for one group of texts in the state
LEAST_GROUPS = 256
_SPACE = r"[\x20\x09-\x0D]+"
_KINDS = ["part", "mask", "good", "toxic"]


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text (not null) fails."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    blank = (inner == "").cast("int")            # splitting an empty text gives one empty word
    split = F.split(inner, _SPACE)
    words, distinct = F.size(split) - blank, F.size(F.array_distinct(split)) - blank
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (words < MIN_WORDS, distinct * 100 < words * MIN_DISTINCT_PERCENT,
             capitals * 100 > F.length(text) * MAX_CAPITALS_PERCENT, text.rlike(SYMBOLS))
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def _settle(zero, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per Arrow batch: the rows with the smallest id of each text, and sums of all others.

    Sums have no digest.  Rows without an id have no smaller id and are none to others."""
    for batch in batches:
        if not batch.num_rows:
            continue
        named = batch.column("id").is_valid()
        free = batch.filter(pa.compute.invert(named)).drop_columns(["id", "digest"]).to_pandas()
        rows = batch.filter(named).to_pandas()
        least = rows["id"] == rows.groupby("digest", sort=False)["id"].transform("min")
        late = rows.loc[~least, _KINDS]
        sums = pd.concat([free[_KINDS], late.assign(mask=late["mask"] | _E)]).groupby(_KINDS).size()
        held = rows[least].groupby(["digest", "id", *_KINDS]).size().reset_index(name="n")
        sums = sums.reset_index(name="n").assign(digest=None, id=zero)
        cols = ["digest", "id", *_KINDS, "n"]
        schema = pa.schema([batch.schema.field("digest"), batch.schema.field("id"),
                            *(batch.schema.field(k) for k in _KINDS), pa.field("n", pa.int64())])
        for part in (held, sums):
            if len(part):
                yield pa.RecordBatch.from_pandas(part[cols], schema=schema, preserve_index=False)


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(payload) as r:
        return r.read_pandas()


def _retract(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Merge a micro-batch's rows of one group of texts into its state; yields differences."""
    held = _unpack(bytes(state.get[0])) if state.exists else None
    out, by, changed = [], ["digest", "id", *_KINDS], False
    for pdf in frames:
        sums = pdf["digest"].isna()
        out.append(pdf.loc[sums, [*_KINDS, "n"]])
        new = pdf.loc[~sums, [*by, "n"]]
        if not len(new):
            continue
        changed = True
        new = new.assign(digest=new["digest"].map(bytes), old=False)
        both = new if held is None else pd.concat([held.assign(old=True), new], ignore_index=True)
        least = both["id"] == both.groupby("digest", sort=False)["id"].transform("min")
        lost = both[~least]
        back = lost.loc[lost["old"]]
        out.append(back.assign(n=-back["n"])[[*_KINDS, "n"]])                  # no longer the smallest: retract
        out.append(lost.assign(mask=lost["mask"] | _E)[[*_KINDS, "n"]])
        out.append(both.loc[least & ~both["old"], [*_KINDS, "n"]])
        held = both[least].groupby(by, sort=False)["n"].sum().reset_index()
    if changed:
        state.update((_pack(held),))
    sums = pd.concat(out).groupby(_KINDS)["n"].sum().reset_index()
    yield sums[sums["n"] != 0]


def _bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def count_masks(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, groups: int | None = None,
                id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, good, toxic, n``: documents of the Parquet files at ``path`` (a path or
    glob that Spark reads) by part, failed filters and labels.

    ``labels`` has ``doc_id, quality, toxic``; a document without a row is neither good
    nor toxic, one with several is what any of them says.  ``batches`` says into about how
    many micro-batches the files are dealt (whole files; at least one each)."""
    table = spark.read.parquet(path)
    size = max(1, _bytes(table))
    groups = groups or max(LEAST_GROUPS, -(-size // BYTES_PER_GROUP))
    kind = dict(table.dtypes)[id_col]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", str(-(-size // batches))).parquet(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stream.select(F.col(id_col).cast("long" if whole else "string").alias("id"),
                         F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                         F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         text_mask(text).alias("mask"))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long" if whole else "string").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")).withColumn("salt", F.lit(0))
    # rows without an id find no label: a seeded draw (the same when a scan task runs again) spreads them
    salt = F.when(F.col("id").isNull(), F.floor(F.rand(17) * (1 << 20))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("salt", salt).join(known, ["id", "salt"], "left").select(
        "id", "digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    id_kind = "long" if whole else "string"
    settled = rows.mapInArrow(functools.partial(_settle, 0 if whole else ""), f"digest binary, id {id_kind}, part string, "
                              "mask int, good int, toxic int, n long")
    group = F.pmod(F.when(F.col("digest").isNull(), F.xxhash64(*_KINDS, "n")).otherwise(F.xxhash64("digest")), F.lit(groups))
    changes = settled.withColumn("texts", group).groupBy("texts").applyInPandasWithState(
        _retract, "part string, mask int, good int, toxic int, n long", "held binary", "append", "NoTimeout")
    folder = fresh_folder(spark, "audit")
    (changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress")
     .trigger(availableNow=True).start(f"{folder}/changes").awaitTermination())
    found = spark.read.schema("part string, mask int, good int, toxic int, n long").parquet(f"{folder}/changes")
    return found.groupBy(*_KINDS).agg(F.sum("n").alias("n")).filter("n <> 0")


def interactions(masks: DataFrame) -> DataFrame:
    """From ``count_masks`` one row per part, order of the filters and step:
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``.  Each group of masks is read 600 times, each part has
    at most 128 groups."""
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    asked = sum((F.when(place[f] < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    own = sum((F.when(place[f] == F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = masks.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")) \
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")) \
        .withColumn("before", F.col("mask").bitwiseAND(asked)).withColumn("own", own) \
        .withColumn("fails", F.col("mask").bitwiseAND(F.col("own")) != 0)
    gone, here = F.col("before") != 0, F.col("fails") & (F.col("before") == 0)
    # in one of popcount(mask) orders the filter is the first that a document fails
    share = F.col("n") * (F.lit(len(orders)) / F.bit_count("mask")).cast("long")

    def total(when: Column, what: Column | None = None) -> Column:
        return F.sum(F.when(when, F.col("n") if what is None else what).otherwise(F.lit(0).cast("long")))

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~F.col("fails")).alias("kept"), total(here).alias("removed"),
        total(F.col("fails") & gone).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here & (F.col("good") == 1)).alias("good_lost"), total(here & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(F.col("fails"), share).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """``interactions`` of the files at ``path``.

    A null text is empty: it fails A alone.  A null part is the empty string.  A
    row without an id fails E never and makes no other fail; repeated rows (same
    id and text) do not fail each other.  Texts of any length are asked whole.
    An empty table gives an empty result; other columns are ignored."""
    return interactions(count_masks(spark, path, labels, **options))
