"""Token packing: document offsets, shard pieces, manifests, training blocks.

W1  document start offsets: two-level prefix sum (never one unpartitioned
    window over documents): documents are bucketed by sampled key ranges; the
    bucket totals get the running sum; each bucket adds its own running sum.
    Buckets bound the work per window partition even when one source holds a
    third of all rows.
U4  shard cut: a document covering tokens ``[start, end)`` is cut into one
    piece per shard it touches (``explode(sequence(start div S, (end-1) div S))``
    + ``slice``); a shard is never one row.
U5  split naming: shard 0 of a source is ``val``, the others ``train``.
U6  next-token blocks per rank, computed from the pieces by arithmetic: an epoch, or
    any range of steps over epochs, reading only the shards they lie in.
M5  truncate / pad to a fixed length.
S11 shard manifest; A15 pack accounting; A16 token budget.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qalam.operators.ranges import range_numbered
from qalam.plans.session import materialize

# Special tokens and their ids, in the reference's order.
SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>", "<mask>"]
PAD, UNK, BOS, EOS, MASK = 0, 1, 2, 3, 4
TOKENS_PER_STEP = 131072   # fixed value: tokens per optimizer step


def ordered_rank(df: DataFrame, n_col: str, key_col: str, first: int = 1, range_rows: int = 4096) -> DataFrame:
    """Dense 1-based rank of ``key_col`` by (``n_col`` desc, ``key_col`` asc) —
    a global order without a window over all rows: rank = rows in earlier key
    ranges + row number inside the range.  Ranges come from sampled keys, so
    equal counts or a common prefix split like any other rows; the running sum
    sees one row per range only.
    """
    order = [F.col(n_col).desc_nulls_last(), F.col(key_col).asc_nulls_first()]
    b = range_numbered(df, order, range_rows)
    per = b.groupBy("__r").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__r", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    inner = Window.partitionBy("__r").orderBy(*order)
    return (b.join(per, "__r")
             .withColumn("rank", (F.col("__off") + F.row_number().over(inner) - 1 + first).cast("long"))
             .drop("__r", "__off"))


def doc_offsets(docs: DataFrame, n_col: str = "n_tokens", order_col: str = "doc_id",
                part_col: str = "source", bucket_rows: int = 4096) -> DataFrame:
    """Per-source running start offset of every document in ``order_col``
    order.  Adds ``start`` and ``end`` (LongType).

    Keys may have any sortable type and spread; a null source is a source of its
    own.  A key that stands twice in a source is an error: ties would make the
    order undefined.  Buckets are sampled ranges of (source, key) of about
    ``bucket_rows`` documents.
    """
    d = range_numbered(docs.select(F.col(part_col).alias("__p"), F.col(order_col).alias("__k"), F.col(n_col).alias("__n")),
                       [F.col("__p").asc_nulls_first(), F.col("__k").asc_nulls_first()], bucket_rows)
    totals = d.groupBy("__p", "__r").agg(F.sum("__n").cast("long").alias("__tot"))
    wb = Window.partitionBy("__p").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__p").alias("__tp"), F.col("__r").alias("__tr"),
                           F.coalesce(F.sum("__tot").over(wb), F.lit(0)).cast("long").alias("__boff"))
    wk = Window.partitionBy("__p", "__r").orderBy("__k")
    inner = F.coalesce(F.sum("__n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = (F.row_number().over(wk) > 1) & F.col("__k").eqNullSafe(F.lag("__k").over(wk))
    d = d.withColumn("__in", inner).withColumn("__again", again)
    fail = F.raise_error(F.concat(F.lit("key twice in one source: "), F.coalesce(F.col("__k").cast("string"), F.lit("null"))))
    starts = (d.join(totals, F.col("__p").eqNullSafe(F.col("__tp")) & (F.col("__r") == F.col("__tr")))
               .select("__p", "__k", F.when(F.col("__again"), fail.cast("long")).otherwise(F.col("__boff") + F.col("__in"))
                       .cast("long").alias("start")))
    return (docs.join(starts, docs[part_col].eqNullSafe(F.col("__p")) & docs[order_col].eqNullSafe(F.col("__k")))
                .withColumn("end", (F.col("start") + F.col(n_col)).cast("long")).drop("__p", "__k"))


def cut_shards(docs: DataFrame, ids_col: str, shard_size: int, part_col: str = "source") -> DataFrame:
    """U4 + U5: pieces ``(source, split, shard_index, pos, piece)``.

    ``docs`` needs ``start``/``end`` from :func:`doc_offsets`.  Concatenating a
    source's pieces by (shard_index, pos) gives its token stream; every shard
    but the last of a source holds exactly ``shard_size`` tokens.
    """
    s = F.lit(shard_size).cast("long")
    d = docs.filter(F.col("end") > F.col("start"))
    sh = F.explode(F.sequence(F.floor(F.col("start") / s).cast("long"),
                              F.floor((F.col("end") - 1) / s).cast("long"))).alias("shard_index")
    p = d.select(part_col, "start", "end", ids_col, sh)
    lo = F.greatest(F.col("start"), F.col("shard_index") * s)
    hi = F.least(F.col("end"), (F.col("shard_index") + 1) * s)
    return p.select(
        part_col,
        F.when(F.col("shard_index") == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        "shard_index",
        (lo - F.col("shard_index") * s).alias("pos"),
        F.slice(ids_col, (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


def shard_name(part_col: str = "source") -> Column:
    """``<tag>_<split>_<%06d>``, the reference's shard file name."""
    return F.format_string("%s_%s_%06d", F.col(part_col), F.col("split"), F.col("shard_index"))


def shard_manifest(pieces: DataFrame, part_col: str = "source", extra=()) -> DataFrame:
    """Tokens and bytes (4 per uint32 id) per shard (plus ``extra`` aggregates)."""
    return (pieces.groupBy(part_col, "split", "shard_index")
                  .agg(F.sum(F.size("piece")).cast("long").alias("n_tokens"), *extra)
                  .withColumn("n_bytes", F.col("n_tokens") * 4)
                  .withColumn("name", shard_name(part_col)))


def shard_folder(part_col: str, part, split: str, index: int) -> str:
    """The folder of a shard below the shards' root, as Spark names partitions; no source and an empty one share a name."""
    from qalam.sources.files import escaped
    name = lambda x: escaped(str(x)) if x not in (None, "") else "__HIVE_DEFAULT_PARTITION__"
    return f"{escaped(part_col)}={name(part)}/split={name(split)}/shard_index={name(index)}"


def _shard_files(root: str, part_col: str, batches):
    """One file per shard, from rows in shard order; the last three columns name the shard.

    A file gets its name when it is whole, always the same one, so a task that runs again leaves no second."""
    import itertools
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark import TaskContext
    task = TaskContext.get()
    writer, last, name, n = None, None, "", 0

    def close():
        writer.close()
        os.replace(f"{name}.{task.taskAttemptId()}", name.replace("/.part-", "/part-"))
    for batch in batches:
        rows, at = batch.select(batch.schema.names[:-3]), 0
        for shard, same in itertools.groupby(zip(*(batch.column(k).to_pylist() for k in (-3, -2, -1)))):
            size = sum(1 for _ in same)
            if shard != last:
                if writer is not None:
                    close()
                folder = f"{root}/{shard_folder(part_col, *shard)}"
                os.makedirs(folder, exist_ok=True)
                # no source and an empty one share a folder, not a file
                name = f"{folder}/.part-{task.partitionId():05d}{'' if shard[0] else '-none' if shard[0] is None else '-empty'}.parquet"
                last, n = shard, n + 1
                writer = pq.ParquetWriter(f"{name}.{task.taskAttemptId()}", rows.schema)
            writer.write_batch(rows.slice(at, size))
            at += size
    if writer is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def write_shards(pieces: DataFrame, path: str, part_col: str = "source") -> None:
    """S11 sink: Parquet partitioned by source/split/shard, pieces kept as rows in
    stream order (``pos``) within a shard's file.

    On a file system path the tasks write the files themselves: there Spark's writer starts a process for each of the
    many small files and moves them one by one through the driver."""
    shard = [part_col, "split", "shard_index"]
    rows = pieces.repartition(*shard).sortWithinPartitions(*shard, "pos")
    out = pieces.limit(0) if path.startswith(("/", "file:")) else rows
    out.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", out is rows).partitionBy(*shard).parquet(path)
    if out is not rows:
        root = "/" + path.removeprefix("file:").strip("/")
        rows = rows.select(*[c for c in pieces.columns if c not in shard], F.col(part_col).cast("string").alias(part_col), "split", "shard_index")
        rows.mapInArrow(functools.partial(_shard_files, root, part_col), "n long").agg(F.sum("n")).collect()


def blocks_per_shard(length: Column, rank: int, world: int, B: int, T: int) -> Column:
    """U6 block count for one rank on one shard: ``max(1, (len-1-r*BT) div (P*BT))``,
    0 when the shard is too short for block 0 (the reference would fail)."""
    bt = B * T
    n = F.greatest(F.lit(1), F.floor((length - 1 - rank * bt) / F.lit(world * bt)))
    return F.when(length >= rank * bt + bt + 1, n).otherwise(F.lit(0)).cast("long")


def _routed(pieces: DataFrame, bt: int, keep: list) -> DataFrame:
    """Every piece with the numbers ``g`` of the blocks it overlaps."""
    a, b = F.col("pos"), F.col("pos") + F.size("piece")
    first = F.greatest(F.lit(0), F.ceil(a / F.lit(bt)) - 1).cast("long")
    last = F.floor((b - 1) / F.lit(bt)).cast("long")
    return pieces.select(*keep, "pos", "piece", F.explode(F.sequence(first, last)).alias("g"))


def _gathered(parts: DataFrame, bt: int, shard: list) -> DataFrame:
    """The ``bt + 1`` ids of every block from the pieces routed to it (bounded groups)."""
    start = F.col("g") * bt
    lo = F.greatest(F.col("pos"), start)
    hi = F.least(F.col("pos") + F.size("piece"), start + bt + 1)
    p = parts.select(*shard, "g", lo.alias("lo"),
                     F.slice("piece", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    return (p.groupBy(*shard, "g")
             .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "part"))), lambda s: s["part"])).alias("ids")))


def _block_rows(blocks: DataFrame, B: int, T: int, keep: list) -> DataFrame:
    rows = F.posexplode(F.sequence(F.lit(0), F.lit(B - 1)))
    return blocks.select(*keep, "ids", rows).select(
        *keep, F.col("pos").alias("row"), F.slice("ids", F.col("pos") * T + 1, T).alias("x"),
        F.slice("ids", F.col("pos") * T + 2, T).alias("y"))


def training_blocks(pieces: DataFrame, B: int, T: int, world: int, split: str,
                    part_col: str = "source") -> DataFrame:
    """``(name, rank, step, row, x, y)`` rows of the B×T next-token blocks
    every rank reads in one epoch; shards in name order, chosen by substring
    (as the reference does), blocks never cross shards, tail ids skipped.

    Global block g of a shard starts at ``g*BT`` and needs ``BT+1`` ids; rank
    ``g mod P`` reads it as its block ``g div P`` if the reference's bound
    allows.  Each piece is routed to the blocks it overlaps; a block collects
    at most ``BT+1`` ids (bounded group).
    """
    bt = B * T
    named = pieces.withColumn("name", shard_name(part_col)).filter(F.col("name").contains(split))
    lens = named.groupBy("name").agg(F.sum(F.size("piece")).cast("long").alias("len"))
    p = named.join(lens, "name")
    p = _routed(p, bt, ["name", "len"])
    r, k = F.col("g") % world, F.floor(F.col("g") / world)
    start = F.col("g") * bt
    ok = ((start + bt + 1 <= F.col("len"))
          & ((k == 0) | (r * bt + (k + 1) * world * bt + 1 <= F.col("len"))))
    blk = _gathered(p.filter(ok), bt, ["name"])
    # step numbering: blocks of earlier shards (name order) for the same rank
    per = (lens.select("name", *[blocks_per_shard(F.col("len"), rr, world, B, T).alias(f"n{rr}")
                                  for rr in range(world)]))
    w = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("name", *[F.coalesce(F.sum(f"n{rr}").over(w), F.lit(0)).alias(f"o{rr}")
                               for rr in range(world)])
    blk = blk.join(per, "name")
    rank = (F.col("g") % world).cast("int")
    off = F.element_at(F.array(*[F.col(f"o{rr}") for rr in range(world)]), rank + 1)
    blk = blk.select("name", rank.alias("rank"), (off + F.floor(F.col("g") / world)).cast("long").alias("step"), "ids")
    return _block_rows(blk, B, T, ["name", "rank", "step"])


def steps_per_epoch(manifest: DataFrame, B: int, T: int, world: int, split: str, part_col: str = "source") -> list[int]:
    """Blocks of every rank in one pass over the shards."""
    m = manifest.filter(shard_name(part_col).contains(split))
    return [int(n or 0) for n in m.agg(*[F.sum(blocks_per_shard(F.col("n_tokens"), r, world, B, T)).alias(f"n{r}")
                                         for r in range(world)]).first()]


def step_index(manifest: DataFrame, B: int, T: int, world: int, split: str, first: int, last: int,
               part_col: str = "source") -> DataFrame:
    """U6 by step: ``(source, split, shard_index, rank, step, g)``: the shard and block that each rank reads
    at the steps ``first`` to ``last - 1``, without a look at any id.

    After a rank's last block the reader starts over with the first shard, so steps go on through any number of
    epochs; ranks may have epochs of different lengths.  Every shard works out its own steps in the range from the
    blocks before it; no step is joined to a range of shards.  A rank without blocks has no steps."""
    m = manifest.select(part_col, "split", "shard_index", F.col("n_tokens").alias("len"), shard_name(part_col).alias("name"))
    m = m.filter(F.col("name").contains(split))
    by_name = Window.orderBy("name", "len")          # a row per shard, as in training_blocks
    every = Window.partitionBy()
    ranks = []
    for r in range(world):
        n = blocks_per_shard(F.col("len"), r, world, B, T)
        ranks.append(F.struct(F.lit(r).alias("rank"), n.alias("n"),
                              F.coalesce(F.sum(n).over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                              F.sum(n).over(every).alias("total")))
    x = m.withColumn("__r", F.array(*ranks)).select(part_col, "split", "shard_index", F.inline("__r")).filter("n > 0")
    lo, hi = F.lit(first).cast("long"), F.lit(last).cast("long")
    x = x.filter(lo < hi).withColumn("epoch", F.explode(F.sequence(F.floor(lo / F.col("total")), F.floor((hi - 1) / F.col("total")))))
    begin = F.col("epoch") * F.col("total") + F.col("before")
    x = x.withColumn("begin", begin).withColumn("from", F.greatest(lo, "begin")).withColumn("to", F.least(hi, F.col("begin") + F.col("n")))
    x = x.filter("from < to").withColumn("step", F.explode(F.sequence(F.col("from"), F.col("to") - 1)))
    return x.select(part_col, "split", "shard_index", "rank", "step",
                    ((F.col("step") - F.col("begin")) * world + F.col("rank")).cast("long").alias("g"))


MOST_LISTED_SHARDS = 10_000      # shards named in a scan's partition filter; more are found by the join alone


def read_steps(spark: SparkSession, path: str, manifest: DataFrame, B: int, T: int, world: int, split: str,
               first: int, last: int, part_col: str = "source") -> DataFrame:
    """U6 by step: ``(source, split, shard_index, rank, step, row, x, y)`` of the steps ``first`` to ``last - 1`` of every
    rank, over any number of epochs, from the files that ``write_shards`` left at ``path``.

    ``step_index`` is worked out before the scan.  The folders of the shards it names are listed and become a partition filter,
    so no other shard's file is opened (beyond ``MOST_LISTED_SHARDS`` the join finds them, the result being the same); pieces that overlap no
    asked block drop out before the shuffle; a block asked in several epochs is put together once."""
    shard = [part_col, "split", "shard_index"]
    steps = materialize(step_index(manifest, B, T, world, split, first, last, part_col)
                        .select(F.col(part_col).cast("string").alias(part_col), "split", F.col("shard_index").cast("long").alias("shard_index"),
                                "rank", "step", "g"))
    named = steps.select(*shard).distinct().limit(MOST_LISTED_SHARDS + 1).collect()
    # the columns are known, so no file is opened for them; nor are other shards' folders listed
    kinds = f"pos long, piece array<int>, `{part_col}` string, split string, shard_index long"
    reader = spark.read.schema(kinds)
    folders = sorted({f"{path.rstrip('/')}/{shard_folder(part_col, *r)}" for r in named})
    if not named:
        files = spark.createDataFrame([], kinds)
    elif len(named) > MOST_LISTED_SHARDS:
        files = reader.parquet(path)
    else:
        # a brace in a name would be read as a pattern
        files = reader.parquet(path) if any("}" in f for f in folders) else reader.option("basePath", path).parquet(*folders)
        groups: dict = {}
        for r in named:
            groups.setdefault((r[0], r[1]), []).append(r[2])
        files = files.filter(functools.reduce(lambda a, b: a | b, [
            F.col(part_col).cast("string").eqNullSafe(F.lit(p)) & (F.col("split") == s) & F.col("shard_index").isin(sorted(ids))
            for (p, s), ids in groups.items()]))
    files = files.withColumn(part_col, F.col(part_col).cast("string")).withColumn("shard_index", F.col("shard_index").cast("long"))
    tag = F.coalesce(F.col(part_col), F.lit("")).alias("__tag"), F.col(part_col).isNull().alias("__none")     # a null source is a source
    key = ["__tag", "__none", "split", "shard_index"]
    asked = steps.select(*tag, "split", "shard_index", "g").distinct()
    parts = _routed(files.select(*tag, "split", "shard_index", "pos", "piece"), B * T, key).join(asked, [*key, "g"])
    blocks = _gathered(parts, B * T, key)
    meant = steps.select(*tag, F.col(part_col), "split", "shard_index", "rank", "step", "g")
    return _block_rows(blocks.join(meant, [*key, "g"]), B, T, [part_col, "split", "shard_index", "rank", "step"])


def pad_truncate(ids: Column, max_len: int, pad: int = PAD) -> Column:
    """M5: first ``max_len`` ids, right-padded with ``pad``."""
    head = F.slice(ids, 1, max_len)
    return F.concat(head, F.array_repeat(F.lit(pad), F.lit(max_len) - F.size(head)))


def pack_accounting(encoded: DataFrame, pieces: DataFrame, part_col: str = "source",
                    ids_col: str = "ids", min_ids: int = 3, filtered: DataFrame | None = None) -> DataFrame:
    """Per source and in total (``is_total``), documents kept and dropped (an
    encoding with only bos/eos counts as dropped), drop rate, tokens, shards.

    ``filtered`` holds the documents a filter dropped before encoding; they are
    counted as ``docs_filtered``."""
    none = F.lit(0).cast("long")
    docs = encoded.select(F.col(part_col), F.when(F.size(ids_col) >= min_ids, 1).otherwise(0).alias("k"),
                          F.when(F.size(ids_col) < min_ids, 1).otherwise(0).alias("d"), none.alias("f"), none.alias("t"),
                          F.lit(None).cast("long").alias("s"))
    cut = pieces.select(F.col(part_col), F.lit(0).alias("k"), F.lit(0).alias("d"), none.alias("f"),
                        F.size("piece").cast("long").alias("t"), F.col("shard_index").cast("long").alias("s"))
    rows = docs.unionByName(cut)
    if filtered is not None:
        rows = rows.unionByName(filtered.select(F.col(part_col), F.lit(0).alias("k"), F.lit(0).alias("d"),
                                                F.lit(1).cast("long").alias("f"), none.alias("t"),
                                                F.lit(None).cast("long").alias("s")))
    # a source's shards are numbered from 0 without gaps
    per = rows.groupBy(part_col).agg(F.sum("k").cast("long").alias("docs_kept"), F.sum("d").cast("long").alias("docs_dropped"),
                                     F.sum("f").cast("long").alias("docs_filtered"), F.sum("t").cast("long").alias("tokens"),
                                     F.coalesce(F.max("s") + 1, F.lit(0)).cast("long").alias("shards"))
    names = ["docs_kept", "docs_dropped", "docs_filtered", "tokens", "shards"]
    whole = per.agg(*[F.sum(n).cast("long").alias(n) for n in names])
    both = per.withColumn("is_total", F.lit(False)).unionByName(
        whole.withColumn(part_col, F.lit(None).cast("string")).withColumn("is_total", F.lit(True)))
    seen = F.col("docs_kept") + F.col("docs_dropped")
    return both.withColumn("drop_rate", F.col("docs_dropped") / F.greatest(seen, F.lit(1)))


def token_budget(pieces: DataFrame) -> DataFrame:
    """Train and val tokens and steps per epoch at 131,072 tokens per step."""
    return (pieces.agg(F.sum(F.when(F.col("split") == "train", F.size("piece"))).cast("long").alias("train_tokens"),
                       F.sum(F.when(F.col("split") == "val", F.size("piece"))).cast("long").alias("val_tokens"))
                  .fillna(0)
                  .withColumn("steps_per_epoch", F.floor(F.col("train_tokens") / TOKENS_PER_STEP).cast("long")))
