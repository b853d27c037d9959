"""Word frequencies and a word-level vocabulary (A17, J5 for word ids).

The word-id encoder is the oracle-friendly stand-in for a learned subword
vocabulary: ids are word ranks (count desc, word asc) after the specials.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.operators.bpe_encode import sliced
from qalam.operators.pack import BOS, EOS, ordered_rank
from qalam.plans.session import materialize

MOST_LOCAL_WORDS = 500_000
MOST_LOCAL_BYTES = 16 << 20
LOOKUP_BYTES = 32 << 20          # bytes of text looked up at a time: Arrow makes its table of the words anew each time


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Whitespace words of all texts in order (``str.split``: Arrow's white space is Python's), and where each text's begin."""
    bare = pa.compute.utf8_trim_whitespace(texts)
    lists = pa.compute.utf8_split_whitespace(bare)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
    sizes[np.asarray(pa.compute.fill_null(pa.compute.binary_length(bare), 0)) == 0] = 0      # a blank text is split into one empty word
    words = lists.flatten()
    return words.filter(pa.compute.not_equal(words, "")), np.concatenate([[0], np.cumsum(sizes)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 0):
        found = pa.compute.value_counts(split_words(batch.column(0))[0])
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over whitespace words, counted per slice of texts before the shuffle."""
    return (docs.select(F.col(text_col)).mapInArrow(_counted, "word string, n long")
                .groupBy("word").agg(F.sum("n").alias("n")))


def word_vocabulary(docs: DataFrame, text_col: str = "text", first_id: int = 5) -> DataFrame:
    """``(word, n, id)``: id = rank by (n desc, word asc) + ``first_id`` - 1."""
    counts = materialize(word_counts(docs, text_col))      # ranking reads the counts several times
    return ordered_rank(counts, "n", "word", first=first_id).withColumnRenamed("rank", "id")


def _ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _looked_up(vocab, unk: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the words; without ``unk`` those not found are null and listed behind."""
    with pa.ipc.open_stream(vocab()) as r:
        table = r.read_all().combine_chunks()
    known, ids = (table.column(c).combine_chunks() for c in ("word", "id"))
    for batch in sliced(batches, -1, LOOKUP_BYTES):
        words, ends = split_words(batch.column(batch.num_columns - 1))
        got = ids.take(pa.compute.index_in(words, value_set=known.cast(words.type)))
        if unk is not None:
            got = got.fill_null(unk)
        cols, names = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), got)], ["ids"]
        if unk is None:
            gone = np.asarray(got.is_null())
            before = np.concatenate([[0], np.cumsum(gone)])[ends].astype("int32")
            cols.append(pa.ListArray.from_arrays(pa.array(before), words.filter(pa.array(gone))))
            names.append("__rare")
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], *names])


def _offsets(lists: pa.ListArray) -> pa.Array:
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))


def encode_words(docs: DataFrame, vocab: DataFrame, key_cols, text_col: str = "text",
                 unk: int = 1) -> DataFrame:
    """J5 + M3 (word level): ``[bos] + ids + [eos]`` per document.

    The ``MOST_LOCAL_WORDS`` smallest ids (the most frequent words, in at most
    ``MOST_LOCAL_BYTES``) go to the tasks, and each document's words are looked up where
    they are.  Only words beyond them are shuffled: they are exploded with row and
    place, joined to the rest of the vocabulary (AQE picks broadcast or a skew-aware
    shuffle join from runtime sizes), and each row's ids fill its gaps in order.
    """
    keys = list(key_cols)
    sizes = vocab.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes"), F.min("id").alias("id")).first()
    all_local = sizes["n"] <= MOST_LOCAL_WORDS and (sizes["bytes"] or 0) <= MOST_LOCAL_BYTES
    hot = vocab if all_local else _hot(vocab, sizes["id"])
    table = hot.select("word", F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
    held = docs.sparkSession.sparkContext.broadcast(_ipc(table))
    rows = docs.select(*keys, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    ends = lambda ids: F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS))).alias("ids")
    if all_local:
        out = rows.mapInArrow(functools.partial(_looked_up, lambda: held.value, unk), f"{kinds}, ids array<int>")
        return out.select(*keys, ends(F.col("ids")))
    rows = rows.select(F.monotonically_increasing_id().alias("__row"), "*")
    part = materialize(rows.mapInArrow(functools.partial(_looked_up, lambda: held.value, None),
                                       f"__row long, {kinds}, ids array<int>, __rare array<string>"))
    rare = part.select("__row", F.posexplode("__rare").alias("i", "word"))
    rest = vocab.join(hot.select("word"), "word", "left_anti").select("word", F.col("id").cast("int").alias("id"))
    # (place, id) packed in one long: a row's order is then a primitive array sort
    shift = F.lit(1 << 32)
    found = (rare.join(rest, "word", "left")
             .groupBy("__row").agg(F.collect_list(F.col("i").cast("long") * shift + F.coalesce("id", F.lit(unk)).cast("long")).alias("__found")))
    joined = part.drop("__rare").join(found, "__row", "left").select(
        *keys, "ids", F.transform(F.array_sort("__found"), lambda x: (x % shift).cast("int")).alias("__found"))
    out = joined.mapInArrow(_filled, f"{kinds}, ids array<int>")
    return out.select(*keys, ends(F.col("ids")))


def _hot(vocab: DataFrame, least: int) -> DataFrame:
    """The words of the smallest ids, as many as may go to the tasks."""
    n = MOST_LOCAL_WORDS
    while True:
        hot = vocab.filter((F.col("id") >= least) & (F.col("id") < least + n))
        got = hot.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
        if got["n"] <= MOST_LOCAL_WORDS and (got["bytes"] or 0) <= MOST_LOCAL_BYTES:
            return hot
        n //= 2


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gaps (nulls) of each row's ids filled in order with the ids found for it."""
    for batch in batches:
        ids, found = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        flat = ids.flatten()
        if flat.null_count:
            flat = pa.compute.replace_with_mask(flat, flat.is_null(), found.flatten())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.ListArray.from_arrays(_offsets(ids), flat)],
                                         names=batch.schema.names[:-1])
