"""Best-fit packing of token sequences (operator 13).

Documents are tokenised, ended and cut into pieces of at most ``CAPACITY`` ids.
Packing depends on nothing but how many pieces have each length, so it is
planned on that histogram (``CAPACITY`` numbers, whatever the corpus):

1. Large items, above a third of the capacity, stand at most twice in a
   sequence.  Greedy matching: the longest takes the longest partner that fits.
2. Smaller items, longest first, go into the tightest gap that holds them
   (best fit); only where no gap does is a sequence opened.

Equal lengths are dealt with in one step, so the plan is a short table of slots
"the next k items of length l stand in sequences s, s+1, ... at offset o".  A
piece finds its slot by its rank among the pieces of its length, a two-level
prefix sum.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalam.llm.bpe_prefix import default_path
from qalam.llm.common import materialize, running_offsets
from qalam.llm.id_files import LibraryEncoder

CAPACITY = 1024
END_ID = 2
_FLUSH = 16 << 20        # bytes of ids in an outgoing batch, about


class Plan(NamedTuple):
    """Slots in the order of (length, rank): the first item of each, the sequence it opens
    with, items per sequence, offset of the first and length; ``base`` numbers the items of
    each length; ``sequences`` counts all."""
    first: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    base: np.ndarray
    sequences: int


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Slots for ``counts[l]`` items of each length 1 to ``capacity``.

    At most one sequence run is split for each length, so the table has a few
    rows per length, however many items there are."""
    left = [int(c) for c in counts]
    base = np.concatenate([[0], np.cumsum(left)])
    used = [0] * (capacity + 1)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]     # room -> runs of sequences
    opened = 0

    def put(length: int, items: int, sequence: int, per: int, offset: int) -> None:
        slots.append((int(base[length]) + used[length], sequence, per, offset, length))
        used[length] += items
        left[length] -= items

    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a] and b > third:                # the longest partner that fits
            k = left[a] // 2 if b == a else min(left[a], left[b])
            if k:
                put(a, k, opened, 1, 0)
                put(b, k, opened, 1, a)
                gaps[capacity - a - b].append((opened, k))
                opened += k
            b -= 1
        if left[a]:
            gaps[capacity - a].append((opened, left[a]))
            opened += left[a]
            put(a, left[a], opened - left[a], 1, 0)
    for a in range(third, 0, -1):
        room = a
        while left[a]:
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:                     # no gap: open as many as the items fill
                n = -(-left[a] // (capacity // a))
                room = capacity
                gaps[room].append((opened, n))
                opened += n
            run, n = gaps[room].pop()
            per, offset = room // a, capacity - room
            full, rest = divmod(min(left[a], n * per), per)
            if full:
                put(a, full * per, run, per, offset)
                gaps[room - per * a].append((run, full))
            if rest:
                put(a, rest, run + full, per, offset)
                gaps[room - rest * a].append((run + full, 1))
            taken = full + bool(rest)
            if taken < n:
                gaps[room].append((run + taken, n - taken))
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    return Plan(*table.T, base, opened)


_OPEN: dict[str, LibraryEncoder] = {}


def _cut(path: str, capacity: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents; the first takes what whole pieces leave."""
    if path not in _OPEN:
        _OPEN[path] = LibraryEncoder(path)
    encode = _OPEN[path]

    def out(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        take, *cols = zip(*rows)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), *map(pa.array, cols, kinds)],
                                          names=[batch.schema.names[0], "piece", "start", "length", "ids"])

    for batch in batches:
        rows, size = [], 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
            start, end = 0, (len(ids) - 1) % capacity + 1
            for piece in range(-(-len(ids) // capacity)):
                rows.append((i, piece, start, end - start, ids[start:end].tobytes()))
                start, end = end, end + capacity
            size += 4 * len(ids)
            if size >= _FLUSH:
                yield out(batch, rows)
                rows, size = [], 0
        if rows:
            yield out(batch, rows)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) for every piece
    of every document: its ids by the tokenizers library, then ``end_id``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_cut, path or default_path(), capacity, end_id),
                           f"doc_id {kind}, piece int, start long, length long, ids binary")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    The rows are written once with a row number; the histogram of lengths is all
    that reaches the driver, and the plan, bounded by ``capacity``, all that
    goes back."""
    rows = materialize(cut.withColumn("__row", F.monotonically_increasing_id())) \
        .withColumn("__part", F.shiftright("__row", 33))      # the task that wrote the row
    counts = materialize(rows.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n")))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect():     # <= capacity rows
        histogram[r["length"]] = r["n"]
    made = plan(histogram, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        item = made.base[length.to_numpy()] + rank.to_numpy()
        at = np.searchsorted(made.first, item, side="right") - 1
        behind, per = item - made.first[at], made.per[at]
        return pd.DataFrame({"sequence_id": made.sequence[at] + behind // per,
                             "offset": made.offset[at] + behind % per * made.length[at]})

    before = running_offsets(counts, ["length"], "__part", "__n", "__before").drop("__n")
    own = Window.partitionBy("length", "__part").orderBy("__row")
    ranked = rows.withColumn("__rank", F.row_number().over(own)).join(before.hint("merge"), ["length", "__part"])
    return (ranked.withColumn("__at", slot("length", F.col("__before") + F.col("__rank") - 1))
            .select(*cut.columns, "__at.sequence_id", "__at.offset"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", **keep: Column) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, piece, start, length, ids,
    sequence_id, offset``.  ``keep`` names columns made of ``ids`` to keep in its stead.

    A null text is empty and gives one piece, the end id.  Null ids and repeated
    rows are packed like any others; equal lengths are interchangeable.  A text
    of any length is cut into pieces inside its task.  An empty table gives an
    empty result; other columns are ignored."""
    keep = keep or {"ids": F.col("ids")}
    cut = pieces(docs, path, capacity, end_id, id_col, text_col)
    return place(cut.select("doc_id", "piece", "start", "length", *[c.alias(n) for n, c in keep.items()]), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids``: the pieces of ``pack`` joined into sequences (a
    group holds at most the capacity)."""
    joined = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("all"))
    return joined.select("sequence_id", "n_tokens",
                         F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                         F.transform("all", lambda x: x["doc_id"]).alias("doc_ids"))
