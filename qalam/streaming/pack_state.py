"""Streaming packing in Spark's own state: an offset and a carry-over buffer per source.

Each micro-batch appends its documents to their source's buffer; a block of ids
leaves as soon as it is full, so a shard leaves with its last block.  What does
not fill a block stays in the state for the next batch.  The state of a source
is one number and fewer ids than a block, whatever the stream's length: a batch
costs what its own documents cost, and a restart goes on from the checkpoint.
No table is written beside the blocks.  ``pack_stream`` packs a hot source in
parallel instead, by prefix sums inside each batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalam.operators.pack import cut_shards

BLOCK = 1 << 16          # ids of a block, at most


def _blocks(start: int, ids: np.ndarray, shard_size: int, block: int) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray]:
    """Full blocks ``(shard_index, pos, ids)`` of a stream that is at ``start``, a block's border, and the rest."""
    out, at = [], 0
    while True:
        shard, pos = divmod(start + at, shard_size)
        n = min(block, shard_size - pos)
        if at + n > len(ids):
            return out, ids[at:]
        out.append((shard, pos, ids[at:at + n]))
        at += n


def _append(part: str, order: str, shard_size: int, block: int, key: tuple, frames: Iterator[pd.DataFrame],
            state) -> Iterator[pd.DataFrame]:
    start, carry = state.get if state.exists else (0, b"")
    docs = pd.concat(frames).sort_values(order, kind="stable")
    ids = np.concatenate([np.frombuffer(bytes(carry), "<i4"), *(np.asarray(x, "<i4") for x in docs["ids"])])
    full, rest = _blocks(start, ids, shard_size, block)
    state.update((start + len(ids) - len(rest), rest.tobytes()))
    yield pd.DataFrame({part: [key[0]] * len(full), "split": ["train" if s else "val" for s, _, _ in full],
                        "shard_index": [s for s, _, _ in full], "pos": [p for _, p, _ in full],
                        "piece": [x.tolist() for _, _, x in full]})


def pack_state_stream(stream: DataFrame, shard_size: int, out_dir: str, part_col: str = "source", order_col: str = "doc_id",
                      block: int = BLOCK):
    """Start the packing query over ``stream(order_col, part_col, ids)``; returns the StreamingQuery.

    Pieces ``(source, split, shard_index, pos, piece)`` land in ``out_dir/pieces``.  Documents of a
    batch are taken in ``order_col`` order; those of a later batch must come later.  A task
    holds one source's documents of one micro-batch, so the trigger's size bounds it.
    A null source is a source of its own."""
    kind = stream.schema[part_col].dataType.simpleString()
    rows = stream.select(part_col, order_col, "ids").filter(F.size("ids") > 0)
    full = rows.groupBy(part_col).applyInPandasWithState(
        functools.partial(_append, part_col, order_col, shard_size, block),
        f"`{part_col}` {kind}, split string, shard_index long, pos long, piece array<int>",
        "at long, carry binary", "append", "NoTimeout")
    return (full.writeStream.format("parquet").option("path", f"{out_dir}/pieces")
            .option("checkpointLocation", f"{out_dir}/_ckpt").trigger(availableNow=True).start())


def _ints(carry: pd.Series) -> pd.Series:
    return carry.map(lambda b: np.frombuffer(bytes(b), "<i4").tolist())


def open_pieces(spark: SparkSession, out_dir: str, shard_size: int, part_col: str = "source") -> DataFrame:
    """What the state still holds of each source, as the pieces of its last, open shard:
    read from the query's checkpoint, at the end of the input or between two runs."""
    held = spark.read.format("statestore").load(f"{out_dir}/_ckpt")
    ids = F.pandas_udf(_ints, "array<int>")
    rows = held.select(F.col(f"key.{part_col}").alias(part_col), F.col("value.groupState.at").alias("start"),
                       ids(F.col("value.groupState.carry")).alias("ids"))
    return cut_shards(rows.withColumn("end", F.col("start") + F.size("ids")), "ids", shard_size, part_col)
