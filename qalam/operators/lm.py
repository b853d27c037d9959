"""Perplexity by group (A11) and an add-k bigram language model counted in Spark (M7).

M7 is re-aimed: the reference scores text with a GPU model; here the model
is counted from the corpus itself (token and bigram counts are plain
aggregations), and any external model can instead feed ``(group, loss, n)``
rows to :func:`group_perplexity`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.operators.bpe_encode import offsets

CHUNK_IDS = 1_000_000            # ids of the documents that are counted together
BUCKET_IDS = 3_000_000           # ids whose bigrams a bucket has, about: what a task scores at a time
NO_NEXT = 0xFFFFFFFF             # in the place of the right id: the key counts the left one alone
CODEC = "zstd"


def group_perplexity(losses: DataFrame, group_col: str, loss_col: str = "loss", n_col: str = "n_tokens",
                     min_tokens: int = 2) -> DataFrame:
    """Token-weighted perplexity ``exp(Σ loss·n / Σ n)`` per group;
    sequences under ``min_tokens`` are skipped."""
    x = losses.filter(F.col(n_col) >= min_tokens)
    return (x.groupBy(group_col)
             .agg(F.exp(F.sum(F.col(loss_col) * F.col(n_col)) / F.sum(n_col)).alias("perplexity"),
                  F.sum(n_col).cast("long").alias("n_tokens"),
                  F.count(F.lit(1)).cast("long").alias("n_sequences")))


def _pack(keys: np.ndarray, rows: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys with the row of each and how often it has it, as small as they are: differences, byte planes, compressed."""
    parts = (np.diff(keys, prepend=keys[:1]).astype("<u8"), rows.astype("<u4"), times.astype("<u4"))
    planes = b"".join(p.view(np.uint8).reshape(len(p), -1).T.tobytes() for p in parts)
    return (np.array([len(keys), keys[0]], dtype="<i8").tobytes() + pa.compress(planes, codec=CODEC, asbytes=True))


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, first = np.frombuffer(body, "<i8", 2).tolist()
    planes = np.frombuffer(pa.decompress(body[16:], decompressed_size=16 * n, codec=CODEC, asbytes=True), dtype=np.uint8)
    cut = lambda a, width, kind: np.ascontiguousarray(planes[a * n:(a + width) * n].reshape(width, n).T).view(kind).ravel()
    return np.cumsum(cut(0, 8, "<u8").astype(np.int64)) + first, cut(8, 4, "<u4"), cut(12, 4, "<u4")


def _counted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, row) by key, and how often each comes; rows rise."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
    return keys[start], rows[start], np.diff(np.append(start, len(keys)))


def _chunked(buckets: int, most: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences into their own rows (buckets below 0, with a place in a chunk) and the keys of chunks, by bucket."""
    from pyspark import TaskContext
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        part = offsets(batch.column(width)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            one = batch.slice(lo, hi - lo)
            lists = one.column(width)
            ends, flat = offsets(lists), lists.flatten()
            ids = np.asarray(pc.fill_null(flat, -1)).astype(np.int64)
            at = np.ones(max(len(ids) - 1, 0), dtype=bool)   # pairs inside a sequence
            inner = ends[1:-1]
            at[inner[(inner > 0) & (inner < len(ids))] - 1] = False
            at = np.flatnonzero(at)
            row = np.searchsorted(ends, at, side="right") - 1
            if flat.null_count:                              # no id: the left one is counted all the same, for no row
                bad = np.asarray(flat.is_null())
                at, row = at[~bad[at]], row[~bad[at]]
                row[bad[at + 1]] = one.num_rows
                order = np.argsort(row, kind="stable")
                at, row = at[order], row[order]
            real = slice(0, int(np.searchsorted(row, one.num_rows)))
            n = np.bincount(row[real], minlength=one.num_rows)
            there = np.flatnonzero(n)
            left, right = ids[at], ids[at[real] + 1]
            own = one.take(pa.array(there))
            yield _rows(own.columns[:width], own.schema.names[:width], -1 - (chunk >> 32) % 1024, chunk, there, n[there], None)
            found = _counted(np.concatenate([left[real] << 32 | right, left << 32 | NO_NEXT]), np.concatenate([row[real], row])) if len(at) else None
            if found is not None:
                keys, rows, times = found
                home = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(home.astype(np.uint32), kind="stable")
                edge = np.searchsorted(home[order], np.arange(buckets + 1))
                took = [(k, order[a:b]) for k, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
                bodies = pa.array([_pack(keys[o], rows[o], times[o]) for _, o in took], pa.binary())
                empty = [pa.nulls(len(took), f.type) for f in one.schema][:width]
                yield _rows(empty, own.schema.names[:width], np.array([k for k, _ in took]), chunk, None, None, bodies)
            chunk += 1


def _rows(keys: list, names: list, bucket, chunk: int, place, n, body) -> pa.RecordBatch:
    size = len(body) if body is not None else len(place)
    cols = [pa.array(np.broadcast_to(bucket, size), pa.int32()), pa.array(np.full(size, chunk), pa.int64()),
            pa.nulls(size, pa.int32()) if place is None else pa.array(place, pa.int32()),
            pa.nulls(size, pa.int64()) if n is None else pa.array(n, pa.int64()),
            pa.nulls(size, pa.binary()) if body is None else body]
    return pa.RecordBatch.from_arrays([*cols, *keys], names=["__bucket", "__chunk", "__i", "__n", "__body", *names])


def _scored(k: float, vocab_size: int, table: pa.Table) -> pa.Table:
    """A bucket's keys, counted over all chunks, into sums of losses by row; a sequence's own row stays."""
    if not table.num_rows or table.column("__bucket")[0].as_py() < 0:
        return table
    parts = [_unpack(b) for b in table.column("__body").to_pylist()]
    keys = np.concatenate([p[0] for p in parts])
    times = np.concatenate([p[2] for p in parts])
    parts = [p[1] for p in parts]
    order = np.argsort(keys, kind="stable")              # runs that are sorted already
    keys, times = keys[order], times[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(times, start, dtype=np.int64)
    # -log((pair + k) / (left + k V)), the two counts one by one
    each = np.where((keys[start] & NO_NEXT) == NO_NEXT, np.log(total + k * vocab_size), -np.log(total + k))
    loss = np.empty(len(keys))
    loss[order] = np.repeat(each, np.diff(np.append(start, len(keys)))) * times
    del keys, times, order
    bodies, at = [], 0
    for rows in parts:
        sums = np.bincount(rows, loss[at:at + len(rows)])
        some = np.flatnonzero(np.bincount(rows))
        at += len(rows)
        if 3 * len(some) > 2 * len(sums):                   # most rows have a sum: no need to name them
            bodies.append(np.array([-len(sums)], "<i8").tobytes() + sums.astype("<f8").tobytes())
        else:
            bodies.append(np.array([len(some)], "<i8").tobytes() + some.astype("<u4").tobytes() + sums[some].astype("<f8").tobytes())
    where = table.schema.get_field_index("__body")
    return table.set_column(where, table.schema.field(where), pa.array(bodies, pa.binary()))


def _summed(table: pa.Table) -> pa.Table:
    """A chunk's sequences with the sums that its buckets found."""
    body = table.column("__body")
    own = table.filter(pc.is_null(body))
    places = np.asarray(own.column("__i")).astype(np.int64)
    sums = np.zeros(int(places.max(initial=-1)) + 1)
    for one in body.drop_null().to_pylist():
        n = int(np.frombuffer(one, "<i8", 1)[0])
        at = np.arange(-n) if n < 0 else np.frombuffer(one, "<u4", n, 8)
        mine = at < len(sums)
        sums[at[mine]] += np.frombuffer(one, "<f8", len(at), 8 + 4 * max(n, 0))[mine]
    out = own.drop_columns(["__bucket", "__chunk", "__i", "__body"])
    return out.append_column("__loss", pa.array(sums[places]))


def bigram_losses(encoded: DataFrame, key_cols, group_col: str, ids_col: str = "ids", k: float = 1.0,
                  vocab_size: int | None = None) -> DataFrame:
    """M7: mean negative log-likelihood per sequence under an add-k bigram
    model counted over all sequences: ``P(b|a) = (c(a,b)+k) / (c(a)+k·V)``.

    Tasks count the bigrams of chunks of sequences.  What travels is each (bigram, row) and (left id, row) once, packed,
    by a hash of the bigram or id to buckets; a bucket knows its counts and sends the sums of
    logarithms back to the chunks.  A bucket has some millions of keys, and a hot one at most a record per sequence.
    Output ``(keys…, group, loss, n_tokens)`` where n counts predicted tokens; rows that share keys and group are one sequence."""
    keys = list(dict.fromkeys([*key_cols, group_col]))
    rows = encoded.select(*keys, F.col(ids_col).cast("array<int>").alias("__ids"))
    if vocab_size is None:   # one scalar, computed once on the cluster
        vocab_size = int(encoded.select(F.explode(ids_col).alias("t")).agg(F.countDistinct("t")).first()[0])
    total = rows.agg(F.sum(F.size("__ids"))).first()[0] or 0
    buckets = max(1, encoded.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET_IDS))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"__bucket int, __chunk long, __i int, __n long, __body binary, {kinds}"
    parts = rows.mapInArrow(functools.partial(_chunked, buckets, CHUNK_IDS, len(keys)), schema)
    scored = parts.groupBy("__bucket").applyInArrow(lambda table: _scored(k, vocab_size, table), schema)
    sums = scored.groupBy("__chunk").applyInArrow(lambda table: _summed(table), f"__n long, {kinds}, __loss double")
    return (sums.groupBy(*keys).agg((F.sum("__loss") / F.sum("__n")).alias("loss"), F.sum("__n").cast("long").alias("n_tokens")))
