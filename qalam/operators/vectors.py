"""Vectors: pooling, cosine similarity, retrieval ranks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalam.plans.session import materialize


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """x / max(||x||, eps) on an array column."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(eps)))


MOST_NUMBERS = 8_000_000      # of token vectors that a task holds (64 MB); a larger table goes in blocks of this size
MOST_ENTRIES = 1_000_000      # (document, token) counts that meet a block of vectors in one cell, about
TOKENS_AT_ONCE = 16_384       # vectors looked up in one step, so that a document of any length takes bounded memory


def _weighted_sum(keys: np.ndarray, matrix: np.ndarray, toks: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Counted tokens that have a vector, and the sum of their vectors."""
    n, out = 0, np.zeros(matrix.shape[1])
    for lo in range(0, len(toks) if len(keys) else 0, TOKENS_AT_ONCE):
        t, c = toks[lo:lo + TOKENS_AT_ONCE], counts[lo:lo + TOKENS_AT_ONCE]
        at = np.minimum(np.searchsorted(keys, t), len(keys) - 1)
        known = keys[at] == t
        n += int(c[known].sum())
        out += c[known].astype(np.float64) @ matrix[at[known]]
    return n, out


def _counted(lists: pa.Array, pad: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct ids of every list with their counts, without nulls and pads."""
    for one in lists:
        ids = one.values.drop_null().to_numpy(zero_copy_only=False) if one.is_valid else np.array([], dtype=np.int64)
        yield np.unique(ids if pad is None else ids[ids != pad], return_counts=True)


def _sorted_vectors(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column(0).combine_chunks().to_numpy(zero_copy_only=False)
    matrix = np.asarray(table.column(1).combine_chunks().flatten(), dtype=np.float64).reshape(-1, d)
    order = np.argsort(keys, kind="stable")
    return keys[order], matrix[order]


def _summed_here(held, pad: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, matrix = held.value
    for batch in batches:
        per = [_weighted_sum(keys, matrix, *x) for x in _counted(batch.column(1), pad)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in per], pa.int64()),
                                          pa.array([s for _, s in per], pa.list_(pa.float64()))],
                                         names=[batch.schema.names[0], "n", "s"])


def _cut_by_block(n_blocks: int, pad: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and block of ids: its distinct ids there and their counts."""
    for batch in batches:
        rows, blocks, toks, counts = [], [], [], []
        for i, (t, c) in enumerate(_counted(batch.column(1), pad)):
            of = t % n_blocks
            for b in np.unique(of):
                rows.append(i)
                blocks.append(b)
                toks.append(t[of == b])
                counts.append(c[of == b])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(blocks, pa.int64()),
                                          pa.array(toks, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                                         names=[batch.schema.names[0], "tb", "toks", "counts"])


def _cell_sums(doc_col: str, d: int, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(b["key"].to_numpy(), kind="stable") if len(b) else []
    keys = b["key"].to_numpy()[order]
    matrix = np.vstack(b["vec"].to_numpy()[order]).astype(np.float64) if len(b) else np.zeros((0, d))
    per = [_weighted_sum(keys, matrix, t, c) for t, c in zip(a["toks"], a["counts"])]
    return pd.DataFrame({doc_col: a[doc_col], "n": [n for n, _ in per], "s": [s for _, s in per]})


def masked_mean_pool(docs: DataFrame, vectors: DataFrame, doc_col: str, ids_col: str, vec_key: str,
                     vec_col: str, pad: int | None = 0, most_numbers: int = MOST_NUMBERS) -> DataFrame:
    """A18 + J5: ``(doc_col, n_tokens, vector)``: the mean vector of a document's non-pad ids (divisor at
    least 1), L2-normalised.

    ``docs``: one row per document (unique key) with its ids; ``vectors``: one row per id.  A document is a sparse row of
    counts of its distinct ids, multiplied by the vectors.  Up to ``most_numbers`` numbers of vectors go to the tasks
    and each document is pooled where it is, without a shuffle.  A larger table is cut into blocks of ids; a document's
    counts meet every block it has ids in, in cells of about ``MOST_ENTRIES`` counts, and its partial sums are added: one vector
    travels per document and block, none per token.

    A document without ids (null, empty, pads only) keeps its row: no tokens, the zero vector.  Null ids and ids
    without a vector do not count."""
    spark = docs.sparkSession
    v = vectors.filter(F.col(vec_key).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(vec_key).cast("long").alias("key"), F.col(vec_col).cast("array<double>").alias("vec"))
    size = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    d = size["d"] or 0
    rows = docs.select(doc_col, F.col(ids_col).cast("array<bigint>").alias("__ids"))
    kind = f"`{doc_col}` {dict(rows.dtypes)[doc_col]}"
    if size["n"] * d <= most_numbers:
        held = spark.sparkContext.broadcast(_sorted_vectors(v.toArrow(), d))
        sums = rows.mapInArrow(functools.partial(_summed_here, held, pad), f"{kind}, n long, s array<double>")
    else:
        blocks = -(-size["n"] * d // most_numbers)
        cut = materialize(rows.mapInArrow(functools.partial(_cut_by_block, blocks, pad),
                                          f"{kind}, tb long, toks array<bigint>, counts array<bigint>"))
        entries = cut.agg(F.sum(F.size("toks"))).first()[0] or 0
        cells = max(1, -(-entries // (blocks * MOST_ENTRIES)))
        a = cut.withColumn("db", F.pmod(F.xxhash64(doc_col), F.lit(cells)))
        b = v.select(F.pmod("key", F.lit(blocks)).cast("long").alias("tb"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("db"), "key", "vec")
        part = a.groupBy("tb", "db").cogroup(b.groupBy("tb", "db")).applyInPandas(
            functools.partial(_cell_sums, doc_col, d), f"{kind}, n long, s array<double>")
        part = part.groupBy(doc_col).agg(F.sum("n").alias("__n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("__s"))
        j = rows.select(F.col(doc_col).alias("__d")).join(part, F.col("__d").eqNullSafe(F.col(doc_col)), "left")
        sums = j.select(F.col("__d").alias(doc_col), F.coalesce("__n", F.lit(0)).alias("n"),
                        F.coalesce("__s", F.array_repeat(F.lit(0.0), d)).alias("s"))
    mean = F.transform("s", lambda x: x / F.greatest(F.col("n"), F.lit(1)))
    return sums.select(doc_col, F.col("n").alias("n_tokens"), mean.alias("s")).select(
        doc_col, "n_tokens", l2_normalize(F.col("s")).alias("vector"))


MOST_PIVOTS = 64       # the driver and every task hold this many vectors
MOST_SLICES = 64       # ... and at most this many blocks for each of them (a block: a number, a distance range, a count)
SAMPLED = 64           # targets sampled per pivot; pivots decide how much is skipped, never the result
SLACK = 1e-6           # distances this near to the own one are left to the products


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def _chords(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _no_unit(x: np.ndarray) -> np.ndarray:
    """Rows that are no unit vectors (zero or not finite): no distance speaks for them."""
    return ~(np.abs((x * x).sum(axis=1) - 1.0) <= SLACK)


def _far_apart(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows of the sample, each the farthest from those before."""
    taken, near = [0], np.sqrt(((sample - sample[0]) ** 2).sum(axis=1))
    while len(taken) < k and near.max() > SLACK:
        taken.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((sample - sample[taken[-1]]) ** 2).sum(axis=1)))
    return sample[taken]


def _slices(sample: np.ndarray, pivots: np.ndarray, n: int, block: int) -> list[tuple[int, np.ndarray]]:
    """Per pivot the number of its first block and the distances that part its blocks, each of about ``block`` of
    all ``n`` targets, after the sample.  Block 0 holds the vectors without length."""
    far = _chords(sample, pivots)
    k, r = far.argmin(axis=1), np.sort(far, axis=1)[:, 0]
    out, first = [], 1
    for p in range(len(pivots)):
        own = np.sort(r[k == p])
        m = min(MOST_SLICES, max(1, round(n * len(own) / len(sample) / block)), max(1, len(own) // 4))
        cuts = np.unique(own[[len(own) * c // m for c in range(1, m)]])
        out.append((first, cuts))
        first += len(cuts) + 1
    return out


def _tagged(pivots: np.ndarray, slices: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Targets with their nearest pivot (-1 for a vector without length), its distance, and their block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1))
        far = _chords(x, pivots)
        k = far.argmin(axis=1)
        r = far[np.arange(len(k)), k]
        loose = _no_unit(x)
        k[loose], r[loose] = -1, 0.0
        b = np.zeros(len(k), dtype=np.int32)
        for p in np.unique(k[~loose]):
            b[k == p] = slices[p][0] + np.searchsorted(slices[p][1], r[k == p])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k, pa.int32()), pa.array(r), pa.array(b)],
                                         names=["i", "vec", "k", "r", "b"])


def _decided(pivots: np.ndarray, blocks: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sources with the targets that distances alone count, and the blocks they leave open."""
    b, k, low, high, n = (np.array(c) for c in zip(*blocks))
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            x, partner = _matrix(batch.column(2)), _matrix(batch.column(3))
            own = np.sqrt(((x - partner) ** 2).sum(axis=1))[:, None]
            far = _chords(x, pivots)[:, k]
            bound = ~(_no_unit(x) | _no_unit(partner))[:, None] & (k >= 0)[None, :]
            nearer = bound & (far + high < own - SLACK)
            beyond = bound & (np.maximum(far - high, low - far) > own + SLACK)
            left = ~(nearer | beyond)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], left.sum(axis=1).cumsum()]).astype("int32")),
                                             pa.array(b[np.nonzero(left)[1]].astype("int32")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((nearer * n).sum(axis=1).astype("int64")), lists],
                                             names=["i", "partner", "vec", "pvec", "gt", "open"])


def _cell(chunk: int, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """One product of sources and targets: per source the targets above and at its own similarity."""
    gt, tie = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    if len(a) and len(b):
        A = np.vstack(a["vec"].to_numpy()).astype(np.float64)
        P = np.vstack(a["pvec"].to_numpy()).astype(np.float64)
        B = np.vstack(b["vec"].to_numpy()).astype(np.float64)
        ids, partner = b["i"].to_numpy(), a["partner"].to_numpy()
        # the product decides all but the pairs within rounding of the own similarity;
        # those are redone elementwise, the same summation whichever cell computes them
        for lo in range(0, len(a), chunk):
            hi = min(lo + chunk, len(a))
            sim = A[lo:hi] @ B.T
            own = (A[lo:hi] * P[lo:hi]).sum(axis=-1)
            close = np.abs(sim - own[:, None]) <= 1e-9
            gt[lo:hi] = ((sim > own[:, None]) & ~close).sum(axis=1)
            rows, cols = np.nonzero(close)
            for at in range(0, len(rows), 16_384):
                x, y = rows[at:at + 16_384], cols[at:at + 16_384]
                exact = (A[lo + x] * B[y]).sum(axis=-1)
                np.add.at(gt, lo + x, exact > own[x])
                np.add.at(tie, lo + x, (exact == own[x]) & (ids[y] < partner[lo + x]))
    return pd.DataFrame({"i": a["i"].to_numpy(dtype=np.int64), "gt": gt, "tie": tie,
                         "scored": np.full(len(a), len(b), dtype=np.int64)})


def scored_ranks(src: DataFrame, tgt: DataFrame, block: int | None = None, chunk: int = 256) -> DataFrame:
    """J3 + W2: ``(i, rank, scored)``: the rank of each source row's true partner among all
    targets by cosine similarity, ``1 + #(sim > own) + #(sim = own and j < partner)``, and
    the number of targets its vector was multiplied with.

    ``src``: (i, partner, vec); ``tgt``: (j, vec), ids unique.  Targets are put to the nearest of
    at most ``MOST_PIVOTS`` pivots (far apart in a sample of ``SAMPLED`` targets each) and
    sliced there by their distance to it (blocks; where they are cut follows the sample).  By the triangle inequality a block of targets
    whose distances to a source are all below (or all above) the partner's is counted (or
    skipped) as a whole; only blocks that stay open are multiplied.  Open
    sources and the targets of a block meet in cells of about ``block`` rows a side: a block
    with more equal distances, or more open sources, is split by a hash of the id.  No
    pair is emitted.  The driver holds the pivots and at most ``MOST_PIVOTS *
    MOST_SLICES`` block rows, whatever the number of vectors.

    A null target vector counts for nobody; a source without a vector, or whose
    partner is absent or has none, has a null rank; zero vectors are multiplied, never skipped.
    """
    spark = src.sparkSession
    every = src.select(F.col("i").cast("long").alias("i"), F.col("partner").cast("long").alias("partner"),
                       l2_normalize(F.col("vec")).alias("vec"))
    t = tgt.filter(F.col("vec").isNotNull()).select(F.col("j").cast("long").alias("i"), l2_normalize(F.col("vec")).alias("vec"))
    s = every.filter(F.col("vec").isNotNull())
    pairs = s.join(t.select(F.col("i").alias("partner"), F.col("vec").alias("pvec")), "partner")
    no_rank = [F.lit(None).cast("long").alias("rank"), F.lit(0).cast("long").alias("scored")]
    alone = (s.join(t.select(F.col("i").alias("partner")), "partner", "left_anti")
              .unionByName(every.filter(F.col("vec").isNull())).select("i", *no_rank))

    sample = t.orderBy(F.xxhash64("i"), "i").limit(MOST_PIVOTS * SAMPLED).select("vec").toArrow().column(0).combine_chunks()
    if not len(sample):
        return alone
    x = _matrix(sample)
    x = x[~_no_unit(x)] if not _no_unit(x).all() else x[:1] * 0.0
    pivots = _far_apart(x, max(1, len(x) // SAMPLED))

    n = t.count()
    if block is None:
        slots = spark.sparkContext.defaultParallelism
        block = min(4096, max(256, -(-n // (2 * slots))))
    slices = _slices(x, pivots, n, block)
    placed = materialize(t.mapInArrow(functools.partial(_tagged, pivots, slices), "i long, vec array<double>, k int, r double, b int"))
    blocks = [tuple(r) for r in placed.groupBy("b").agg(F.first("k"), F.min("r"), F.max("r"), F.count(F.lit(1))).collect()]

    shape = "i long, partner long, vec array<double>, pvec array<double>, gt long, open array<int>"
    met = materialize(pairs.select("i", "partner", "vec", "pvec").mapInArrow(functools.partial(_decided, pivots, blocks), shape))
    waiting = dict(met.select(F.explode("open").alias("b")).groupBy("b").count().collect())
    cells = spark.createDataFrame([(b, -(-n // block), -(-waiting[b] // block)) for b, _, _, _, n in blocks if b in waiting],
                                  "b int, tparts int, sparts int")
    n_cells = sum(-(-n // block) * -(-waiting[b] // block) for b, _, _, _, n in blocks if b in waiting)
    tasks = max(1, min(n_cells, max(spark.sparkContext.defaultParallelism, -(-n_cells // 8))))
    # a row per block is broadcast
    o = met.select("i", "partner", "vec", "pvec", F.explode("open").alias("b")).join(F.broadcast(cells), "b")
    o = o.select("b", F.pmod(F.xxhash64("i"), F.col("sparts")).alias("sb"),
                 F.explode(F.sequence(F.lit(0), F.col("tparts") - 1)).alias("tb"), "i", "partner", "vec", "pvec")
    g = placed.join(F.broadcast(cells), "b")
    g = g.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sparts").cast("long") - 1)).alias("sb"),
                 F.pmod(F.xxhash64("i"), F.col("tparts")).cast("int").alias("tb"), "i", "vec")
    # a number of its own, as AQE would join cells to tasks by their bytes, not by their products
    o, g = (f.repartition(tasks, "b", "sb", "tb") for f in (o, g))
    parts = (o.groupBy("b", "sb", "tb").cogroup(g.groupBy("b", "sb", "tb"))
              .applyInPandas(functools.partial(_cell, chunk), "i long, gt long, tie long, scored long"))
    none = F.lit(0).cast("long")
    ranks = (parts.unionByName(met.select("i", "gt", none.alias("tie"), none.alias("scored"))).groupBy("i")
                  .agg((F.sum("gt") + F.sum("tie") + 1).cast("long").alias("rank"), F.sum("scored").cast("long").alias("scored")))
    return ranks.unionByName(alone)


def retrieval_ranks(src: DataFrame, tgt: DataFrame, block: int | None = None, chunk: int = 256) -> DataFrame:
    """J3 + W2: ``(i, rank)`` of ``scored_ranks``."""
    return scored_ranks(src, tgt, block, chunk).select("i", "rank")


def retrieval_metrics(ranks: DataFrame, rank_col: str = "rank") -> DataFrame:
    """A10: Recall@1/5/10 and MRR."""
    r = F.col(rank_col)
    return ranks.agg(*[F.avg((r <= k).cast("double")).alias(f"recall_at_{k}") for k in (1, 5, 10)],
                     F.avg(1.0 / r).alias("mrr"))
