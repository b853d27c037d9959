"""Registered queries for packing (W1, U4, U5, U6, M5, A15, A16, A17, S11) on word ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalam.operators.pack import (cut_shards, doc_offsets, pack_accounting, pad_truncate, read_steps, shard_manifest,
                                  shard_name, steps_per_epoch, token_budget, training_blocks, write_shards)
from qalam.operators.vocab import encode_words, word_vocabulary
from qalam.plans import duck as d
from qalam.plans.registry import query
from qalam.plans.session import materialize, spread
from qalam.sources.tables import read_table

SHARD = 10_000                      # tokens per shard (small so documents cross borders)
B, T, WORLD = 4, 64, 2              # block geometry for the loader check
MAX_LEN = 64


def _vocab_and_encoded(spark, sf_dir):
    """Word vocabulary and encoded documents, each written once: the vocabulary is
    read by the encoder and for its size, the encoding by offsets, pieces and counts."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    vocab = materialize(word_vocabulary(docs))
    enc = encode_words(docs, vocab, ["doc_id", "source"])
    return vocab, materialize(enc.withColumn("n_tokens", F.size("ids")))


def _encoded(spark, sf_dir):
    return _vocab_and_encoded(spark, sf_dir)[1]


def _pieces(spark, sf_dir):
    return cut_shards(doc_offsets(_encoded(spark, sf_dir)), "ids", SHARD)


def _possum(arr: str, base) -> F.Column:
    return F.aggregate(F.transform(arr, lambda x, i: x.cast("long") * (base + i)), F.lit(0).cast("long"),
                       lambda a, b: a + b)


STREAM_SQL = f"""
WITH words AS (SELECT doc_id, source, {d.tokens('text')} AS toks FROM documents),
wpos AS (SELECT doc_id, source, unnest(toks) AS word, unnest(generate_series(1, len(toks))) AS i FROM words),
counts AS (SELECT word, count(*) AS n FROM wpos GROUP BY word),
vocab AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) + 4 AS id FROM counts),
ids AS (SELECT w.doc_id, w.source, w.i, v.id FROM wpos w JOIN vocab v USING (word)),
doclen AS (SELECT doc_id, source, len(toks) + 2 AS n FROM words),
starts AS (SELECT doc_id, source, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM doclen),
stream AS (SELECT source, doc_id, start AS gpos, 2 AS id FROM starts
  UNION ALL SELECT s.source, s.doc_id, s.start + i.i, i.id FROM ids i JOIN starts s USING (doc_id, source)
  UNION ALL SELECT source, doc_id, start + n - 1, 3 FROM starts),
shards AS (SELECT source, gpos // {SHARD} AS shard_index, gpos % {SHARD} AS q, id, doc_id, gpos,
  CASE WHEN gpos // {SHARD} = 0 THEN 'val' ELSE 'train' END AS split FROM stream)
"""


@query("word_vocab", STREAM_SQL + "SELECT word, CAST(n AS BIGINT) AS n, CAST(id AS BIGINT) AS id FROM vocab")
def word_vocab(spark, sf_dir):
    """A17 + ordered rank: word frequencies and word ids (count desc, word asc) + 5."""
    docs = spread(read_table(spark, sf_dir, "documents").select("text"))
    return word_vocabulary(docs).select("word", "n", "id")


@query("doc_offsets", STREAM_SQL + "SELECT source, doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(start AS BIGINT) AS start FROM starts")
def doc_offsets_q(spark, sf_dir):
    """Per-source running token offsets in doc_id order (two-level prefix sum)."""
    return doc_offsets(_encoded(spark, sf_dir)).select("source", "doc_id", F.col("n_tokens").cast("long"), "start")


@query("pack_shards", STREAM_SQL + f"""
SELECT source, split, CAST(shard_index AS BIGINT) AS shard_index, printf('%s_%s_%06d', source, split, shard_index) AS name,
  CAST(count(*) AS BIGINT) AS n_tokens, CAST(4 * count(*) AS BIGINT) AS n_bytes,
  CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(id * q) AS BIGINT) AS id_possum,
  CAST(count(DISTINCT doc_id) AS BIGINT) AS n_pieces
FROM shards GROUP BY ALL""")
def pack_shards(spark, sf_dir):
    """U4 + U5 + S11: shard manifest with content checksums (position-weighted)."""
    pieces = _pieces(spark, sf_dir)
    # manifest and checksums in one aggregation over the pieces
    man = shard_manifest(pieces, extra=[
        F.sum(F.aggregate("piece", F.lit(0).cast("long"), lambda a, x: a + x)).cast("long").alias("id_sum"),
        F.sum(_possum("piece", F.col("pos"))).cast("long").alias("id_possum"),
        F.count(F.lit(1)).cast("long").alias("n_pieces")])
    return man.select("source", "split", F.col("shard_index").cast("long"), "name", "n_tokens", "n_bytes",
                      "id_sum", "id_possum", "n_pieces")


@query("pack_accounting", STREAM_SQL + f"""
, per AS (SELECT source, CAST(count(*) FILTER (WHERE n >= 3) AS BIGINT) AS docs_kept,
  CAST(count(*) FILTER (WHERE n < 3) AS BIGINT) AS docs_dropped, CAST(0 AS BIGINT) AS docs_filtered,
  CAST(sum(n) AS BIGINT) AS tokens, CAST((max(start + n) - 1) // {SHARD} + 1 AS BIGINT) AS shards, false AS is_total
FROM starts GROUP BY source),
whole AS (SELECT * FROM per UNION ALL SELECT NULL, CAST(sum(docs_kept) AS BIGINT), CAST(sum(docs_dropped) AS BIGINT),
  CAST(sum(docs_filtered) AS BIGINT), CAST(sum(tokens) AS BIGINT), CAST(sum(shards) AS BIGINT), true FROM per)
SELECT *, docs_dropped / greatest(docs_kept + docs_dropped, 1) AS drop_rate FROM whole""")
def pack_accounting_q(spark, sf_dir):
    """Documents kept and dropped, tokens, shards; per source and in total."""
    enc = _encoded(spark, sf_dir)
    pieces = cut_shards(doc_offsets(enc), "ids", SHARD)
    return pack_accounting(enc, pieces).select("source", "docs_kept", "docs_dropped", "docs_filtered", "tokens",
                                               "shards", "is_total", "drop_rate")


@query("token_budget", STREAM_SQL + """
SELECT CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train_tokens,
  CAST(count(*) FILTER (WHERE split = 'val') AS BIGINT) AS val_tokens,
  CAST(count(*) FILTER (WHERE split = 'train') // 131072 AS BIGINT) AS steps_per_epoch FROM shards""")
def token_budget_q(spark, sf_dir):
    """train/val tokens and steps per epoch."""
    return token_budget(_pieces(spark, sf_dir))


BT = B * T
CELLS_SQL = STREAM_SQL + f""",
named AS (SELECT printf('%s_%s_%06d', source, split, shard_index) AS name, q, id FROM shards
          WHERE contains(printf('%s_%s_%06d', source, split, shard_index), 'train')),
lens AS (SELECT name, count(*) AS len FROM named GROUP BY name),
nb AS (SELECT name, len, {', '.join(
    f"CASE WHEN len >= {r * BT + BT + 1} THEN greatest(1, (len - 1 - {r * BT}) // {WORLD * BT}) ELSE 0 END AS n{r}"
    for r in range(WORLD))} FROM lens),
offs AS (SELECT name, len, {', '.join(
    f"coalesce(sum(n{r}) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o{r}"
    for r in range(WORLD))} FROM nb),
gx AS (SELECT n.name, o.len, n.q, n.id, g FROM named n JOIN offs o USING (name),
       unnest(generate_series(greatest(0, ceil(n.q / {BT}) - 1)::BIGINT, (n.q // {BT})::BIGINT)) AS t(g)),
valid AS (SELECT *, g % {WORLD} AS rank, g // {WORLD} AS k FROM gx
          WHERE g * {BT} + {BT} + 1 <= len AND (g // {WORLD} = 0 OR (g % {WORLD}) * {BT} + (g // {WORLD} + 1) * {WORLD * BT} + 1 <= len)),
cells AS (SELECT v.name, v.rank, v.k, v.q - v.g * {BT} AS j, v.id, o.o0, o.o1 FROM valid v JOIN offs o USING (name)
          WHERE v.q - v.g * {BT} BETWEEN 0 AND {BT})"""

BLOCKS_SQL = CELLS_SQL + f"""
SELECT name, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN rank = 0 THEN o0 ELSE o1 END + k AS BIGINT) AS step,
  CAST(r AS INTEGER) AS row, CAST(sum(xs) AS BIGINT) AS x_sum, CAST(sum(xw) AS BIGINT) AS x_wsum,
  CAST(sum(ys) AS BIGINT) AS y_sum, CAST(sum(yw) AS BIGINT) AS y_wsum
FROM (
  SELECT name, rank, k, o0, o1, j // {T} AS r, id AS xs, id * (j % {T} + 1) AS xw, 0 AS ys, 0 AS yw FROM cells WHERE j < {BT}
  UNION ALL
  SELECT name, rank, k, o0, o1, (j - 1) // {T} AS r, 0, 0, id, id * ((j - 1) % {T} + 1) FROM cells WHERE j >= 1)
GROUP BY ALL"""


@query("train_blocks", BLOCKS_SQL)
def train_blocks(spark, sf_dir):
    """B×T next-token blocks per rank (checksums of x and y per row), read
    from the shard files the packer writes (S11), as a training loader does."""
    from qalam.sources.files import scratch_path
    root = scratch_path(spark, "u6-shards")
    write_shards(_pieces(spark, sf_dir), root)
    shards = spark.read.parquet(root).withColumn("shard_index", F.col("shard_index").cast("long"))
    blk = training_blocks(shards, B, T, WORLD, "train")

    def s(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    def ws(c):
        return _possum(c, F.lit(1))
    assert WORLD == 2
    return blk.select("name", "rank", "step", "row", s(F.col("x")).alias("x_sum"), ws(F.col("x")).alias("x_wsum"),
                      s(F.col("y")).alias("y_sum"), ws(F.col("y")).alias("y_wsum"))


STEPS_BACK, STEPS_ON = 3, 4         # the steps around the end of rank 0's first epoch
STEPS_SQL = CELLS_SQL + f""",
tot AS (SELECT CAST(sum(n0) AS BIGINT) AS t0, CAST(sum(n1) AS BIGINT) AS t1 FROM nb),
asked AS (SELECT rank, step, step % CASE WHEN rank = 0 THEN t0 ELSE t1 END AS local
  FROM (SELECT t0, t1, unnest(generate_series(greatest(t0 - {STEPS_BACK}, 0), 2 * t0 + {STEPS_ON} - 1)) AS step FROM tot) s
  CROSS JOIN (VALUES (0), (1)) AS r(rank) WHERE CASE WHEN rank = 0 THEN t0 ELSE t1 END > 0
    AND (step < t0 + {STEPS_ON} OR step >= 2 * t0 - {STEPS_BACK})),
hit AS (SELECT a.rank, a.step, c.name, c.j, c.id FROM asked a JOIN cells c
  ON c.rank = a.rank AND CASE WHEN c.rank = 0 THEN c.o0 ELSE c.o1 END + c.k = a.local)
SELECT name, CAST(rank AS INTEGER) AS rank, CAST(step AS BIGINT) AS step, CAST(r AS INTEGER) AS row,
  CAST(sum(xs) AS BIGINT) AS x_sum, CAST(sum(xw) AS BIGINT) AS x_wsum, CAST(sum(ys) AS BIGINT) AS y_sum, CAST(sum(yw) AS BIGINT) AS y_wsum
FROM (
  SELECT name, rank, step, j // {T} AS r, id AS xs, id * (j % {T} + 1) AS xw, 0 AS ys, 0 AS yw FROM hit WHERE j < {BT}
  UNION ALL
  SELECT name, rank, step, (j - 1) // {T} AS r, 0, 0, id, id * ((j - 1) % {T} + 1) FROM hit WHERE j >= 1)
GROUP BY ALL"""


@query("train_steps", STEPS_SQL)
def train_steps(spark, sf_dir):
    """U6 by step: what both ranks read around the ends of the first and the second epoch, as a resumed
    run does; only the shards those steps lie in are opened."""
    from qalam.sources.files import scratch_path
    root = scratch_path(spark, "u6-steps")
    pieces = materialize(_pieces(spark, sf_dir))
    write_shards(pieces, root)
    manifest = materialize(shard_manifest(pieces))
    end = steps_per_epoch(manifest, B, T, WORLD, "train")[0]
    at = [(max(end - STEPS_BACK, 0), end + STEPS_ON), (2 * end - STEPS_BACK, 2 * end + STEPS_ON)]
    if at[1][0] < at[0][1]:                                 # an epoch shorter than the look around its end
        at = [(at[0][0], at[1][1])]
    blk = None
    for lo, hi in at:
        one = read_steps(spark, root, manifest, B, T, WORLD, "train", lo, hi)
        blk = one if blk is None else blk.unionByName(one)

    def s(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return blk.select(shard_name().alias("name"), "rank", "step", "row", s(F.col("x")).alias("x_sum"), _possum("x", F.lit(1)).alias("x_wsum"),
                      s(F.col("y")).alias("y_sum"), _possum("y", F.lit(1)).alias("y_wsum"))


@query("pad_truncate", STREAM_SQL + f"""
SELECT doc_id, CAST({MAX_LEN} AS INTEGER) AS n, CAST(sum(id) AS BIGINT) AS id_sum,
  CAST(sum(id * (gpos - start + 1)) AS BIGINT) AS id_wsum
FROM stream JOIN (SELECT doc_id, source, start FROM starts) USING (doc_id, source)
WHERE gpos - start < {MAX_LEN} GROUP BY doc_id""")
def pad_truncate_q(spark, sf_dir):
    """M5: ids truncated to 64 and right-padded with <pad>."""
    enc = _encoded(spark, sf_dir).select("doc_id", pad_truncate(F.col("ids"), MAX_LEN).alias("x"))
    return enc.select("doc_id", F.size("x").alias("n"),
                      F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                      _possum("x", F.lit(1)).alias("id_wsum"))
