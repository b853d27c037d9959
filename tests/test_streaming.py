"""Streaming packing: offsets carry across batches; a replayed batch changes nothing."""

import tempfile

from pyspark.sql import functions as F

from qalam.sources.files import read_corpus
from qalam.streaming.clean_stream import run_to_table
from qalam.streaming.pack_state import open_pieces, pack_state_stream
from qalam.streaming.pack_stream import pack_batch, pack_stream


def _rows():
    return [(d, f"s{d % 2}", [2] + [5 + (d * 7 + k) % 11 for k in range(d % 9)] + [3]) for d in range(40)]


def _enc(batch):
    return batch.withColumn("n_tokens", F.size("ids"))


def test_stream_packing_carries_offsets_and_replays_idempotently(spark):
    rows = _rows()
    src = tempfile.mkdtemp(prefix="qalam-t2-src-")
    schema = "doc_id long, source string, ids array<int>"
    spark.createDataFrame([r for r in rows if r[0] < 20], schema).coalesce(1).write.parquet(f"{src}/a")
    spark.createDataFrame([r for r in rows if r[0] >= 20], schema).coalesce(1).write.parquet(f"{src}/b")
    out = tempfile.mkdtemp(prefix="qalam-t2-out-")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", True).parquet(src))
    pack_stream(spark, stream, _enc, 13, out).awaitTermination()
    before = sorted(tuple(r) for r in spark.read.parquet(f"{out}/pieces").select(
        "source", "shard_index", "pos", "piece", "batch_id").collect())
    assert len({b for *_, b in before}) == 2                      # two micro-batches
    # replay batch 0 (as after a failure): output unchanged
    first = spark.createDataFrame([r for r in rows if r[0] < 20], schema)
    pack_batch(spark, first, 0, _enc, 13, out)
    after = sorted(tuple(r) for r in spark.read.parquet(f"{out}/pieces").select(
        "source", "shard_index", "pos", "piece", "batch_id").collect())
    assert after == before
    # the pieces rebuild each source's stream across the batch border
    for s in ("s0", "s1"):
        stream_ids = [t for d, src_, ids in rows if src_ == s for t in ids]
        got = [t for src_, sh, pos, piece, _ in sorted(after) if src_ == s for t in piece]
        assert got == stream_ids


def test_state_packing_over_batches_and_a_restart(spark):
    rows = [*_rows(), *((d, None, [2, d, 3]) for d in range(40, 50)), (50, "s0", []), (51, "s1", list(range(100)))]
    src, out = tempfile.mkdtemp(prefix="qalam-t2-src-"), tempfile.mkdtemp(prefix="qalam-t2-out-")
    schema = "doc_id long, source string, ids array<int>"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src))
    runs = []
    for lo, hi in ((0, 26), (26, 52)):                 # a restart between the two
        for at in range(lo, hi, 5):
            spark.createDataFrame([r for r in rows if at <= r[0] < min(at + 5, hi)][::-1], schema).coalesce(1).write.parquet(f"{src}/{at}")
        q = pack_state_stream(stream, 13, out, block=4)
        q.awaitTermination()
        runs.append(spark.read.parquet(f"{out}/pieces").count())
    assert 0 < runs[0] < runs[1]
    full = [tuple(r) for r in spark.read.parquet(f"{out}/pieces").select("source", "shard_index", "pos", "piece", "split").collect()]
    # blocks are full: 4 ids, or what is left of a shard of 13
    assert all(len(p) == min(4, 13 - pos) and pos % 4 == 0 for _, _, pos, p, _ in full)
    rest = [tuple(r) for r in open_pieces(spark, out, 13).select("source", "shard_index", "pos", "piece", "split").collect()]
    assert all(len(p) < 4 for _, _, _, p, _ in rest)
    for s in ("s0", "s1", None):
        want = [t for _, src_, ids in rows if src_ == s for t in ids]
        mine = sorted((r for r in full + rest if r[0] == s), key=lambda r: (r[1], r[2]))
        assert [t for r in mine for t in r[3]] == want
        assert all(r[4] == ("train" if r[1] else "val") for r in mine)


def test_first_rows_of_a_stream_over_batches(spark):
    src = tempfile.mkdtemp(prefix="qalam-s6-")
    for lot in range(4):
        spark.range(lot * 10, lot * 10 + 10).selectExpr("id", "cast(id as string) as body").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    got = read_corpus(spark, src, text_col="body", limit=25, streaming=True, schema=schema, max_files=1)
    rows = spark.read.parquet(run_to_table(spark, got, "s6-test")).collect()
    assert sorted(r.id for r in rows) == list(range(25)) and all(r.text == str(r.id) for r in rows)


def test_stream_reads_a_table_of_part_files(spark, tmp_path):
    """A table is one file or a folder of them; the cleaned stream has the rows of both."""
    from qalam.plans.streams import stream_clean_kept, stream_web_kept
    text = "هذا نص طويل يكفي للبوابة الاخيرة من بوابات التنظيف كلها بلا شك"
    rows = [(k, "s", text.translate(str.maketrans("ابتثجحخدذرزسشصضطظعغفقكلمنه", "abcdefghijklmnopqrstuvwxyz"))) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "raw"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "raw").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for query in (stream_clean_kept, stream_web_kept):
        one, parts = ([tuple(r) for r in query(spark, str(tmp_path / d)).orderBy("id").collect()] for d in ("one", "parts"))
        assert one == parts and len(one) > 10
