"""Packing properties: pieces rebuild the stream, shards are full, blocks follow the loader rule."""

import random
import re

from pyspark.sql import functions as F

from qalam.operators.pack import (cut_shards, doc_offsets, pad_truncate, read_steps, shard_manifest, step_index,
                                  steps_per_epoch, training_blocks, write_shards)


def _docs(spark, n_docs=60, seed=7):
    rnd = random.Random(seed)
    rows = []
    for d in range(n_docs):
        src = f"s{d % 3}"
        ids = [rnd.randint(5, 99) for _ in range(rnd.randint(0, 40))]
        rows.append((d, src, [2] + ids + [3]))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, ids array<int>").withColumn(
        "n_tokens", F.size("ids"))


def test_pieces_rebuild_stream_and_shards_full(spark):
    rows, df = _docs(spark)
    S = 17
    pieces = cut_shards(doc_offsets(df, bucket_rows=4), "ids", S).collect()
    for src in {"s0", "s1", "s2"}:
        stream = [t for d, s, ids in sorted(rows) if s == src for t in ids]
        ps = sorted((p["shard_index"], p["pos"], p["piece"]) for p in pieces if p["source"] == src)
        rebuilt = [t for _, _, piece in ps for t in piece]
        assert rebuilt == stream
        sizes = {}
        for sh, _, piece in ps:
            sizes[sh] = sizes.get(sh, 0) + len(piece)
        last = max(sizes)
        assert all(v == S for k, v in sizes.items() if k != last)
        assert all(p["split"] == ("val" if p["shard_index"] == 0 else "train") for p in pieces)


def test_blocks_of_one_shard_worked_by_hand(spark):
    """One training shard of the ids 0..29, B x T = 2 x 3, two ranks.  A block of 6 ids needs a
    seventh as its last target.  Blocks start at 0, 6, 12, 18; rank 0 takes 0 and 12, rank 1 takes 6
    and, as 6 + 2 * 12 + 1 is past the end, no other."""
    df = spark.createDataFrame([("s", "train", 1, 0, list(range(13))), ("s", "train", 1, 13, list(range(13, 30)))],
                               "source string, split string, shard_index long, pos long, piece array<int>")
    got = {(b["rank"], b["step"], b["row"]): (list(b["x"]), list(b["y"])) for b in training_blocks(df, 2, 3, 2, "train").collect()}
    assert got == {
        (0, 0, 0): ([0, 1, 2], [1, 2, 3]), (0, 0, 1): ([3, 4, 5], [4, 5, 6]),
        (0, 1, 0): ([12, 13, 14], [13, 14, 15]), (0, 1, 1): ([15, 16, 17], [16, 17, 18]),
        (1, 0, 0): ([6, 7, 8], [7, 8, 9]), (1, 0, 1): ([9, 10, 11], [10, 11, 12])}


def test_blocks_start_where_the_formula_says(spark):
    """Over random shards: block k of rank r starts at (r + k * P) * B * T, and a rank's steps go on
    from shard to shard."""
    rows, df = _docs(spark, 80, 3)
    S, B, T, P = 50, 2, 4, 2
    pieces = cut_shards(doc_offsets(df), "ids", S)
    ids = {}
    for p in pieces.collect():
        ids.setdefault(f"{p['source']}_{p['split']}_{p['shard_index']:06d}", {})[p["pos"]] = p["piece"]
    ids = {n: [t for _, part in sorted(parts.items()) for t in part] for n, parts in ids.items() if "train" in n}
    steps = {}
    for b in training_blocks(pieces, B, T, P, "train").collect():
        steps.setdefault((b["rank"], b["step"]), []).append(b)
    for r in range(P):
        step = 0
        for name in sorted(ids):
            size = len(ids[name])
            count = max(1, (size - 1 - r * B * T) // (P * B * T)) if size > (r + 1) * B * T else 0
            for start in ((r + k * P) * B * T for k in range(count)):
                block = sorted(steps.pop((r, step)), key=lambda b: b["row"])
                assert [b["name"] for b in block] == [name] * B
                assert sum((list(b["x"]) for b in block), []) == ids[name][start:start + B * T]
                assert sum((list(b["y"]) for b in block), []) == ids[name][start + 1:start + B * T + 1]
                step += 1
    assert not steps


def test_pad_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1] * 10,)], "ids array<int>")
    out = [list(r[0]) for r in df.select(pad_truncate(F.col("ids"), 5)).collect()]
    assert out == [[1, 2, 3, 0, 0], [1, 1, 1, 1, 1]]


def test_offsets_with_sparse_order_keys(spark):
    # keys far apart: buckets are sized by rows per source, not by key range
    rows, df = _docs(spark, 50, 11)
    sparse = df.withColumn("doc_id", F.col("doc_id") * 1000003 + 7)
    got = {(r["source"], r["doc_id"]): r["start"] for r in doc_offsets(sparse, bucket_rows=3).collect()}
    for src in {"s0", "s1", "s2"}:
        pos = 0
        for d, s, ids in sorted(rows):
            if s == src:
                assert got[(src, d * 1000003 + 7)] == pos
                pos += len(ids)


def test_offsets_with_string_keys_null_sources_and_an_outlier(spark):
    rows = [(f"t3_{i:x}", None if i % 3 == 0 else "s", i % 5) for i in range(500)] + [("~~~~ far away", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id string, source string, n_tokens int")
    got = {(r["source"], r["doc_id"]): r["start"] for r in doc_offsets(df, bucket_rows=16).collect()}
    assert len(got) == 501
    for src in (None, "s"):
        at = 0
        for key, _, n in sorted(r for r in rows if r[1] == src) if src else sorted((r for r in rows if r[1] is None), key=lambda r: r[0]):
            assert got[src, key] == at
            at += n


def test_a_key_twice_in_a_source_is_an_error(spark):
    import pytest
    df = spark.createDataFrame([(1, "s", 2), (1, "s", 3), (1, "t", 3)], "doc_id long, source string, n_tokens int")
    with pytest.raises(Exception, match="key twice"):
        doc_offsets(df).collect()


def test_ranges_stay_even_with_clustered_keys(spark):
    from qalam.operators.ranges import range_numbered
    df = spark.createDataFrame([(i,) for i in range(2000)] + [(10 ** 15,)], "k long")
    sizes = [r["count"] for r in range_numbered(df, [F.col("k")], rows=100).groupBy("__r").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 400


def test_rank_of_equal_counts_and_prefixes(spark):
    from qalam.operators.pack import ordered_rank
    words = [(f"ال{i:05d}", 1) for i in range(1500)] + [("b", 3), ("a", 3), ("c", 2)]
    got = {r["w"]: r["rank"] for r in ordered_rank(spark.createDataFrame(words, "w string, n long"), "n", "w", range_rows=64).collect()}
    want = {w: i + 1 for i, (w, _) in enumerate(sorted(words, key=lambda x: (-x[1], x[0].encode())))}
    assert got == want


def test_split_keeps_rows_with_a_null_label(spark):
    from qalam.operators.dialect import stratified_split
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "x") for i in range(100)], "k long, l string")
    out = stratified_split(df, "l", "k").collect()
    assert len(out) == 100 and sum(r["is_test"] for r in out if r["l"] is None) == 5


def test_word_ids_by_look_up_equal_the_join(spark, monkeypatch):
    from qalam.operators import vocab as v
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, " c\u00a0zz\tb "), (None, "a")], "doc_id long, text string")
    words = v.word_vocabulary(docs.filter("doc_id < 4 OR doc_id IS NULL"))
    local = {r.doc_id: r.ids for r in v.encode_words(docs, words, ["doc_id"]).collect()}
    monkeypatch.setattr(v, "MOST_LOCAL_WORDS", 0)
    plan = v.encode_words(docs, words, ["doc_id"])
    assert {r.doc_id: r.ids for r in plan.collect()} == local
    assert local == {1: [2, 5, 6, 5, 3], 2: [2, 3], 3: [2, 3], 4: [2, 1, 1, 6, 3], None: [2, 5, 3]}


def test_only_rare_words_are_shuffled(spark, monkeypatch):
    """beyond the bound the frequent words are still looked up in place, row by row."""
    from qalam.operators import vocab as v
    docs = spark.createDataFrame([(1, "a b a q c"), (2, None), (3, ""), (4, " c zz b r"), (4, "r q zz a"), (None, "a b b c d")], "doc_id long, text string")
    words = v.word_vocabulary(docs.filter("text NOT LIKE '%zz%' OR text IS NULL"))
    whole = sorted(map(str, v.encode_words(docs, words, ["doc_id"]).collect()))
    for n in (1, 2, 3):
        monkeypatch.setattr(v, "MOST_LOCAL_WORDS", n)
        assert sorted(map(str, v.encode_words(docs, words, ["doc_id"]).collect())) == whole
    seen = []
    monkeypatch.setattr(v, "materialize", lambda df: seen.append(df) or df)
    v.encode_words(docs, words, ["doc_id"])
    assert sum(len(r["__rare"]) for r in seen[0].collect()) < sum(len((r.text or "").split()) for r in docs.collect()) / 2


def test_word_ids_shuffle_no_token(spark):
    from qalam.operators.vocab import encode_words, word_vocabulary
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = encode_words(docs, word_vocabulary(docs), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_steps_of_any_epoch_read_only_their_shards(spark, tmp_path):
    """A range of steps over three epochs equals the blocks of one epoch taken cyclically, per rank; shards
    without an asked step are not opened.  One source is null, one has a name with a slash."""
    rnd = random.Random(5)
    rows = [(d, [None, "a/b", "s"][d % 3], [2] + [rnd.randint(5, 99) for _ in range(rnd.randint(0, 60))] + [3]) for d in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, ids array<int>").withColumn("n_tokens", F.size("ids"))
    S, B, T, P = 150, 2, 4, 2
    pieces = cut_shards(doc_offsets(df), "ids", S)
    root = str(tmp_path / "shards")
    write_shards(pieces, root)
    manifest = shard_manifest(pieces)
    epoch = {}
    for b in training_blocks(pieces, B, T, P, "train").collect():
        epoch[(b["rank"], b["step"], b["row"])] = (list(b["x"]), list(b["y"]))
    total = steps_per_epoch(manifest, B, T, P, "train")
    assert total == [1 + max(s for r, s, _ in epoch if r == rank) for rank in range(P)] and total[0] != total[1]

    def read(first, last):
        out = read_steps(spark, root, manifest, B, T, P, "train", first, last)
        got = {(b["rank"], b["step"], b["row"]): (list(b["x"]), list(b["y"])) for b in out.collect()}
        assert got == {(r, s, row): epoch[(r, s % total[r], row)] for r in range(P) for s in range(first, last) for row in range(B)}
        return out
    read(total[0] - 3, 2 * total[0] + 5)
    one = read(5 * total[0] + 1, 5 * total[0] + 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard_index" in plan.split("PartitionFilters: [")[1].split("]")[0]
    n_shards = manifest.count()
    opened = {int(n) for n in re.findall(r"number of (?:files|partitions) read: (\d+)", plan)}
    index = step_index(manifest, B, T, P, "train", 5 * total[0] + 1, 5 * total[0] + 2)
    assert index.select("source", "shard_index").distinct().count() <= P < n_shards and all(n <= P for n in opened)
    assert read(7, 7).collect() == []
    none = step_index(manifest.filter("n_tokens < 0"), B, T, P, "train", 0, 10)
    assert none.collect() == [] and steps_per_epoch(manifest.filter("n_tokens < 0"), B, T, P, "train") == [0, 0]


def test_words_are_split_in_the_task_as_by_python(spark):
    """every white space, and words counted together before the shuffle."""
    from collections import Counter
    from qalam.operators.vocab import split_words, word_counts
    import pyarrow as pa
    texts = [f"a{chr(c)}b" for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF] + ["", " ", None, "\n a\t\tb 　"]
    words, ends = split_words(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in (t or "").split()] and ends[-1] == len(words)
    some = [t for t in texts if t is None or len(t) != 3] + [f"x{c}y x" for c in "\x1c\x85 ​."]
    out = word_counts(spark.createDataFrame([(t,) for t in some], "text string"))
    assert {r.word: r.n for r in out.collect()} == Counter(w for t in some for w in (t or "").split())
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_shards_are_written_by_their_tasks_and_only_asked_ones_listed(spark, tmp_path):
    """one file a shard, under its own name, whatever the source's name; steps list the folders they need."""
    import os
    names = [None, "", "a/b", "s=1", "100%", "x y", "7"]
    rows = [(s, "train" if k else "val", k, p * 3, [k, p, 9]) for s in names for k in range(3) for p in range(4)]
    pieces = spark.createDataFrame(rows, "source string, split string, shard_index long, pos long, piece array<int>").repartition(5)
    root = str(tmp_path / "shards")
    write_shards(pieces.limit(3), root)                      # is written over
    write_shards(pieces, root)
    files = [f for _, _, fs in os.walk(root) for f in fs if not f.endswith(".crc")]
    assert len(files) == len(names) * 3 and all(re.fullmatch(r"part-\d{5}(-none|-empty)?\.parquet", f) for f in files)
    back = spark.read.parquet(root).selectExpr("coalesce(cast(source AS string), '') AS source", "split", "cast(shard_index AS long) AS k", "pos", "piece")
    assert sorted(map(tuple, back.collect())) == sorted((s or "", *r) for s, *r in rows)
    named = pieces.filter("source IS NULL OR source <> ''")
    write_shards(named, root)
    out = read_steps(spark, root, shard_manifest(named), 1, 2, 1, "train", 2, 4)
    assert out.count() == 2 and "InMemoryFileIndex(1 paths)" in out._jdf.queryExecution().executedPlan().toString()


def test_bigram_losses_by_buckets(spark, monkeypatch, tmp_path):
    """the plain model's losses, whatever the chunks and buckets; rows of one key are one sequence; no bigram is joined."""
    import math
    from collections import Counter
    from qalam.operators import lm
    rnd = random.Random(2)
    rows = [(None if i % 17 == 0 else i // 2 if i % 5 == 0 else i, rnd.choice([None, "a", "b", ""]), None if i % 23 == 0 else
             [2] + [rnd.choice([5, 6, 7, 5, 5, 8]) for _ in range(rnd.randint(0, 9))] + [3] if i % 9 else [2][:i % 2]) for i in range(400)]
    pairs = [((k, s), a, b) for k, s, ids in rows for a, b in zip(ids or (), (ids or ())[1:])]
    both, left = Counter((a, b) for _, a, b in pairs), Counter(a for _, a, _ in pairs)
    want: dict = {}
    for key, a, b in pairs:
        loss, n = want.get(key, (0.0, 0))
        want[key] = loss - math.log((both[a, b] + 0.5) / (left[a] + 0.5 * 9)), n + 1
    spark.createDataFrame(rows, "doc_id long, source string, ids array<int>").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for ids, chunk in ((4_000_000, 2_000_000), (50, 40)):
        monkeypatch.setattr(lm, "BUCKET_IDS", ids)
        monkeypatch.setattr(lm, "CHUNK_IDS", chunk)
        out = lm.bigram_losses(df, ["doc_id"], "source", k=0.5, vocab_size=9)
        got = {(r.doc_id, r.source): (r.loss, r.n_tokens) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(n == want[k][1] and abs(x - want[k][0] / n) < 1e-9 for k, (x, n) in got.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
