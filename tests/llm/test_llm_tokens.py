"""Subword encoding, id files, the quality classifier and the pipeline."""

import hashlib
import random
import tempfile
import zlib

import numpy as np
import pytest
from llm_edge import SF, documents, edge, empty, rows

import __spark_entry__ as E
import corpus_pipeline
from qalam.llm import bpe_prefix, id_coder, id_files, quality
from qalam.plans.session import materialize


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe_prefix.default_path())


def test_prefix_bpe_is_the_library(library):
    enc, rng = bpe_prefix.encoder(bpe_prefix.default_path()), random.Random(1)
    pool = "ab teh's 're'll  \n\t12!?.,éñ漢字😀  　՘\U0003fc3f<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["x<|endoftext|>y<|endoftext|>", "a" * 3000, " " * 3000, "aaab" * 700, "=-" * 900, "the" * 900, "ingtheion" * 300]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = enc.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert enc.decode(got) == library.decode(want, skip_special_tokens=False)
    assert enc.decode(np.array([162, 8, 50256], "<u4").tobytes()) == library.decode([162, 8, 50256], skip_special_tokens=False)


def test_pair_compatibility_is_encoding_the_pair():
    enc, rng = bpe_prefix.encoder(bpe_prefix.default_path()), random.Random(2)
    ids = [rng.randrange(5000) for _ in range(4000)]
    for a, b in zip(ids, ids[1:]):
        parts = [bytes([x]) for x in enc.token[a] + enc.token[b]]
        while True:        # plain merging by rank
            ranked = [(enc.rank.get((enc.single.get(x.decode("latin-1"), -1), enc.single.get(y.decode("latin-1"), -1)), 10 ** 9), i)
                      for i, (x, y) in enumerate(zip(parts, parts[1:]))]
            if not ranked or min(ranked)[0] == 10 ** 9:
                break
            i = min(ranked)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert enc.fits(a, b) == (parts == [enc.token[a], enc.token[b]])


def test_bpe_and_file_queries(spark, library):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    bpe = {r.doc_id: r for r in E.queries()["op7_bpe"](spark, SF).collect()}
    files = {r.doc_id: r for r in E.queries()["op8_id_files"](spark, SF).collect()}
    at = 0
    for d in sorted(docs):
        ids = library.encode(docs[d], add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        assert (bpe[d].n_tokens, bpe[d].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert bpe[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (files[d].start, files[d].n_tokens, files[d].ids_crc32) == (at, len(ids) + 1, zlib.crc32(raw + bytes(4)))
        at += len(ids) + 1


def test_starts_run_on_over_shards(spark, monkeypatch):
    monkeypatch.setattr(id_files, "DOCS_PER_SHARD", 30)
    folder = tempfile.mkdtemp() + "/ids"
    id_files.write_ids(documents(spark).repartition(5), folder)
    assert spark.read.parquet(folder).select("shard").distinct().count() > 3
    at = 0
    for r in id_files.read_ids(spark, folder).orderBy("doc_id").collect():
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and r.ids.endswith(bytes(4))
        at += r.n_tokens


@pytest.mark.parametrize("values", [1, 2, 40, 3000, 1 << 16])
def test_coder_round_trip(values):
    rng = np.random.default_rng(values)
    ids = rng.integers(0, values, 9000).astype(np.uint32)
    starts = np.array([0, 0, 10, 500, 2500, 2501])
    sizes = np.array([0, 10, 490, 2000, 1, 6499])
    blocks = id_coder.encode_blocks(ids, starts, sizes, 16)
    for got, s, n in zip(id_coder.decode_blocks(blocks, 16), starts, sizes):
        assert np.array_equal(got, ids[s:s + n])
    alone = id_coder.encode_blocks(ids, starts[3:4], sizes[3:4], 16)
    assert alone == blocks[3:4] and id_coder.decode_blocks(blocks[2:3], 16)[0].tolist() == ids[10:500].tolist()


def test_coder_compresses_and_notices_damage():
    ids = np.tile(np.arange(37, dtype=np.uint32) * 991, 300)
    block = id_coder.encode_blocks(ids, np.array([0]), np.array([len(ids)]), 16)[0]
    assert len(block) < len(ids) // 4
    rng = random.Random(4)
    for _ in range(40):
        i = rng.randrange(4, len(block))
        bad = block[:i] + bytes([block[i] ^ (1 + rng.randrange(255))]) + block[i + 1:]
        if 4 <= i < 12:
            continue              # the counts themselves
        try:                      # the last word holds spare bits: the ids are right or the block is refused
            assert np.array_equal(id_coder.decode_blocks([bad], 16)[0], ids)
        except ValueError:
            pass
    with pytest.raises(ValueError):
        id_coder.decode_blocks([block[:-2]], 16)


def test_quotient_is_exact():
    rng = np.random.default_rng(1)
    r = rng.integers(1, 1 << 40, 100_000).astype(np.uint64)
    v = rng.integers(0, 1 << 48, 100_000).astype(np.uint64)
    v = np.where(np.arange(len(v)) % 2, v, v // r * r)
    assert np.array_equal(id_coder._quotient(v, r), v // r)


def test_tokens_edge(spark, library):
    texts = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in rows())
    encoded = bpe_prefix.encode_documents(edge(spark))
    assert sorted(r.n_tokens for r in encoded.collect()) == sorted(
        len(library.encode(t, add_special_tokens=False).ids) for *_, t in texts)
    assert sorted(r.text for r in bpe_prefix.decode_documents(encoded).collect()) == sorted(t for *_, t in texts)
    folder = tempfile.mkdtemp() + "/ids"
    id_files.write_ids(edge(spark), folder)
    got = sorted(id_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (known, doc, text) in zip(got, texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc if known else None, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    folder = tempfile.mkdtemp() + "/ids"
    id_files.write_ids(empty(spark), folder)
    assert id_files.read_ids(spark, folder).count() == 0 and bpe_prefix.encode_documents(empty(spark)).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    true, accuracy = rng.random(40_000) < 0.8, np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((40_000, 5)) < accuracy, true[:, None], ~true[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, got, post = quality.fit_accuracies(patterns, counts.astype(float))
    assert abs(good - 0.8) < 0.02 and np.abs(got - accuracy).max() < 0.03


def test_quality_on_the_labels(spark):
    """Held-out accuracy: the labels take no part in training."""
    sf = "/root/testdata/sf0.01"
    rows = E.queries()["op10_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_quality_edge(spark):
    model, report = quality.fit(quality.prepare(documents(spark)))
    rows = quality.prepare(edge(spark))
    got = quality.score(rows, model).collect()
    assert len(got) == 13 and all((r.score, r.kept) == (0.0, False) for r in got if r.words == 0)
    assert all(r.kept for r in got if r.doc_id in (1, 2, 9))
    kept = quality.keep_good(edge(spark), model)
    assert kept.columns == edge(spark).columns and kept.count() == sum(r.kept for r in got)
    none = quality.prepare(empty(spark))
    assert quality.fit(none)[0] is None and quality.score(none, model).count() == 0
    assert quality.score(rows, None).filter("kept").count() == sum(r.words > 0 for r in got)


def test_pipeline_stage_by_stage(spark):
    docs = documents(spark)
    columns, before = docs.columns, docs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, SF))
        ids = {r.doc_id for r in after.select("doc_id").distinct().collect()}
        assert ids and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "tokens":
            assert after.columns == columns
        if name == "quality":
            assert not any(labels.get(d) == 0 for d in ids) and all(d in ids for d, q in labels.items() if q == 1)
        if name == "near":
            want = {r.doc_id for r in before.collect()} - {r.doc_id for r in __import__("qalam.llm.ngram_join", fromlist=["x"])
                                                           .link_documents(before, 5, 80, 100).filter("doc_id <> component_id").collect()}
            assert ids == want
        before = after
    again = E.queries()["pipeline"](spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, before.collect()))


def test_pipeline_stages_take_edge_rows_and_empty_tables(spark):
    for start in (edge(spark), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            after = materialize(stage(spark, docs, SF))
            docs = docs if name == "quality" else after       # the tiny table's classifier is not the point here
            if name != "tokens":
                assert after.columns == start.columns


def test_rows_decoded_together_and_two_halves_of_memory():
    """op7: Arrow joins the tokens of many rows; bytes that are not UTF-8 are replaced; a piece in use outlives a full memory."""
    import pyarrow as pa
    from qalam.llm import bpe_prefix
    coder = bpe_prefix.PrefixBpe(bpe_prefix.default_path(), memory=4)
    texts = ["", "one two one two", "naïve 😀 text", "a b c d e f g"]
    ids = coder.encode_all(pa.array(texts))
    assert coder.decode_all(ids).to_pylist() == texts == [coder.decode(x) for x in ids.to_pylist()]
    broken = [ids[2].as_py()[:8 + 4 * k] for k in range(4)] + [b""]
    assert coder.decode_all(pa.array(broken, pa.binary())).to_pylist() == [coder.decode(x) for x in broken]
    made = []
    memory = bpe_prefix._Memory(lambda p: made.append(p) or p.encode(), 4)
    for p in "hahbhchdhe":
        assert memory[p] == p.encode()
    assert made.count("h") == 1 and len(memory) + len(memory.older) <= 4


@pytest.fixture(scope="module")
def ids_of():
    return id_files.LibraryEncoder(bpe_prefix.default_path())


def test_each_distinct_word_is_encoded_once(ids_of, monkeypatch):
    """op8: a batch asks the encoder for its distinct words, not for every text."""
    import pyarrow as pa
    rng, asked, quick = random.Random(5), [], ids_of.quick
    vocabulary = ["".join(rng.choice("abcdefgh\u00e9") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    texts = [" ".join(rng.choices(vocabulary, k=100)) + "\n" for _ in range(100)]
    want = [ids_of(t) for t in texts]
    monkeypatch.setattr(ids_of, "quick", lambda t: asked.append(len(t)) or quick(t))
    got = ids_of.encode_all(pa.array(texts))
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert sum(asked) < sum(map(len, texts)) / 10


def test_texts_encoded_together_are_the_library(ids_of, library, monkeypatch):
    """White space of every kind at every place, added tokens, characters classed differently, empty texts, slices."""
    import pyarrow as pa
    rng = random.Random(6)
    pool = ["a", "b", "the", "'s", "'", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003",
            "\u2019", "\u2028", "\u3000", "\u3002", "\u1e9f", "\u00e9", "\u6f22", "\U0001f600", "12", "!?", "<|endoftext|>", "\u0558"]
    texts = ["", " ", "a", *["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(5000)], ""]
    array = pa.array(["left out", *texts]).slice(1)
    for some in (array, array.cast(pa.large_string()), array.slice(0, 1), array.slice(0, 0), pa.array(["", ""])):
        got = ids_of.encode_all(some)
        assert len(got) == len(some)
        for text, ids in zip(some.to_pylist(), got):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    low = [f"x{chr(c)} y{chr(c)}\n{chr(c)} \t{chr(c)}  z" for c in range(1, 0x3100)]
    assert [x.tolist() for x in ids_of.encode_all(pa.array(low))] == [ids_of.quick(t).tolist() for t in low]
    monkeypatch.setattr(id_files, "TEXTS", 10)
    long = "one two two  three " * 9
    assert ids_of.encode_all(pa.array([long]))[0].tolist() == ids_of(long).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(["", long, "a b", "c"])], names=["doc_id", "text"])
    got = dict(id_files._tokenised(bpe_prefix.default_path(), 0, iter([batch])))
    assert {d: x.tolist() for d, x in got.items()} == {
        d: [*ids_of(t).tolist(), 0] for d, t in enumerate(["", long, "a b", "c"])}


def test_coded_blocks_stay_the_same():
    """Blocks of the first version of the coder (their digests) are still written, and so read."""
    rng = np.random.default_rng(8)
    digests = []
    for ids in (rng.integers(0, 1 << 16, 60_000), rng.zipf(1.2, 60_000) % 50_257, np.arange(60_000) // 7 % 300):
        starts = np.arange(0, 60_000, 2048)
        sizes = np.minimum(2048, 60_000 - starts)
        blocks = id_coder.encode_blocks(ids.astype(np.uint16), starts, sizes, 16)
        assert np.array_equal(np.concatenate(id_coder.decode_blocks(blocks, 16)), ids)
        digests.append(hashlib.sha256(b"".join(blocks)).hexdigest()[:16])
    assert digests == ["562d66f916b89fb1", "c447a4e24d7bc09c", "9bff5643fb0dcedb"]


def test_quotient_next_to_whole_numbers():
    rng = np.random.default_rng(9)
    r = rng.integers(1 << 4, 1 << 48, 100_000).astype(np.uint64) >> rng.integers(0, 44, 100_000).astype(np.uint64)
    r = np.maximum(r, np.uint64(1))
    q = np.uint64((1 << 48) - 1) // r
    for v in (q * r, q * r - np.uint64(1), np.full(len(r), (1 << 48) - 1, dtype=np.uint64)):
        assert np.array_equal(id_coder._quotient(v, r), v // r)
