"""Subword learning: passes equal one merge at a time; encode/decode round trip."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qalam.operators.bpe import (WordEncoder, decode, diagnose_roundtrip, encode, encode_places, learn_bpe,
                                 vocab_report)
from qalam.operators.bpe_learn import _apply, _cut, joined, learn_runs
from tests.conftest import one_col


def _sequential(words: Counter, n_merges: int, min_freq: int = 2, prefix: str = "##"):
    """Plain BPE: most frequent adjacent pair (ties: smallest left, right), merged left to right."""
    segs = {w: [c if i == 0 else prefix + c for i, c in enumerate(w)] for w in words}
    out = []
    for _ in range(n_merges):
        pc = Counter()
        for w, s in segs.items():
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += words[w]
        if not pc:
            break
        (a, b), c = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))
        if c < min_freq:
            break
        m = a + (b[len(prefix):] if b.startswith(prefix) else b)
        out.append((a, b, m, c))
        for w, s in segs.items():
            r, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    r.append(m)
                    i += 2
                else:
                    r.append(s[i])
                    i += 1
            segs[w] = r
    return out


def _corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    return lines


def test_passes_over_runs_equal_one_merge_at_a_time(spark):
    for seed in (1, 2):
        lines = _corpus(seed)
        df = one_col(spark, lines, "text")
        wc = Counter(w for ln in lines for w in ln.split())
        n_alpha = len({c for w in wc for c in w[:1]}) + len({"##" + c for w in wc for c in w[1:]})
        size = 5 + n_alpha + 25
        for runs in (100_000, 30, 8):       # whole words, then few runs and many passes
            m, _ = learn_bpe(spark, df, vocab_size=size, most_runs=runs)
            got = [tuple(r) for r in m.orderBy("rank").select("left", "right", "merged", "count").collect()]
            assert got == _sequential(wc, 25)
            assert len(learn_bpe.last_rounds) == 1 or runs < 100


def test_encode_decode_round_trip(spark):
    lines = _corpus(3)
    df = one_col(spark, lines, "text").withColumn("id", F.monotonically_increasing_id())
    m, v = learn_bpe(spark, df, vocab_size=40)
    enc = encode(df, m, v, ["id"])
    dec = decode(enc, v, ["id"])
    got = {r["id"]: r["text"] for r in dec.collect()}
    src = {r["id"]: r["text"] for r in df.collect()}
    assert got == src
    ids = [r["ids"] for r in enc.collect()]
    assert all(x[0] == 2 and x[-1] == 3 for x in ids)
    rep = vocab_report(v).first()
    assert rep["size"] == v.count() and rep["subword"] > 0


def test_fast_mode_takes_several_merges_a_round(spark):
    lines = _corpus(4)
    df = one_col(spark, lines, "text")
    m_exact, v_exact = learn_bpe(spark, df, vocab_size=45)
    m_fast, v_fast = learn_bpe(spark, df, vocab_size=45, exact=False)
    assert len(learn_bpe.last_rounds) < m_fast.count() == m_exact.count()
    assert v_fast.count() == v_exact.count()
    assert m_fast.filter(F.col("count") < 2).count() == 0
    assert m_fast.select("exact").distinct().collect()[0][0] is False


def _passes(words: Counter, budget: int, most_pairs: int):
    """The passes of the learner without Spark, with few pairs in each."""
    import pandas as pd
    table = pd.DataFrame([(" ".join(c if i == 0 else "##" + c for i, c in enumerate(w)), n) for w, n in words.items()],
                         columns=["sym", "freq"])
    existing, out = {s for w in table["sym"] for s in w.split(" ")}, []
    while len(out) < budget:
        counts = Counter()
        for s, n in zip(table["sym"], table["freq"]):
            for p in zip(s.split(" "), s.split(" ")[1:]):
                counts[p] += n
        top = sorted(((c, p) for p, c in counts.items() if c >= 2), key=lambda x: (-x[0], x[1]))
        if not top:
            break
        floor = top[most_pairs][0] if most_pairs < len(top) else 1
        most, active = budget - len(out), {p for c, p in top[:most_pairs] if c > floor}
        if not active:
            active, floor, most = {top[0][1]}, top[0][0] - 1, 1
        runs = pd.concat(_cut(active)([table]))
        got = list(learn_runs([(r.split(" "), n) for r, n in zip(runs["run"], runs["n"])], floor, most, existing, "##", False))
        out += [(l, r, joined(l, r, "##"), c) for l, r, c in got]
        table = next(_apply([m[:2] for m in got], "##")([table.copy()]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=25), st.integers(1, 12))
def test_any_floor_gives_the_same_merges(words, most_pairs):
    # few letters: merged strings come up again, pairs of equal symbols and ties abound
    counts = Counter({w: 1 + 3 * k % 7 for k, w in enumerate(words)})
    assert _passes(counts, 40, most_pairs) == _sequential(counts, 40)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=30), st.integers(0, 2**16))
def test_heap_encoding_equals_merging_the_lowest_rank_first(word, seed):
    rnd = random.Random(seed)
    symbols, merges = ["a", "b", "##a", "##b"], []
    for _ in range(8):
        pair = rnd.choice(symbols), rnd.choice([s for s in symbols if s.startswith("##")])
        merges.append(pair)
        symbols.append(joined(*pair, "##"))
    ranks = {p: k for k, p in enumerate(merges)}
    got = [c if i == 0 else "##" + c for i, c in enumerate(word)]
    while found := [ranks[p] for p in zip(got, got[1:]) if p in ranks]:
        pair, out, i = next(p for p, k in ranks.items() if k == min(found)), [], 0
        while i < len(got):
            hit = i + 1 < len(got) and (got[i], got[i + 1]) == pair
            out.append(joined(*pair, "##") if hit else got[i])
            i += 1 + hit
        got = out
    vocab = {s: k for k, s in enumerate(dict.fromkeys(symbols))}
    assert WordEncoder(ranks, vocab, "##")[word] == [vocab[s] for s in got]


def test_long_words_and_bounded_memory():
    coder = WordEncoder({("a", "##a"): 0, ("##a", "##a"): 1}, {"a": 0, "##a": 1, "aa": 2, "##aa": 3}, "##", room=2000)
    assert len(coder["a" * 100_000]) == 50_000 and not coder
    for k in range(50):
        coder["a" * k]
    assert 0 < len(coder) < 10 and coder.held <= 2000


def test_round_trips_are_placed(spark):
    """Spans cut the text exactly; unknown characters, spacing and clean-up are told apart, worked by hand."""
    rows = [("plain", "aab ab b"), ("spaces", " aab   b\nab "), ("lost", "ab aXb Ya b"), ("point", "ab.b"), ("clean", "ab . b"),
            ("bare", None), ("blank", " \t "), ("wide", "\U0001f600 ab\U0001f600b"), ("again", "b b b ab b")]
    df = spark.createDataFrame(rows, "key string, text string")
    learn = spark.createDataFrame([("aab ab ab b a . aab",)], "text string")
    merges, vocab = learn_bpe(spark, learn, vocab_size=40, min_frequency=1)
    placed = encode_places(df, merges, vocab, ["key"])
    ids = {r.key: list(r.ids) for r in encode(df, merges, vocab, ["key"], add_bos_eos=False).collect()}
    token = {r.id: r.token for r in vocab.collect()}
    for r in placed.collect():
        text = dict(rows)[r.key] or ""
        assert list(r.ids) == (ids[r.key] or [])
        covered = set()
        for one, a, b in zip(r.ids, r.starts, r.ends):
            assert token[one] in ("<unk>", text[a:b], "##" + text[a:b])
            covered |= set(range(a, b))
        assert all(c.isspace() for i, c in enumerate(text) if i not in covered)
    got = {r.key: tuple(r)[2:] for r in diagnose_roundtrip(df, placed, vocab, "key").collect()}
    #                  status, unknown ids, their characters, first, spacing errors, first, clean-up
    assert got == {
        "plain": ("match", 0, 0, None, 0, None, False),
        "spaces": ("mismatch", 0, 0, None, 2, 4, False),          # "aab" ends at 4, "b" before the line break at 8
        "lost": ("has_unk", 2, 2, 4, 0, None, False),             # "a" known, "X" at 4 and "Y" at 7 lost
        "point": ("mismatch", 0, 0, None, 2, 2, True),            # "ab . b", cleaned to "ab. b"
        "clean": ("mismatch", 0, 0, None, 0, None, True),         # decoded right, then cleaned to "ab. b"
        "bare": ("match", 0, 0, None, 0, None, False), "blank": ("match", 0, 0, None, 0, None, False),
        "wide": ("has_unk", 2, 2, 0, 0, None, False), "again": ("match", 0, 0, None, 0, None, False)}


def test_decoding_makes_no_row_per_token(spark):
    """M4: id lists are decoded whole; ids without a piece, empty and null lists, null and shared keys."""
    vocab = spark.createDataFrame([("<pad>", 0), ("<bos>", 2), ("a", 5), ("b", 6), ("##c", 7), (".", 8)], "token string, id int")
    rows = [("x", [2, 5, 7, 6, 8, 99, None]), ("y", []), ("z", None), (None, [5, 6]), ("w", [5, 6]), ("w", [6, 7])]
    out = decode(spark.createDataFrame(rows, "k string, ids array<int>"), vocab, ["k"])
    assert sorted((str(r.k), r.text) for r in out.collect()) == [
        ("None", ""), ("w", "a bc b"), ("w", "a bc b"), ("x", "ac b."), ("y", ""), ("z", "")]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    raw = decode(spark.createDataFrame(rows[:1], "k string, ids array<int>"), vocab, ["k"], cleanup=False, skip_special=False)
    assert raw.first().text == "<bos> ac b ."


def test_array_phase_equals_the_index(monkeypatch):
    """M1: merges of all runs in one array are those of the index and heap, and the passes may end between."""
    from qalam.operators import bpe_learn
    for seed in range(120):
        rnd = random.Random(seed)
        words = sorted({"".join(rnd.choice("abc"[:rnd.randint(1, 3)]) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 25))})
        runs = [([c if i == 0 else "##" + c for i, c in enumerate(w)], 1 + 3 * k % 7 + (1 << 40) * (seed % 3)) for k, w in enumerate(words)]
        floor, whole, got = rnd.randint(1, 4), rnd.random() < 0.5, []
        for symbols, many in ((1024, 1000), (0, 1000), (1024, 25)):         # the array, the index, one after the other
            monkeypatch.setattr(bpe_learn, "MOST_SYMBOLS", symbols)
            monkeypatch.setattr(bpe_learn, "MANY", many)
            existing = {s for r, _ in runs for s in r}
            got.append((list(learn_runs([(list(r), n) for r, n in runs], floor, 30, existing, "##", whole)), existing))
        assert got[0] == got[1] == got[2]


def test_plain_words_are_cut_as_by_the_pattern(spark):
    from qalam.operators.bpe import PRETOKEN, pretokenize
    rows = ["", " ", "سلام عليكم", "  a  b_1 ", "a,b", "كِتاب", "a\nb", "ا ب", None, "😀 x", "ة ى آ", "a-b c", "١٢ ab"]
    df = one_col(spark, rows, "text")
    got = df.select("text", pretokenize("text").alias("a"), F.regexp_extract_all("text", F.lit(PRETOKEN), 0).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got) == len(rows)


def test_decoding_in_arrays_equals_joining_pieces():
    import pyarrow as pa
    from qalam.operators.bpe import CLEANUP, _decoded
    rnd = random.Random(5)
    token = dict(enumerate(["a", "##b", "##", "####", ".", "n't", " ##x", "x y", "do", "not", "'", "", "##'s", "# "]))
    rows = [[[rnd.choice([*token, 99, None]) for _ in range(rnd.randint(0, 9))] for _ in range(1 + (k % 5 == 0))] for k in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array([k if k % 11 else None for k in range(600)]),
                                        pa.array(rows, pa.list_(pa.list_(pa.int32()))), pa.array([len(r) for r in rows])], names=["k", "i", "n"])
    for cleanup in (True, False):
        want = []
        for k, lists in enumerate(rows):
            pieces = [t for _, t in sorted((i, token[x]) for one in lists for i, x in enumerate(one) if x in token)] if len(lists) > 1 \
                else [token[x] for x in lists[0] if x in token]
            text = "" if k % 11 == 0 else " ".join(pieces).replace(" ##", "")
            for a, b in CLEANUP if cleanup else ():
                text = text.replace(a, b)
            want += [text] * len(lists)
        got = [t for b in _decoded(lambda: token, "##", cleanup, [batch]) for t in b.column(1).to_pylist()]
        assert got == want


def test_diagnosis_joins_no_id_list(spark, monkeypatch):
    """places and texts are read row by row; digests and counts alone are written or joined, also for keys that come again."""
    from qalam.operators import bpe
    rows = [("a", "ab aXb"), ("b", "aab  ab"), ("c", None), (None, "ab"), ("twice", "ab b"), ("twice", "b  aab")]
    df = spark.createDataFrame(rows, "key string, text string")
    merges, vocab = learn_bpe(spark, spark.createDataFrame([("aab ab ab b a aab",)], "text string"), vocab_size=40, min_frequency=1)
    seen = []
    monkeypatch.setattr(bpe, "materialize", lambda one: seen.append(one) or one)
    one = df.filter("key IS NULL OR key <> 'twice'")
    out = bpe.diagnose_roundtrip(one, encode_places(one, merges, vocab, ["key"]), vocab, "key")
    assert {r.key: r.status for r in out.collect()} == {"a": "has_unk", "b": "mismatch", "c": "match"}
    assert seen and not any("array<" in f.dataType.simpleString() for x in seen for f in x.schema.fields)
    both = bpe.diagnose_roundtrip(df, encode_places(df, merges, vocab, ["key"]), vocab, "key").filter("key = 'twice'").collect()
    # two texts, two encodings, one decoded text for each of the two rows, as the join of all three has it
    assert len(both) == 8 and {(r.n_tokens, r.n_gaps, r.status) for r in both} == {(2, 0, "mismatch"), (2, 1, "mismatch")}


def test_only_shared_keys_are_shuffled_to_be_decoded(spark, tmp_path):
    """Id lists stay where they are, but for keys that stand in several rows."""
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("##c", 7)], "token string, id int")
    rows = [(k, [5, 7, 6]) for k in range(20)] + [(None, [5])] * 2
    spark.createDataFrame(rows, "k int, ids array<int>").write.parquet(str(tmp_path / "t"))
    out = decode(spark.read.parquet(str(tmp_path / "t")), vocab, ["k"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, out.collect())) == sorted([f"Row(k={k}, text='ac b')" for k in range(20)] + ["Row(k=None, text='')"] * 2)


def test_words_are_counted_in_the_task(spark):
    """Words of a slice of texts are counted together before the shuffle, none is a row of its own."""
    from qalam.operators.bpe import word_frequencies
    texts = [None, "", "  ", "سلام  عليكم سلام", "a,b a", "كِتاب x", "a\u00a0b"] * 3
    out = word_frequencies(one_col(spark, texts, "text"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert {r.word: r.freq for r in out.collect()} == {"سلام": 6, "عليكم": 3, "a": 9, ",": 3, "b": 6, "كِتاب": 3, "x": 3}


def test_words_in_arrays_are_encoded_as_by_the_heap():
    """M3: also where a merge makes a symbol that an earlier one takes, for long words and many symbols."""
    import pyarrow as pa
    from qalam.operators import bpe_encode
    early = 0
    for seed in range(400):
        rnd = random.Random(seed)
        symbols, merges = ["a", "b", "##a", "##b"], []
        for _ in range(rnd.randint(0, 10)):
            pair = rnd.choice(symbols), rnd.choice([s for s in symbols if s.startswith("##")])
            merges.append(pair)
            symbols.append(joined(*pair, "##"))
        ranks = {p: k for k, p in enumerate(merges)}
        vocab = {s: k + 5 for k, s in enumerate(dict.fromkeys(symbols)) if rnd.random() < 0.9}
        words = ["".join(rnd.choice("aabX"[:rnd.randint(1, 4)]) for _ in range(rnd.choice([0, 1, 3, 8, 20, 70]))) for _ in range(12)]
        heap = WordEncoder(ranks, vocab, "##")
        most, bpe_encode.MOST_CELLS = bpe_encode.MOST_CELLS, 0 if seed % 2 else 1 << 22
        try:
            coder = bpe_encode.ArrayEncoder(ranks, vocab, "##")
        finally:
            bpe_encode.MOST_CELLS = most
        early += bool(coder.early.any())
        ids, lengths, sizes = coder.of_all(pa.array(words))
        assert ids.tolist() == [x for w in words for x in heap[w]] and sizes.tolist() == [len(heap[w]) for w in words]
        assert lengths.tolist() == [len(s) - (2 if i else 0) for w in words for i, s in enumerate(heap.pieces(w))]
    assert early > 20


def test_slices_keep_words_and_texts_together():
    import pyarrow as pa
    from qalam.operators.bpe_encode import code_points, cut_words, sliced
    rnd = random.Random(3)
    for _ in range(100):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice("اب a.\n😀 ") for _ in range(rnd.randint(0, 12))) for _ in range(20)]
        words = [t.replace("\n", " ").replace(".", " . ").split() if t else [] for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(
            [w if t and not set(t) <= set("اب a") else None for t, w in zip(texts, words)], pa.list_(pa.string()))], names=["t", "w"])
        at = 0
        for part in sliced([batch], -2, 20):
            got, ends = cut_words(part.column(0), part.column(1))
            mine = words[at:at + part.num_rows]
            assert got.to_pylist() == [x for w in mine for x in w]
            assert ends.tolist() == [sum(map(len, mine[:k])) for k in range(len(mine) + 1)]
            assert "".join(map(chr, code_points(part.column(0)))) == "".join(t or "" for t in texts[at:at + part.num_rows])
            at += part.num_rows
        assert at == 20
