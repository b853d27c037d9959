"""Filter interaction audit, fill-in-middle and best-fit packing."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_edge import SCHEMA, SF, documents, edge, empty, rows
from pyspark.sql import functions as F

import __spark_entry__ as E
from qalam.llm import best_fit, filter_audit, piece_table

WORD = re.compile("[^\x20\x09-\x0D]+")


def _mask(text):
    words = WORD.findall(text)
    return ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
            | (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) << 2 | bool(re.search("[#$%&*|]", text)) << 3)


def _brute_audit(docs, labels):
    """``docs``: (id, text, part) rows."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    masked = [(p or "", _mask(t or "") | (i is not None and least[t or ""] < i) << 4, i in good, i in toxic)
              for i, t, p in docs]
    out, shapley = {}, collections.Counter()
    for part in {m[0] for m in masked}:
        for order in itertools.permutations("ABCDE"):
            left = [m for m in masked if m[0] == part]
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                hit = [m for m in left if m[1] & bit]
                left = [m for m in left if not m[1] & bit]
                every = [m for m in masked if m[0] == part]
                fails = sum(m[1] & bit > 0 for m in every)
                out[part, "".join(order), step] = [len(left), len(hit), fails - len(hit), sum(m[1] == bit for m in every),
                                                   sum(m[2] for m in hit), sum(m[3] for m in hit)]
                shapley[part, f] += len(hit)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                               r.shapley) for r in df.collect()}


def _written(spark, df, tmp_path, files, order=None):
    """The rows in one file each, in the order of ``order``: later files may bring smaller ids."""
    path = str(tmp_path / "docs.parquet")
    for k, cond in enumerate(order or [F.lit(True)]):
        df.filter(cond).coalesce(files).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("batches", [1, 6])
def test_audit_retracts_when_smaller_ids_come_later(spark, tmp_path, batches):
    docs = documents(spark)
    copies = docs.withColumn("doc_id", F.col("doc_id") + 1000).filter("doc_id % 3 = 0")
    all_docs = docs.unionByName(copies)
    # descending ids: every copy comes before its original
    order = [F.col("doc_id") >= 1100, F.col("doc_id").between(1000, 1099), F.col("doc_id").between(150, 999),
             F.col("doc_id").between(100, 149), F.col("doc_id").between(50, 99), F.col("doc_id") < 50]
    path = _written(spark, all_docs, tmp_path, 1, order)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    masks = filter_audit.count_masks(spark, path, labels, batches=batches, groups=7)
    got = _got(filter_audit.interactions(masks))
    want = _brute_audit([(r.doc_id, r.text, r.lang) for r in all_docs.collect()],
                        [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert got == want
    assert sum(r.n for r in masks.collect()) == all_docs.count() and masks.filter("mask >= 16").count() > 0


def test_audit_edge(spark, tmp_path):
    path = _written(spark, edge(spark), tmp_path, 2)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = _got(filter_audit.audit(spark, path, labels))
    docs = [(r[0], r[1], r[2]) for r in rows()]
    assert got == _brute_audit(docs, [(1, 1, 0), (1, 0, 1), (3, 0, 1)])
    assert len(got) == 2 * 600
    none = _written(spark, empty(spark), tmp_path / "none", 1)
    assert filter_audit.audit(spark, none, labels).count() == 0


def test_audit_string_ids(spark, tmp_path):
    docs = [("b", "x y", "en"), ("a", "x y", None), ("c", "x y", "en"), (None, "x y", "")]
    path = _written(spark, spark.createDataFrame(docs, "doc_id string, text string, lang string"), tmp_path, 1)
    labels = spark.createDataFrame([("a", 1, 1)], "doc_id string, quality int, toxic int")
    assert _got(filter_audit.audit(spark, path, labels)) == _brute_audit(docs, [("a", 1, 1)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a\n", "\n", "é漢😀\n", "<P", ">", "<S>", "S>\n", "end", "<"]), max_size=12),
       st.integers(0, 2**128 - 1))
def test_transform_and_restore(parts, draw):
    text, marks = "".join(parts), tuple(m.encode() for m in piece_table.MARKS)
    n, form, pre, mid, out, sha = piece_table._transform(marks, 100, 50, text.encode(), f"{draw:032x}")
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert n == len(lines) and sha == hashlib.sha256(out).hexdigest()
    assert piece_table._restored(marks, out, form) == (text.encode(), hashlib.sha256(text.encode()).hexdigest())
    if not text or any(m in text for m in piece_table.MARKS):
        assert form == "plain" and out == text.encode()
        return
    h = [int(f"{draw:032x}"[i:i + 8], 16) for i in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    assert (pre, mid) == (len(a), len(b)) and form == ("spm" if h[3] % 100 < 50 else "psm")
    assert out.decode() == (f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}")


def test_piece_table_moves_descriptors_only():
    text = b"one two three"
    table = piece_table.PieceTable(text, b"##")
    table.cut(0, 4)
    table.cut(1, 4)
    table.append(1, 0, 2)
    assert table.pieces == [(0, 0, 4), (0, 4, 4), (0, 8, 5), (1, 0, 2)]
    table.arrange((2, 3, 0, 1))
    assert table.read() == b"three##one two " and table.sha256() == hashlib.sha256(table.read()).hexdigest()
    table.restore((2, 3, 0, 1))
    assert table.read() == text + b"##" and all(b.obj in (text, b"##") for b in table.buffers)


def test_fill_in_middle_edge(spark):
    long_text = "line of words\n" * 200_000
    more = spark.createDataFrame([(11, long_text), (12, "has <S> inside\nit"), (13, "\n" * 30_000)], "doc_id long, text string")
    docs = edge(spark).select("doc_id", "text").unionByName(more)
    back = piece_table.restore(piece_table.fill_in_middle(docs)).collect()
    assert len(back) == 16
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text or "")
    for r in back:
        assert r.restored in texts[r.doc_id]
        assert (r.form == "plain") == (r.doc_id in (3, 4, 12) or r.restored == "")
    one = {r.doc_id: r for r in back}
    assert one[11].n == 200_000 and one[13].n == 30_000 and one[12].n == 2
    assert piece_table.fill_in_middle(empty(spark)).count() == 0
    plain = piece_table.fill_in_middle(docs, fim_percent=0).select("form").distinct().collect()
    assert [r.form for r in plain] == ["plain"]
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            piece_table.fill_in_middle(docs, marks=bad)


def _plain_packing(lengths, capacity):
    """Piece by piece: matching of the large ones, then best fit; the fills of the sequences."""
    big = sorted((x for x in lengths if x > capacity // 3), reverse=True)
    bins = []
    while big:
        a = big.pop(0)
        fit = next((i for i, b in enumerate(big) if a + b <= capacity), None)
        bins.append(a if fit is None else a + big.pop(fit))
    for x in sorted((x for x in lengths if x <= capacity // 3), reverse=True):
        room = [(capacity - b, i) for i, b in enumerate(bins) if b + x <= capacity]
        if room:
            bins[min(room)[1]] += x
        else:
            bins.append(x)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40), st.data())
def test_plan_equals_packing_piece_by_piece(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    counts = np.bincount(lengths, minlength=capacity + 1)
    made = best_fit.plan(counts, capacity)
    ends = np.append(made.first[1:], sum(counts))
    at = collections.defaultdict(list)
    for k in range(len(made.first)):
        for j in range(int(ends[k] - made.first[k])):
            s = int(made.sequence[k]) + j // int(made.per[k])
            at[s].append((int(made.offset[k]) + j % int(made.per[k]) * int(made.length[k]), int(made.length[k])))
    for slots in at.values():
        slots.sort()
        assert [o for o, _ in slots] == list(np.cumsum([0] + [n for _, n in slots])[:-1])
    assert sorted(sum(n for _, n in v) for v in at.values()) == _plain_packing(lengths, capacity)
    assert sorted(n for v in at.values() for _, n in v) == sorted(lengths) and len(at) == made.sequences


def test_packed_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark)
    want = {}
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, p] = (a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
    rows = E.queries()["op13_best_fit"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert sum(n for _, n in v) <= 1024 and [o for o, _ in v] == list(np.cumsum([0] + [n for _, n in v])[:-1])
    lengths = [w[1] for w in want.values()]
    assert len(by) == len(_plain_packing(lengths, 1024)) <= -(-sum(lengths) // 1024) * 1.02 + 1


def test_pack_edge_and_sequences(spark):
    more = spark.createDataFrame([(None, "same")] * 40 + [(20, "")] * 30, "doc_id long, text string")
    docs = edge(spark).select("doc_id", "text").unionByName(more)
    packed = best_fit.pack(docs).collect()
    assert sum(r.piece == 0 for r in packed) == 83
    by_doc = collections.Counter((r.doc_id, r.length) for r in packed)
    assert by_doc[None, 2] == 40 and by_doc[3, 1] == by_doc[4, 1] == 1 and by_doc[20, 1] == 30
    whole = {(r.sequence_id): r for r in best_fit.sequences(best_fit.pack(docs, capacity=64)).collect()}
    assert all(len(r.ids) == 4 * r.n_tokens <= 256 for r in whole.values())
    packed = best_fit.pack(docs, capacity=64).collect()
    for r in packed:
        assert bytes(whole[r.sequence_id].ids)[4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert best_fit.pack(empty(spark)).count() == 0
    strings = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id for r in best_fit.pack(strings).collect()} == {"a", "b"}
