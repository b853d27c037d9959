"""Personal data, line deduplication, fingerprints and the n-gram join against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
from llm_edge import PROSE, SF, documents, edge, empty
from pyspark.sql import functions as F

import __spark_entry__ as E
from qalam.llm import fingerprint, line_dedup, ngram_join, pii, quality
from qalam.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")
STRICT = (("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
          ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")), ("card", re.compile(r"[0-9]([ -]?[0-9])+")),
          ("phone", re.compile(r"\+[0-9][ ().0-9-]+[0-9]")))


def strict(text):
    out = []
    for k, (name, pattern) in enumerate(STRICT):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), name))
    return [(s, e, n) for s, _, e, n in sorted(out)]


def test_base_spans_are_the_plain_patterns():
    rng = random.Random(3)
    parts = ["1", "2", "0", "255", ".", ".", "@", "@", "a", "b.", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "é",
             "+1 (743) 555-3824", "x@y.z", "\n", "999"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == strict(text), text


def test_base_spans_are_linear_on_long_runs():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 100_000, "@" * 200_000):
        pii.base_spans(text)


def test_pii_query_keeps_base_spans(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = E.queries()["op2_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = strict(docs[r.doc_id])
        listed = ",".join(f"{n}:{s}:{e}" for s, e, n in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(n == k for *_, n in base) for k, _ in STRICT]


def test_trees_add_spans_in_like_format_and_context(spark):
    rng = random.Random(1)

    def number():
        return f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"

    rows = [(i, f"please call me on +1 {number()} today") for i in range(300)]
    rows += [(300 + i, f"order number {rng.randint(10**9, 10**10)} was shipped in {rng.randint(1000, 9999)}") for i in range(300)]
    rows += [(600 + i, f"please call me on 1 {number()} today") for i in range(20)]
    rows += [(700 + i, f"you may write to bob{i}@corp{i}.org about it") for i in range(50)]
    found = {r.doc_id: r.found for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([(x.kind, x.base) for x in found[i]] == [(3, True)] for i in range(300))
    assert all([(x.kind, x.base) for x in found[700 + i]] == [(0, True)] for i in range(50))
    assert not any(found[300 + i] for i in range(300))
    hits = [found[600 + i] for i in range(20)]
    assert sum(bool(f) and f[0].kind == 3 and not f[0].base for f in hits) >= 18
    for spans in found.values():
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_pii_edge(spark):
    got = pii.describe(pii.find_pii(edge(spark))).collect()
    assert len(got) == 13 and [r.spans for r in got if r.doc_id == 7] == ["email:4:11,ip:12:20"]
    assert pii.find_pii(empty(spark)).count() == 0


def _normal(line):
    return re.sub(r"\s+", " ", re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", line)).strip()


def test_exactly_repeated_lines_go_but_stay_in_the_first_document(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    seen = collections.defaultdict(set)
    for d, t in docs.items():
        for line in t.split("\n"):
            seen[_normal(line)].add(d)
    got = {r.doc_id: r for r in E.queries()["op3_line_dedup"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs.items():
        kept = got[d].text.split("\n")
        lines = t.split("\n")
        assert got[d].n_lines == len(lines) and len(lines) - got[d].dropped_lines == (len(kept) if got[d].text or "" in lines else 0)
        rest = iter(lines)
        assert all(line in rest for line in kept if line)          # a subsequence
        for line in lines:
            n = _normal(line)
            words = n.split(" ")
            # lines without variable fields: the template is the line
            if len(words) >= 4 and "<*>" not in words and len(seen[n]) >= 3 and d != min(seen[n]):
                assert line not in kept
            # short lines too, and lines of two documents
            if line.strip() and "<*>" not in words and len(seen[n]) >= 2 and d != min(seen[n]):
                assert line not in kept


def test_templates_generalise_fields(spark):
    names = ["Ann", "Bob", "Cid", "Dan", "Eve"]
    rows = [(i, f"Own text number {i} of this very page {'x' * i}\nUser {names[i]} wrote {i} comments in this old forum today")
            for i in range(5)]
    rows.append((9, "User Ann wrote a long poem about other things altogether instead"))
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string"), leading=1).collect()}
    assert "wrote" in got[0] and all("wrote" not in got[i] for i in range(1, 5))
    assert got[9] == rows[-1][1]


def test_lines_edge(spark):
    df = edge(spark)
    out = line_dedup.dedup_lines(df, min_docs=2)
    assert out.count() == 13 and set(out.columns) == set(df.columns)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert got[1][0].kept_text == PROSE and [r.kept_text for r in got[2]] == ["", ""] and got[9][0].dropped_lines == 1
    assert got[3][0].kept_text is None and got[5][0].kept_text == "  \n\t "
    kept = line_dedup.keep_deduplicated(df, min_docs=2)
    assert kept.columns == df.columns and kept.filter("doc_id in (2, 9)").count() == 0
    assert kept.filter("kept_text = 'clash'").count() == kept.count() == 10
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def _grams(text, k):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_fingerprints_estimate_the_jaccard_similarity(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = {r.doc_id: r for r in E.queries()["op4_fingerprint"](spark, SF).collect()}
    ids, errors, of = sorted(docs, reverse=True), [], {}
    for i, d in enumerate(ids):
        after, text, r = docs[ids[(i + 1) % len(ids)]], docs[d], rows[d]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (_grams(t, 5) for t in (text, edited, after))
        errors += [r.near_edited - len(a & b) / max(1, len(a | b)), r.near_next - len(a & c) / max(1, len(a | c))]
        assert of.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) in (0, 2 * fingerprint.BINS)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_fingerprint_buckets_do_not_change_the_order(spark):
    docs = documents(spark).withColumn("doc_id", F.when(F.col("doc_id") == 7, F.lit(10 ** 17)).otherwise(F.col("doc_id")))
    ids = sorted((r.doc_id for r in docs.collect()), reverse=True)
    text = {r.doc_id: r.text for r in docs.collect()}
    for per in (1, 7, 1000):
        got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, per_bucket=per).select("doc_id", "next_text").collect()}
        assert all(got[d] == text[ids[(i + 1) % len(ids)]] for i, d in enumerate(ids))


def test_fingerprint_edge(spark):
    got = fingerprint.fingerprint_edits(edge(spark)).collect()
    assert len(got) == 13
    of = {r.doc_id: r for r in got}
    assert of[3].fingerprint == of[4].fingerprint == of[5].fingerprint == ""
    assert of[4].near_next == 1.0 and of[9].fingerprint == of[1].fingerprint and of[10].near_next == 0.0
    one = edge(spark).filter("doc_id = 1")
    assert fingerprint.fingerprint_edits(one).first().near_next == 1.0
    assert fingerprint.fingerprint_edits(empty(spark)).count() == 0


def _linked(docs, k, num, den, lower=True):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {d: _grams((t or "").translate(low), k) for d, t in docs.items()}
    inv, links, up = collections.defaultdict(list), collections.Counter(), {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sorted(sets):
        shared = collections.Counter(e for g in sets[d] for e in inv[g])
        for e, n in shared.items():
            if den * n >= num * (len(sets[d]) + len(sets[e]) - n):
                links[d] += 1
                links[e] += 1
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
        for g in sets[d]:
            inv[g].append(d)
    return {d: (len(s), find(d), links[d]) for d, s in sets.items()}


def test_join_on_the_tables(spark):
    want = _linked({r.doc_id: r.text for r in documents(spark).collect()}, 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in E.queries()["op5_ngram_join"](spark, SF).collect()}
    assert got == want


def test_join_on_near_copies_of_every_kind(spark, monkeypatch):
    """Families of edits around the threshold, short texts, boilerplate that many share; small blocks,
    small parts and many heavy counters force every path."""
    rng = random.Random(11)
    docs, words = {}, [f"w{i}" for i in range(60)]
    boiler = [rng.choice(words) for _ in range(30)]
    for f in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = rng.choice(words)
            if f % 3 == 0:
                own += boiler
            docs[len(docs)] = " ".join(own)
    monkeypatch.setattr(ngram_join, "PART_SETS", 2)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for k, num in ((4, 85), (2, 60)):
        want = _linked(docs, k, num, 100)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links)
               for r in ngram_join.link_documents(df, k, num, 100, block_sets=2).collect()}
        assert got == want


def test_long_lists_pass_through():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    rows = sorted((int(t), int(b), 10, int(p)) for t, b, p in zip(rng.integers(0, 6, 300) ** 2, rng.integers(0, 40, 300), rng.integers(0, 2, 300)))
    whole = {}
    for size in (7, 50, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + size])], names=["token", "block", "n", "pos"])
                   for i in range(0, 300, size)]
        old, ngram_join.LONG = ngram_join.LONG, 52
        try:
            out = [r for b in ngram_join._listed(85, 100, iter(batches)) for r in b.to_pylist()]
        finally:
            ngram_join.LONG = old
        long_rows = sorted((r["token"], r["a"], r["lists"], r["need"]) for r in out if r["b"] is None)
        per = collections.Counter(t for t, *_ in rows)
        assert long_rows == [r for r in rows if per[r[0]] > 52] and long_rows
        pairs = {(r["a"], r["b"]): r["lists"] for r in out if r["b"] is not None}
        assert pairs == whole.setdefault("pairs", pairs) and pairs


def test_join_edge(spark):
    got = collections.defaultdict(list)
    for r in ngram_join.link_documents(edge(spark), 4, 85, 100).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.n_links))
    assert sum(map(len, got.values())) == 13
    assert got[1] == got[9] == [(16, 1, 4)] and got[2] == [(16, 1, 4)] * 2     # with the null id's longer text
    assert got[3] == [(0, 3, 0)] and got[8] == [(1, 8, 0)] and sorted(got[None], key=str) == [(0, None, 0), (17, 1, 4)]
    kept = ngram_join.keep_one(edge(spark), k=4, num=85, den=100)
    assert kept.columns == edge(spark).columns and kept.filter("doc_id in (2, 9)").count() == 0
    assert ngram_join.link_documents(empty(spark)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_many_repeated_lines_in_long_documents(spark):
    lines = [f"line {'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760)} of text" for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "own words here\n" + "\n".join(lines))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1].dropped_lines == 0 and got[2].dropped_lines == 60_000 and got[2].kept_text == "own words here"


def test_quality_takes_a_word_of_30000_parts(spark):
    docs = spark.createDataFrame([(1, "well-known" + "-known" * 30_000), (2, "it's" + "'s" * 30_000)], "doc_id long, text string")
    votes = quality.labellers(F.col("shape"), F.col("words"))
    assert quality.prepare(docs).select(*votes.values()).count() == 2
