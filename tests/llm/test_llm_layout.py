"""Sharding, exact deduplication and mixing."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from llm_edge import SF, documents, edge, empty
from pyspark.sql import functions as F

import __spark_entry__ as E
from qalam.llm import exact_dedup, mixing, sharding


def test_shards_follow_the_row_law_and_the_mixture(spark):
    rows = sharding.shard_rows(documents(spark), 8).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 200 and sorted(by) == list(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    per = collections.Counter((r.source, r.shard) for r in rows)
    whole = collections.Counter(r.source for r in rows)
    # fractional ranks: every shard gets its share of every source, one row more or less
    assert all(abs(per[s, k] - n / 8) <= 2 for s, n in whole.items() for k in range(8))


def test_shards_do_not_depend_on_partitioning_or_bucket_size(spark):
    docs = documents(spark)
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs, 8).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs.repartition(7), 8, rows_per_bucket=3).collect()}
    assert one == two


def test_shards_edge(spark):
    got = sharding.shard_rows(edge(spark), 4).collect()
    assert len(got) == 13 and sorted((r.shard, r.slot) for r in got) == [
        (s, i) for s, n in enumerate((4, 3, 3, 3)) for i in range(n)]
    null = [r for r in got if r.doc_id == 3][0]
    assert (null.size, null.text_crc32, null.grown_shard) == (1, 0, None)
    seven = [r for r in got if r.doc_id == 7][0]
    raw = "é漢😀 x@y.org 10.0.0.1\n\nsecond line here now".encode()
    assert (seven.size, seven.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard_rows(empty(spark), 4).count() == 0


def _groups(rows):
    want = collections.defaultdict(list)
    for i, t in rows:
        want[t or ""].append(i)
    return want


@pytest.mark.parametrize("digest", [None, lambda sha: F.substring(sha, 1, 1).cast("binary")])
@pytest.mark.parametrize("hot_rows", [0, 10_000])
def test_exact_groups_also_when_digests_collide_and_when_all_are_hot(spark, digest, hot_rows):
    docs = documents(spark).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"))
    want = _groups((r.doc_id, r.text) for r in docs.collect())
    got = exact_dedup.exact_dedup(docs, digest=digest, hot_rows=hot_rows).collect()
    assert len(got) == 200
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = want[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_exact_edge(spark):
    got = exact_dedup.exact_dedup(edge(spark)).collect()
    assert len(got) == 13
    of = collections.defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
    assert of[9][0].kept and of[9][0].group_size == 4            # 1, 2, 2 again, 9
    assert [r.kept for r in of[2]] == [False, False] and of[1][0].keep_id == 9
    assert of[3][0].keep_id == of[4][0].keep_id == 4             # null is the empty text
    assert sorted((r.keep_id, r.kept) for r in of[None] if r.keep_id) == [(4, False)]
    assert [r.kept for r in of[None] if r.keep_id is None] == [True]
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def _brute_targets(size, weight):
    total, t = sum(size.values()), {}
    free, left = set(size), sum(size.values())
    while True:
        w = sum(weight[s] for s in free)
        t.update({s: left * weight[s] / w for s in free} if w else {})
        over = {s for s in free if t[s] > 3 * size[s]}
        if not over:
            return t, total
        for s in over:
            t[s] = 3 * size[s]
        free -= over
        left = total - sum(3 * size[s] for s in size if s not in free)


def test_mixture_reaches_targets(spark):
    rows = E.queries()["op9_mixing"](spark, SF).collect()
    text = {r.doc_id: r for r in documents(spark).collect()}
    word = re.compile("[^\x20\x09-\x0D]+")
    size = collections.Counter()
    for r in rows:
        assert r.size == len(word.findall(text[r.doc_id].text or ""))
        size[r.source] += r.size
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    want, _ = _brute_targets(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken, unused = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        if r.size and r.taken < r.size * (want[r.source] // size[r.source] + 1):
            unused[r.source].append(r.size)
    # what is missing is less than the smallest document that the mix could still use
    assert all(abs(taken[s] - want[s]) <= min(unused[s], default=1) for s in size)
    assert abs(sum(taken.values()) - sum(size.values())) < 0.02 * sum(size.values())
    again = {r.doc_id: r.taken for r in E.queries()["op9_mixing"](spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_split_tree_deals_every_block_once():
    counts = [1000, 3, 0, 77, 412]
    q = mixing.split_tree(counts, 7, seed=5)
    assert q.sum(axis=0).tolist() == counts and q.min() >= 0
    assert np.ptp(q.sum(axis=1)) <= 2
    share = np.mean([mixing.split_tree([600, 200], 4, seed=s)[0, 0] for s in range(300)])
    assert abs(share - 150) < 2            # the hypergeometric mean


def test_mix_edge_and_mixed_rows(spark):
    plan, uses = mixing.mix(edge(spark), shards=3)
    assert plan.count() == 13 and uses.agg(F.max("shard")).first()[0] <= 2
    copies = {r.row: r.copies for r in plan.collect()}
    used = collections.Counter(r.row for r in uses.collect())
    assert all(used[row] == n for row, n in copies.items())
    mixed = mixing.mixed_documents(edge(spark))
    assert mixed.columns == edge(spark).columns and mixed.count() == sum(copies.values())
    assert mixing.mix(empty(spark))[0].count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_mixture_with_a_third_of_the_rows_without_an_id(spark):
    docs = documents(spark).withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    same = spark.createDataFrame([(None, "the same words here", "en", "hot", 19)] * 400, docs.schema)
    plan, _ = mixing.mix(docs.unionByName(same), rows_per_block=4)
    taken, target, least, most = collections.Counter(), {}, {}, collections.Counter()
    for r in plan.collect():
        most[r.source] = max(most[r.source], r.size)
        taken[r.source] += r.size * r.copies
        target[r.source] = (r.target, r.source_size)
        if r.size and r.copies <= r.target // r.source_size:
            least[r.source] = min(r.size, least.get(r.source, r.size))
    assert all(abs(taken[s] - t) <= least.get(s, most[s]) for s, (t, _) in target.items())


def test_words_are_counted_without_an_array(spark):
    from qalam.llm.common import WORD, count_words
    texts = ["", " ", "\t\n", "a", " a  b\x0b\x0cc\r\n", "é\u00a0ö ü", "x" * 50_000, "a " * 50_000, "\u2003a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", count_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len(re.findall(WORD, r.t)) for r in rows]
