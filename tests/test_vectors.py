"""Blocked retrieval ranks against brute force on a small fixture (many cells)."""

import re

import numpy as np
from pyspark.sql import functions as F

from qalam.operators.vectors import masked_mean_pool, retrieval_ranks, scored_ranks


def test_blocked_ranks_equal_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = sorted((r["vec_id"], list(r["embedding"])) for r in e.collect())
    src = e.filter(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("i"), (F.col("vec_id") + 1).alias("partner"),
                                                    F.col("embedding").alias("vec"))
    tgt = e.filter(F.col("vec_id") % 2 == 1).select(F.col("vec_id").alias("j"), F.col("embedding").alias("vec"))
    got = {r["i"]: r["rank"] for r in retrieval_ranks(src, tgt, block=16, chunk=5).collect()}
    vec = {i: np.asarray(v, dtype=np.float64) / max(np.linalg.norm(v), 1e-12) for i, v in rows}
    tids = [i for i, _ in rows if i % 2 == 1]
    for i, _ in rows:
        if i % 2 or (i + 1) not in vec:
            continue
        sims = {j: float(np.dot(vec[i], vec[j])) for j in tids}
        own = sims[i + 1]
        # exact ties are impossible to tell apart from rounding here; ranks
        # agree when no other similarity is within 1e-12 of the partner's
        if any(j != i + 1 and abs(s - own) < 1e-12 for j, s in sims.items()):
            continue
        assert got[i] == 1 + sum(s > own for s in sims.values()), i
    assert len(got) == len([i for i, _ in rows if i % 2 == 0 and (i + 1) in vec])


def _plain_ranks(src, tgt):
    """Every pair, one by one; null vectors and absent partners as in the docstring."""
    def unit(v):
        v = np.asarray(v, dtype=np.float64)
        return v / max(np.sqrt((v * v).sum()), 1e-12)
    t = {j: unit(v) for j, v in tgt if v is not None}
    out = {}
    for i, partner, v in src:
        if v is None or partner not in t:
            out[i] = None
            continue
        s = unit(v)
        own = (s * t[partner]).sum()
        sims = {j: (s * x).sum() for j, x in t.items()}
        out[i] = 1 + sum(x > own for x in sims.values()) + sum(x == own and j < partner for j, x in sims.items())
    return out


def _clustered(seed, groups, n, d=16, noise=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    which = rng.integers(groups, size=n)
    base = centre[which]
    tgt = base + noise * rng.normal(size=(n, d))
    src = tgt + noise * rng.normal(size=(n, d))
    return ([(i, i, src[i].tolist()) for i in range(n)], [(i, tgt[i].tolist()) for i in range(n)])


def _frames(spark, src, tgt):
    return (spark.createDataFrame(src, "i long, partner long, vec array<double>"),
            spark.createDataFrame(tgt, "j long, vec array<double>"))


def test_clustered_vectors_score_under_a_third_of_the_pairs_in_many_tasks(spark):
    src, tgt = _clustered(1, 20, 1500)
    out = scored_ranks(*_frames(spark, src, tgt), block=64)
    got = out.collect()
    assert {r.i: r["rank"] for r in got} == _plain_ranks(src, tgt)
    assert sum(r.scored for r in got) < len(src) * len(tgt) / 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(b#\d+, sb#\d+L?, tb#\d+, (\d+)\), REPARTITION_BY_NUM", plan).group(1) != "1"


def test_equal_zero_null_and_hot_vectors_keep_their_ranks(spark):
    src, tgt = _clustered(2, 5, 200, d=4)
    one, zero = [1.0, 0.0, 0.0, 0.0], [0.0] * 4
    # a third of the targets is one vector; some have no length, some are missing
    tgt += [(1000 + k, one) for k in range(150)] + [(2000, zero), (2001, zero), (2002, None)]
    src += [(1000 + k, 1149 - k, one) for k in range(20)] + [(3000, 2001, one), (3001, 2000, zero), (3002, 1005, zero),
                                                             (3003, 2002, one), (3004, 99_999, one), (3005, 5, None),
                                                             (3006, None, one)]
    got = {r.i: r["rank"] for r in retrieval_ranks(*_frames(spark, src, tgt), block=16, chunk=7).collect()}
    assert got == _plain_ranks(src, tgt)


def test_no_targets_no_ranks(spark):
    src, tgt = _frames(spark, [(1, 1, [1.0]), (2, 2, None)], [])
    assert {r.i: r["rank"] for r in retrieval_ranks(src, tgt).collect()} == {1: None, 2: None}
    src, tgt = _frames(spark, [], [(1, [1.0])])
    assert retrieval_ranks(src, tgt).collect() == []


def test_pooling_here_and_in_blocks_equals_the_plain_mean(spark):
    rng = np.random.default_rng(4)
    vec = {k: rng.normal(size=5) for k in range(-3, 60)}
    docs = [(f"d{k}", rng.integers(-3, 70, size=int(rng.integers(0, 80))).tolist()) for k in range(120)]
    docs += [("long", rng.integers(-3, 60, size=40_000).tolist()), ("null", None), ("pads", [0, 0]), ("holes", [None, 5, None]),
             ("strange", [999]), (None, [7, 7, 0])]
    df = spark.createDataFrame(docs, "doc string, ids array<int>")
    table = spark.createDataFrame([(k, v.tolist()) for k, v in vec.items()] + [(None, [1.0] * 5), (1000, None)],
                                  "k long, v array<double>")
    for most in (10_000, 40, 5):
        got = {r.doc: r for r in masked_mean_pool(df, table, "doc", "ids", "k", "v", pad=0, most_numbers=most).collect()}
        assert len(got) == len(docs)
        for name, ids in docs:
            known = [vec[i] for i in ids or [] if i is not None and i != 0 and i in vec]
            mean = np.sum(known, axis=0) / len(known) if known else np.zeros(5)
            want = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
            assert got[name].n_tokens == len(known)
            assert np.allclose(got[name].vector, want, atol=1e-12)
    plan = masked_mean_pool(df, table, "doc", "ids", "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert masked_mean_pool(df.filter("false"), table, "doc", "ids", "k", "v", most_numbers=5).collect() == []
