"""Registered queries: parallel corpus, dialect evaluation, vectors and retrieval
(J2, U1, L1, L2, L6, W5, W6, A5–A10, A18, J3, J4, J5, W2, L4, M5, M6, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalam.operators.dialect import (CITIES, CITY_TO_REGION, accuracy_by, best_by, class_weights, f1_table,
                                     label_codes, linear_probe, majority_baseline, per_class_scores,
                                     region_table, stratified_split, with_region)
from qalam.operators.parallel import drop_all_null, first_n_per_group, first_pairs, row_argmax, unpivot_texts, widen
from qalam.operators.probe import probe_checkpoints
from qalam.operators.vectors import l2_normalize, masked_mean_pool, retrieval_metrics, retrieval_ranks
from qalam.plans.packing import STREAM_SQL, _encoded
from qalam.plans.registry import query
from qalam.plans.session import materialize
from qalam.sources.fixtures import fixture, fixture_sql
from qalam.sources.tables import read_table

LANGS = ["ALX", "BEI", "CAI", "MSA"]
PL = f"WITH pl AS ({fixture_sql('parallel_long')})\n"
WIDE = PL + ", wide AS (SELECT sent_id, " + ", ".join(
    f"max(sent) FILTER (WHERE lang = '{l}') AS {l}" for l in LANGS) + " FROM pl GROUP BY sent_id)\n"


def _wide(spark, sf_dir):
    return widen(fixture(spark, sf_dir, "parallel_long"), LANGS)


@query("parallel_wide", WIDE + "SELECT * FROM wide")
def parallel_wide(spark, sf_dir):
    """N-way outer merge on sentence id as one pivot."""
    return _wide(spark, sf_dir)


@query("parallel_examples", PL + "SELECT sent_id, lang, sent AS text FROM pl WHERE sent IS NOT NULL")
def parallel_examples(spark, sf_dir):
    """Wide → labelled (sent_id, lang, text), nulls dropped."""
    return unpivot_texts(_wide(spark, sf_dir), LANGS)


PS = f"WITH ps AS ({fixture_sql('parallel_sentences')})\n"


@query("parallel_first_n", PS + """SELECT sent_id, lang, sent AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sent_id) AS rn FROM ps WHERE sent IS NOT NULL) WHERE rn <= 1000""")
def parallel_first_n(spark, sf_dir):
    """L1: first 1,000 non-null sentences per dialect (the limit is the feature)."""
    wide = widen(fixture(spark, sf_dir, "parallel_sentences"), LANGS)
    return first_n_per_group(unpivot_texts(wide, LANGS), 1000, "lang", "sent_id")


@query("parallel_first_pairs", PS + """SELECT * FROM (SELECT sent_id, max(sent) FILTER (WHERE lang = 'MSA') AS src,
  max(sent) FILTER (WHERE lang = 'CAI') AS tgt FROM ps GROUP BY sent_id)
WHERE src IS NOT NULL AND tgt IS NOT NULL ORDER BY sent_id LIMIT 1000""")
def parallel_first_pairs(spark, sf_dir):
    """L1, pair form: first 1,000 rows with a sentence in both columns (the limit is the feature)."""
    return first_pairs(widen(fixture(spark, sf_dir, "parallel_sentences"), LANGS), "MSA", "CAI", 1000)


@query("parallel_nonempty", WIDE + "SELECT * FROM wide WHERE " + " OR ".join(f"{l} IS NOT NULL" for l in LANGS))
def parallel_nonempty(spark, sf_dir):
    """L2: drop wide rows whose texts are all null."""
    return drop_all_null(_wide(spark, sf_dir), LANGS)


SPLIT = PL + """, ex AS (SELECT sent_id, lang FROM pl WHERE sent IS NOT NULL),
r AS (SELECT sent_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', CAST(sent_id AS VARCHAR)))) AS rn,
             count(*) OVER (PARTITION BY lang) AS n FROM ex),
sp AS (SELECT sent_id, lang, rn <= round(n * 0.2) AS is_test FROM r)
"""


def _split(spark, sf_dir):
    ex = unpivot_texts(_wide(spark, sf_dir), LANGS)
    return stratified_split(ex, "lang", "sent_id", 0.2, 42)


@query("stratified_split", SPLIT + "SELECT sent_id, lang, is_test FROM sp")
def stratified_split_q(spark, sf_dir):
    """Deterministic stratified 80/20 split by dialect."""
    return _split(spark, sf_dir).select("sent_id", "lang", "is_test")


@query("label_codes", PL + "SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lang FROM pl)")
def label_codes_q(spark, sf_dir):
    """Sorted labels → 0..n-1."""
    return label_codes(fixture(spark, sf_dir, "parallel_long"), "lang")


@query("class_weights", SPLIT + """, c AS (SELECT lang, count(*) AS n FROM sp WHERE NOT is_test GROUP BY lang),
a AS (SELECT l.lang, coalesce(c.n, 1) AS n FROM (SELECT DISTINCT lang FROM sp) l LEFT JOIN c USING (lang))
SELECT lang, CAST(n AS BIGINT) AS n, round((1.0 / n) / sum(1.0 / n) OVER () * count(*) OVER (), 9) AS weight FROM a""")
def class_weights_q(spark, sf_dir):
    """A5: inverse-frequency class weights on the train split."""
    sp = _split(spark, sf_dir)
    w = class_weights(sp.filter(~F.col("is_test")), sp, "lang")
    return w.withColumn("n", F.col("n").cast("long")).withColumn("weight", F.round("weight", 9))


@query("majority_baseline", SPLIT + """, top AS (SELECT arg_min(lang, (-n, lang)) AS majority FROM
  (SELECT lang, count(*) AS n FROM sp WHERE NOT is_test GROUP BY lang))
SELECT (SELECT majority FROM top) AS majority,
  avg(CASE WHEN lang = (SELECT majority FROM top) THEN 1.0 ELSE 0.0 END) AS accuracy FROM sp WHERE is_test""")
def majority_baseline_q(spark, sf_dir):
    """Train majority class and its test accuracy."""
    sp = _split(spark, sf_dir)
    return majority_baseline(sp.filter(~F.col("is_test")), sp.filter(F.col("is_test")), "lang")


_CITY_VALUES = ", ".join(f"({i}, '{c}', '{CITY_TO_REGION[c]}')" for i, c in enumerate(sorted(CITIES)))
PRED = f"""WITH pr AS ({fixture_sql('predictions')}),
cities(code, city, region) AS (VALUES {_CITY_VALUES}),
pc AS (SELECT p.checkpoint, p.vec_id, p.target, p.pred, t.city AS target_city, coalesce(t.region, 'UNK') AS target_region,
              q.city AS pred_city, coalesce(q.region, 'UNK') AS pred_region
       FROM pr p LEFT JOIN cities t ON p.target = t.code LEFT JOIN cities q ON p.pred = q.code)
"""


def _preds(spark, sf_dir):
    pr = fixture(spark, sf_dir, "predictions")
    codes = label_codes(spark.createDataFrame([(c,) for c in CITIES], "city string"), "city")
    regions = region_table(spark)
    tc = codes.select(F.col("code").alias("target"), F.col("city").alias("target_city"))
    pc = codes.select(F.col("code").alias("pred"), F.col("city").alias("pred_city"))
    x = pr.join(F.broadcast(tc), "target", "left").join(F.broadcast(pc), "pred", "left")
    x = with_region(x, "target_city", "target_region", regions)
    return with_region(x, "pred_city", "pred_region", regions)


@query("checkpoint_accuracy", PRED + """SELECT checkpoint, avg(CASE WHEN target = pred THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(CASE WHEN target_region = pred_region THEN 1.0 ELSE 0.0 END) AS region_accuracy FROM pc GROUP BY checkpoint""")
def checkpoint_accuracy(spark, sf_dir):
    """A7 + J4 + W6 decode: city and region accuracy per checkpoint."""
    p = _preds(spark, sf_dir)
    a = accuracy_by(p, "checkpoint", "target", "pred", "accuracy")
    r = accuracy_by(p, "checkpoint", "target_region", "pred_region", "region_accuracy")
    return a.join(r, "checkpoint")


SCORES = PRED + """, sup AS (SELECT checkpoint, target AS cls, count(*) AS support FROM pc GROUP BY ALL),
tp AS (SELECT checkpoint, target AS cls, count(*) AS tp FROM pc WHERE target = pred GROUP BY ALL),
np AS (SELECT checkpoint, pred AS cls, count(*) AS n_pred FROM pc GROUP BY ALL),
j AS (SELECT s.checkpoint, s.cls, s.support, coalesce(tp.tp, 0) AS tp, coalesce(np.n_pred, 0) AS n_pred
      FROM sup s LEFT JOIN tp USING (checkpoint, cls) LEFT JOIN np USING (checkpoint, cls)),
pr2 AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM j),
sc AS (SELECT checkpoint, cls, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  CAST(support AS BIGINT) AS support FROM pr2)
"""


@query("class_scores", SCORES + "SELECT * FROM sc")
def class_scores(spark, sf_dir):
    """Per-class precision, recall, F1, support per checkpoint."""
    return per_class_scores(_preds(spark, sf_dir), "checkpoint", "target", "pred")


@query("f1_table", SCORES + "SELECT checkpoint, " + ", ".join(
    f"max(f1) FILTER (WHERE cls = {c}) AS f1_{c}" for c in range(10)) + " FROM sc GROUP BY checkpoint")
def f1_table_q(spark, sf_dir):
    """One result row per checkpoint with f1_<class> columns."""
    return f1_table(per_class_scores(_preds(spark, sf_dir), "checkpoint", "target", "pred"), "checkpoint", range(10))


@query("best_checkpoint", PRED + """SELECT arg_min(checkpoint, (-accuracy, checkpoint)) AS checkpoint, max(accuracy) AS accuracy
FROM (SELECT checkpoint, avg(CASE WHEN target = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM pc GROUP BY checkpoint)""")
def best_checkpoint(spark, sf_dir):
    """L4: checkpoint with the best accuracy (ties: the first)."""
    return best_by(accuracy_by(_preds(spark, sf_dir), "checkpoint", "target", "pred"), "accuracy", "checkpoint")


ARGMAX_COLS = [f"c{i}" for i in range(64)]      # every dimension of the embeddings


@query("row_argmax", """SELECT vec_id, concat('c', CAST(list_position(embedding, list_max(embedding)) - 1 AS VARCHAR)) AS label
FROM embeddings""")
def row_argmax_q(spark, sf_dir):
    """Row-wise argmax over named score columns (first maximum wins)."""
    e = read_table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(ARGMAX_COLS)])
    return e.select("vec_id", row_argmax(ARGMAX_COLS).alias("label"))


@query("doc_vectors", STREAM_SQL + """,
tv AS (SELECT s.doc_id, e.embedding FROM stream s JOIN embeddings e ON e.vec_id = s.id % (SELECT count(*) FROM embeddings)),
dims AS (SELECT doc_id, unnest(generate_series(1, 64)) AS k, unnest(embedding) AS x FROM tv),
mean AS (SELECT doc_id, k, sum(x::DOUBLE) / greatest(count(*), 1) AS m FROM dims GROUP BY doc_id, k),
nrm AS (SELECT doc_id, greatest(sqrt(sum(m * m)), 1e-12) AS nr FROM mean GROUP BY doc_id),
ntok AS (SELECT doc_id, count(*) AS n FROM stream GROUP BY doc_id)
SELECT doc_id, CAST(any_value(ntok.n) AS BIGINT) AS n_tokens,
  round(sum(m / nr), 9) AS v_sum, round(sum(m / nr * k), 9) AS v_wsum, round(max(CASE WHEN k = 1 THEN m / nr END), 9) AS v_first
FROM mean JOIN nrm USING (doc_id) JOIN ntok USING (doc_id) GROUP BY doc_id""")
def doc_vectors(spark, sf_dir):
    """M8 + A18 + J5: token vectors (id modulo the rows of embeddings) of every id of
    each whole document, masked mean-pooled and L2-normalised."""
    vecs = read_table(spark, sf_dir, "embeddings")
    n = vecs.count()
    enc = _encoded(spark, sf_dir).select("doc_id", F.transform("ids", lambda x: x % F.lit(n)).alias("ids"))
    pooled = masked_mean_pool(enc, vecs, "doc_id", "ids", "vec_id", "embedding", pad=None)
    v = F.col("vector")
    # sums whose order differs between engines are reported to 9 decimals
    return pooled.select("doc_id", F.col("n_tokens").cast("long"),
                         F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 9).alias("v_sum"),
                         F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0),
                                             lambda a, x: a + x), 9).alias("v_wsum"),
                         F.round(v[0], 9).alias("v_first"))


RETR = """WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nr FROM embeddings),
s AS (SELECT vec_id AS i, vec_id + 1 AS partner, embedding AS v, nr FROM e WHERE vec_id % 2 = 0),
t AS (SELECT vec_id AS j, embedding AS v, nr FROM e WHERE vec_id % 2 = 1),
sim AS (SELECT s.i, s.partner, t.j, list_sum(list_transform(list_zip(s.v, t.v), lambda p: (p[1]::DOUBLE / greatest(s.nr, 1e-12)) * (p[2]::DOUBLE / greatest(t.nr, 1e-12)))) AS sim FROM s, t),
own AS (SELECT i, sim AS own FROM sim WHERE j = partner),
ranks AS (SELECT sim.i, CAST(1 + count(*) FILTER (WHERE sim > own) + count(*) FILTER (WHERE sim = own AND j < partner) AS BIGINT) AS rank
          FROM sim JOIN own USING (i) GROUP BY sim.i)
"""


def _ranks(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    src = e.filter(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("i"), (F.col("vec_id") + 1).alias("partner"),
                                                    F.col("embedding").alias("vec"))
    tgt = e.filter(F.col("vec_id") % 2 == 1).select(F.col("vec_id").alias("j"), F.col("embedding").alias("vec"))
    return retrieval_ranks(src, tgt)


@query("retrieval_ranks", RETR + "SELECT i, rank FROM ranks")
def retrieval_ranks_q(spark, sf_dir):
    """J3 + W2: rank of the true partner (vec_id + 1) for every even vec_id."""
    return _ranks(spark, sf_dir)


@query("retrieval_metrics", RETR + """SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_1,
  round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_5,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_10,
  round(avg(1.0 / rank), 9) AS mrr FROM ranks""")
def retrieval_metrics_q(spark, sf_dir):
    """A10: Recall@1/5/10 and MRR."""
    m = retrieval_metrics(_ranks(spark, sf_dir))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("linear_probe")
def linear_probe_q(spark, sf_dir):
    """M6: class-weighted multinomial probe on embeddings; test predictions
    (an iterative fit: rows-only check)."""
    e = read_table(spark, sf_dir, "embeddings")
    sp = stratified_split(e, "label", "vec_id", 0.2, 42)
    w = class_weights(sp.filter(~F.col("is_test")), sp, "label").select("label", "weight")
    train = sp.filter(~F.col("is_test")).join(w, "label")
    test = sp.filter(F.col("is_test"))
    out = linear_probe(train, test, "embedding", "label", "weight", max_iter=30)
    return out.select("vec_id", F.col("label").alias("target"), "pred")


# Vectors of three checkpoints: the first numbers of the embedding, more of them as training goes on.
CHECKPOINT_WIDTHS = {0: 5, 1: 10, 2: None}


def checkpoint_vectors(spark, sf_dir):
    """``(checkpoint, vec_id, vec, city, part)``: the city is the place of the largest of the first ten numbers; a
    stratified fifth is the test part, a fifth of the rest validation."""
    e = read_table(spark, sf_dir, "embeddings")
    e = e.withColumn("city", (F.array_position(F.slice("embedding", 1, 10), F.array_max(F.slice("embedding", 1, 10))) - 1).cast("int"))
    sp = stratified_split(e, "city", "vec_id", 0.2, 42)
    rest = stratified_split(sp.filter(~F.col("is_test")).drop("is_test"), "city", "vec_id", 0.2, 43)
    rows = (rest.withColumn("part", F.when(F.col("is_test"), "val").otherwise("train"))
                .unionByName(sp.filter("is_test").withColumn("part", F.lit("test"))))
    each = [F.struct(F.lit(k).alias("checkpoint"), l2_normalize(F.slice("embedding", 1, n) if n else F.col("embedding")).alias("vec"))
            for k, n in CHECKPOINT_WIDTHS.items()]
    return rows.select("vec_id", "city", "part", F.inline(F.array(*each)))


@query("probe_by_checkpoint")
def probe_by_checkpoint(spark, sf_dir):
    """One fit of all checkpoints' probes (M6), then accuracy (A7), F1 per class (A8, A9) and the best checkpoint (L4)
    on the test part (an iterative fit; the tests compare it with a plain one)."""
    preds, epochs = probe_checkpoints(checkpoint_vectors(spark, sf_dir), "checkpoint", "vec_id", "vec", "city", "part", 10)
    preds = materialize(preds)
    acc = accuracy_by(preds, "checkpoint", "city", "pred")
    best = best_by(acc, "accuracy", "checkpoint").select(F.col("checkpoint").alias("__best"))     # one row
    table = acc.join(f1_table(per_class_scores(preds, "checkpoint", "city", "pred"), "checkpoint", range(10)), "checkpoint")
    chosen = epochs.filter("chosen").select("checkpoint", F.col("epoch").alias("chosen_epoch"), "val_accuracy")
    return (table.join(chosen, "checkpoint").join(F.broadcast(best), F.col("checkpoint") == F.col("__best"), "left")
                 .withColumn("is_best", F.col("__best").isNotNull()).drop("__best"))


# The labels of the given embeddings do not depend on the vectors, so M6 is judged on a label that does.
SIDE = "CASE WHEN embedding[{0}] > embedding[{1}] THEN 'first' ELSE 'second' END"


@query("probe_against_majority", f"""WITH r AS (SELECT {SIDE.format(1, 2)} AS side, count(*) AS n FROM embeddings GROUP BY side)
SELECT CAST(sum(round(n * 0.2)) AS BIGINT) AS n_test, true AS beats_majority FROM r""")
def probe_against_majority(spark, sf_dir):
    """M6 against A6 on a label the vectors decide: a prediction for every test row, better than the
    most frequent label by a quarter of all rows at least."""
    e = read_table(spark, sf_dir, "embeddings").withColumn("side", F.expr(SIDE.format(0, 1)))
    e = e.withColumn("code", (F.col("side") == "first").cast("int"))
    sp = stratified_split(e, "side", "vec_id", 0.2, 42)
    train, test = sp.filter(~F.col("is_test")), sp.filter("is_test")
    preds = linear_probe(train, test, "embedding", "code", max_iter=50)
    base = majority_baseline(train, test, "code").select(F.col("accuracy").alias("base"))
    own = preds.agg(F.count("pred").cast("long").alias("n_test"), F.avg((F.col("code") == F.col("pred")).cast("double")).alias("own"))
    # two one-row tables
    return (own.withColumn("__k", F.lit(1)).join(base.withColumn("__k", F.lit(1)), "__k")
               .select("n_test", (F.col("own") > F.col("base") + 0.25).alias("beats_majority")))
