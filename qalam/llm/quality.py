"""Quality classifier from weak labels (operator 10).

1. Heuristic labellers vote good, bad or abstain on every document.  They look
   at the text's shape: digits become 0, lower-case runs 1, single capitals 2,
   runs of capitals 3, a word before its own repetition 4; other characters stay.
2. Expectation-maximisation over the counts of vote patterns (all documents;
   at most 3**labellers patterns) estimates each labeller's accuracy and the
   share of good documents.
3. The posterior of a document's pattern labels a bounded sample, which trains
   a logistic scorer on hashed shape words and pairs of shape words.
4. The scorer rates every whole document.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalam.llm.common import key_bucket, materialize, seeded_key

SAMPLE_ROWS = 20_000        # training rows at most, about; drawn by a hash of the id from all documents
FEATURES = 1 << 12
KEEP_FROM = 0.5             # documents with a lower score are rejected
_SCALE = 1_000_000


def shape(text: Column) -> Column:
    s = F.regexp_replace(text, r"\p{Nd}+", "0")
    s = F.regexp_replace(s, r"(?<![^ \n])([^ \n]++)(?= \1(?![^ \n]))", "4")
    s = F.regexp_replace(s, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "1")
    s = F.regexp_replace(s, r"\p{Lu}{2,}", "3")
    return F.regexp_replace(s, r"\p{Lu}", "2")


def _share(shape_col: Column, pattern: str, words: Column) -> Column:
    return F.regexp_count(shape_col, F.lit(pattern)) / F.greatest(words, F.lit(1))


def labellers(s: Column, words: Column) -> dict[str, Column]:
    """Votes 1 (good), 0 (bad) or 2 (abstain) from the shape.  Most labellers know one
    kind of junk and abstain elsewhere; three know what prose looks like."""
    def bad(pattern: str, at_least: float) -> Column:
        return F.when(_share(s, pattern, words) >= at_least, 0).otherwise(2)

    plain = _share(s, r"(?<![^ \n])[('\"]?2?1?(?:['-][12]++)*+[.,;:!?)'\"]?(?![^ \n])", words)
    breaks = _share(s, r"1[.!?]['\")]?[ \n]+2", words)
    runs = _share(s, r"1[,;]?[ \n](?=1)", words)
    votes = {
        "capitals": bad("3", 0.2),
        "shouting": bad(r"[!?]{2,}", 0.05),
        "symbol_runs": bad(r"[*$%&#=~^<>]{2,}", 0.1),
        "bare_marks": bad(r"(?<![^ \n])[^0-4 \n]+(?![^ \n])", 0.1),
        "odd_marks": bad(r"[^0-4\s.,;:'\"()!?-]", 0.15),
        "numbers": bad("0", 0.4),
        "repetition": bad("4", 0.2),
        "plain_words": F.when(plain >= 0.9, 1).when(plain < 0.75, 0).otherwise(2),
        "breaks": F.when(breaks >= 0.02, 1).when((breaks < 0.005) & (words >= 30), 0).otherwise(2),
        "runs": F.when(runs >= 0.4, 1).when(runs < 0.2, 0).otherwise(2),
    }
    return {k: F.when(words < 3, 2).otherwise(v) for k, v in votes.items()}


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """``(share of good, accuracy per labeller, posterior of good per pattern)``.

    A labeller that votes is right with its accuracy, whatever the class, and
    independently of the others, and better than chance; an abstention says nothing.  Starts from
    labellers that are right nine times in ten; two pseudo-votes keep an
    accuracy off 0 and 1."""
    votes = patterns != 2
    right_if_good = np.where(patterns == 1, 1.0, 0.0)
    accuracy, good, post = np.full(patterns.shape[1], 0.9), 0.7, np.full(len(counts), 0.5)
    for _ in range(rounds):
        edge = np.log(accuracy / (1 - accuracy)) * (2 * right_if_good - 1) * votes
        new = 1 / (1 + np.exp(-np.clip(edge.sum(axis=1) + np.log(good / (1 - good)), -500, 500)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        good = float(np.clip((counts @ post + 1) / (counts.sum() + 2), 0.01, 0.99))
        agree = right_if_good * post[:, None] + (1 - right_if_good) * (1 - post[:, None])
        n = (votes * counts[:, None]).sum(axis=0)
        accuracy = np.clip(((votes * agree * counts[:, None]).sum(axis=0) + 1.8) / (n + 2), 0.55, 0.995)
        if done:
            break
    return good, accuracy, post


def _featured(rows: DataFrame) -> DataFrame:
    """Hashed shape words and pairs (the last word's pair is the word alone), of unit length."""
    tokens = F.filter(F.split("shape", r"[ \n]+"), lambda t: t != "")
    pairs = F.zip_with(F.col("tokens"), F.slice("tokens", 2, F.greatest(F.size("tokens"), F.lit(1))),
                       lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.withColumn("tokens", tokens).withColumn("tokens", F.concat("tokens", pairs))
    hashed = HashingTF(numFeatures=FEATURES, inputCol="tokens", outputCol="tf").transform(rows)
    return Normalizer(p=2.0, inputCol="tf", outputCol="features").transform(hashed).drop("tokens", "tf")


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shape, words`` of every row, written once and read by all steps."""
    rows = docs.select(F.col(id_col).alias("doc_id"), shape(F.coalesce(F.col(text_col), F.lit(""))).alias("shape"))
    return materialize(rows).withColumn("words", F.regexp_count("shape", F.lit(r"[^ \n]+")))


def fit(shaped: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 41) -> tuple[LogisticRegressionModel | None, dict]:
    """From ``prepare``'s rows the scorer and the report ``{good, accuracy, labellers, patterns}``.

    Without two classes among the sampled posteriors (an empty table, say) there
    is no scorer: ``None``."""
    votes = labellers(F.col("shape"), F.col("words"))
    names = list(votes)
    drawn = shaped.withColumn("key", seeded_key(seed, F.col("doc_id"))).select(
        *[v.cast("tinyint").alias(n) for n, v in votes.items()], "key")
    counted = drawn.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()   # <= 3 ** labellers rows
    if not counted:
        return None, {"good": None, "accuracy": None, "labellers": names, "patterns": []}
    patterns = np.array([[r[n] for n in names] for r in counted])
    counts = np.array([r["n"] for r in counted], dtype=float)
    good, accuracy, post = fit_accuracies(patterns, counts)
    report = {"good": good, "accuracy": accuracy, "labellers": names,
              "patterns": sorted(zip(patterns.tolist(), counts.tolist(), post.tolist()), key=lambda x: -x[1])}

    spark = shaped.sparkSession
    labels = spark.createDataFrame([(*map(int, p), float(g)) for p, g in zip(patterns, post)],
                                   ", ".join(f"{n} tinyint" for n in names) + ", good double")
    share = min(1.0, sample_rows / max(1.0, counts.sum()))
    sample = shaped.filter(key_bucket(seeded_key(seed, F.col("doc_id")), _SCALE) < int(share * _SCALE))
    sample = sample.select("shape", *[v.cast("tinyint").alias(n) for n, v in votes.items()]) \
        .join(F.broadcast(labels), names).select("shape", "good")
    # a soft label is two rows weighted by the posterior
    soft = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("good").alias("weight")),
                             F.struct(F.lit(0.0).alias("label"), (1 - F.col("good")).alias("weight"))))
    train = materialize(_featured(sample).select("features", soft.alias("y")).select("features", "y.*")
                        .filter("weight > 0.01"))
    if train.select("label").distinct().count() < 2:
        return None, report
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100,
                              regParam=1e-4).fit(train), report


def score(shaped: DataFrame, model: LogisticRegressionModel | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per row of ``prepare``: ``doc_id, words, score`` (probability of good) and ``kept``.

    Null, empty and blank texts score 0 and are rejected.  Without a scorer all
    other documents score 1.  Null ids, repeated rows and empty tables pass
    through; other columns are ignored."""
    if model is None:
        scored = shaped.withColumn("p", F.lit(1.0))
    else:
        scored = model.transform(_featured(shaped)).withColumn("p", vector_to_array("probability")[1])
    value = F.when(F.col("words") == 0, 0.0).otherwise(F.col("p"))
    return scored.select("doc_id", F.col("words").cast("long").alias("words"), value.alias("score"),
                         (value >= keep_from).alias("kept"))


def keep_good(docs: DataFrame, model: LogisticRegressionModel | None = None, keep_from: float = KEEP_FROM,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A filtering stage: the rows of ``docs`` that ``score`` keeps, columns as they were.
    Without ``model`` the scorer is fitted on ``docs`` itself.

    The last filter stands in a generator: Spark would copy the features' whole
    expression into a plain filter, once for every use."""
    if model is None:
        model, _ = fit(prepare(docs, id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(text.rlike(r"[^ \n]")).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), shape(text).alias("shape"))
    if model is None:
        return rows.select("doc.*")
    scored = model.transform(_featured(rows))
    one = F.array(F.struct(F.col("doc"), vector_to_array("probability")[1].alias("p")))
    return scored.select(F.inline(F.filter(one, lambda x: x["p"] >= keep_from))).select("doc.*")
