"""Dialect evaluation: splits, label codes, class weights, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The 26 city codes and their regions.
CITIES = ["ALE", "ALX", "ALG", "AMM", "ASW", "BAG", "BAS", "BEI", "BEN",
          "CAI", "DAM", "DOH", "FES", "JED", "JER", "KHA", "MSA", "MOS",
          "MUS", "RAB", "RIY", "SAL", "SAN", "SFX", "TRI", "TUN"]
CITY_TO_REGION = {
    "ALE": "LEV", "DAM": "LEV", "BEI": "LEV", "JER": "LEV", "AMM": "LEV",
    "CAI": "EGY", "ALX": "EGY", "ASW": "EGY",
    "BAG": "IRQ", "BAS": "IRQ", "MOS": "IRQ",
    "RIY": "GLF", "JED": "GLF", "DOH": "GLF", "KHA": "GLF", "MUS": "GLF", "SAL": "GLF",
    "SAN": "YEM",
    "TRI": "MGH", "TUN": "MGH", "SFX": "MGH", "ALG": "MGH", "FES": "MGH", "RAB": "MGH", "BEN": "MGH",
    "MSA": "MSA",
}


def region_table(spark) -> DataFrame:
    """J4 lookup table (26 rows) as data."""
    return spark.createDataFrame(sorted(CITY_TO_REGION.items()), "city string, region string")


def with_region(df: DataFrame, city_col: str, out_col: str, regions: DataFrame) -> DataFrame:
    """Left join city → region, ``UNK`` when unknown (Spark broadcasts the table when it is small)."""
    r = regions.withColumnRenamed("city", "__c").withColumnRenamed("region", out_col)
    return (df.join(r, df[city_col] == r["__c"], "left").drop("__c")
              .withColumn(out_col, F.coalesce(F.col(out_col), F.lit("UNK"))))


def label_codes(df: DataFrame, label_col: str) -> DataFrame:
    """Sorted distinct labels → 0..n-1 (``label``, ``code``).  The label
    set is small by nature; its window runs over distinct labels only."""
    return (df.select(label_col).distinct()
              .withColumn("code", (F.dense_rank().over(Window.orderBy(label_col)) - 1).cast("int")))


def stratified_split(df: DataFrame, label_col: str, key_col: str, test_size: float = 0.2,
                     seed: int = 42, prefix_len: int = 3) -> DataFrame:
    """Deterministic stratified split; adds ``is_test``.

    Within each label, rows are ordered by ``md5(seed:key)``; the first
    ``round(n_label * test_size)`` go to test.  The rank is two-level (label,
    hash prefix buckets), so a label holding a third of all rows is still
    spread over many tasks.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")))
    d = df.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, prefix_len))
    buckets = d.groupBy(label_col, "__p").agg(F.count(F.lit(1)).alias("__c"))
    wb = Window.partitionBy(label_col).orderBy("__p")
    buckets = (buckets.withColumn("__off", F.coalesce(F.sum("__c").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                                      F.lit(0)))
                      .withColumn("__n", F.sum("__c").over(Window.partitionBy(label_col)))
                      .drop("__c"))
    w = Window.partitionBy(label_col, "__p").orderBy("__h")
    rank = F.col("__off") + F.row_number().over(w)
    buckets = buckets.withColumnsRenamed({label_col: "__l", "__p": "__bp"})     # a null label is a label too
    return (d.join(buckets, d[label_col].eqNullSafe(F.col("__l")) & (F.col("__p") == F.col("__bp")))
             .withColumn("is_test", rank <= F.round(F.col("__n") * test_size))
             .drop("__h", "__p", "__off", "__n", "__l", "__bp"))


def class_weights(train: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """A5: inverse-frequency weights scaled to sum to the number of classes;
    a class absent from ``train`` counts as 1."""
    c = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    all_l = labels.select(label_col).distinct()
    j = all_l.join(c, label_col, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    inv = 1.0 / F.col("n")
    w = Window.partitionBy()
    return j.select(label_col, "n", (inv / F.sum(inv).over(w) * F.count(F.lit(1)).over(w)).alias("weight"))


def majority_baseline(train: DataFrame, test: DataFrame, label_col: str) -> DataFrame:
    """The train set's most frequent label (ties: smallest) and its accuracy on test."""
    top = (train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
                .agg(F.min_by(label_col, F.struct(-F.col("n"), F.col(label_col))).alias("majority")))
    tc = test.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    j = tc.join(F.broadcast(top), tc[label_col] == top["majority"], "full")   # top is one row
    return j.agg(F.max("majority").alias("majority"),
                 (F.coalesce(F.sum(F.when(F.col(label_col) == F.col("majority"), F.col("n"))), F.lit(0))
                  / F.sum("n")).alias("accuracy"))


def accuracy_by(preds: DataFrame, group_col: str, target: str, pred: str, name: str = "accuracy") -> DataFrame:
    """Mean of pred == target per group."""
    return preds.groupBy(group_col).agg(F.avg((F.col(target) == F.col(pred)).cast("double")).alias(name))


def per_class_scores(preds: DataFrame, group_col: str, target: str, pred: str) -> DataFrame:
    """Precision, recall, F1, support per class and group; zero division → 0;
    classes are those present among the targets."""
    tp = (preds.filter(F.col(target) == F.col(pred)).groupBy(group_col, F.col(target).alias("cls"))
               .agg(F.count(F.lit(1)).alias("tp")))
    sup = preds.groupBy(group_col, F.col(target).alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    npred = preds.groupBy(group_col, F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = (sup.join(tp, [group_col, "cls"], "left").join(npred, [group_col, "cls"], "left")
            .fillna(0, ["tp", "n_pred"]))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1).select(group_col, "cls", "precision", "recall", "f1",
                                         F.col("support").cast("long").alias("support"))


def f1_table(scores: DataFrame, group_col: str, classes) -> DataFrame:
    """One row per group with ``f1_<class>`` columns."""
    w = scores.groupBy(group_col).pivot("cls", list(classes)).agg(F.first("f1"))
    return w.select(group_col, *[F.col(f"`{c}`").alias(f"f1_{c}") for c in classes])


def best_by(df: DataFrame, metric: str, key: str) -> DataFrame:
    """L4: the row with the highest metric (ties: smallest key)."""
    return df.agg(F.min_by(key, F.struct(-F.col(metric), F.col(key))).alias(key), F.max(metric).alias(metric))


def linear_probe(train: DataFrame, test: DataFrame, features: str, label: str, weight: str | None = None,
                 max_iter: int = 50, reg: float = 0.0):
    """M6: multinomial logistic regression on fixed vectors (class-weighted).
    Model selection never looks at the test set."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    tr = train.withColumn("__f", array_to_vector(F.col(features)))
    te = test.withColumn("__f", array_to_vector(F.col(features)))
    lr = LogisticRegression(featuresCol="__f", labelCol=label, family="multinomial",
                            maxIter=max_iter, regParam=reg, predictionCol="__pred")
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(tr)
    return model.transform(te).withColumn("pred", F.col("__pred").cast("int")).drop("__f", "__pred",
                                                                                    "rawPrediction", "probability")
