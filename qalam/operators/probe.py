"""Linear probes of many checkpoints in one distributed fit (M6 inside E4).

Every checkpoint turns the same labelled sentences into vectors of its own
length.  All probes are fitted together: one pass over the rows gives, for every
checkpoint, the gradient on its training part and the hits on its validation part;
what leaves a task is one fixed-size array per checkpoint, added up in the JVM.
The driver holds the weights only (checkpoints x classes x (length + 1)).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.plans.session import materialize

MOST_WEIGHTS = 8_000_000       # numbers in all probes together, on the driver and in every task
BETAS, EPS = (0.9, 0.999), 1e-8


def _scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:, :-1].T + w[:, -1]


def _by_checkpoint(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the checkpoint numbers in a batch: rows and vectors."""
    which = batch.column(0).to_numpy(zero_copy_only=False)
    for c in np.unique(which):
        rows = np.nonzero(which == c)[0]
        vecs = batch.column(1).take(pa.array(rows))
        yield int(c), rows, np.asarray(vecs.flatten(), dtype=np.float64).reshape(len(rows), -1)


def _sums(weights: dict[int, np.ndarray], class_weights: dict[int, np.ndarray],
          batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per checkpoint of a task: gradient, then (sum of class weights, weighted loss, validation hits, validation rows)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(2).to_numpy(zero_copy_only=False)
        parts = np.array(batch.column(3).to_pylist(), dtype=object)
        for c, rows, x in _by_checkpoint(batch):
            w = weights[c]
            out = held.setdefault(c, np.zeros(w.size + 4))
            y, z = labels[rows], _scores(x, w)
            fit, val = parts[rows] == "train", parts[rows] == "val"
            if fit.any():
                yt, zt, xt = y[fit], z[fit], x[fit]
                zt = zt - zt.max(axis=1, keepdims=True)
                p = np.exp(zt)
                p /= p.sum(axis=1, keepdims=True)
                cw = class_weights[c][yt]
                at = np.arange(len(yt))
                out[-3] += (cw * -np.log(np.maximum(p[at, yt], 1e-300))).sum()
                p[at, yt] -= 1.0
                p *= cw[:, None]
                out[:w.size] += np.hstack([p.T @ xt, p.sum(axis=0)[:, None]]).ravel()
                out[-4] += cw.sum()
            out[-2] += (z[val].argmax(axis=1) == y[val]).sum()
            out[-1] += val.sum()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()),
                                          pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["c", "sums"])


def _predicted(weights: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pred = np.zeros(batch.num_rows, dtype=np.int32)
        for c, rows, x in _by_checkpoint(batch):
            pred[rows] = _scores(x, weights[c]).argmax(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(pred)], names=[*batch.schema.names[2:], "pred"])


def probe_checkpoints(rows: DataFrame, checkpoint: str, key: str, features: str, label: str, part: str,
                      n_classes: int, epochs: int = 25, lr: float = 0.1, weight_decay: float = 1e-4
                      ) -> tuple[DataFrame, DataFrame]:
    """M6: ``(predictions, epochs)``.

    ``rows``: one row per checkpoint and sentence: vector, label code in ``[0, n_classes)`` and ``part``: ``train`` rows
    are learned from, ``val`` rows choose the epoch, all others are predicted.
    ``predictions``: (checkpoint, key, label, pred) of the predicted rows.
    ``epochs``: (checkpoint, epoch, loss, val_accuracy, chosen); epoch 0 is the zero probe before any step.

    Class-weighted softmax regression (A5's weights, per checkpoint), full-batch gradients, Adam steps with decoupled
    weight decay.  The epoch with the best validation accuracy is kept (ties: the earliest; without validation
    rows the last), so the test rows choose nothing.  Each epoch is one pass over the rows, without a shuffle of
    rows: a checkpoint or label with a third of all rows makes no large group.

    A row without vector is not learned from and has a null prediction; one without label is predicted only
    if its part says so.  Vectors of one checkpoint must have one length; a checkpoint without training rows keeps
    the zero probe (class 0).
    """
    spark = rows.sparkSession
    base = rows.select(F.col(checkpoint).alias("__c"), F.col(features).cast("array<double>").alias("__x"),
                       F.col(label).cast("int").alias("__y"), F.coalesce(F.col(part), F.lit("")).alias("__p"), F.col(key).alias("__k"))
    base = materialize(base)
    seen = base.filter("__x is not null").groupBy("__c").agg(F.max(F.size("__x")).alias("d"), F.min(F.size("__x")).alias("least")).collect()
    if any(r["d"] != r["least"] for r in seen):
        raise ValueError("vectors of one checkpoint differ in length")
    if sum(n_classes * (r["d"] + 1) for r in seen) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights in all probes")
    names = sorted((r["__c"] for r in seen), key=lambda c: (c is not None, c))
    number = spark.createDataFrame([(i, c) for i, c in enumerate(names)],
                                   f"c int, __n {dict(base.dtypes)['__c']}")                 # a row per checkpoint
    j = base.join(F.broadcast(number), F.col("__c").eqNullSafe(F.col("__n")), "left").drop("__n")

    learn = j.filter("__x is not null and __y is not null and __p in ('train', 'val')")
    counts = {(r["c"], r["__y"]): r["count"] for r in learn.filter("__p = 'train'").groupBy("c", "__y").count().collect()}
    size = {names.index(r["__c"]): r["d"] for r in seen}
    weights = {c: np.zeros((n_classes, d + 1)) for c, d in size.items()}
    inverse = {c: np.array([1.0 / counts.get((c, y), 1) for y in range(n_classes)]) for c in size}
    class_weights = {c: v / v.sum() * n_classes for c, v in inverse.items()}
    first, second = ({c: np.zeros_like(w) for c, w in weights.items()} for _ in range(2))
    best: dict[int, tuple[float, int, np.ndarray]] = {}
    log = []
    fields = learn.select("c", "__x", "__y", "__p")
    for epoch in range(epochs + 1):
        sums = fields.mapInArrow(functools.partial(_sums, weights, class_weights), "c int, sums array<double>")
        total = sums.groupBy("c").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
        weights = dict(weights)
        for r in total:
            c, s = r["c"], np.array(r["sums"])
            fitted, loss, hits, n_val = s[-4:]
            accuracy = hits / n_val if n_val else None
            log.append((names[c], epoch, float(loss / fitted) if fitted else None, None if accuracy is None else float(accuracy), c))
            if c not in best or accuracy is None or accuracy > best[c][0]:
                best[c] = (accuracy, epoch, weights[c])
            if fitted:
                g = s[:-4].reshape(weights[c].shape) / fitted
                first[c] = BETAS[0] * first[c] + (1 - BETAS[0]) * g
                second[c] = BETAS[1] * second[c] + (1 - BETAS[1]) * g * g
                step = (first[c] / (1 - BETAS[0] ** (epoch + 1))) / (np.sqrt(second[c] / (1 - BETAS[1] ** (epoch + 1))) + EPS)
                weights[c] = weights[c] * (1 - lr * weight_decay) - lr * step
    kept = {c: best[c][2] if c in best else w for c, w in weights.items()}
    epochs_df = spark.createDataFrame([(n, e, loss, acc, best[c][1] == e) for n, e, loss, acc, c in log],
                                      f"`{checkpoint}` {dict(base.dtypes)['__c']}, epoch int, loss double, val_accuracy double, chosen boolean")

    asked = j.filter("__p not in ('train', 'val')")
    kinds = dict(base.dtypes)
    out = asked.filter("__x is not null").select("c", "__x", "__c", "__k", "__y").mapInArrow(
        functools.partial(_predicted, kept), f"__c {kinds['__c']}, __k {kinds['__k']}, __y int, pred int")
    bare = asked.filter("__x is null").select("__c", "__k", "__y", F.lit(None).cast("int").alias("pred"))
    preds = out.unionByName(bare).select(F.col("__c").alias(checkpoint), F.col("__k").alias(key), F.col("__y").alias(label), "pred")
    return preds, epochs_df
