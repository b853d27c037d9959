"""Probes of many checkpoints in one fit against a plain numpy fit of each."""

import collections

import numpy as np

import __spark_entry__ as E
from qalam.operators.probe import probe_checkpoints
from qalam.plans.evaluation import checkpoint_vectors

SF = "/root/testdata/sf0.001"


def _plain(rows, n_classes, epochs=25, lr=0.1, decay=1e-4):
    """One checkpoint: (epoch kept, validation accuracy, predictor) by plain full-batch steps."""
    x = {p: np.array([r.vec for r in rows if r.part == p]) for p in ("train", "val")}
    y = {p: np.array([r.city for r in rows if r.part == p], dtype=int) for p in ("train", "val")}
    ones = {p: np.hstack([v, np.ones((len(v), 1))]) for p, v in x.items()}
    n = collections.Counter(y["train"].tolist())
    cw = np.array([1.0 / max(n[c], 1) for c in range(n_classes)])
    cw = cw / cw.sum() * n_classes
    target = np.eye(n_classes)[y["train"]]
    w = np.zeros((x["train"].shape[1] + 1, n_classes))
    m, v = np.zeros_like(w), np.zeros_like(w)
    best = None
    for epoch in range(epochs + 1):
        acc = ((ones["val"] @ w).argmax(1) == y["val"]).mean()
        if best is None or acc > best[1]:
            best = (epoch, acc, w.copy())
        z = ones["train"] @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = cw[y["train"]]
        g = ones["train"].T @ ((p - target) * weight[:, None]) / weight.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w * (1 - lr * decay) - lr * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return best


def test_all_checkpoints_equal_their_own_plain_fit(spark):
    rows = checkpoint_vectors(spark, SF).collect()
    table = {r.checkpoint: r for r in E.queries()["probe_by_checkpoint"](spark, SF).collect()}
    assert sorted(table) == [0, 1, 2] and sum(r.is_best for r in table.values()) == 1
    for k, got in table.items():
        own = [r for r in rows if r.checkpoint == k]
        assert {len(r.vec) for r in own} == {{0: 5, 1: 10, 2: 64}[k]}
        epoch, acc, w = _plain(own, 10)
        assert got.chosen_epoch == epoch and abs(got.val_accuracy - acc) < 1e-12
        test = [r for r in own if r.part == "test"]
        pred = (np.hstack([np.array([r.vec for r in test]), np.ones((len(test), 1))]) @ w).argmax(1)
        assert abs(got.accuracy - np.mean(pred == [r.city for r in test])) < 1e-12
        for c in {r.city for r in test}:
            tp = sum(p == c == r.city for p, r in zip(pred, test))
            f1 = 2 * tp / (sum(pred == c) + sum(r.city == c for r in test))
            assert abs(got[f"f1_{c}"] - f1) < 1e-12
    best = max(table.values(), key=lambda r: (r.accuracy, -r.checkpoint))
    assert best.is_best and table[1].accuracy > table[0].accuracy


def test_nulls_missing_parts_and_strange_keys(spark):
    rows = [("a", "x1", [1.0, 0.0], 0, "train"), ("a", "x2", [0.0, 1.0], 1, "train"), ("a", "x3", [0.9, 0.1], None, "test"),
            ("a", "x4", None, 1, "test"), ("a", "x5", None, 1, "train"), ("a", "x6", [0.1, 0.9], None, "train"),
            (None, "y1", [1.0], 1, "train"), (None, "y2", [1.0], 0, None), ("b", "z1", [1.0, 2.0, 3.0], 1, "test"),
            ("c", "w1", None, 1, "test")]
    df = spark.createDataFrame(rows, "cp string, id string, vec array<float>, y int, part string")
    preds, epochs = probe_checkpoints(df, "cp", "id", "vec", "y", "part", 2, epochs=6)
    # no validation rows: the last epoch; no training rows: the zero probe; no vector: no prediction
    assert {(r.cp, r.id): (r.y, r.pred) for r in preds.collect()} == {
        ("a", "x3"): (None, 0), ("a", "x4"): (1, None), (None, "y2"): (0, 1), ("b", "z1"): (1, 0), ("c", "w1"): (1, None)}
    chosen = {r.cp: r.epoch for r in epochs.filter("chosen").collect()}
    assert chosen == {"a": 6, None: 6}
    none, log = probe_checkpoints(df.filter("false"), "cp", "id", "vec", "y", "part", 2, epochs=1)
    assert none.collect() == [] and log.collect() == []
