"""Linear models against plain numpy minimisers and on rows left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import linear as L


def table(spark, n=240, seed=3, classes=2):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        y = k % classes
        rows.append((float(y), [int(x) for x in rng.integers(0, 40, 6)] + [40 + 3 * y + int(x) for x in rng.integers(0, 3, 2)]))
    rows += [(None, [1, 2]), (0.0, [])]
    return spark.createDataFrame(rows, "label double, ids array<int>")


def dense(df, size):
    rows = [r for r in df.collect() if r["label"] is not None]
    x = np.zeros((len(rows), size + 1))
    for k, r in enumerate(rows):
        for i in r["ids"]:
            x[k, i] += 1 / np.sqrt(len(r["ids"]))
        x[k, -1] = 1
    return x, np.array([r["label"] for r in rows])


@pytest.mark.parametrize("solver", [0, 5, 6])
def test_objective_is_as_small_as_plain_steps_find(spark, solver):
    df, size = table(spark), 64
    m = L.solved(df, solver, size=size, steps=60, c=0.2)
    x, y = dense(df, size)
    kind, penalty = L.SOLVERS[solver]
    lam = 1 / (0.2 * len(y))

    def objective(w):
        p = (w[:-1] ** 2).sum() / 2 if penalty == "l2" else np.abs(w[:-1]).sum()
        return L.loss(kind, (x @ w)[None], 2 * y - 1)[0].mean() + lam * p

    w, rate = np.zeros(size + 1), 1 / (L.CURVE[kind] * np.linalg.norm(x, 2) ** 2 / len(y) + lam)
    for _ in range(3000):
        g = x.T @ L.loss(kind, (x @ w)[None], 2 * y - 1)[1][0] / len(y)
        g[:-1] += lam * w[:-1] if penalty == "l2" else 0
        w = w - rate * g
        if penalty == "l1":
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * lam, 0)
    assert objective(m.w[0]) < objective(w) + 0.02 * abs(objective(w)) + 1e-4
    if penalty == "l1":
        assert (m.w[0][:-1] == 0).sum() > 10


def test_hinge(spark):
    """Rounded corners are steep, so steps are small: the rows are parted, whatever is left of the objective."""
    df = table(spark)
    got = L.solved(df, 3, size=64, steps=30).scored(df.where("size(ids) > 0 and label is not null")).collect()
    assert np.mean([r["prediction"] == r["label"] for r in got]) > 0.97


def test_many_classes_weights_numbers_and_going_on(spark):
    df = table(spark, classes=3)
    m = L.solved(df, 4, size=64, steps=40)
    got = m.scored(df.where("label is not null and size(ids) > 0")).collect()
    assert np.mean([r["prediction"] == r["label"] for r in got]) > 0.95 and len(got[0]["raw"]) == 3
    two = table(spark)
    plain, heavy = (L.solved(two, 0, size=64, steps=10, weights=w).scored(two).agg(F.sum("prediction")).first()[0] for w in (None, {1.0: 50.0}))
    assert heavy > plain
    x, y = dense(two, 64)
    numbers = two.where("label is not null").withColumn("label", F.aggregate("ids", F.lit(0.0), lambda z, i: z + F.when(i >= 40, 1.0).otherwise(0.0)) + F.when(F.array_contains("ids", 43), 1.0).otherwise(0.0))
    r = L.fit(numbers, "regression", c=10.0, size=64, steps=60).scored(numbers).collect()
    assert np.mean([abs(v["prediction"] - v["label"]) for v in r]) < 0.3
    half = L.fit(two, size=64, steps=5)
    more = L.fit(two, size=64, steps=5, start=half)
    loss = lambda m: L.loss("logistic", (x @ m.w[0])[None], 2 * y - 1)[0].mean()
    assert loss(more) < loss(half)
    assert L.fit(two.where("false"), size=64).scored(two).count() == two.count()
