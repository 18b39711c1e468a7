"""Nested forests against a plain recursive tree, and against separately grown smaller ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.models import forests
from seriesloom.models.forests import BINS, Forest, Grower, bin_edges, binned, draws, grow_and_predict, tried_features


def data(n=400, features=5, seed=1):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, BINS, (n, features))
    y = np.sin(bins[:, 0] / 4) + 0.1 * bins[:, 1] + rng.normal(0, 0.3, n)
    return bins, y, rng.random(n) < 0.8


def plain_tree(forest, tree, least, bins, y, weight, depth, node=1):
    """What each row's node says, by plain recursion over the rows."""
    total = weight.sum()
    mean = (weight * y).sum() / max(total, 1)
    best = (0.0, None)
    if node.bit_length() - 1 < depth and total >= 2 * least:
        for f in tried_features(forest, tree, np.array([node]))[0]:
            for b in range(BINS):
                left = bins[:, f] <= b
                nl, nr = weight[left].sum(), weight[~left].sum()
                if nl >= least and nr >= least:
                    off = (weight * (y - mean))[left].sum()
                    gain = round(off**2 / nl + off**2 / nr, 9)
                    if gain > best[0] + 1e-8:
                        best = gain, (f, b)
    if best[1] is None:
        return np.full(len(y), mean)
    left = bins[:, best[1][0]] <= best[1][1]
    out = np.empty(len(y))
    out[left] = plain_tree(forest, tree, least, bins[left], y[left], weight[left], depth, 2 * node)
    out[~left] = plain_tree(forest, tree, least, bins[~left], y[~left], weight[~left], depth, 2 * node + 1)
    return out


@pytest.mark.parametrize("least, bootstrap", [(1, True), (4, True), (2, False)])
def test_grower_against_recursion(least, bootstrap):
    bins, y, train = data()
    forest = Forest(3, (1, 3, 12), 5, bootstrap=bootstrap, share=0.6)
    for tree in range(3):
        weight = draws(forest, np.arange(len(y)), tree) * train
        for depth, says in Grower(forest, tree, least, bins, y, weight).run():
            assert np.allclose(says, plain_tree(forest, tree, least, bins, y, weight, depth))


def test_draws_are_poisson():
    forest = Forest(1, (1,), 1)
    found = draws(forest, np.arange(200_000), 3)
    assert abs(found.mean() - 1) < 0.01 and abs(found.var() - 1) < 0.02
    assert abs(np.corrcoef(found, draws(forest, np.arange(200_000), 4))[0, 1]) < 0.01


def frame(spark, n=400):
    bins, y, train = data(n)
    rows = [(i, [int(b) for b in bins[i]], float(y[i]), bool(train[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row bigint, bins array<tinyint>, y double, train boolean").repartition(3), (bins, y, train)


def test_smaller_forests_are_begins_of_the_large_one(spark):
    rows, (bins, y, train) = frame(spark)
    whole = {r["row"]: r for r in grow_and_predict(rows, Forest(30, (2, 5, 9), 5), 2, (10, 30)).collect()}
    assert set(whole) == set(np.flatnonzero(~train))
    for depth in (2, 5, 9):
        for count in (10, 30):
            name = f"d{depth}_t{count}"
            alone = {r["row"]: r[name] for r in grow_and_predict(rows, Forest(count, (depth,), 5), 2, (count,)).collect()}
            assert {i: round(r[name], 9) for i, r in whole.items()} == {i: round(v, 9) for i, v in alone.items()}
    error = np.mean([(whole[i]["d9_t30"] - y[i]) ** 2 for i in whole])
    assert error < 0.5 * np.var(y[~train])


@pytest.mark.parametrize("local_rows", [150, 40, 1])
def test_splits_by_spark_equal_those_of_a_task(spark, local_rows):
    """Nodes above the limit are split by aggregates; the predictions are the same."""
    rows, _ = frame(spark)
    forest = Forest(4, (1, 3, 6), 5)
    near = {r["row"]: [round(v, 6) for v in r[1:]] for r in grow_and_predict(rows, forest, 2, (2, 4)).collect()}
    far = {r["row"]: [round(v, 6) for v in r[1:]] for r in grow_and_predict(rows, forest, 2, (2, 4), local_rows=local_rows).collect()}
    assert near == far


def test_equal_labels_and_no_rows(spark):
    rows = spark.range(50).select(F.col("id").alias("row"), F.array((F.col("id") % 30).cast("tinyint")).alias("bins"), F.lit(2.5).alias("y"), (F.col("id") < 40).alias("train"))
    for local_rows in (1000, 5):
        assert {r[1] for r in grow_and_predict(rows, Forest(2, (3,), 1), 1, (2,), local_rows).collect()} == {2.5}
    assert grow_and_predict(rows.limit(0), Forest(2, (3,), 1), 1, (2,)).count() == 0


def test_bins(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    found = binned(rows, ["a", "b"], bin_edges(rows, ["a", "b"], ["g"]), ["g"]).select("a", "bins").collect()
    assert {r["bins"][1] for r in found} == {0}
    assert all(a["bins"][0] <= b["bins"][0] for a, b in zip(sorted(found), sorted(found)[1:])) and {r["bins"][0] for r in found} == set(range(BINS))
