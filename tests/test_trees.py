"""Compiled trees against spark.ml's own predictions; nested searches against single ones."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from seriesloom.catalogue import QUERIES
from seriesloom.models import trees
from seriesloom.models.compiled import compile_trees

HOW = {"ts": "ts", "y": "y", "keys": ("k",)}


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    day = datetime.date(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(i), 10.0 * (i % 7) + 3 * rng.random() + 100 * (k == "b")) for k in "ab" for i in range(90)]
    return spark.createDataFrame(rows, "k string, ts date, y double").cache()


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    rows = [(i, [float(v) for v in x[i]], float(np.sin(6 * x[i, 0]) + x[i, 1])) for i in range(300)]
    return spark.createDataFrame(rows, "i int, x array<double>, _label double").withColumn("features", array_to_vector("x")).cache()


@pytest.mark.parametrize("build", [lambda: trees.forest(numTrees=7, maxDepth=6), lambda: trees.boosted(maxIter=9, maxDepth=3)])
def test_compiled_predictions(spark, design, build):
    model = build().fit(design)
    compiled = compile_trees(model, spark)
    found = model.transform(design).orderBy("i").select("x", "prediction").collect()
    assert np.allclose(compiled.predict(np.array([r["x"] for r in found])), [r["prediction"] for r in found])


def test_staged_predictions(spark, design):
    model = trees.boosted(maxIter=9, maxDepth=3, stepSize=0.3).fit(design)
    found = {r["i"]: r["staged"] for r in compile_trees(model, spark).staged(design, "features", [1, 4, 9], ["i"]).collect()}
    for k, rounds in enumerate((1, 4, 9)):
        alone = trees.boosted(maxIter=rounds, maxDepth=3, stepSize=0.3).fit(design).transform(design).select("i", "prediction").collect()
        assert np.allclose([found[r["i"]][k] for r in alone], [r["prediction"] for r in alone])


def test_recursion_equals_single_steps(spark, series):
    """Each prediction, appended to the history, gives the next one."""
    model, scales = trees.fit_trees(series, kind="rf", n_lags=7, numTrees=5, **HOW)
    path = {(r["k"], r["step"]): (r["date"], r["forecast"]) for r in trees.forecast_trees(model, scales, series, steps=4, n_lags=7, **HOW).collect()}
    history = series
    for step in range(1, 5):
        one = trees.forecast_trees(model, scales, history, steps=1, n_lags=7, **HOW).collect()
        assert {r["k"]: r["date"] for r in one} == {k: path[k, step][0] for k in "ab"}
        assert np.allclose([r["forecast"] for r in one], [path[r["k"], step][1] for r in one])
        history = history.union(spark.createDataFrame([(r["k"], r["date"], r["forecast"]) for r in one], series.schema))


@pytest.mark.parametrize("kind, grid", [
    ("rf", {"numTrees": (3, 8), "maxDepth": (2, 6), "minInstancesPerNode": (1, 5)}),
    ("gb", {"maxIter": (2, 5), "stepSize": (0.3,), "maxDepth": (2, 3)}),
])
def test_nested_search_equals_single_points(series, kind, grid):
    how = {"n_lags": 3, "n_splits": 2, "kind": kind, **HOW}
    found = {r["params"]: r["neg_mse"] for r in trees.grid_search(series, grid=grid, **how).collect()}
    assert len(found) == np.prod([len(v) for v in grid.values()])
    for params in list(found)[:3]:
        alone = trees.grid_search(series, grid={k: (v,) for k, v in json.loads(params).items()}, **how).first()
        assert alone["params"] == params and np.isclose(alone["neg_mse"], found[params])


def test_search_beats_the_mean_and_gives_its_model(series):
    how = {"n_lags": 7, "n_splits": 2, **HOW}
    grid = {"numTrees": (20,), "maxDepth": (1, 6), "minInstancesPerNode": (1,)}
    ranked = trees.grid_search(series, grid=grid, **how).collect()
    assert [r["rank"] for r in ranked] == [1, 2] and ranked[0]["neg_mse"] >= ranked[1]["neg_mse"]
    variance = series.groupBy("k").agg(F.var_pop("y").alias("v")).agg(F.avg("v")).first()[0]
    assert -ranked[0]["neg_mse"] < 0.5 * variance
    model, scales, params = trees.best_trees(series, grid=grid, **how)
    assert params == json.loads(ranked[0]["params"]) and model.getNumTrees == 20
    with pytest.raises(ValueError, match="subsamplingRate"):
        trees.grid_search(series, grid={"subsamplingRate": (0.5,)}, **how)


@pytest.fixture
def partitions(spark):
    """Sets the session's shuffle partitions; the test leaves them as they were."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, n)
    spark.conf.set(name, before)


@pytest.mark.parametrize("kind", ["rf", "xgb"])
def test_fit_gets_partitions_by_its_rows(series, monkeypatch, partitions, kind):
    """A fit gets the same rows in the same places under any number of shuffle partitions."""
    seen = []

    class Recorder:
        def fit(self, design):
            seen.append([[(r["_label"], tuple(r["features"])) for r in part] for part in design.rdd.glom().collect()])

    monkeypatch.setattr(trees, "forest", lambda **given: Recorder())
    monkeypatch.setattr(trees, "boosted", lambda **given: Recorder())
    for rows, n in ((10_000, 3), (10_000, 40), (50, 3), (50, 40)):
        monkeypatch.setattr(trees, "FIT_ROWS", rows, raising=False)
        partitions(n)
        trees.fit_trees(series, kind=kind, n_lags=7, **HOW)
    assert [len(s) for s in seen] == [1, 1, 4, 4]
    assert all(sum(map(len, s)) == 2 * (90 - 7) for s in seen)
    for a, b in (seen[:2], seen[2:]):
        for left, right in zip(a, b):
            assert np.allclose([v for v, _ in left], [v for v, _ in right]) and np.allclose([v for _, v in left], [v for _, v in right])


def test_boosted_forecast_under_other_partitions(spark, small, monkeypatch, partitions):
    """The query's fit has one task for its few rows, and its forecasts are the same."""
    sizes, fitted = [], trees.boosted

    class Recorder:
        def fit(self, design):
            sizes.append(design.rdd.getNumPartitions())
            return fitted(maxIter=3).fit(design)

    monkeypatch.setattr(trees, "boosted", lambda **given: Recorder())
    paths = []
    for n in (3, 40):
        partitions(n)
        paths.append([r["forecast"] for r in QUERIES["boosted_forecast"](spark, small).orderBy("o_orderpriority", "step").collect()])
    assert sizes == [1, 1]
    assert len(paths[0]) == 5 * 30 and np.allclose(*paths)
