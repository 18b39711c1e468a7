"""Random forests and boosted trees on lag and calendar inputs, pooled over all series.

One spark.ml model learns from the rows of every series. Each series is put on its own
scale first (mean and deviation of its training rows), which leaves the splits for a single
series as they are and lets many series share one model.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import MODEL_CALENDAR, model_calendar
from seriesloom.models.compiled import compile_trees
from seriesloom.models.forests import Forest, bin_edges, binned, grow_and_predict
from seriesloom.models.leastsq import feature_names, lag_names, model_features
from seriesloom.operators.lags import last_values
from seriesloom.operators.ordering import join_on_keys, with_position
from seriesloom.operators.split import fold_roles
from seriesloom.operators.timeaxis import dates_after
from seriesloom.session import cut_lineage

SEED = 42
FIT_ROWS = 10_000  # rows of a task of a fit

# The default hyper-parameter grids. spark.ml limits the depth to 30, which
# stands for "no limit"; it has no least size of a split node.
FOREST_GRID = {"numTrees": (100, 200, 300), "maxDepth": (30, 10, 20), "minInstancesPerNode": (1, 2, 4)}
BOOSTED_GRID = {"maxIter": (100, 200, 300), "stepSize": (0.01, 0.05, 0.1), "maxDepth": (3, 5, 7)}
SUBSAMPLED_GRID = BOOSTED_GRID | {"subsamplingRate": (0.8, 0.9, 1.0)}


def forest(**params) -> RandomForestRegressor:
    """A forest of 100 trees unless told otherwise."""
    return RandomForestRegressor(**({"numTrees": 100, "seed": SEED, "featuresCol": "features", "labelCol": "_label"} | params))


def boosted(**params) -> GBTRegressor:
    """100 rounds of depth 5 at rate 0.1 unless told otherwise."""
    base = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": SEED, "featuresCol": "features", "labelCol": "_label"}
    return GBTRegressor(**(base | params))


def series_scales(df: DataFrame, *, y: str, keys: Sequence[str] = ()) -> DataFrame:
    std = F.stddev_samp(y)
    return df.groupBy(*keys).agg(F.avg(y).alias("_mu"), F.when(std > 0, std).otherwise(1.0).alias("_sd"))


def scaled_design(
    df: DataFrame, scales: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), n_lags: int = 12, calendar: bool = True,
    by_split: str | None = None, carry_lags: bool = False,
) -> DataFrame:
    """Model rows with ``features`` and ``_label`` on the series' scale.

    With ``by_split`` the lags of each part come from that part alone, so the first
    ``n_lags`` rows of the test part are lost; ``carry_lags`` lets them reach back.
    """
    if by_split and not carry_lags:
        rows = model_features(df, ts=ts, y=y, keys=[*keys, by_split], n_lags=n_lags, calendar=calendar)
    else:
        rows = model_features(df, ts=ts, y=y, keys=keys, n_lags=n_lags, calendar=calendar)
        if by_split:
            rows = join_on_keys(rows, df.select(*keys, ts, by_split), [*keys, ts])
    return on_scale(join_on_keys(rows, scales, keys), y=y, n_lags=n_lags, calendar=calendar)


def on_scale(rows: DataFrame, *, y: str, n_lags: int, calendar: bool) -> DataFrame:
    """``features`` and ``_label`` of model rows that carry their scale ``_mu``, ``_sd``."""
    lags = {c: (F.col(c) - F.col("_mu")) / F.col("_sd") for c in lag_names(n_lags)}
    scaled = rows.withColumns(lags | {"_label": (F.col(y) - F.col("_mu")) / F.col("_sd")})
    return VectorAssembler(inputCols=feature_names(n_lags, calendar), outputCol="features").transform(scaled)


def dealt(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Written rows in as many partitions as their number asks for, each in one order.

    A boosted model runs hundreds of jobs, each with a task per partition. The partitions that a
    shuffle leaves follow the session's settings, and a cached frame keeps the empty ones. ``by``
    tells rows apart, so neither those settings nor a lost task change what a fit sees.
    """
    return rows.repartition(max(1, -(-rows.count() // FIT_ROWS)), *by).sortWithinPartitions(*by)


def fit_trees(df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), kind: str = "rf", n_lags: int = 12, calendar: bool = True, **params):
    """Fit ``rf``, ``gb`` or ``xgb`` on calendar-grain series; returns the model and the series' scales."""
    scales = series_scales(df, y=y, keys=keys)
    design = scaled_design(df, scales, ts=ts, y=y, keys=keys, n_lags=n_lags, calendar=calendar).select(*keys, ts, "features", "_label")
    design = dealt(cut_lineage(design), [*keys, ts]).select("features", "_label").persist()
    try:
        if kind == "rf":
            return forest(**params).fit(design), scales
        defaults = {"maxDepth": 3} if kind == "gb" else {}
        return boosted(**(defaults | params)).fit(design), scales
    finally:
        design.unpersist()


def forecast_trees(
    model, scales: DataFrame, history: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), steps: int = 30, freq: str = "D",
    n_lags: int = 12, calendar: bool = True, name: str = "RF",
) -> DataFrame:
    """Recursive forecast of all series in one pass.

    The frame holds one row per series: its scaled last values, newest first, and the calendar
    inputs of all steps. A batch of series runs through the compiled trees step by step, each
    prediction the first lag of the next step.
    """
    tail = join_on_keys(last_values(history, ts=ts, y=y, keys=keys, grain="bin", n=n_lags), scales, keys).where(F.size("last_values") == n_lags)
    recent = F.reverse(F.transform("last_values", lambda v: (v - F.col("_mu")) / F.col("_sd")))
    last = F.to_date("last_ts") if freq != "H" else F.col("last_ts")
    state = tail.select(*keys, "_mu", "_sd", recent.alias("_recent"), dates_after(last, steps, freq).alias("_dates"))
    inputs = feature_names(n_lags, calendar)
    given = F.flatten(F.transform("_dates", lambda d: F.array(*[model_calendar(d)[c].cast("double") for c in inputs[n_lags:]]))) if calendar else F.array().cast("array<double>")
    paths = compile_trees(model, state.sparkSession).recursive(state.withColumn("_given", given), "_recent", "_given", steps)
    path = F.transform("_path", lambda v: v * F.col("_sd") + F.col("_mu"))
    pairs = F.arrays_zip(F.col("_dates").alias("date"), path.alias("forecast"))
    return paths.select(*keys, F.posexplode(pairs).alias("_i", "_p")).select(
        *keys, F.lit(name).alias("model"), (F.col("_i") + 1).alias("step"), F.col("_p.date").alias("date"), F.col("_p.forecast").alias("forecast"))


def predict_split(
    model, scales: DataFrame, df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), split: str = "split", n_lags: int = 12,
    calendar: bool = True, carry_lags: bool = False,
) -> DataFrame:
    """One-step predictions of the test part with its known lags: keys, time, actual, forecast."""
    design = scaled_design(df, scales, ts=ts, y=y, keys=keys, n_lags=n_lags, calendar=calendar, by_split=split, carry_lags=carry_lags)
    rows = model.transform(design.where(F.col(split) == "test"))
    return rows.select(*keys, ts, F.col(y).alias("actual"), (F.col("prediction") * F.col("_sd") + F.col("_mu")).alias("forecast"))


def default_lags(train_rows: int) -> int:
    """min(12, rows // 10), at least one."""
    return max(1, min(12, train_rows // 10))


def grid_search(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), kind: str = "rf", grid: dict[str, Sequence] | None = None,
    n_splits: int = 5, n_lags: int = 12, calendar: bool = True, width: int = 4,
) -> DataFrame:
    """Mean squared error of every grid point over expanding-window folds, best first.

    Folds are cut per series in time order, so no fold trains on rows later than its test
    block, and each fold's scale comes from its training rows. Points that differ only in the
    depth or the number of trees share one forest per fold, grown to the largest
    (:mod:`seriesloom.models.forests`); points that differ in the boosting rounds share one
    boosted model. ``width`` fits run at a time. Columns: the parameters as JSON, ``neg_mse``
    and ``rank``.
    """
    grid = grid or {"rf": FOREST_GRID, "gb": BOOSTED_GRID, "xgb": SUBSAMPLED_GRID}[kind]
    unknown = set(grid) - set(FOREST_GRID)
    if kind == "rf" and unknown:
        raise ValueError(f"a forest is searched over {sorted(FOREST_GRID)}, not {sorted(unknown)}")
    names = feature_names(n_lags, calendar)
    rows = model_features(df, ts=ts, y=y, keys=keys, n_lags=n_lags, calendar=calendar)
    placed = with_position(rows, ts=ts, keys=keys, grain="bin", position="_t", size="_n")
    folds = fold_roles(placed, position="_t", size="_n", n_splits=n_splits)
    scales = series_scales(folds.where("role = 'train'"), y=y, keys=[*keys, "fold"])
    folds = on_scale(join_on_keys(folds, scales, [*keys, "fold"]), y=y, n_lags=n_lags, calendar=calendar)
    folds = folds.withColumns({"row": F.xxhash64(*keys, ts), "train": F.col("role") == "train"})
    if kind == "rf":
        edges = bin_edges(folds.where("train"), names, ["fold"])
        folds = binned(folds, names, edges, ["fold"]).select("fold", "row", "bins", F.col("_label").alias("y"), "train", "_sd")
    else:
        folds = folds.select("fold", "row", "features", "_label", "train", "_sd")
    folds = cut_lineage(folds)  # read by every fit
    errors = (_forest_errors if kind == "rf" else _boosted_errors)(folds, grid, n_splits, width, names)

    def mean(point: dict) -> float | None:
        usable = [e for e in errors[json.dumps(point)] if e is not None]
        return -sum(usable) / len(usable) if usable else None

    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    results = [(json.dumps(point), mean(point)) for point in points]
    table = df.sparkSession.createDataFrame(results, "params string, neg_mse double")  # one row per grid point
    order = F.struct(F.col("neg_mse").isNull(), -F.col("neg_mse"), F.col("params"))
    ranked = table.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "params", "neg_mse"))).alias("_r"))
    return ranked.select(F.posexplode("_r").alias("_i", "_p")).select((F.col("_i") + 1).alias("rank"), "_p.params", "_p.neg_mse")


def _fits(groups: dict[str, list[dict]], n_splits: int, width: int, fit) -> dict[str, list]:
    """Errors per point from ``fit(points, fold)``, one fit per group of points and fold."""
    asked = [(points, fold) for points in groups.values() for fold in range(1, n_splits + 1)]
    with ThreadPoolExecutor(width) as pool:
        found = list(pool.map(lambda one: fit(*one), asked))
    errors: dict[str, list] = {}
    for (points, _), values in zip(asked, found):
        for point, value in zip(points, values):
            errors.setdefault(json.dumps(point), []).append(value)
    return errors


def _grouped(grid: dict[str, Sequence], nested: Sequence[str]) -> dict[str, list[dict]]:
    """Grid points by the parameters that need a fit of their own."""
    groups: dict[str, list[dict]] = {}
    for values in product(*grid.values()):
        point = dict(zip(grid, values))
        groups.setdefault(json.dumps({k: v for k, v in point.items() if k not in nested}), []).append(point)
    return groups


def _forest_errors(folds: DataFrame, grid: dict[str, Sequence], n_splits: int, width: int, names: Sequence[str]) -> dict[str, list]:
    def size(point: dict) -> tuple[int, int, int]:
        return point.get("maxDepth", 5), point.get("numTrees", 100), point.get("minInstancesPerNode", 1)

    def fit(points: list[dict], fold: int) -> list[float | None]:
        part = folds.where(F.col("fold") == fold)
        depths, counts, least = (sorted({size(p)[k] for p in points}) for k in range(3))
        found = grow_and_predict(part, Forest(counts[-1], tuple(depths), len(names), SEED), least[0], counts)
        test = part.where("NOT train").select("row", F.col("y").alias("_label"), "_sd")
        gaps = {f"{d}_{t}": (F.col(f"d{d}_t{t}") - F.col("_label")) * F.col("_sd") for d in depths for t in counts}
        scored = test.join(found, "row").agg(*[F.avg(g * g).alias(n) for n, g in gaps.items()]).first()
        return [scored[f"{size(p)[0]}_{size(p)[1]}"] for p in points]

    return _fits(_grouped(grid, ("numTrees", "maxDepth")), n_splits, width, fit)


def _boosted_errors(folds: DataFrame, grid: dict[str, Sequence], n_splits: int, width: int, names: Sequence[str]) -> dict[str, list]:
    def fit(points: list[dict], fold: int) -> list[float | None]:
        part = folds.where(F.col("fold") == fold)
        train = part.where("train")
        if train.isEmpty():
            return [None] * len(points)
        rounds = sorted({p.get("maxIter", 100) for p in points})
        compiled = compile_trees(boosted(**(points[0] | {"maxIter": rounds[-1]})).fit(train), part.sparkSession)
        found = compiled.staged(part.where("NOT train"), "features", rounds, ["_label", "_sd"])
        gaps = [(F.col("staged")[k] - F.col("_label")) * F.col("_sd") for k in range(len(rounds))]
        scored = found.agg(*[F.avg(g * g) for g in gaps]).first()
        return [scored[rounds.index(p.get("maxIter", 100))] for p in points]

    return _fits(_grouped(grid, ("maxIter",)), n_splits, width, fit)


def best_trees(df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), kind: str = "rf", n_lags: int = 12, calendar: bool = True, **search):
    """The model of the best grid point, fitted to all rows: model, scales, its parameters."""
    ranked = grid_search(df, ts=ts, y=y, keys=keys, kind=kind, n_lags=n_lags, calendar=calendar, **search)
    params = json.loads(ranked.where("rank = 1").first()["params"])
    model, scales = fit_trees(df, ts=ts, y=y, keys=keys, kind=kind, n_lags=n_lags, calendar=calendar, **params)
    return model, scales, params
