"""Exponential smoothing of many series, with weights given or searched on a grid.

The recursion runs from row to row, in one pass over many series
(:func:`seriesloom.models.perseries.map_series`). All weights of the grid advance together as
one vector per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.perseries import map_series
from seriesloom.operators.ordering import join_on_keys
from seriesloom.operators.timeaxis import dates_after

WEIGHT_GRID = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
PARAMS = "alpha double, beta double, gamma double, n long, sse double, level double, slope double, seasons array<double>"


def smooth(y: np.ndarray, alpha, beta, gamma, trend: str | None, seasonal: str | None, period: int):
    """Run the recursion for vectors of weights; returns sse, level, slope and seasons per weight."""
    wide = len(alpha)
    start = period if seasonal else 1
    level = np.full(wide, y[:start].mean())
    if seasonal == "add":
        seasons = np.tile(y[:start] - level[0], (wide, 1)).T
    elif seasonal == "mul":
        seasons = np.tile(y[:start] / level[0], (wide, 1)).T
    else:
        seasons = np.zeros((1, wide))
    reach = min(2 * start, len(y)) - start
    ahead = y[start:start + reach].mean() if reach else level[0]
    slope = np.full(wide, {None: 0.0, "add": (ahead - level[0]) / start, "mul": (ahead / level[0]) ** (1 / start) if level[0] else 1.0}[trend])
    sse = np.zeros(wide)
    for t in range(start, len(y)):
        base = level * slope if trend == "mul" else level + slope
        season = seasons[t % len(seasons)]
        guess = base * season if seasonal == "mul" else base + season
        sse += (y[t] - guess) ** 2
        bare = y[t] / season if seasonal == "mul" else y[t] - season
        newer = alpha * bare + (1 - alpha) * base
        if trend == "add":
            slope = beta * (newer - level) + (1 - beta) * slope
        elif trend == "mul":
            slope = beta * (newer / level) + (1 - beta) * slope
        if seasonal:
            rest = y[t] / newer if seasonal == "mul" else y[t] - newer
            seasons[t % period] = gamma * rest + (1 - gamma) * season
        level = newer
    return sse, level, slope, seasons


def model_name(trend: str | None, seasonal: str | None, period: int | None) -> str:
    return f"ETS_{trend}_{seasonal}_{period if seasonal else None}"


def fit_smoothing(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), trend: str | None = None, seasonal: str | None = None,
    period: int | None = None, weights: dict[str, float] | None = None, grid: Sequence[float] = WEIGHT_GRID,
) -> DataFrame:
    """One row per series: the weights of least squared one-step error and the final state.

    ``weights`` fixes alpha (and beta, gamma). ``trend`` and ``seasonal`` are None, "add" or
    "mul". A series shorter than two periods (or two rows) has no row.
    """
    if seasonal and not period:
        raise ValueError("a seasonal model needs its period")
    length = period or 1
    axes = [grid, grid if trend else (0.0,), grid if seasonal else (0.0,)]
    choices = [[weights[k]] if weights and k in weights else list(axis) for k, axis in zip(("alpha", "beta", "gamma"), axes)]
    alpha, beta, gamma = (np.array(v, dtype=float) for v in zip(*product(*choices)))

    def fit(values: np.ndarray, last: pa.RecordBatch) -> tuple | None:
        if len(values) < 2 * length or len(values) < 2:
            return None
        with np.errstate(all="ignore"):
            sse, level, slope, seasons = smooth(values, alpha, beta, gamma, trend, seasonal, length)
        best = int(np.argmin(np.where(np.isfinite(sse), sse, np.inf)))
        return alpha[best], beta[best], gamma[best], len(values), sse[best], level[best], slope[best], list(seasons[:, best]) if seasonal else None

    known = df.where(F.col(y).isNotNull()).select(*keys, F.col(ts).alias("_ts"), F.col(y).cast("double").alias("_y"))
    return map_series(known, fit, ts="_ts", y="_y", keys=keys, types=PARAMS).withColumn("model", F.lit(model_name(trend, seasonal, period)))


def forecast_smoothing(
    fitted: DataFrame, *, keys: Sequence[str] = (), steps: int = 30, freq: str = "D", trend: str | None = None, seasonal: str | None = None,
    period: int | None = None,
) -> DataFrame:
    """Level, trend and season carried forward from the final state."""
    dates = dates_after(F.to_date("last_ts") if freq != "H" else F.col("last_ts"), steps, freq)
    ahead = fitted.select("*", F.posexplode(dates).alias("_i", "date")).withColumn("step", F.col("_i") + 1)
    base = F.col("level")
    if trend == "add":
        base = base + F.col("step") * F.col("slope")
    elif trend == "mul":
        base = base * F.pow("slope", F.col("step"))
    if seasonal:
        season = F.get("seasons", ((F.col("n") + F.col("step") - 1) % period).cast("int"))
        base = base * season if seasonal == "mul" else base + season
    return ahead.select(*keys, "model", "step", "date", base.alias("forecast"))


def choose_variants(df: DataFrame, verdict: DataFrame, *, keys: Sequence[str] = (), min_seasonal: int = 24) -> DataFrame:
    """Per series the smoothing variants to run, as rows with ``trend``, ``seasonal``, ``period``.

    A stationary series gets the simple model. The others get an additive trend, and with
    more than ``min_seasonal`` rows also one with an additive season of 12.
    """
    sizes = join_on_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")), verdict.select(*keys, "stationary"), keys, "left")
    variant = lambda t, s, p: F.struct(
        F.lit(t).cast("string").alias("trend"), F.lit(s).cast("string").alias("seasonal"), F.lit(p).cast("int").alias("period"))
    still = F.coalesce("stationary", F.lit(False))
    picks = F.array_compact(F.array(
        F.when(still, variant(None, None, None)),
        F.when(~still, variant("add", None, None)),
        F.when(~still & (F.col("n_rows") > min_seasonal), variant("add", "add", 12))))
    return sizes.select(*keys, "n_rows", "stationary", F.explode(picks).alias("_v")).select(*keys, "n_rows", "stationary", "_v.*")
