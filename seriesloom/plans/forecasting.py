"""From a prepared series to scored and blended forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import add_time_features
from seriesloom.models.registry import run_models
from seriesloom.models.stationarity import adf
from seriesloom.operators.correlate import acf, pacf
from seriesloom.operators.fill import fill_gaps
from seriesloom.operators.metrics import best_models, blend, evaluate_models, number_steps
from seriesloom.operators.split import chrono_split
from seriesloom.operators.timeaxis import to_grain
from seriesloom.session import cut_lineage


@dataclass
class Run:
    """The tables a run gives back; all lazy but the forecasts, which are written down."""

    series: DataFrame
    features: DataFrame
    stationarity: DataFrame
    autocorrelation: DataFrame
    partial_autocorrelation: DataFrame
    split: DataFrame
    forecasts: DataFrame
    status: DataFrame
    scores: DataFrame
    best: DataFrame


def forecast_run(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), freq: str = "D", how: str = "mean",
    models: Sequence[str] = ("arima", "ets", "lr"), test_size: float = 0.2, steps: int = 30, ensemble: bool = True,
    weights: Mapping[str, float] | None = None, options: dict[str, dict] | None = None,
) -> Run:
    """Bring rows to a regular grain, test, split, fit every model on the train part and score it.

    Empty bins are interpolated, so that step k of a forecast and of the test part are the
    same bin. The series are written down once, as every model and test reads them again.
    ``weights`` of the ensemble are by requested model; each series blends the requested
    models that it has. Backtest forecasts start at the first test row and are paired with
    it by step.
    """
    where = {"ts": ts, "keys": keys}
    regular = to_grain(df, y=y, freq=freq, how=how, empty_bins=True, **where)
    series = cut_lineage(fill_gaps(regular, [y], grain="bin", method="linear", **where))
    split = cut_lineage(chrono_split(series, grain="bin", test_size=test_size, **where))
    train = split.where("split = 'train'").drop("split")
    forecasts, status = run_models(train, models, y=y, steps=steps, freq=freq, options=options, **where)
    if ensemble and len(models) > 1:
        mixed = blend(forecasts, keys=keys, models=models, weights=weights, by="requested", present_only=True)
        forecasts = forecasts.unionByName(mixed.withColumn("requested", F.lit("ensemble")))
    test = number_steps(split.where("split = 'test'"), **where).withColumn("actual", F.col(y))
    scores = evaluate_models(test, forecasts.drop("requested"), keys=keys, steps=steps)
    return Run(
        series=series, features=add_time_features(series, ts=ts), stationarity=adf(series, y=y, **where),
        autocorrelation=acf(series, y=y, grain="bin", **where), partial_autocorrelation=pacf(series, y=y, grain="bin", **where),
        split=split, forecasts=forecasts, status=status, scores=scores, best=best_models(scores, keys=keys))
