"""Forecasters by name, and runs of many models over many series."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.models import arima, leastsq, smoothing, stationarity, trees, trendseason
from seriesloom.operators.metrics import align_by_step, number_steps, score
from seriesloom.operators.ordering import join_on_keys
from seriesloom.session import cut_lineage
from seriesloom.sources.sinks import write_forecasts

FORECAST_COLUMNS = ("model", "step", "date", "forecast")


@dataclass
class Forecaster:
    """A model with the calls all models share: fit, forecast, evaluate, save, load, save_forecast.

    Subclasses give :meth:`fit` and :meth:`forecast` and may keep state in ``fitted``, one
    row per series, which save and load handle.
    """

    ts: str
    y: str
    keys: Sequence[str] = ()
    freq: str = "D"
    options: dict = field(default_factory=dict)
    fitted: DataFrame | None = None

    def fit(self, train: DataFrame) -> Forecaster:
        raise NotImplementedError

    def forecast(self, steps: int = 30) -> DataFrame:
        raise NotImplementedError

    def evaluate(self, actual: DataFrame, steps: int = 30) -> DataFrame:
        """Scores against the rows that follow the training part."""
        numbered = number_steps(actual, ts=self.ts, keys=self.keys).withColumn("actual", F.col(self.y))
        return score(align_by_step(numbered, self.forecast(steps), keys=self.keys), by=[*self.keys, "model"])

    def save(self, path: str) -> str:
        self.fitted.write.mode("overwrite").parquet(f"{path}/fitted")
        return path

    def load(self, spark: SparkSession, path: str) -> Forecaster:
        self.fitted = spark.read.parquet(f"{path}/fitted")
        return self

    def save_forecast(self, path: str, steps: int = 30) -> str:
        return write_forecasts(self.forecast(steps), path)

    @property
    def axes(self) -> dict:
        return {"ts": self.ts, "y": self.y, "keys": self.keys}


@dataclass
class LagRegression(Forecaster):
    n_lags: int = 12
    calendar: bool = True

    def fit(self, train: DataFrame) -> Forecaster:
        self.fitted = leastsq.fit_lag_regression(train, n_lags=self.n_lags, calendar=self.calendar, freq=self.freq, **self.axes)
        return self

    def forecast(self, steps: int = 30) -> DataFrame:
        return leastsq.forecast_lag_regression(
            self.fitted, keys=self.keys, steps=steps, n_lags=self.n_lags, calendar=self.calendar, freq=self.freq)


@dataclass
class Arima(Forecaster):
    orders: Sequence = ((1, 1, 1),)

    def fit(self, train: DataFrame) -> Forecaster:
        self.fitted = arima.search_arima(train, orders=self.orders, **self.axes, **self.options)
        return self

    def forecast(self, steps: int = 30) -> DataFrame:
        return arima.forecast_arima(self.fitted, keys=self.keys, steps=steps, freq=self.freq)


@dataclass
class Smoothing(Forecaster):
    """With ``auto`` each series gets the variants its stationarity and length call for."""

    trend: str | None = None
    seasonal: str | None = None
    period: int | None = None
    auto: bool = False

    def variants(self) -> list[tuple]:
        return [(None, None, None), ("add", None, None), ("add", "add", 12)] if self.auto else [(self.trend, self.seasonal, self.period)]

    def fit(self, train: DataFrame) -> Forecaster:
        parts = []
        chosen = smoothing.choose_variants(train, stationarity.adf(train, **self.axes), keys=self.keys) if self.auto else None
        for trend, seasonal, period in self.variants():
            rows = train
            if chosen is not None:
                same = F.col("trend").eqNullSafe(F.lit(trend)) & F.col("seasonal").eqNullSafe(F.lit(seasonal))
                rows = self.only(train, chosen.where(same))
            parts.append(smoothing.fit_smoothing(rows, trend=trend, seasonal=seasonal, period=period, **self.axes, **self.options))
        self.fitted = reduce(DataFrame.unionByName, parts)
        return self

    def only(self, rows: DataFrame, chosen: DataFrame) -> DataFrame:
        """The rows of the chosen series."""
        if self.keys:
            return join_on_keys(rows, chosen.select(*self.keys), self.keys, "left_semi")
        return rows.withColumn("_any", chosen.agg(F.count(F.lit(1))).scalar()).where("_any > 0").drop("_any")

    def forecast(self, steps: int = 30) -> DataFrame:
        parts = []
        for trend, seasonal, period in self.variants():
            rows = self.fitted.where(F.col("model") == smoothing.model_name(trend, seasonal, period))
            parts.append(smoothing.forecast_smoothing(
                rows, keys=self.keys, steps=steps, freq=self.freq, trend=trend, seasonal=seasonal, period=period))
        return reduce(DataFrame.unionByName, parts)


@dataclass
class TrendSeason(Forecaster):
    """Keeps the training rows; fit and forecast are one aggregate."""

    def fit(self, train: DataFrame) -> Forecaster:
        self.fitted = train
        return self

    def forecast(self, steps: int = 30) -> DataFrame:
        return trendseason.trend_season(self.fitted, steps=steps, freq=self.freq, **self.axes, **self.options)


@dataclass
class Trees(Forecaster):
    kind: str = "rf"
    n_lags: int = 12
    model: object = None
    scales: DataFrame | None = None

    def fit(self, train: DataFrame) -> Forecaster:
        self.model, self.scales = trees.fit_trees(train, kind=self.kind, n_lags=self.n_lags, **self.axes, **self.options)
        self.fitted = train
        return self

    def forecast(self, steps: int = 30) -> DataFrame:
        return trees.forecast_trees(
            self.model, self.scales, self.fitted, steps=steps, freq=self.freq, n_lags=self.n_lags, name=self.kind.upper(), **self.axes)

    def save(self, path: str) -> str:
        self.model.write().overwrite().save(f"{path}/model")
        self.scales.write.mode("overwrite").parquet(f"{path}/scales")
        return super().save(path)

    def load(self, spark: SparkSession, path: str) -> Forecaster:
        kinds = {"RandomForestRegressionModel": RandomForestRegressionModel, "GBTRegressionModel": GBTRegressionModel}
        name = spark.read.json(f"{path}/model/metadata").first()["class"].rsplit(".", 1)[-1]
        self.model = kinds[name].load(f"{path}/model")
        self.scales = spark.read.parquet(f"{path}/scales")
        return super().load(spark, path)


MODELS: dict[str, Callable[..., Forecaster]] = {
    "lr": LagRegression,
    "arima": Arima,
    "arima_search": lambda **kw: Arima(orders=arima.ARIMA_GRID, **kw),
    "sarima": lambda **kw: Arima(orders=((1, 1, 1, 1, 1, 1, 12),), **kw),
    "sarima_search": lambda **kw: Arima(orders=arima.SARIMA_GRID, **kw),
    "ets": lambda **kw: Smoothing(auto=True, **kw),
    "prophet": TrendSeason,
    "rf": lambda **kw: Trees(kind="rf", **kw),
    "gb": lambda **kw: Trees(kind="gb", **kw),
    "xgb": lambda **kw: Trees(kind="xgb", **kw),
}


def register(name: str, factory: Callable[..., Forecaster]) -> None:
    """Add a forecaster under a name of its own."""
    MODELS[name] = factory


def reason(problem: Exception) -> str:
    """The line that says what went wrong: the last Python error in a message, else its first line."""
    lines = [line.strip() for line in str(problem).splitlines() if line.strip()]
    errors = [line for line in lines if re.match(r"(\w+\.)*\w*(Error|Exception|Warning): \S", line)]
    return (errors or lines or [type(problem).__name__])[-1 if errors else 0]


def run_models(
    train: DataFrame, models: Sequence[str], *, ts: str, y: str, keys: Sequence[str] = (), steps: int = 30, freq: str = "D",
    options: dict[str, dict] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all models, and a status per requested model and series.

    Each model's forecasts are written to the checkpoint folder at once, so a model that
    fails costs only its own rows. Status: ok, unknown model, failed (with the message), no
    forecast (the series does not suit the model) or not finite (its numbers do not).
    """
    spark = train.sparkSession
    series = train.select(*keys).distinct() if keys else train.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    parts, status = [], []
    for name in models:
        wanted = series.withColumn("requested", F.lit(name))
        if name not in MODELS:
            status.append(wanted.withColumns({"status": F.lit("unknown model"), "message": F.lit(None).cast("string")}))
            continue
        try:
            forecaster = MODELS[name](ts=ts, y=y, keys=keys, freq=freq, **(options or {}).get(name, {}))
            rows = cut_lineage(forecaster.fit(train).forecast(steps).select(*keys, F.lit(name).alias("requested"), *FORECAST_COLUMNS))
        except Exception as problem:  # noqa: BLE001 - one model's failure must not end the run
            status.append(wanted.withColumns({"status": F.lit("failed"), "message": F.lit(reason(problem))}))
            continue
        parts.append(rows.where("forecast is not null and abs(forecast) < double('infinity')"))
        known = F.col("forecast").isNotNull() & (F.abs("forecast") < float("inf"))
        made = rows.groupBy(*keys, "requested").agg(F.count(F.lit(1)).alias("_made"), F.count_if(known).alias("_known"))
        found = join_on_keys(wanted, made, [*keys, "requested"], "left")
        ok = F.when(F.col("_known") == F.col("_made"), "ok").when(F.col("_made") > 0, "not finite").otherwise("no forecast")
        status.append(found.select(*keys, "requested", ok.alias("status"), F.lit(None).cast("string").alias("message")))
    nothing = spark.createDataFrame([], "requested string, model string, step int, date date, forecast double")
    forecasts = reduce(DataFrame.unionByName, parts) if parts else nothing
    return forecasts, reduce(DataFrame.unionByName, status)
