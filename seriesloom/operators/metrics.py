"""Forecast scores, the best model per score, rankings and weighted blends.

Forecast frames carry keys, ``model``, ``step``, ``date`` and ``forecast``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.ordering import join_on_keys, with_position
from seriesloom.operators.profile import union_all, unfold


def align_by_step(actual: DataFrame, forecast: DataFrame, *, keys: Sequence[str] = (), on: str = "step") -> DataFrame:
    """Pair actual and forecast by series and step (or date); null keys match, unmatched rows fall out."""
    return join_on_keys(forecast, actual.select(*keys, on, "actual"), [*keys, on])


def number_steps(df: DataFrame, *, ts: str, keys: Sequence[str] = (), grain: str = "bin") -> DataFrame:
    """Add ``step`` = 1, 2, ... in time order."""
    return with_position(df, ts=ts, keys=keys, grain=grain, position="_t").withColumn("step", (F.col("_t") + 1).cast("int")).drop("_t")


def score(
    pairs: DataFrame, *, by: Sequence[str] = (), actual: str = "actual", forecast: str = "forecast", guarded: bool = False,
) -> DataFrame:
    """MAE, MSE, RMSE, R2 and MAPE per group in one aggregate.

    The plain MAPE is null if an actual value is zero. ``guarded`` leaves such rows out
    of the MAPE and adds the symmetric SMAPE instead of R2.
    """
    a, f = F.col(actual), F.col(forecast)
    error, known = a - f, a.isNotNull() & f.isNotNull()
    ratio = F.abs(F.try_divide(error, a))
    rows = pairs.where(known)
    basic = [F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.sqrt(F.avg(error * error)).alias("rmse")]
    if guarded:
        smape = F.avg(F.try_divide(2 * F.abs(error), F.abs(a) + F.abs(f))) * 100
        return rows.groupBy(*by).agg(*basic, (F.avg(ratio) * 100).alias("mape"), smape.alias("smape"))
    r2 = 1 - F.try_divide(F.sum(error * error), F.var_pop(a) * F.count(a))
    mape = F.when(F.count_if(a == 0) == 0, F.avg(ratio) * 100)
    return rows.groupBy(*by).agg(*basic, r2.alias("r2"), mape.alias("mape"))


def evaluate_models(
    actual: DataFrame, forecasts: DataFrame, *, keys: Sequence[str] = (), steps: int | None = None, guarded: bool = False,
) -> DataFrame:
    """Scores per series and model over the first ``steps`` steps that both sides have."""
    pairs = align_by_step(actual, forecasts, keys=keys)
    if steps is not None:
        pairs = pairs.where(F.col("step") <= steps)
    return score(pairs, by=[*keys, "model"], guarded=guarded)


def best_models(scores: DataFrame, *, keys: Sequence[str] = (), metrics: Sequence[str] = ("rmse", "mae", "mape")) -> DataFrame:
    """Per metric the model with the lowest value; equal values by model name."""
    wide = scores.groupBy(*keys).agg(*[
        c for m in metrics for c in (
            F.min_by("model", F.when(F.col(m).isNotNull(), F.struct(F.col(m), F.col("model")))).alias(f"{m}|model"), F.min(m).alias(f"{m}|value"))])
    return unfold(wide, {m: {"model": f"{m}|model", "value": f"{m}|value"} for m in metrics}, keys=keys, label="metric")


def rank_models(scores: DataFrame, *, keys: Sequence[str] = (), metrics: Sequence[str] = ("rmse", "mae", "mape")) -> DataFrame:
    """Add ``rank_<metric>``; a group is as long as the list of models."""
    return scores.withColumns({f"rank_{m}": F.rank().over(Window.partitionBy(*keys).orderBy(F.col(m).asc_nulls_last())) for m in metrics})


def blend(
    forecasts: DataFrame, *, keys: Sequence[str] = (), models: Sequence[str], weights: Sequence[float] | Mapping[str, float] | None = None,
    name: str = "ensemble", by: str = "model", present_only: bool = False,
) -> DataFrame:
    """Weighted mean of the models per step, weights normalised, cut to the steps all models have.

    ``by`` is the column that names the models. Weights stand in the order of ``models`` or
    carry their names, which must then be those of ``models``. With ``present_only`` each
    series blends the models it has, if more than one. Several forecasts of one model for a
    step count as their mean.
    """
    if isinstance(weights, Mapping):
        if set(weights) != set(models):
            raise ValueError(f"weights name {sorted(weights)}, the models are {sorted(models)}")
        shares = [float(weights[m]) for m in models]
    else:
        shares = list(weights) if weights is not None else [1.0] * len(models)
        if len(shares) != len(models):
            raise ValueError(f"{len(shares)} weights for {len(models)} models")
    total = float(sum(shares))
    weight = F.create_map(*[x for m, w in zip(models, shares) for x in (F.lit(m), F.lit(w / total))])
    chosen = forecasts.where(F.col(by).isin(*models) & F.col("forecast").isNotNull())
    each = chosen.groupBy(*keys, by, "step").agg(F.avg("forecast").alias("forecast"), F.min("date").alias("date"))
    share = F.element_at(weight, F.col(by))
    out = each.groupBy(*keys, "step").agg(
        F.sum(F.col("forecast") * share).alias("forecast"), F.sum(share).alias("_share"), F.min("date").alias("date"), F.count(F.lit(1)).alias("_models"))
    if present_only:
        have = each.groupBy(*keys).agg(F.count_distinct(by).alias("_have"))
        out = join_on_keys(out, have, keys).where("_models = _have AND _have > 1 AND _share > 0").withColumn("forecast", F.col("forecast") / F.col("_share"))
    else:
        out = out.where(F.col("_models") == len(models))
    return out.select(*keys, F.lit(name).alias("model"), "step", "date", "forecast")


def forecast_frame(
    history: DataFrame, forecast: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), split: str = "split",
) -> DataFrame:
    """One row per date: actual, train, test, forecast and bounds.

    ``history`` carries the split label. A union and one aggregate take the place of
    outer joins.
    """
    bounds = [c if c in forecast.columns else None for c in ("lower_bound", "upper_bound")]
    none = F.lit(None).cast("double")
    past = history.select(
        *keys, F.to_date(ts).alias("date"), F.col(y).cast("double").alias("actual"),
        F.when(F.col(split) == "train", F.col(y)).cast("double").alias("train"), F.when(F.col(split) == "test", F.col(y)).cast("double").alias("test"),
        none.alias("forecast"), none.alias("lower_bound"), none.alias("upper_bound"))
    coming = forecast.select(
        *keys, F.to_date("date").alias("date"), none.alias("actual"), none.alias("train"), none.alias("test"), "forecast",
        *[(F.col(c) if c else none).alias(alias) for c, alias in zip(bounds, ("lower_bound", "upper_bound"))])
    values = ("actual", "forecast", "train", "test", "lower_bound", "upper_bound")
    return union_all([past, coming]).groupBy(*keys, "date").agg(*[F.max(c).alias(c) for c in values])
