"""Trend and season regression: bent trend, Fourier seasons, holidays and regressors.

A ridge least-squares model in place of a sampled one: the same components, fitted for all
series by one aggregate. Bounds come from the residual deviation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.models.leastsq import constant_of, gram, solve, square
from seriesloom.operators.ordering import join_on_keys
from seriesloom.operators.timeaxis import dates_after

# Season name, its period in days, Fourier pairs, rows a series needs for it.
SEASONS = (("yearly", 365.25, 10, 365), ("weekly", 7.0, 3, 14), ("daily", 1.0, 4, 7))
N_BENDS = 25
BEND_RANGE = 0.8
MOST_HOLIDAYS = 200
SEASON_SCALE = 10.0
Z80 = 1.2815515655446004  # fixed value: two-sided 80 % point of the normal


def day_number(ts: Column) -> Column:
    """Days since 1970 with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400e6)


def component_columns(seasons: dict[str, bool], holidays: Sequence[str], regressors: Sequence[str]) -> tuple[dict[str, Column], list[float]]:
    """The model inputs by name and their penalty class: 0 free, 1 bend, 2 season or effect.

    Needs ``_day``, the range ``_d0`` and ``_d1`` of the training days and its rows ``_n``.
    """
    t = F.try_divide(F.col("_day") - F.col("_d0"), F.col("_d1") - F.col("_d0"))
    out, classes = {"_x0": t}, [0]
    for i in range(1, N_BENDS + 1):
        bend = BEND_RANGE * i / N_BENDS
        out[f"_x{len(out)}"] = F.greatest(t - bend, F.lit(0.0))
        classes.append(1)
    for name, period, pairs, least in SEASONS:
        if not seasons.get(name):
            continue
        on = F.when(F.col("_n") >= least, 1.0).otherwise(0.0)
        for k in range(1, pairs + 1):
            angle = F.col("_day") * (2 * math.pi * k / period)
            for wave in (F.sin(angle), F.cos(angle)):
                out[f"_x{len(out)}"] = wave * on
                classes.append(2)
    for c in [*holidays, *regressors]:
        out[f"_x{len(out)}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        classes.append(2)
    return out, classes


def with_holidays(df: DataFrame, holidays: DataFrame | None, *, ts: str) -> tuple[DataFrame, list[str]]:
    """Flag columns, one per holiday name, joined by day. ``holidays`` has ``ds`` and ``holiday``."""
    if holidays is None:
        return df, []
    names = [r["holiday"] for r in holidays.select("holiday").distinct().orderBy("holiday").limit(MOST_HOLIDAYS + 1).collect()]
    if len(names) > MOST_HOLIDAYS:
        raise ValueError(f"more than {MOST_HOLIDAYS} holiday names; each becomes an input of the regression")
    flags = holidays.groupBy(F.to_date("ds").alias("_hday")).agg(
        *[F.max(F.when(F.col("holiday") == h, 1.0).otherwise(0.0)).alias(f"_holiday{i}") for i, h in enumerate(names)])
    joined = df.join(flags, F.to_date(ts) == F.col("_hday"), "left").drop("_hday")
    return joined, [f"_holiday{i}" for i in range(len(names))]


def attach_regressors(df: DataFrame, extra: DataFrame, *, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Left join of further numeric columns by series and time."""
    return join_on_keys(df, extra, [*keys, ts], "left")


def trend_season(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), steps: int = 30, freq: str = "D",
    yearly: bool = True, weekly: bool = True, daily: bool = False, changepoint_prior_scale: float = 0.05,
    holidays: DataFrame | None = None, regressors: Sequence[str] = (), future_regressors: DataFrame | None = None,
    model: str = "Prophet", fitted_rows: bool = False,
) -> DataFrame:
    """Fit and forecast: model, step, date, forecast, forecast_lower, forecast_upper.

    A season is used where asked for and where the series has the rows for it (365, 14, 7).
    ``future_regressors`` gives the regressors of the forecast days; missing ones count as 0.
    ``fitted_rows`` returns the fit of the history instead (its step counts down to 0).
    """
    seasons = {"yearly": yearly, "weekly": weekly, "daily": daily}
    known = df.where(F.col(y).isNotNull()).select(*keys, ts, F.col(y).cast("double").alias("_y"), *regressors)
    spans = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(day_number(F.col(ts))).alias("_d0"), F.max(day_number(F.col(ts))).alias("_d1"),
        F.max(ts).alias("_last"), F.max(F.abs("_y")).alias("_scale"))
    dated, flags = with_holidays(known, holidays, ts=ts)
    rows = join_on_keys(dated.withColumn("_day", day_number(F.col(ts))), spans, keys)
    inputs, classes = component_columns(seasons, flags, regressors)
    design = rows.withColumns(inputs).withColumn("_z", F.try_divide(F.col("_y"), F.col("_scale")))
    names = list(inputs)
    size = len(names) + 2
    penalty = np.array([0.0] + [{0: 0.0, 1: 1.0 / changepoint_prior_scale, 2: 1.0 / SEASON_SCALE**2}[c] for c in classes])

    @F.pandas_udf("struct<beta:array<double>,sigma:double>")
    def fit(n: pd.Series, m: pd.Series, g: pd.Series) -> pd.DataFrame:
        out, columns = [], list(range(size - 1))
        for count, means, packed in zip(n, m, g):
            beta, sse, _ = solve(square(packed, size), columns, penalty)
            known = np.isfinite(sse)
            out.append((list(constant_of(beta, means, columns)), math.sqrt(sse / max(count - 1, 1))) if known else (None, None))
        return pd.DataFrame(out, columns=["beta", "sigma"])

    fitted = gram(design, names, "_z", keys=keys).select(*keys, fit("n", "m", "g").alias("_f")).select(*keys, "_f.*")
    if fitted_rows:
        scored = join_on_keys(design, fitted, keys).withColumns({"date": F.to_date(ts), "step": F.datediff(ts, "_last")})
    else:
        last = F.to_date("_last") if freq != "H" else F.col("_last")
        ahead = spans.select("*", F.posexplode(dates_after(last, steps, freq)).alias("_i", ts))
        ahead = ahead.withColumn("_day", day_number(F.col(ts)))
        if regressors:
            if future_regressors is not None:
                ahead = attach_regressors(ahead, future_regressors.select(*keys, ts, *regressors), ts=ts, keys=keys)
            else:
                ahead = ahead.withColumns({c: F.lit(0.0) for c in regressors})
        dated, _ = with_holidays(ahead, holidays, ts=ts)
        scored = join_on_keys(dated.withColumns(inputs), fitted, keys).withColumns({"date": F.col(ts), "step": F.col("_i") + 1})
    terms = F.zip_with(F.col("beta"), F.array(F.lit(1.0), *names), lambda b, x: b * x)
    centre = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) * F.col("_scale")
    spread = F.lit(Z80) * F.col("sigma") * F.col("_scale")
    return scored.select(*keys, F.lit(model).alias("model"), "step", "date", centre.alias("forecast"),
                         (centre - spread).alias("forecast_lower"), (centre + spread).alias("forecast_upper"))
