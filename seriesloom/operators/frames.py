"""Forecast frames as read from files: which column is which, and the common names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from seriesloom.functions.cleaning import name_has
from seriesloom.operators.profile import numeric_columns

# Names a forecast or its bounds go by, in order of preference.
FORECAST_NAMES = ("forecast", "prediction", "pred")
FORECAST_WORDS = ("forecast", "predict", "pred")
BOUND_NAMES = (("lower_bound", "upper_bound"), ("lower_ci", "upper_ci"))


def forecast_column(columns: Sequence[str]) -> str | None:
    """The forecast column: by exact name, else the first whose name holds a forecast word."""
    exact = [c for c in FORECAST_NAMES if c in columns]
    return exact[0] if exact else next((c for c in columns if name_has(c, FORECAST_WORDS)), None)


def bound_columns(columns: Sequence[str]) -> tuple[str, str] | None:
    """Lower and upper bound: a known pair, else the first names holding lower and upper."""
    for low, high in BOUND_NAMES:
        if low in columns and high in columns:
            return low, high
    low = next((c for c in columns if "lower" in c.lower()), None)
    high = next((c for c in columns if "upper" in c.lower()), None)
    return (low, high) if low and high else None


def normalise_forecast(df: DataFrame) -> DataFrame:
    """Name the first column ``date``, and the first number ``forecast`` if no column is one.

    A metric table (it has ``Model``) stays as it is.
    """
    if "Model" in df.columns:
        return df
    out = df.withColumnRenamed(df.columns[0], "date")
    if not set(FORECAST_NAMES) & set(out.columns):
        number = next((c for c in numeric_columns(out) if c != "date"), None)
        out = out.withColumnRenamed(number, "forecast") if number else out
    return out


def resolve_forecast(df: DataFrame) -> DataFrame:
    """The frame with its forecast and bounds under their common names."""
    names = {}
    found, bounds = forecast_column(df.columns), bound_columns(df.columns)
    if found:
        names[found] = "forecast"
    if bounds:
        names |= dict(zip(bounds, ("lower_bound", "upper_bound")))
    return df.withColumnsRenamed(names)
