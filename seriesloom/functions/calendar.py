"""Calendar columns of a time column: parts, cycles and bundles of both."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length of each cycle as used by the sine/cosine features.
MONTHS_PER_CYCLE = 12
WEEKDAYS_PER_CYCLE = 7
DAYS_PER_CYCLE = 365


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def monday_weekday(ts: Column | str) -> Column:
    """Day of the week, Monday = 0 .. Sunday = 6."""
    return F.weekday(column(ts))


def weekend_flag(ts: Column | str) -> Column:
    return F.when(monday_weekday(ts) >= 5, 1).otherwise(0)


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of ``value`` on a circle of ``period`` steps."""
    angle = value * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def add_time_features(df: DataFrame, *, ts: str) -> DataFrame:
    """Year, month, weekday, day of year, quarter, weekend and the two cyclic pairs."""
    month_sin, month_cos = cycle(F.month(ts), MONTHS_PER_CYCLE)
    weekday_sin, weekday_cos = cycle(monday_weekday(ts), WEEKDAYS_PER_CYCLE)
    return df.withColumns({
        "year": F.year(ts),
        "month": F.month(ts),
        "day_of_week": monday_weekday(ts),
        "day_of_year": F.dayofyear(ts),
        "quarter": F.quarter(ts),
        "is_weekend": weekend_flag(ts),
        "month_sin": month_sin,
        "month_cos": month_cos,
        "day_of_week_sin": weekday_sin,
        "day_of_week_cos": weekday_cos,
    })


def add_date_parts(df: DataFrame, *, ts: str) -> DataFrame:
    """Year, month, day, weekday and quarter."""
    return df.withColumns({
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "dayofweek": monday_weekday(ts),
        "quarter": F.quarter(ts),
    })


MODEL_CALENDAR = ("month", "dayofyear", "dayofweek", "month_sin", "month_cos", "day_sin", "day_cos")


def model_calendar(ts: Column | str) -> dict[str, Column]:
    """The calendar inputs of the regression and tree models, by name."""
    ts = column(ts)
    month_sin, month_cos = cycle(F.month(ts), MONTHS_PER_CYCLE)
    day_sin, day_cos = cycle(F.dayofyear(ts), DAYS_PER_CYCLE)
    values = (F.month(ts), F.dayofyear(ts), monday_weekday(ts), month_sin, month_cos, day_sin, day_cos)
    return {name: value.cast("double") for name, value in zip(MODEL_CALENDAR, values)}


def month_name(ts: Column | str) -> Column:
    return F.date_format(column(ts), "MMMM")


def weekday_name(ts: Column | str) -> Column:
    return F.date_format(column(ts), "EEEE")


def iso_day(ts: Column | str) -> Column:
    """The day as ``yyyy-MM-dd`` text."""
    return F.date_format(column(ts), "yyyy-MM-dd")
