"""Additive seasonal decomposition with a centred moving average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from seriesloom.operators.ordering import block_columns, join_facts, join_on_keys, series_window, with_position


def centred_mean(y: str, window: WindowSpec, period: int) -> Column:
    """Centred mean over one period; an even period halves the two outer rows."""
    half = period // 2
    frame = window.rowsBetween(-half, half)
    known = F.count(y).over(frame) == 2 * half + 1
    total = F.sum(y).over(frame)
    if period % 2 == 0:
        total = total - (F.lag(y, half).over(window) + F.lead(y, half).over(window)) / 2
    return F.when(known, total / period)


def seasonal_decompose(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", period: int = 7,
) -> DataFrame:
    """Add trend, seasonal and residual; observed = trend + seasonal + residual.

    The seasonal value of a position in the period is the mean of the detrended rows
    there, shifted so that the values of one period sum to zero.
    """
    placed = with_position(df, ts=ts, keys=keys, tie=tie, grain=grain, position="_t")
    trend = lambda w: {"trend": centred_mean(y, w, period)}
    if grain == "bin":
        trended = placed.withColumns(trend(series_window(keys, ["_t"])))
    else:
        trended = block_columns(placed, trend, keys=keys, position="_t", back=period, ahead=period)
    trended = trended.withColumn("_phase", F.pmod("_t", F.lit(period)).cast("int"))
    phases = trended.groupBy(*keys, "_phase").agg(F.avg(F.col(y) - F.col("trend")).alias("_m"))
    centre = phases.groupBy(*keys).agg(F.avg("_m").alias("_centre"))
    seasonal = join_on_keys(phases, centre, keys).select(*keys, "_phase", (F.col("_m") - F.col("_centre")).alias("seasonal"))
    join = join_on_keys if grain == "bin" else join_facts
    out = join(trended, seasonal, [*keys, "_phase"])
    return out.withColumn("residual", F.col(y) - F.col("trend") - F.col("seasonal")).drop("_t", "_phase")
