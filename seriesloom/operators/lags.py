"""Lags, rolling statistics, centred trend, sliding sequences and series tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.operators.ordering import BLOCK_ROWS, block_columns, ordered_columns, with_position


def full_frame(value: Column, y: str, frame: WindowSpec, rows: int) -> Column:
    """``value`` over the frame, null unless the frame has ``rows`` known values."""
    return F.when(F.count(y).over(frame) == rows, value.over(frame))


def add_lags(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row",
    n_lags: int | None = 7, lags: Sequence[int] | None = None, name: str = "{y}_lag_{k}",
) -> DataFrame:
    """The values ``k`` rows back, for k = 1..n_lags or for the listed lags."""
    steps = list(lags) if lags is not None else list(range(1, n_lags + 1))
    return ordered_columns(
        df, lambda w: {name.format(y=y, k=k): F.lag(y, k).over(w) for k in steps},
        ts=ts, keys=keys, tie=tie, grain=grain, back=max(steps, default=0),
    )


def add_rolling(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row",
    windows: Sequence[int] = (7, 14, 30), std: bool = False, partial: bool = False,
    mean_name: str = "{y}_rolling_mean_{k}", std_name: str = "{y}_rolling_std_{k}",
) -> DataFrame:
    """Trailing mean (and sample deviation) over k rows; ``partial`` allows short frames."""
    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for k in windows:
            frame = w.rowsBetween(-(k - 1), 0)
            stats = {mean_name: F.avg(y)} | ({std_name: F.stddev_samp(y)} if std else {})
            for pattern, stat in stats.items():
                out[pattern.format(y=y, k=k)] = stat.over(frame) if partial else full_frame(stat, y, frame, k)
        return out
    return ordered_columns(df, build, ts=ts, keys=keys, tie=tie, grain=grain, back=max(windows))


def add_lag_features(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", n_lags: int = 7,
) -> DataFrame:
    """Lags 1..n_lags plus rolling means over 7, 14 and 30 rows, in one pass."""
    windows = (7, 14, 30)  # fixed values
    def build(w: WindowSpec) -> dict[str, Column]:
        out = {f"{y}_lag_{k}": F.lag(y, k).over(w) for k in range(1, n_lags + 1)}
        for k in windows:
            out[f"{y}_rolling_mean_{k}"] = full_frame(F.avg(y), y, w.rowsBetween(-(k - 1), 0), k)
        return out
    return ordered_columns(df, build, ts=ts, keys=keys, tie=tie, grain=grain, back=max(n_lags, *windows))


def centred_trend(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "bin", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Centred moving average and the detrended rest, per series.

    The window is min(30, max(7, n // 10)) rows, so its reach differs by series; a series
    of fewer than 14 rows has no trend. The values of the largest window are neighbours at
    fixed distances, of which each row takes those within the reach of its series.
    """
    placed = with_position(df, ts=ts, keys=keys, tie=tie, grain=grain, position="_t", size="_n")
    width = F.least(F.lit(30), F.greatest(F.lit(7), F.floor(F.col("_n") / 10)))
    behind, ahead = F.floor(width / 2), F.floor((width - 1) / 2)
    most_behind, most_ahead = 15, 14  # of the largest window

    def build(w: WindowSpec) -> dict[str, Column]:
        near = {k: F.lag(F.col(y).cast("double"), -k).over(w) for k in range(-most_behind, most_ahead + 1)}
        return {f"_near_{k + most_behind}": v for k, v in near.items()}

    if grain == "bin":
        wide = placed.withColumns(build(Window.partitionBy(*keys).orderBy("_t")))
    else:
        wide = block_columns(placed, build, keys=keys, position="_t", back=most_behind, ahead=most_ahead, block_rows=block_rows)
    taken = []
    for k in range(-most_behind, most_ahead + 1):
        reached = behind >= -k if k < 0 else ahead >= k
        taken.append(F.when(reached, F.col(f"_near_{k + most_behind}")))
    known = sum((v.isNotNull().cast("int") for v in taken), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in taken), F.lit(0.0))
    trend = F.when((F.col("_n") >= 14) & (known == width), total / width)
    out = wide.withColumn("trend_ma", trend).withColumn("detrended", F.col(y) - F.col("trend_ma"))
    return out.drop("_t", "_n", *[f"_near_{k}" for k in range(most_behind + most_ahead + 1)])


def sequences(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", n_steps: int = 30,
) -> DataFrame:
    """Each row's ``n_steps`` values before it, oldest first, as ``inputs``; its own as ``label``."""
    def build(w: WindowSpec) -> dict[str, Column]:
        return {"inputs": F.collect_list(y).over(w.rowsBetween(-n_steps, -1)), "label": F.col(y)}
    out = ordered_columns(df.where(F.col(y).isNotNull()), build, ts=ts, keys=keys, tie=tie, grain=grain, back=n_steps)
    return out.where(F.size("inputs") == n_steps)


def last_values(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", n: int = 20,
) -> DataFrame:
    """The last ``n`` values of each series, oldest first, as one array row per series."""
    placed = with_position(df, ts=ts, keys=keys, tie=tie, grain=grain, position="_t", size="_n")
    tail = placed.where(F.col("_t") >= F.col("_n") - n)
    item = F.struct(F.col("_t").alias("t"), F.col(ts).alias("ts"), F.col(y).alias("v"))
    packed = tail.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_tail"))
    return packed.select(*keys, F.col("_tail.v").alias("last_values"), F.element_at("_tail", -1)["ts"].alias("last_ts"))
