"""Least squares for every series in one aggregate, and linear recursive forecasts.

The rows of all series meet in one ``groupBy().agg``: the sums of products of the inputs.
They combine map-side, so neither a long series nor a hot key gathers its rows anywhere.
What is left per series is a k x k solve on one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import MODEL_CALENDAR, model_calendar
from seriesloom.operators.lags import last_values
from seriesloom.operators.ordering import join_on_keys, ordered_columns
from seriesloom.operators.timeaxis import dates_after

RCOND = 1e-11
MOST_SUMS = 100  # more sums than this are not compiled into one aggregate


def finite(column: str) -> str:
    """SQL that is true for a known number: not null, not NaN, not infinite."""
    return f"abs(cast(`{column}` as double)) <= 1.7976931348623157E308D"


def gram(rows: DataFrame, x: Sequence[str], y: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Per series ``n``, ``m`` and ``g``: the means of (1, x..., y) and the upper triangle of
    the products of (1, x..., y), each of x and y taken from its mean.

    Products of raw values would lose a series' movement in the digits of its level. Rows
    with a null, NaN or infinite value among them do not count; a series without other rows
    has no row. A few inputs are combined by generated code; for many inputs each Arrow
    batch is reduced to one matrix product per series first.
    """
    columns = [*x, y]
    known = rows.where(" and ".join(finite(c) for c in columns))
    if (len(columns) + 1) * (len(columns) + 2) // 2 > MOST_SUMS:
        return wide_gram(known, columns, keys=keys)
    zeros = ", ".join("0D" for _ in columns)
    products = ", ".join(f"covar_pop(`{a}`, `{b}`) * count(1)" for i, a in enumerate(columns) for b in columns[i:])
    means = ", ".join(f"avg(`{c}`)" for c in columns)
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"array(1D, {means})").alias("m"),
        F.expr(f"array(cast(count(1) as double), {zeros}, {products})").alias("g")).where("n > 0")


def wide_gram(known: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """:func:`gram` by partial products per batch; the few partial ones of a series are then merged."""
    columns, keys = list(columns), list(keys)
    upper = np.triu_indices(len(columns))
    types = "".join(f"`{k}` {known.schema[k].dataType.simpleString()}, " for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[columns].to_numpy(dtype=float)
            groups = batch.groupby(keys, sort=False, dropna=False).indices if keys else {(): np.arange(len(batch))}
            groups = [rows for rows in groups.values() if len(rows)]
            means = [values[rows].mean(axis=0) for rows in groups]
            products = [(values[rows] - m).T @ (values[rows] - m) for rows, m in zip(groups, means)]
            out = batch[keys].iloc[[rows[0] for rows in groups]].reset_index(drop=True) if keys else pd.DataFrame(index=range(len(groups)))
            yield out.assign(n=[len(rows) for rows in groups], m=means, g=[p[upper] for p in products])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        n, mean, product = 0, np.zeros(len(columns)), np.zeros(len(upper[0]))
        for count, m, g in zip(parts["n"], parts["m"], parts["g"]):
            gap = np.asarray(m) - mean
            product = product + np.asarray(g) + np.outer(gap, gap)[upper] * (n * count / (n + count))
            mean, n = mean + gap * (count / (n + count)), n + count
        packed = np.concatenate([[float(n)], np.zeros(len(columns)), product])
        return parts[keys].iloc[:1].reset_index(drop=True).assign(n=[n], m=[np.r_[1.0, mean]], g=[packed])

    slim = known.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    near = slim.sortWithinPartitions(*keys) if keys else slim  # rows of a series share a batch
    schema = types + "n long, m array<double>, g array<double>"
    return near.mapInPandas(partial, schema).groupBy(*keys).applyInPandas(merge, schema)


def square(packed: np.ndarray, size: int) -> np.ndarray:
    """The full symmetric matrix of a packed upper triangle."""
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = np.asarray(packed, dtype=float)
    return full + np.triu(full, 1).T


def solve(full: np.ndarray, columns: Sequence[int], ridge: np.ndarray | None = None):
    """Coefficients of the chosen inputs, their squared error and the inverse normal matrix.

    The last row of ``full`` is the target. Inputs are put on one scale first; inputs that
    are all zero, or repeat others, get the shortest solution. Products that are not finite
    give NaN throughout, so that one bad series does not end a job.
    """
    xx, xy, yy = full[np.ix_(columns, columns)], full[columns, -1], full[-1, -1]
    if not np.isfinite(full[:, [*columns, -1]]).all():
        return np.full(len(columns), np.nan), np.nan, np.full(xx.shape, np.nan)
    size = np.sqrt(np.diag(xx))
    size[size == 0] = 1.0
    scaled = xx / np.outer(size, size)
    if ridge is not None:
        scaled = scaled + np.diag(ridge / size**2)
    inverse = np.linalg.pinv(scaled, rcond=RCOND, hermitian=True) / np.outer(size, size)
    beta = inverse @ xy
    sse = yy - 2 * beta @ xy + beta @ xx @ beta
    return beta, max(float(sse), 0.0), inverse


def from_zero(full: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The products of the values themselves, for models without a constant."""
    means = np.r_[0.0, np.asarray(m, dtype=float)[1:]]
    out = full + full[0, 0] * np.outer(means, means)
    out[0, 1:] = out[1:, 0] = full[0, 0] * means[1:]
    return out


def constant_of(beta: np.ndarray, m: np.ndarray, columns: Sequence[int]) -> np.ndarray:
    """Coefficients (constant first) of values taken from their means, for the values themselves."""
    m = np.asarray(m, dtype=float)
    return np.r_[beta[0] + m[-1] - beta[1:] @ m[list(columns)[1:]], beta[1:]]


def least_squares(rows: DataFrame, x: Sequence[str], y: str, *, keys: Sequence[str] = (), ridge: float = 0.0) -> DataFrame:
    """Per series: ``n``, ``intercept``, ``coef`` (one per input), ``stderr``, ``sse``, ``sigma``, ``r2``, ``aic``.

    All but ``n`` are null where the products of a series are not finite.
    """
    size = len(x) + 2
    columns = list(range(size - 1))

    @F.pandas_udf("struct<intercept:double,coef:array<double>,stderr:array<double>,sse:double,sigma:double,r2:double,aic:double>")
    def fit(n: pd.Series, m: pd.Series, g: pd.Series) -> pd.DataFrame:
        out = []
        for count, means, packed in zip(n, m, g):
            full = square(packed, size)
            penalty = None if ridge == 0 else np.r_[0.0, np.full(len(x), ridge)]
            beta, sse, inverse = solve(full, columns, penalty)
            if not np.isfinite(sse):
                out.append((None,) * 7)
                continue
            beta = constant_of(beta, means, columns)
            back = np.eye(size - 1)
            back[0, 1:] = -np.asarray(means, dtype=float)[1:-1]
            spare = count - (size - 1)
            sigma = np.sqrt(sse / spare) if spare > 0 else None
            errors = None if sigma is None else list(sigma * np.sqrt(np.maximum(np.diag(back @ inverse @ back.T), 0)))
            total = full[-1, -1]
            aic = count * np.log(sse / count) + 2 * size if sse > 0 else None
            out.append((beta[0], list(beta[1:]), errors, sse, sigma, 1 - sse / total if total > 0 else None, aic))
        return pd.DataFrame(out, columns=["intercept", "coef", "stderr", "sse", "sigma", "r2", "aic"])

    return gram(rows, x, y, keys=keys).withColumn("_f", fit("n", "m", "g")).select(*keys, "n", "_f.*")


def lag_names(n_lags: int) -> list[str]:
    return [f"lag_{k}" for k in range(1, n_lags + 1)]


def model_features(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "bin",
    n_lags: int = 12, calendar: bool = True,
) -> DataFrame:
    """Keys, time, target, lags 1..n_lags and the calendar inputs; rows with nulls dropped."""
    base = df.select(*keys, ts, y, *[c for c in tie if c not in (*keys, ts, y)])
    lagged = ordered_columns(
        base, lambda w: {f"lag_{k}": F.lag(y, k).over(w) for k in range(1, n_lags + 1)},
        ts=ts, keys=keys, tie=tie, grain=grain, back=n_lags)
    if calendar:
        lagged = lagged.withColumns(model_calendar(ts))
    return lagged.dropna(subset=[c for c in lagged.columns if c not in keys])


def feature_names(n_lags: int, calendar: bool) -> list[str]:
    return lag_names(n_lags) + (list(MODEL_CALENDAR) if calendar else [])


def fit_lag_regression(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), n_lags: int = 12, calendar: bool = True, freq: str = "D",
) -> DataFrame:
    """The lag regression of each calendar-grain series with what its forecast needs."""
    rows = model_features(df, ts=ts, y=y, keys=keys, n_lags=n_lags, calendar=calendar)
    fitted = least_squares(rows, feature_names(n_lags, calendar), y, keys=keys)
    tail = last_values(df, ts=ts, y=y, keys=keys, grain="bin", n=n_lags)
    return join_on_keys(fitted, tail, keys).withColumns({"n_lags": F.lit(n_lags), "freq": F.lit(freq)})


def forecast_lag_regression(
    fitted: DataFrame, *, keys: Sequence[str] = (), steps: int = 30, n_lags: int = 12, calendar: bool = True, freq: str = "D", model: str = "LR",
) -> DataFrame:
    """Recursive forecast: every forecast value becomes lag 1 of the next step."""
    dates = dates_after(F.to_date("last_ts") if freq != "H" else F.col("last_ts"), steps, freq)
    level = F.col("intercept")
    if calendar:
        def offset(day: Column) -> Column:
            inputs = model_calendar(day).values()
            return sum((F.get("coef", F.lit(n_lags + i)) * v for i, v in enumerate(inputs)), level)
    else:
        def offset(day: Column) -> Column:
            return level
    ready = fitted.withColumn("_dates", dates).withColumns({
        "offset": F.transform("_dates", offset), "lag_coef": F.slice("coef", 1, n_lags)})
    return recursive_linear(ready, keys=keys, steps=steps, model=model)


def recursive_linear(ready: DataFrame, *, keys: Sequence[str], steps: int, model: str | Column) -> DataFrame:
    """Unroll y[k] = offset[k] + sum(lag_coef[i] * y[k - i]) from the last values of each series.

    ``ready`` has one row per series: ``last_values`` (oldest first), ``lag_coef``,
    ``offset`` and ``_dates``, the latter two of length ``steps``.
    """
    lags = F.size("lag_coef")

    def step(path: Column, k: Column) -> Column:
        recent = F.reverse(F.slice(path, F.size(path) - lags + 1, lags))
        pull = F.aggregate(F.zip_with("lag_coef", recent, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return F.concat(path, F.array(F.get("offset", k - 1) + pull))

    start = F.transform("last_values", lambda v: v.cast("double"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    ahead = F.slice(path, F.size("last_values") + 1, steps)
    pairs = F.arrays_zip(F.col("_dates").alias("date"), ahead.alias("forecast"))
    usable = ready.where(F.size("last_values") >= lags)
    name = F.lit(model) if isinstance(model, str) else model
    return usable.select(*keys, name.alias("model"), F.posexplode(pairs).alias("_i", "_p")).select(
        *keys, "model", (F.col("_i") + 1).alias("step"), F.col("_p.date").alias("date"), F.col("_p.forecast").alias("forecast"))
