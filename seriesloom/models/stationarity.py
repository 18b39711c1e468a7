"""Augmented Dickey-Fuller test of every series, on shared least-squares aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.leastsq import gram, solve, square
from seriesloom.operators.ordering import join_on_keys, series_window, with_position

# MacKinnon's published response surfaces for a test with a constant.
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
P_SWITCH, P_MIN, P_MAX = -1.61, -18.83, 2.74
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def p_value(statistic: float) -> float:
    """Approximate p-value of the test statistic."""
    if statistic > P_MAX:
        return 1.0
    if statistic < P_MIN:
        return 0.0
    surface = P_SMALL if statistic <= P_SWITCH else P_LARGE
    z = sum(b * statistic**i for i, b in enumerate(surface))
    return 0.5 * (1.0 + erf(z / sqrt(2.0)))


def default_max_lag(n: int) -> int:
    """ceil(12 (n / 100)^(1/4)), at most what the series length allows."""
    return max(0, min(ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def adf(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), max_lag: int | None = None, alpha: float = 0.05, min_rows: int = 5,
) -> DataFrame:
    """Test statistic, p-value, lags, observations, critical values and verdict per series.

    A calendar-grain frame. The number of lagged differences is chosen by AIC on a common
    sample, then the test runs on all rows that many lags leave. Series of fewer than
    ``min_rows`` known values have no row. Without ``max_lag`` the longest series sets the
    number of lag columns, which costs one count.
    """
    known = df.where(F.col(y).isNotNull()).select(*keys, ts, F.col(y).cast("double").alias("_y"))
    known = with_position(known, ts=ts, keys=keys, grain="bin", position="_t", size="_n").where(F.col("_n") >= min_rows)
    longest = known.agg(F.max("_n").alias("n")).first()["n"] if max_lag is None else None
    top = default_max_lag(longest or 0) if max_lag is None else max_lag
    window = series_window(keys, ["_t"])
    change = F.coalesce(F.col("_y") - F.col("_before"), F.lit(0.0))
    steps = known.withColumn("_before", F.lag("_y").over(window)).withColumn("_d0", change)
    names = [f"_d{k}" for k in range(1, top + 1)]
    lagged = steps.withColumns({c: F.lag("_d0", k, 0.0).over(window) for k, c in enumerate(names, 1)})
    own = F.ceil(12.0 * F.pow(F.col("_n") / 100.0, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    use = F.greatest(F.lit(0), F.least(own, F.floor(F.col("_n") / 2) - 2)).cast("int")
    lagged = lagged.withColumn("_use", use)

    # All candidate lags share the rows that the largest one leaves. The chosen lag leaves
    # a few more at the start of the series; those are rebuilt from its first values.
    sums = gram(lagged.where(F.col("_t") > F.col("_use")), ["_before", *names], "_d0", keys=[*keys, "_use"])
    heads = known.where(F.col("_t") <= top + 1).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_t", "_y"))).alias("_h"))
    size = top + 3
    width = ["statistic", "p_value", "lags", "n_obs", *CRITICAL]

    @F.pandas_udf("struct<statistic:double,p_value:double,lags:int,n_obs:long,crit_1:double,crit_5:double,crit_10:double>")
    def test(use: pd.Series, n: pd.Series, m: pd.Series, g: pd.Series, head: pd.Series) -> pd.DataFrame:
        out = []
        for most, count, means, packed, first in zip(use, n, m, g, head):
            full, shift = square(packed, size), np.r_[0.0, np.asarray(means, dtype=float)[1:]]
            if not np.isfinite(full).all():
                out.append((None,) * len(width))
                continue
            errors = [solve(full, list(range(2 + k)))[1] for k in range(most + 1)]
            lags = int(np.argmin([count * np.log(max(e, 1e-300) / count) + 2 * (2 + k) for k, e in enumerate(errors)]))
            level = np.asarray(first, dtype=float)
            diff = np.r_[0.0, np.diff(level)]
            for t in range(lags + 1, most + 1):
                row = np.r_[1.0, level[t - 1], diff[t - np.arange(1, lags + 1)], np.zeros(top - lags), diff[t]]
                row = row - shift
                full, count = full + np.outer(row, row), count + 1
            columns = list(range(2 + lags))
            beta, sse, inverse = solve(full, columns)
            spare = count - len(columns)
            error = sqrt(sse / spare * inverse[1, 1]) if spare > 0 and inverse[1, 1] > 0 else 0.0
            statistic = beta[1] / error if error > 0 else None
            limits = [sum(b / count**i for i, b in enumerate(surface)) for surface in CRITICAL.values()]
            out.append((statistic, None if statistic is None else p_value(statistic), lags, count, *limits))
        return pd.DataFrame(out, columns=width)

    tested = join_on_keys(sums, heads, keys).withColumn("_r", test("_use", "n", "m", "g", F.col("_h._y")))
    return tested.select(*keys, *[f"_r.{c}" for c in width], (F.col("_r.p_value") <= alpha).alias("stationary"))
