"""Autocorrelation and partial autocorrelation of many series in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordering import join_facts, join_on_keys, ordered_columns

Z95 = 1.959963984540054  # fixed value: two-sided 95 % point of the normal


def acf_arrays(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", n_lags: int = 40,
) -> DataFrame:
    """One row per series: ``n`` and ``acf``, the autocorrelations of lags 0..n_lags."""
    known = df.where(F.col(y).isNotNull()).select(*keys, ts, y, *[c for c in tie if c not in (*keys, ts, y)])
    mean = known.groupBy(*keys).agg(F.avg(y).alias("_mean"))
    join = join_on_keys if grain == "bin" else join_facts
    centred = join(known, mean, keys).withColumn("_c", F.col(y) - F.col("_mean")).drop("_mean", y)
    lagged = ordered_columns(
        centred, lambda w: {f"_c{k}": F.lag("_c", k).over(w) for k in range(1, n_lags + 1)},
        ts=ts, keys=keys, tie=tie, grain=grain, back=n_lags)
    products = ", ".join(["sum(_c * _c)"] + [f"sum(_c * _c{k})" for k in range(1, n_lags + 1)])
    sums = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr(f"array({products})").alias("_s"))
    # A lag the series is too short for has no product; it is cut off.
    kept = F.slice("_s", 1, F.least(F.lit(n_lags + 1), F.col("n").cast("int")))
    return sums.select(*keys, "n", F.transform(kept, lambda s: F.try_divide(s, F.col("_s")[0])).alias("acf"))


def acf(df: DataFrame, *, n_lags: int | None = 40, keys: Sequence[str] = (), **where) -> DataFrame:
    """Autocorrelation per lag with the white-noise band and Bartlett's band (both 95 %).

    ``n_lags=None`` takes min(50, n // 2) lags per series.
    """
    arrays = acf_arrays(df, keys=keys, n_lags=50 if n_lags is None else n_lags, **where)
    out = arrays.select(*keys, "n", "acf", F.posexplode("acf").alias("lag", "value"))
    if n_lags is None:
        out = out.where(F.col("lag") <= F.floor(F.col("n") / 2))
    squares = F.aggregate(F.slice("acf", 2, F.greatest(F.col("lag") - 1, F.lit(0))), F.lit(0.0), lambda a, r: a + r * r)
    bartlett = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(F.lit(Z95) * F.sqrt((1 + 2 * squares) / F.col("n")))
    return out.select(*keys, "lag", F.col("value").alias("acf"), (F.lit(Z95) / F.sqrt("n")).alias("band"), bartlett.alias("bartlett"))


def durbin_levinson(r: Column) -> Column:
    """Partial autocorrelations of lags 1.. from the autocorrelations of lags 0.. ."""
    empty = F.expr("cast(array() as array<double>)")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda acc, v: acc + v)

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        last = F.try_divide(F.get(r, k) - dot(phi, F.reverse(F.slice(r, 2, F.size(phi)))), 1 - dot(phi, F.slice(r, 2, F.size(phi))))
        newer = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b), F.array(last))
        return F.struct(newer.alias("phi"), F.concat(state["pacf"], F.array(last)).alias("pacf"))

    start = F.struct(empty.alias("phi"), empty.alias("pacf"))
    return F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), start, step)["pacf"]


def pacf(df: DataFrame, *, n_lags: int = 40, keys: Sequence[str] = (), **where) -> DataFrame:
    """Partial autocorrelation per lag (Yule-Walker, by Durbin-Levinson) with its 95 % band."""
    arrays = acf_arrays(df, keys=keys, n_lags=n_lags, **where).where(F.size("acf") > 1)
    parts = arrays.select(*keys, "n", F.posexplode(durbin_levinson(F.col("acf"))).alias("_i", "pacf"))
    return parts.select(*keys, (F.col("_i") + 1).alias("lag"), "pacf", (F.lit(Z95) / F.sqrt("n")).alias("band"))
