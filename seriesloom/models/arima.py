"""ARIMA and seasonal ARIMA by least squares in three stages (Hannan-Rissanen), all series at once.

Stage one fits a long autoregression; its residuals stand in for the shocks. Stage two
regresses the differenced series on its own lags and on lagged residuals. All orders with
the same differencing share one aggregate: each is a sub-matrix of the largest one, and the
order is chosen by these. Stage three mends the bias of models with shocks: series and
residuals are filtered by the inverse moving-average polynomial and regressed once more, until
the coefficients stand still. That is the minimum of the conditional sum of squares, not the
exact maximum likelihood. A seasonal model takes the lags of the product polynomial with free
coefficients.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.leastsq import constant_of, from_zero, gram, least_squares, recursive_linear, solve, square
from seriesloom.models.perseries import map_series
from seriesloom.operators.ordering import join_on_keys, series_window, with_position
from seriesloom.operators.timeaxis import dates_after
from seriesloom.session import keep_facts

ORDER = ("p", "d", "q", "sp", "sd", "sq", "s")
NO_SEASON = (0, 0, 0, 0)

# The default search ranges.
ARIMA_GRID = tuple(product(range(3), range(2), range(3)))
SARIMA_GRID = tuple((*o, *so, 12) for o in product(range(2), repeat=3) for so in product(range(2), range(1), range(2)))


def lag_set(p: int, sp: int, s: int) -> list[int]:
    """The lags of a product of an ordinary and a seasonal polynomial."""
    return sorted({i + s * j for i in range(p + 1) for j in range(sp + 1)} - {0})


def difference_weights(d: int, sd: int, s: int) -> list[float]:
    """Weights of y[t], y[t-1], ... in the differenced series."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(sd):
        poly = np.convolve(poly, np.r_[1.0, np.zeros(s - 1), -1.0])
    return poly.tolist()


def model_name(order: Sequence[int]) -> str:
    p, d, q, sp, sd, sq, s = order
    return f"SARIMA({p},{d},{q})x({sp},{sd},{sq},{s})" if s else f"ARIMA({p},{d},{q})"


def shocks(diffed: DataFrame, *, keys: Sequence[str], n_lags: int) -> DataFrame:
    """Add ``_e``, the residuals of a long autoregression of ``_w``."""
    window = series_window(keys, ["_t"])
    names = [f"_long{k}" for k in range(1, n_lags + 1)]
    rows = diffed.withColumns({c: F.lag("_w", k).over(window) for k, c in enumerate(names, 1)})
    fitted = least_squares(rows, names, "_w", keys=keys).select(*keys, "intercept", "coef")
    guess = sum((F.get("coef", F.lit(i)) * F.col(c) for i, c in enumerate(names)), F.col("intercept"))
    return join_on_keys(rows, fitted, keys).withColumn("_e", F.col("_w") - guess).drop(*names, "intercept", "coef")


def fit_arima(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), orders: Iterable[Sequence[int]] = ((1, 1, 1),),
    constant: bool | None = None, long_lags: int | None = None,
) -> DataFrame:
    """One row per series and order: ``n``, ``coef``, ``sse``, ``aic`` and what a forecast needs.

    An order is (p, d, q) or (p, d, q, P, D, Q, s). Without ``constant`` only a plain model
    without differencing has one. ``coef`` holds constant, AR and MA terms in lag order. An
    order that a series is too short for has no row. A calendar-grain frame.
    """
    full_orders = [(*o, *NO_SEASON) if len(o) == 3 else tuple(o) for o in orders]
    groups: dict[tuple, list[tuple]] = {}
    for o in full_orders:
        groups.setdefault((o[1], o[4], o[6]), []).append(o)
    known = df.where(F.col(y).isNotNull()).select(*keys, ts, F.col(y).cast("double").alias("_y"))
    base = with_position(known, ts=ts, keys=keys, grain="bin", position="_t", size="_n")
    parts = [fit_group(base, group, ts=ts, keys=keys, constant=constant, long_lags=long_lags) for group in groups.values()]
    return reduce(DataFrame.unionByName, parts)


def fit_group(base: DataFrame, group: list[tuple], *, ts: str, keys: Sequence[str], constant: bool | None, long_lags: int | None) -> DataFrame:
    """All orders of one differencing, from one aggregate."""
    _, d, _, _, sd, _, s = group[0]
    has_constant = (d + sd == 0 and s == 0) if constant is None else constant
    ar = sorted(set().union(*[lag_set(o[0], o[3], s) for o in group]))
    ma = sorted(set().union(*[lag_set(o[2], o[5], s) for o in group]))
    weights = difference_weights(d, sd, s)
    window = series_window(keys, ["_t"])
    pieces = [F.col("_y") if i == 0 else F.lag("_y", i).over(window) * w for i, w in enumerate(weights) if w]
    rows = base.withColumn("_w", sum(pieces[1:], pieces[0]))
    if ma:
        n_long = long_lags or max(ar + ma) + 5
        rows = shocks(rows, keys=keys, n_lags=n_long)
    lags = {f"_ar{k}": F.lag("_w", k).over(window) for k in ar} | {f"_ma{k}": F.lag("_e", k).over(window) for k in ma}
    design = rows.withColumns(lags)
    names = list(lags)
    size = len(names) + 2

    # The tail of each series: enough values for the widest order to start its forecast.
    reach_y, reach_e = max(ar, default=0) + len(weights) - 1, max(ma, default=0)
    item = F.struct("_t", "_y", F.col("_e") if ma else F.lit(None).cast("double").alias("_e"))
    tail = rows.where(F.col("_t") >= F.col("_n") - max(reach_y, reach_e, 1)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_tail"), F.max(ts).alias("last_ts"))
    tail = tail.select(*keys, F.col("_tail._y").alias("last_values"), F.col("_tail._e").alias("last_shocks"), "last_ts")

    picks = []
    for o in group:
        wanted = [f"_ar{k}" for k in lag_set(o[0], o[3], s)] + [f"_ma{k}" for k in lag_set(o[2], o[5], s)]
        picks.append((o, ([0] if has_constant else []) + [1 + names.index(c) for c in wanted]))
    fields = ",".join(f"{c}:int" for c in ORDER)

    @F.pandas_udf(f"array<struct<{fields},coef:array<double>,sse:double,aic:double>>")
    def candidates(n: pd.Series, m: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for count, means, packed in zip(n, m, g):
            full, found = square(packed, size), []
            full = full if has_constant else from_zero(full, means)
            for order, columns in picks:
                if count <= len(columns) + 1:
                    continue
                beta, sse, _ = solve(full, columns) if columns else (np.zeros(0), full[-1, -1], None)
                if not np.isfinite(sse) or sse <= 0:
                    continue
                beta = constant_of(beta, means, columns) if has_constant else beta
                aic = count * (np.log(2 * np.pi * sse / count) + 1) + 2 * (len(columns) + 1)
                found.append(dict(zip(ORDER, order)) | {"coef": list(beta), "sse": sse, "aic": aic})
            out.append(found)
        return pd.Series(out)

    fitted = gram(design, names, "_w", keys=keys).select(*keys, "n", F.explode(candidates("n", "m", "g")).alias("_c"))
    fitted = fitted.select(*keys, *[f"_c.{c}" for c in ORDER], "n", "_c.coef", "_c.sse", "_c.aic", F.lit(has_constant).alias("has_constant"))
    return join_on_keys(fitted, tail, keys)


def best_order(fitted: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """The row of lowest AIC per series; equal values by order."""
    rest = [c for c in fitted.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("aic", *ORDER))
    return fitted.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def search_arima(
    df: DataFrame, *, ts: str, y: str, orders: Iterable[Sequence[int]] = ARIMA_GRID, keys: Sequence[str] = (), refine: bool = True, **options,
) -> DataFrame:
    """The order of lowest AIC per series; plain models by default, ``SARIMA_GRID`` for seasonal ones.

    With ``refine`` the chosen model goes through the third stage.
    """
    orders = list(orders)
    best = best_order(fit_arima(df, ts=ts, y=y, orders=orders, keys=keys, **options), keys=keys)
    shocked = any(o[2] or (len(o) > 3 and o[5]) for o in orders)
    return refine_arima(best, df, ts=ts, y=y, keys=keys) if refine and shocked else best


def inverse_filter(columns: np.ndarray, theta: Sequence[float], lags: Sequence[int]) -> np.ndarray:
    """``x[t] = columns[t] - sum(theta * x[t - lag])``, from zeros on; a series per column."""
    out = columns.copy()
    for t in range(min(lags, default=len(out)), len(out)):
        for weight, k in zip(theta, lags):
            if t >= k:
                out[t] -= weight * out[t - k]
    return out


def lagged(values: np.ndarray, k: int) -> np.ndarray:
    return np.r_[np.zeros(min(k, len(values))), values[: max(0, len(values) - k)]]


def third_stage(w: np.ndarray, beta: np.ndarray, ar: list[int], ma: list[int], constant: bool, rounds: int = 20, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant, AR, MA) of least conditional squares, and the shocks they leave."""
    begin, inputs = max(ar, default=0), [np.ones(len(w))] * constant + [lagged(w, k) for k in ar]
    design = np.stack(inputs, axis=1) if inputs else np.zeros((len(w), 0))

    def shocks_of(beta: np.ndarray) -> np.ndarray:
        rest = w - design @ beta[: design.shape[1]]
        rest[:begin] = 0
        return inverse_filter(rest[:, None], beta[design.shape[1] :], ma)[:, 0]

    def stable(beta: np.ndarray) -> bool:
        poly = np.zeros(max(ma) + 1)
        poly[0] = 1.0
        poly[ma] = beta[design.shape[1] :]
        return bool(np.all(np.abs(np.roots(poly)) < 1)) if poly[1:].any() else True

    if not stable(beta):
        beta = np.r_[beta[: design.shape[1]], 0.5 * beta[design.shape[1] :] / max(1.0, np.abs(beta[design.shape[1] :]).sum())]
    found = shocks_of(beta)
    for _ in range(rounds):
        slopes = inverse_filter(np.column_stack([design, *[lagged(found, k) for k in ma]])[begin:], beta[design.shape[1] :], ma)
        step = np.linalg.lstsq(slopes, found[begin:], rcond=None)[0]
        for _ in range(10):  # shorter steps until the squares fall
            tried = beta + step
            after = shocks_of(tried) if stable(tried) else None
            if after is not None and after @ after <= found @ found:
                break
            step = step / 2
        else:
            break
        beta, found, moved = tried, after, np.abs(step).max(initial=0)
        if moved < tolerance * (1 + np.abs(beta).max(initial=0)):
            break
    return beta, found


def refine_arima(fitted: DataFrame, df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """``fitted`` after the third stage: better ``coef`` and ``last_shocks`` where a model has shocks.

    ``sse`` and ``aic`` stay those by which the order was chosen. A calendar-grain frame; a
    series is read from start to end once per fitted order.
    """
    known = df.where(F.col(y).isNotNull()).select(*keys, F.col(ts).alias("_ts"), F.col(y).cast("double").alias("_y"))
    fitted = keep_facts(fitted)  # a row per series and order, read twice
    shocked = fitted.where("q + sq > 0").select(*keys, *ORDER, "has_constant", "coef")
    if keys:
        rows = join_on_keys(known, shocked, keys)
    else:  # one series: a row per fitted order
        models = shocked.select(F.collect_list(F.struct(*shocked.columns))).scalar()
        rows = known.select("_ts", "_y", F.explode(models).alias("_m")).select("_ts", "_y", "_m.*")

    def fit(values: np.ndarray, last: pa.RecordBatch) -> tuple | None:
        p, d, q, sp, sd, sq, s = (last.column(c)[0].as_py() for c in ORDER)
        ar, ma, weights = lag_set(p, sp, s), lag_set(q, sq, s), difference_weights(d, sd, s)
        w = np.convolve(values, weights)[len(weights) - 1 : len(values)]
        coef = np.array(last.column("coef")[0].as_py(), dtype=float)
        if not (np.isfinite(w).all() and np.isfinite(coef).all()):
            return None  # the second stage stands
        beta, found = third_stage(w, coef, ar, ma, last.column("has_constant")[0].as_py())
        return beta.tolist(), found[-max(ma) :].tolist()

    group = [*keys, *ORDER]
    better = map_series(rows, fit, ts="_ts", y="_y", keys=group, types="_coef array<double>, _shocks array<double>").drop("last_ts")
    joined = join_on_keys(fitted, better, group, "left")
    return joined.withColumns({"coef": F.coalesce("_coef", "coef"), "last_shocks": F.coalesce("_shocks", "last_shocks")}).drop("_coef", "_shocks")


def forecast_arima(fitted: DataFrame, *, keys: Sequence[str] = (), steps: int = 30, freq: str = "D") -> DataFrame:
    """Forecasts of the fitted rows; the model name states the order."""

    @F.pandas_udf("struct<lag_coef:array<double>,offset:array<double>,model:string>")
    def unroll(orders: pd.DataFrame, coef: pd.Series, shock: pd.Series, const: pd.Series) -> pd.DataFrame:
        out = []
        for order, beta, last_e, with_const in zip(orders[list(ORDER)].itertuples(index=False), coef, shock, const):
            p, d, q, sp, sd, sq, s = order
            ar, ma = lag_set(p, sp, s), lag_set(q, sq, s)
            beta = list(beta)
            level = beta.pop(0) if with_const else 0.0
            poly = np.zeros(max(ar, default=0) + 1)
            poly[0] = 1.0
            poly[ar] = -np.array(beta[:len(ar)])
            whole = np.convolve(poly, difference_weights(d, sd, s))
            theta = dict(zip(ma, beta[len(ar):]))
            recent = list(last_e)[::-1]  # recent[0] is the shock of the last row
            offset = [level + sum(w * recent[j - k] for j, w in theta.items() if 0 <= j - k < len(recent) and recent[j - k] is not None
                                  and not np.isnan(recent[j - k])) for k in range(1, steps + 1)]
            out.append((list(-whole[1:]), offset, model_name(order)))
        return pd.DataFrame(out, columns=["lag_coef", "offset", "model"])

    terms = unroll(F.struct(*ORDER), "coef", "last_shocks", "has_constant")
    ready = fitted.withColumn("_u", terms).select(
        *keys, "last_values", "_u.*", dates_after(F.to_date("last_ts") if freq != "H" else F.col("last_ts"), steps, freq).alias("_dates"))
    return recursive_linear(ready, keys=keys, steps=steps, model=F.col("model"))
