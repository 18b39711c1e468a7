"""Series statistics and forecasting models."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalogue.base import (
    DAILY_BY, MONTHLY_BY, PRIORITY, SHIP, daily_by_priority, query, r, rounded, scratch, segment_monthly, ship_daily)
from seriesloom.models import arima, leastsq, smoothing, trees
from seriesloom.models.registry import MODELS
from seriesloom.models.stationarity import adf
from seriesloom.models.trendseason import trend_season
from seriesloom.operators import correlate, split

SEGMENT = ("c_mktsegment",)
DAYS = {"ts": "ts", "y": "y", "keys": PRIORITY}
MONTHS = {"ts": "ts", "y": "y", "keys": SEGMENT}
ACF_LAGS = 40


AUTOCORRELATION = f"""c AS (SELECT ts, y - avg(y) OVER () AS c, row_number() OVER (ORDER BY ts) AS t, count(*) OVER () AS n FROM daily),
p AS (SELECT CAST(k AS INTEGER) AS lag, any_value(a.n) AS n, sum(a.c * b.c) AS s FROM c a, range({ACF_LAGS + 1}) AS g(k), c b WHERE b.t = a.t - k GROUP BY 1),
f AS (SELECT lag, n, s / first_value(s) OVER (ORDER BY lag) AS acf FROM p)
SELECT lag, round(acf, 6) AS acf, round(1.959963984540054 / sqrt(n), 6) AS band,
CASE WHEN lag = 0 THEN 0.0::DOUBLE ELSE round(1.959963984540054 * sqrt((1 + 2 * coalesce(sum(acf * acf) FILTER (WHERE lag > 0) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n), 6) END AS bartlett FROM f"""


@query(f"WITH {SHIP}, {AUTOCORRELATION}")
def acf(spark, d):
    return rounded(correlate.acf(ship_daily(spark, d), ts="ts", y="y", grain="bin", n_lags=ACF_LAGS), "acf", "band", "bartlett", digits=6)


@query(f"WITH {SHIP.replace('daily AS', 'every_day AS')}, daily AS (SELECT * FROM every_day WHERE day(ts) <> 1), {AUTOCORRELATION}")
def acf_with_gaps(spark, d):
    """Unknown values on the first of each month; the known ones are paired by their order."""
    t = ship_daily(spark, d).withColumn("y", F.when(F.dayofmonth("ts") != 1, F.col("y")))
    return rounded(correlate.acf(t, ts="ts", y="y", grain="bin", n_lags=ACF_LAGS), "acf", "band", "bartlett", digits=6)


@query(f"""WITH RECURSIVE {SHIP}, c AS (SELECT ts, y - avg(y) OVER () AS c, row_number() OVER (ORDER BY ts) AS t, count(*) OVER () AS n FROM daily),
p AS (SELECT k AS lag, any_value(a.n) AS n, sum(a.c * b.c) AS s FROM c a, range({ACF_LAGS + 1}) AS g(k), c b WHERE b.t = a.t - k GROUP BY 1),
l AS (SELECT any_value(n) AS n, list(s / s0 ORDER BY lag) AS r FROM p, (SELECT s AS s0 FROM p WHERE lag = 0)),
z AS (SELECT 1 AS k, n, r, [r[2]] AS phi FROM l
  UNION ALL SELECT k + 1, n, r, list_append([phi[j] - q * phi[k + 1 - j] FOR j IN range(1, k + 1)], q) FROM
    (SELECT k, n, r, phi, (r[k + 2] - list_sum([phi[j] * r[k + 2 - j] FOR j IN range(1, k + 1)])) / (1 - list_sum([phi[j] * r[j + 1] FOR j IN range(1, k + 1)])) AS q FROM z WHERE k < {ACF_LAGS}))
SELECT CAST(k AS INTEGER) AS lag, round(phi[k], 6) AS pacf, round(1.959963984540054 / sqrt(n), 6) AS band FROM z""")
def pacf(spark, d):
    return rounded(correlate.pacf(ship_daily(spark, d), ts="ts", y="y", grain="bin", n_lags=ACF_LAGS), "pacf", "band", digits=6)


@query(f"""WITH {DAILY_BY}, x AS (SELECT o_orderpriority, y - lag(y) OVER w AS dy, lag(y) OVER w AS b FROM daily WINDOW w AS (PARTITION BY o_orderpriority ORDER BY ts)),
f AS (SELECT o_orderpriority, regr_slope(dy, b) AS beta, regr_sxx(dy, b) AS sxx, regr_syy(dy, b) AS syy, count(dy) AS n FROM x WHERE b IS NOT NULL GROUP BY 1)
SELECT o_orderpriority, round(beta / sqrt((syy - beta * beta * sxx) / (n - 2) / sxx), 5) AS statistic, CAST(0 AS INTEGER) AS lags, n AS n_obs FROM f""")
def adf_lag_zero(spark, d):
    """The unit-root regression without lagged differences."""
    out = adf(daily_by_priority(spark, d), max_lag=0, **DAYS)
    return rounded(out.select(*PRIORITY, "statistic", "lags", "n_obs"), "statistic", digits=5)


@query(name="adf")
def adf_query(spark, d):
    return rounded(adf(daily_by_priority(spark, d), **DAYS), "statistic", "p_value", "crit_1", "crit_5", "crit_10", digits=6)


@query(f"""WITH {DAILY_BY}, x AS (SELECT o_orderpriority, y, lag(y) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS b FROM daily)
SELECT o_orderpriority, regr_count(y, b) AS n, round(regr_intercept(y, b), 3) AS intercept, round(regr_slope(y, b), 8) AS slope, round(regr_r2(y, b), 8) AS r2 FROM x GROUP BY 1""")
def ols_lag1(spark, d):
    rows = leastsq.model_features(daily_by_priority(spark, d), n_lags=1, calendar=False, **DAYS)
    out = leastsq.least_squares(rows, ["lag_1"], "y", keys=PRIORITY)
    return rounded(rounded(out.select(*PRIORITY, "n", "intercept", F.col("coef")[0].alias("slope"), "r2"), "slope", "r2", digits=8), "intercept", digits=3)


@query()
def ols_lags(spark, d):
    """Twelve lags and the calendar inputs."""
    fitted = leastsq.fit_lag_regression(daily_by_priority(spark, d), **DAYS)
    return fitted.select(*PRIORITY, "n", r("intercept").alias("intercept"), F.posexplode("coef").alias("place", "coef")).withColumn("coef", r("coef", 6))


RECURSION = f"""WITH RECURSIVE {DAILY_BY}, x AS (SELECT o_orderpriority, ts, y, lag(y) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS b FROM daily),
f AS (SELECT o_orderpriority, regr_intercept(y, b) AS a, regr_slope(y, b) AS s, max(ts) AS last_ts, arg_max(y, ts) AS v FROM x GROUP BY 1),
z AS (SELECT o_orderpriority, a, s, last_ts, 1 AS step, a + s * v AS forecast FROM f
  UNION ALL SELECT o_orderpriority, a, s, last_ts, step + 1, a + s * forecast FROM z WHERE step < 30)
SELECT o_orderpriority, 'LR' AS model, CAST(step AS INTEGER) AS step, last_ts + CAST(step AS INTEGER) AS date, round(forecast, 3) AS forecast FROM z"""


@query(RECURSION)
def recursive_linear(spark, d):
    fitted = leastsq.fit_lag_regression(daily_by_priority(spark, d), n_lags=1, calendar=False, **DAYS)
    return rounded(leastsq.forecast_lag_regression(fitted, keys=PRIORITY, n_lags=1, calendar=False), "forecast", digits=3)


@query()
def lag_regression_forecast(spark, d):
    fitted = leastsq.fit_lag_regression(daily_by_priority(spark, d), **DAYS)
    return rounded(leastsq.forecast_lag_regression(fitted, keys=PRIORITY), "forecast", digits=3)


SMOOTHED = f"""{MONTHLY_BY}, n AS (SELECT c_mktsegment, y, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ts) AS t, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM monthly)"""


@query(f"""WITH RECURSIVE {SMOOTHED},
z AS (SELECT c_mktsegment, n, t, y AS level, 0.0::DOUBLE AS sse FROM n WHERE t = 1
  UNION ALL SELECT z.c_mktsegment, z.n, n.t, 0.3 * n.y + 0.7 * level, sse + (n.y - level) ** 2 FROM z JOIN n ON n.c_mktsegment = z.c_mktsegment AND n.t = z.t + 1)
SELECT c_mktsegment, n, round(level, 3) AS level, round(sqrt(sse / n), 2) AS error FROM z WHERE t = n""")
def ses_fixed(spark, d):
    out = smoothing.fit_smoothing(segment_monthly(spark, d), weights={"alpha": 0.3}, **MONTHS)
    return out.select(*SEGMENT, "n", r("level", 3).alias("level"), r(F.sqrt(F.col("sse") / F.col("n")), 2).alias("error"))


@query(f"""WITH RECURSIVE {SMOOTHED},
z AS (SELECT a.c_mktsegment, a.n, a.t, a.y AS level, b.y - a.y AS slope FROM n a JOIN n b ON a.c_mktsegment = b.c_mktsegment AND a.t = 1 AND b.t = 2
  UNION ALL SELECT z.c_mktsegment, z.n, n.t, 0.3 * n.y + 0.7 * (level + slope), 0.1 * (0.3 * n.y + 0.7 * (level + slope) - level) + 0.9 * slope FROM z JOIN n ON n.c_mktsegment = z.c_mktsegment AND n.t = z.t + 1),
e AS (SELECT c_mktsegment, max(ts) AS last_ts FROM monthly GROUP BY 1)
SELECT z.c_mktsegment, 'ETS_add_None_None' AS model, CAST(i AS INTEGER) AS step, last_day(last_ts + to_months(CAST(i AS INTEGER))) AS date, round(level + i * slope, 2) AS forecast
FROM z JOIN e ON z.c_mktsegment = e.c_mktsegment, generate_series(1, 12) AS g(i) WHERE t = n""")
def holt_fixed(spark, d):
    out = smoothing.fit_smoothing(segment_monthly(spark, d), trend="add", weights={"alpha": 0.3, "beta": 0.1}, **MONTHS)
    return rounded(smoothing.forecast_smoothing(out, keys=SEGMENT, steps=12, freq="M", trend="add"), "forecast", digits=2)


def searched(trend: str, seasonal: str) -> str:
    """The whole weight grid as a recursion over the months; the least squared error forecasts."""
    times = {"add": ("-", "+"), "mul": ("/", "*")}
    off, on = times[seasonal]
    base = "level + slope" if trend == "add" else "level * slope"
    start = "(ahead - level0) / 12" if trend == "add" else "(ahead / level0) ** (1 / 12::DOUBLE)"
    step = "newer - level" if trend == "add" else "newer / level"
    ahead = "level + i * slope" if trend == "add" else "level * slope ** i"
    grid = ", ".join(f"{w}::DOUBLE" for w in smoothing.WEIGHT_GRID)
    return f"""WITH RECURSIVE {MONTHLY_BY},
s AS (SELECT c_mktsegment, list(y ORDER BY ts) AS l, count(*) AS n, max(ts) AS last_ts FROM monthly GROUP BY 1),
i0 AS (SELECT *, list_avg(l[1:12]) AS level0, list_avg(l[13:least(24, n)]) AS ahead FROM s WHERE n >= 24),
w AS (SELECT unnest([{grid}]) AS w),
z AS (SELECT c_mktsegment, a.w AS alpha, b.w AS beta, c.w AS gamma, 12 AS t, level0 AS level, {start} AS slope,
    list_transform(l[1:12], lambda v: v {off} level0) AS seasons, 0.0::DOUBLE AS sse FROM i0, w a, w b, w c
  UNION ALL SELECT c_mktsegment, alpha, beta, gamma, t + 1, newer, beta * ({step}) + (1 - beta) * slope,
    list_transform(range(12), lambda k: CASE WHEN k = t % 12 THEN gamma * (y {off} newer) + (1 - gamma) * season ELSE seasons[k + 1] END), sse + (y - guess) ** 2
  FROM (SELECT z.*, s.l[t + 1] AS y, seasons[t % 12 + 1] AS season, {base} AS base, base {on} season AS guess, alpha * (y {off} season) + (1 - alpha) * base AS newer
    FROM z JOIN s USING (c_mktsegment) WHERE t < n)),
best AS (SELECT z.*, n, last_ts FROM z JOIN s USING (c_mktsegment) WHERE t = n AND isfinite(sse)
  QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sse, alpha, beta, gamma) = 1)
SELECT c_mktsegment, 'ETS_{trend}_{seasonal}_12' AS model, CAST(i AS INTEGER) AS step, last_day(last_ts + to_months(CAST(i AS INTEGER))) AS date,
round(({ahead}) {on} seasons[(n + i - 1) % 12 + 1], 2) AS forecast FROM best, generate_series(1, 12) AS g(i)"""


@query(searched("add", "add"))
def ets_search(spark, d):
    """Weights of an additive trend and season of twelve months, searched on the grid."""
    out = smoothing.fit_smoothing(segment_monthly(spark, d), trend="add", seasonal="add", period=12, **MONTHS)
    return rounded(smoothing.forecast_smoothing(out, keys=SEGMENT, steps=12, freq="M", trend="add", seasonal="add", period=12), "forecast", digits=2)


@query(searched("mul", "mul"))
def ets_multiplicative(spark, d):
    out = smoothing.fit_smoothing(segment_monthly(spark, d), trend="mul", seasonal="mul", period=12, **MONTHS)
    return rounded(smoothing.forecast_smoothing(out, keys=SEGMENT, steps=12, freq="M", trend="mul", seasonal="mul", period=12), "forecast", digits=2)


@query()
def ets_variants(spark, d):
    t = segment_monthly(spark, d)
    return smoothing.choose_variants(t, adf(t, **MONTHS), keys=SEGMENT)


@query(f"""WITH {MONTHLY_BY}, x AS (SELECT c_mktsegment, y - lag(y) OVER w AS dy, lag(y) OVER w AS b FROM monthly WINDOW w AS (PARTITION BY c_mktsegment ORDER BY ts)),
f AS (SELECT c_mktsegment, count(*) AS n_rows, regr_slope(dy, b) AS beta, regr_sxx(dy, b) AS sxx, regr_syy(dy, b) AS syy, regr_count(dy, b) AS n FROM x GROUP BY 1),
v AS (SELECT c_mktsegment, n_rows, beta / sqrt((syy - beta * beta * sxx) / (n - 2) / sxx) < -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3 AS stationary FROM f),
p AS (SELECT *, unnest(CASE WHEN stationary THEN [0] WHEN n_rows > 24 THEN [1, 2] ELSE [1] END) AS k FROM v)
SELECT c_mktsegment, n_rows, stationary, CASE WHEN k > 0 THEN 'add' END AS trend, CASE WHEN k = 2 THEN 'add' END AS seasonal, CAST(CASE WHEN k = 2 THEN 12 END AS INTEGER) AS period FROM p""")
def ets_variants_lag_zero(spark, d):
    """Smoothing variants by the unit-root statistic without lagged differences and its 5 % limit."""
    t = segment_monthly(spark, d)
    verdict = adf(t, max_lag=0, **MONTHS).withColumn("stationary", F.col("statistic") < F.col("crit_5"))
    return smoothing.choose_variants(t, verdict, keys=SEGMENT)


@query(f"""WITH {DAILY_BY}, w AS (SELECT o_orderpriority, ts, y - lag(y) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS w FROM daily),
x AS (SELECT o_orderpriority, w, lag(w) OVER o AS b, lag(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY o_orderpriority ORDER BY ts)),
g AS (SELECT o_orderpriority, count(*) AS n, sum(w * w) AS ww, sum(b * b) AS bb, sum(c * c) AS cc, sum(b * c) AS bc, sum(w * b) AS wb, sum(w * c) AS wc FROM x WHERE c IS NOT NULL GROUP BY 1),
f AS (SELECT o_orderpriority, n, 0 AS p, ww AS sse FROM g UNION ALL SELECT o_orderpriority, n, 1, ww - wb * wb / bb FROM g
  UNION ALL SELECT o_orderpriority, n, 2, ww - ((wb * cc - wc * bc) * wb + (wc * bb - wb * bc) * wc) / (bb * cc - bc * bc) FROM g)
SELECT o_orderpriority, CAST(p AS INTEGER) AS p, CAST(1 AS INTEGER) AS d, CAST(0 AS INTEGER) AS q, n, round(n * (ln(2 * pi() * sse / n) + 1) + 2 * (p + 1), 4) AS aic FROM f
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n * (ln(2 * pi() * sse / n) + 1) + 2 * (p + 1)) = 1""")
def arima_search_ar(spark, d):
    """The best of three orders without shocks, by AIC over one sample."""
    best = arima.search_arima(daily_by_priority(spark, d), orders=[(0, 1, 0), (1, 1, 0), (2, 1, 0)], **DAYS)
    return best.select(*PRIORITY, "p", "d", "q", "n", r("aic", 4).alias("aic"))


SEASONAL_AR = f"""{MONTHLY_BY}, w AS (SELECT c_mktsegment, ts, y, y - lag(y, 12) OVER (PARTITION BY c_mktsegment ORDER BY ts) AS w,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY ts) AS t, count(*) OVER (PARTITION BY c_mktsegment) AS n, max(ts) OVER (PARTITION BY c_mktsegment) AS last_ts FROM monthly),
x AS (SELECT *, lag(w, 12) OVER (PARTITION BY c_mktsegment ORDER BY ts) AS b FROM w),
f AS (SELECT c_mktsegment, count(*) AS n_obs, sum(w * b) / sum(b * b) AS phi, sum(w * w) AS ww, sum(w * w) - sum(w * b) ** 2 / sum(b * b) AS sse FROM x WHERE b IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {SEASONAL_AR} SELECT c_mktsegment, 'SARIMA(0,0,0)x(1,1,0,12)' AS model, CAST(t - n + 12 AS INTEGER) AS step,
last_day(last_ts + to_months(CAST(t - n + 12 AS INTEGER))) AS date, round(y + phi * w, 2) AS forecast FROM x JOIN f USING (c_mktsegment) WHERE t > n - 12""")
def seasonal_ar_forecast(spark, d):
    """One seasonal term on yearly differences, a year ahead."""
    fitted = arima.fit_arima(segment_monthly(spark, d), orders=[(0, 0, 0, 1, 1, 0, 12)], **MONTHS)
    return rounded(arima.forecast_arima(fitted, keys=SEGMENT, steps=12, freq="M"), "forecast", digits=2)


@query(f"""WITH {SEASONAL_AR}, o AS (SELECT c_mktsegment, 0 AS sp, n_obs, ww AS sse FROM f UNION ALL SELECT c_mktsegment, 1, n_obs, sse FROM f),
c AS (SELECT *, n_obs * (ln(2 * pi() * sse / n_obs) + 1) + 2 * (sp + 1) AS aic FROM o)
SELECT c_mktsegment, CAST(sp AS INTEGER) AS sp, n_obs AS n, round(aic, 4) AS aic FROM c QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c.aic) = 1""")
def seasonal_ar_search(spark, d):
    """Yearly differences with and without a seasonal term; the lower AIC stays."""
    best = arima.search_arima(segment_monthly(spark, d), orders=[(0, 0, 0, 0, 1, 0, 12), (0, 0, 0, 1, 1, 0, 12)], **MONTHS)
    return best.select(*SEGMENT, "sp", "n", r("aic", 4).alias("aic"))


@query(f"""WITH {DAILY_BY}, w AS (SELECT o_orderpriority, ts, y - lag(y) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS w FROM daily),
x AS (SELECT o_orderpriority, w, lag(w) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS b FROM w)
SELECT o_orderpriority, count(*) AS n, round(sum(w * b) / sum(b * b), 8) AS phi, round(sqrt((sum(w * w) - sum(w * b) ** 2 / sum(b * b)) / count(*)), 2) AS error FROM x WHERE b IS NOT NULL GROUP BY 1""")
def arima_110(spark, d):
    out = arima.fit_arima(daily_by_priority(spark, d), orders=[(1, 1, 0)], **DAYS)
    return out.select(*PRIORITY, "n", r(F.col("coef")[0], 8).alias("phi"), r(F.sqrt(F.col("sse") / F.col("n")), 2).alias("error"))


@query(f"""WITH RECURSIVE {DAILY_BY}, w AS (SELECT o_orderpriority, ts, y, y - lag(y) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS w FROM daily),
x AS (SELECT *, lag(w) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS b FROM w),
f AS (SELECT o_orderpriority, sum(w * b) FILTER (WHERE b IS NOT NULL) / sum(b * b) FILTER (WHERE b IS NOT NULL) AS phi, arg_max(y, ts) AS y, arg_max(w, ts) AS w, max(ts) AS last_ts FROM x GROUP BY 1),
z AS (SELECT o_orderpriority, phi, last_ts, 1 AS step, phi * w AS w, y + phi * w AS forecast FROM f
  UNION ALL SELECT o_orderpriority, phi, last_ts, step + 1, phi * w, forecast + phi * w FROM z WHERE step < 30)
SELECT o_orderpriority, 'ARIMA(1,1,0)' AS model, CAST(step AS INTEGER) AS step, last_ts + CAST(step AS INTEGER) AS date, round(forecast, 2) AS forecast FROM z""")
def arima_forecast(spark, d):
    out = arima.fit_arima(daily_by_priority(spark, d), orders=[(1, 1, 0)], **DAYS)
    return rounded(arima.forecast_arima(out, keys=PRIORITY), "forecast", digits=2)


@query()
def arima_search(spark, d):
    """Eighteen orders per series; the one of lowest AIC forecasts."""
    best = arima.search_arima(daily_by_priority(spark, d), **DAYS)
    return rounded(arima.forecast_arima(best, keys=PRIORITY), "forecast", digits=2)


@query()
def seasonal_arima(spark, d):
    fitted = arima.fit_arima(segment_monthly(spark, d), orders=[(1, 1, 1, 1, 1, 1, 12)], **MONTHS)
    return rounded(arima.forecast_arima(fitted, keys=SEGMENT, steps=12, freq="M"), "forecast", digits=2)


@query()
def seasonal_arima_search(spark, d):
    best = arima.search_arima(segment_monthly(spark, d), orders=arima.SARIMA_GRID, **MONTHS)
    return best.select(*SEGMENT, *arima.ORDER, r("aic", 3).alias("aic"))


@query()
def trend_season_regression(spark, d):
    """Bent trend with yearly and weekly season."""
    return rounded(trend_season(daily_by_priority(spark, d), **DAYS), "forecast", "forecast_lower", "forecast_upper", digits=2)


@query()
def trend_season_regressors(spark, d):
    """The same with a holiday on each year's first day and a numeric regressor."""
    t = daily_by_priority(spark, d).withColumn("load", F.dayofmonth("ts").cast("double"))
    holidays = t.where(F.dayofyear("ts") == 1).select(F.col("ts").alias("ds")).distinct().withColumn("holiday", F.lit("new_year"))
    return rounded(trend_season(t, holidays=holidays, regressors=["load"], **DAYS), "forecast", "forecast_lower", "forecast_upper", digits=2)


@query()
def forest_forecast(spark, d):
    t = daily_by_priority(spark, d)
    model, scales = trees.fit_trees(t, kind="rf", **DAYS)
    return trees.forecast_trees(model, scales, t, **DAYS)


@query()
def boosted_forecast(spark, d):
    """A boosted model of all series, unrolled 30 days."""
    t = daily_by_priority(spark, d)
    model, scales = trees.fit_trees(t, kind="xgb", **DAYS)
    return trees.forecast_trees(model, scales, t, name="XGB", **DAYS)


@query()
def split_predictions(spark, d):
    """One-step predictions of the test part, its features made from the test part alone."""
    t = split.chrono_split(daily_by_priority(spark, d), ts="ts", keys=PRIORITY, grain="bin")
    model, scales = trees.fit_trees(t.where("split = 'train'").drop("split"), kind="xgb", **DAYS)
    return trees.predict_split(model, scales, t, **DAYS)


@query()
def grid_search(spark, d):
    """The forest grid over five expanding folds."""
    return trees.grid_search(daily_by_priority(spark, d), **DAYS)


@query(RECURSION)
def model_round_trip(spark, d):
    """Forecasts of a model that was saved and loaded again."""
    first = MODELS["lr"](n_lags=1, calendar=False, **DAYS).fit(daily_by_priority(spark, d))
    again = MODELS["lr"](n_lags=1, calendar=False, **DAYS).load(spark, first.save(scratch(spark)))
    return rounded(again.forecast(30), "forecast", digits=3)
