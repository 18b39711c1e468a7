"""Scoring queries: naive and seasonal-naive forecasts of daily order value, scored and blended.

The backtest holds out the last fifth of each series. ``naive`` repeats the last training
value; ``week`` takes the value of the same position seven rows before the test start.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalogue.base import DAILY_BY, PRIORITY, daily_by_priority, query, rounded
from seriesloom.operators import metrics as score
from seriesloom.operators.lags import last_values
from seriesloom.operators.profile import union_all
from seriesloom.operators.split import chrono_split
from seriesloom.operators.timeaxis import dates_after

STEPS = 30
BACKTEST = f"""{DAILY_BY}, n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM daily),
s AS (SELECT *, CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM n),
test AS (SELECT o_orderpriority, ts, y AS actual, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) AS INTEGER) AS step FROM s WHERE split = 'test'),
tail AS (SELECT o_orderpriority, list(y ORDER BY ts) AS v, max(ts) AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts DESC) AS b FROM s WHERE split = 'train') WHERE b <= 7 GROUP BY 1),
fc AS (SELECT o_orderpriority, 'naive' AS model, CAST(i AS INTEGER) AS step, last_ts + CAST(i AS INTEGER) AS date, v[7] AS forecast FROM tail, generate_series(1, {STEPS}) AS g(i)
  UNION ALL SELECT o_orderpriority, 'week', CAST(i AS INTEGER), last_ts + CAST(i AS INTEGER), v[(i - 1) % 7 + 1] FROM tail, generate_series(1, {STEPS}) AS g(i)
  UNION ALL SELECT o_orderpriority, 'mean', CAST(i AS INTEGER), last_ts + CAST(i AS INTEGER), list_sum(v) / 7 FROM tail, generate_series(1, {STEPS - 10}) AS g(i)),
pairs AS (SELECT fc.*, actual FROM fc JOIN test USING (o_orderpriority, step))"""


def backtest(spark, d):
    """The split series, the numbered test rows and the forecasts of three simple models."""
    split = chrono_split(daily_by_priority(spark, d), ts="ts", keys=PRIORITY, grain="bin")
    test = score.number_steps(split.where("split = 'test'").select(*PRIORITY, "ts", F.col("y").alias("actual")), ts="ts", keys=PRIORITY)
    tail = last_values(split.where("split = 'train'"), ts="ts", y="y", keys=PRIORITY, grain="bin", n=7)
    days = tail.select("*", F.posexplode(dates_after(F.col("last_ts"), STEPS)).alias("_i", "date")).withColumn("step", F.col("_i") + 1)
    total = F.aggregate("last_values", F.lit(0.0), lambda a, v: a + v)
    models = {"naive": F.element_at("last_values", 7), "week": F.get("last_values", F.col("_i") % 7), "mean": total / 7}
    made = union_all([days.select(*PRIORITY, F.lit(m).alias("model"), "step", "date", v.alias("forecast")) for m, v in models.items()])
    return split, test, made.where(f"model <> 'mean' or step <= {STEPS - 10}")


METRICS = """round(avg(abs(actual - forecast)), 2) AS mae, round(avg((actual - forecast) ** 2), 0) AS mse, round(sqrt(avg((actual - forecast) ** 2)), 2) AS rmse"""


def tidy(df, *more):
    return rounded(rounded(rounded(df, "mae", "rmse", digits=2), "mse", digits=0), *more, digits=6)


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, model, {METRICS},
round(1 - sum((actual - forecast) ** 2) / (var_pop(actual) * count(actual)), 6) AS r2,
CASE WHEN count(*) FILTER (WHERE actual = 0) = 0 THEN round(avg(abs((actual - forecast) / actual)) * 100, 6) END AS mape FROM pairs GROUP BY 1, 2""")
def metrics(spark, d):
    _, test, made = backtest(spark, d)
    return tidy(score.evaluate_models(test, made, keys=PRIORITY, steps=STEPS), "r2", "mape")


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, model, {METRICS},
round(avg(abs((actual - forecast) / nullif(actual, 0))) * 100, 6) AS mape,
round(avg(2 * abs(actual - forecast) / nullif(abs(actual) + abs(forecast), 0)) * 100, 6) AS smape FROM pairs GROUP BY 1, 2""")
def metrics_guarded(spark, d):
    _, test, made = backtest(spark, d)
    return tidy(score.evaluate_models(test, made, keys=PRIORITY, guarded=True), "mape", "smape")


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, model, {METRICS} FROM fc JOIN (SELECT o_orderpriority, ts AS date, actual FROM test) USING (o_orderpriority, date) GROUP BY 1, 2""")
def metrics_by_date(spark, d):
    """Actual and forecast paired by day instead of by step."""
    _, test, made = backtest(spark, d)
    pairs = score.align_by_step(test.select(*PRIORITY, F.col("ts").alias("date"), "actual"), made, keys=PRIORITY, on="date")
    return tidy(score.score(pairs, by=[*PRIORITY, "model"]).drop("r2", "mape"))


SCORES = f"""{BACKTEST}, scores AS (SELECT o_orderpriority, model, avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) ** 2)) AS rmse,
avg(abs((actual - forecast) / actual)) * 100 AS mape FROM pairs GROUP BY 1, 2)"""


@query(f"""WITH {SCORES} {" UNION ALL ".join(f"SELECT o_orderpriority, '{m}' AS metric, arg_min(model, {m}) AS model, round(min({m}), 2) AS value FROM scores GROUP BY 1" for m in ("rmse", "mae", "mape"))}""")
def best_model(spark, d):
    _, test, made = backtest(spark, d)
    return rounded(score.best_models(score.evaluate_models(test, made, keys=PRIORITY), keys=PRIORITY), "value", digits=2)


@query(f"""WITH {SCORES} SELECT o_orderpriority, model, {", ".join(f"CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY {m}) AS INTEGER) AS rank_{m}" for m in ("rmse", "mae", "mape"))} FROM scores""")
def model_ranking(spark, d):
    _, test, made = backtest(spark, d)
    ranked = score.rank_models(score.evaluate_models(test, made, keys=PRIORITY), keys=PRIORITY)
    return ranked.select(*PRIORITY, "model", "rank_rmse", "rank_mae", "rank_mape")


@query(f"""WITH {BACKTEST}, w AS (SELECT * FROM (VALUES ('naive', 1.0), ('week', 2.0), ('mean', 1.0)) AS v(model, w))
SELECT o_orderpriority, 'ensemble' AS model, step, min(date) AS date, round(sum(forecast * w) / sum(w), 4) AS forecast FROM fc JOIN w USING (model) GROUP BY 1, 3 HAVING count(*) = 3""")
def ensemble(spark, d):
    _, _, made = backtest(spark, d)
    return rounded(score.blend(made, keys=PRIORITY, models=["naive", "week", "mean"], weights=[1, 2, 1]), "forecast")


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, 'ensemble' AS model, step, min(date) AS date, round(avg(forecast), 4) AS forecast FROM fc WHERE model <> 'mean' GROUP BY 1, 3""")
def ensemble_equal(spark, d):
    _, _, made = backtest(spark, d)
    return rounded(score.blend(made, keys=PRIORITY, models=["naive", "week"]), "forecast")


@query(f"""WITH {BACKTEST}, h AS (SELECT o_orderpriority, ts AS date, y AS actual, CASE WHEN split = 'train' THEN y END AS train, CASE WHEN split = 'test' THEN y END AS test, CAST(NULL AS DOUBLE) AS forecast FROM s),
f AS (SELECT o_orderpriority, date, forecast FROM fc WHERE model = 'week')
SELECT o_orderpriority, date, h.actual, f.forecast, h.train, h.test, f.forecast * 0.5 AS lower_bound, f.forecast * 1.5 AS upper_bound
FROM (SELECT o_orderpriority, date, actual, train, test FROM h) h FULL JOIN f USING (o_orderpriority, date)""")
def forecast_frame(spark, d):
    split, _, made = backtest(spark, d)
    week = made.where("model = 'week'").withColumns({"lower_bound": F.col("forecast") * 0.5, "upper_bound": F.col("forecast") * 1.5})
    return score.forecast_frame(split, week, ts="ts", y="y", keys=PRIORITY)


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, model, step, date, round(forecast, 4) AS forecast FROM fc WHERE step <= 5""")
def horizon_prefix(spark, d):
    _, _, made = backtest(spark, d)
    return rounded(made.where("step <= 5"), "forecast")


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, ts, y FROM s WHERE split = 'train' UNION ALL SELECT o_orderpriority, ts, actual FROM test""")
def append_parts(spark, d):
    split, test, _ = backtest(spark, d)
    return split.where("split = 'train'").select(*PRIORITY, "ts", "y").unionByName(test.select(*PRIORITY, "ts", F.col("actual").alias("y")))
