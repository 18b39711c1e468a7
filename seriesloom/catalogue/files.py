"""Source and sink queries: tables are written beside the checkpoints and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from seriesloom.catalogue.base import DAILY_BY, PRIORITY, daily_by_priority, orders, query, r, rounded, scratch
from seriesloom.catalogue.scoring import BACKTEST, METRICS, SCORES, STEPS, backtest, tidy
from seriesloom.operators import metrics as score
from seriesloom.operators.frames import resolve_forecast
from seriesloom.operators.split import chrono_split
from seriesloom.operators.validate import has_columns, validate
from seriesloom.sources import config, sinks, tables

ORDER_CSV = "o_orderkey bigint, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double"


@query("SELECT o_orderkey, o_orderdate, o_orderpriority, o_totalprice FROM orders")
def csv_round_trip(spark, d):
    t = tables.read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    return tables.read_csv(spark, sinks.write_table(t, scratch(spark), fmt="csv"), schema=ORDER_CSV)


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def csv_inferred(spark, d):
    """A CSV whose types Spark infers."""
    t = tables.read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    back = tables.read_csv(spark, sinks.write_table(t, scratch(spark), fmt="csv"))
    return back.groupBy(F.col("user_id").cast("long").alias("user_id"), "event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query("SELECT CAST(o_orderdate AS DATE) AS ts, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def csv_indexed(spark, d):
    """A CSV whose first column is the time."""
    t = orders(spark, d).groupBy("ts").agg(r(F.sum("y"), 2).alias("y"))
    back = tables.read_indexed_csv(spark, sinks.write_table(t, scratch(spark), fmt="csv"), schema="ts string, y double")
    return back.withColumn("ts", F.to_date("ts"))


@query("SELECT event_id, date_trunc('second', ts) AS seen_time, event_type FROM events")
def csv_other_time(spark, d):
    """The named time column does not parse; another column named like one does."""
    t = tables.read_table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy/MM/dd").alias("bad"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_time"), "event_type")
    back = tables.read_with_time(spark, sinks.write_table(t.drop("bad"), scratch(spark), fmt="csv"), ts="event_type")
    return back.select(F.col("event_id").cast("long").alias("event_id"), F.col("seen_time").cast("timestamp_ntz").alias("seen_time"), "event_type")


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, ts, y, split FROM s""")
def split_sink(spark, d):
    t = chrono_split(daily_by_priority(spark, d), ts="ts", keys=PRIORITY, grain="bin")
    back = spark.read.parquet(sinks.write_splits(t, scratch(spark)))
    return back.select(*PRIORITY, "ts", "y", "split")


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, model, step, date, round(forecast, 4) AS forecast FROM fc""")
def forecast_sink(spark, d):
    _, _, made = backtest(spark, d)
    back = spark.read.option("header", True).schema("o_orderpriority string, step int, date date, forecast double, model string").csv(
        sinks.write_forecasts(made, scratch(spark), fmt="csv"))
    return rounded(back.select(*PRIORITY, "model", "step", "date", "forecast"), "forecast")


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, model, {METRICS} FROM pairs GROUP BY 1, 2""")
def metrics_json_sink(spark, d):
    _, test, made = backtest(spark, d)
    scores = score.evaluate_models(test, made, keys=PRIORITY, steps=STEPS)
    back = spark.read.schema("o_orderpriority string, model string, mae double, mse double, rmse double").json(sinks.write_metrics_json(scores, scratch(spark)))
    return tidy(back)


@query(f"""WITH {BACKTEST} SELECT o_orderpriority, model, {METRICS} FROM pairs GROUP BY 1, 2""")
def metrics_table_sink(spark, d):
    """The score table as Parquet."""
    _, test, made = backtest(spark, d)
    back = spark.read.parquet(sinks.write_metrics(score.evaluate_models(test, made, keys=PRIORITY, steps=STEPS), scratch(spark)))
    return tidy(back.select("o_orderpriority", "model", "mae", "mse", "rmse"))


@query("""SELECT 'ORDERS' AS dataset_name, 'custom' AS dataset_type, min(o_orderpriority) AS date_col, max(o_orderstatus) AS target_col FROM orders""")
def settings_precedence(spark, d):
    """The run's settings go before the column file, which fills what they leave blank."""
    names = tables.read_table(spark, d, "orders").agg(
        F.min("o_orderpriority").alias("a"), F.max("o_orderpriority").alias("b"), F.max("o_orderstatus").alias("c")).first()
    folder = f"{scratch(spark)}/orders_run"
    config.write_config(spark, {"date_col": names["a"], "target_col": ""}, f"{folder}/config.json")
    config.write_config(spark, {"date_col": names["b"], "target_col": names["c"]}, f"{folder}/column_info.json")
    return config.dataset_info(spark, folder)


@query("""SELECT 'orders' AS name, (SELECT count(*) FROM (DESCRIBE orders) WHERE column_name IN ('o_orderdate', 'o_totalprice')) = 2 AS complete, count(*) AS "rows" FROM orders
UNION ALL SELECT 'customer', (SELECT count(*) FROM (DESCRIBE customer) WHERE column_name IN ('c_custkey', 'o_totalprice')) = 2, count(*) FROM customer
UNION ALL SELECT 'events', (SELECT count(*) FROM (DESCRIBE events) WHERE column_name IN ('ts', 'value')) = 2, count(*) FROM events""")
def required_columns(spark, d):
    """Whether tables have the columns that a step needs."""
    wanted = {"orders": ("o_orderdate", "o_totalprice"), "customer": ("c_custkey", "o_totalprice"), "events": ("ts", "value")}
    found = [(name, tables.read_table(spark, d, name)) for name in wanted]
    parts = [t.agg(F.lit(name).alias("name"), F.lit(has_columns(t, wanted[name])).alias("complete"), F.count(F.lit(1)).alias("rows")) for name, t in found]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"""WITH {SCORES} SELECT o_orderpriority, model AS "Model", round(rmse, 2) AS "RMSE", round(mae, 2) AS "MAE" FROM scores""")
def metrics_file_repair(spark, d):
    """A score table under other names: lower-case metrics behind a column of model names."""
    _, test, made = backtest(spark, d)
    scores = score.evaluate_models(test, made, keys=PRIORITY).select(
        F.concat(F.lit("arima "), "model").alias("name"), "rmse", "mae", F.ascii("o_orderpriority").alias("first_letter"))
    back = tables.read_metrics(spark, sinks.write_table(scores, scratch(spark), fmt="csv"))
    key = back.select(F.substring_index("Model", " ", -1).alias("Model"), r("RMSE", 2).alias("RMSE"), r("MAE", 2).alias("MAE"), F.char(F.col("FIRST_LETTER")).alias("letter"))
    names = daily_by_priority(spark, d).select(*PRIORITY).distinct()
    return key.join(names, F.substring("o_orderpriority", 1, 1) == F.col("letter")).drop("letter")


@query("""SELECT o_orderpriority, count(*) AS "rows", round(avg(o_totalprice), 4) AS target_mean FROM orders GROUP BY 1""")
def report_sink(spark, d):
    report = validate(orders(spark, d), ts="ts", y="y", keys=PRIORITY)
    back = spark.read.schema("o_orderpriority string, statistics struct<rows:bigint,target_mean:double>").json(sinks.write_report(report, scratch(spark)))
    return rounded(back.select(*PRIORITY, "statistics.*"), "target_mean")


@query("""SELECT 'l_quantity' AS "column", count(l_quantity) AS known, round(quantile_cont(l_quantity, 0.5), 4) AS q50 FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), round(quantile_cont(l_extendedprice, 0.5), 4) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(l_returnflag), NULL FROM lineitem""")
def profile_sink(spark, d):
    t = tables.read_table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    path = scratch(spark)
    sinks.write_profile(t, path)
    return rounded(spark.read.parquet(path).select("column", "known", "q50"), "q50")


@query(f"""WITH {SCORES} SELECT 'best' AS part, 'rmse' AS metric, o_orderpriority, arg_min(model, rmse) AS model, round(min(rmse), 2) AS value FROM scores GROUP BY 3
UNION ALL SELECT 'best', 'mae', o_orderpriority, arg_min(model, mae), round(min(mae), 2) FROM scores GROUP BY 3
UNION ALL SELECT 'all', 'rmse', o_orderpriority, model, round(rmse, 2) FROM scores UNION ALL SELECT 'all', 'mae', o_orderpriority, model, round(mae, 2) FROM scores""")
def summary_sink(spark, d):
    _, test, made = backtest(spark, d)
    path = scratch(spark)
    sinks.write_summary(score.evaluate_models(test, made, keys=PRIORITY), path, keys=PRIORITY)
    back = spark.read.schema("part string, metric string, o_orderpriority string, model string, value double").json(path)
    return rounded(back.where("metric in ('rmse', 'mae')"), "value", digits=2)


@query(f"""WITH {DAILY_BY} SELECT o_orderpriority AS series, count(*) AS n FROM daily GROUP BY 1""")
def newest_result(spark, d):
    """The files of a written table are found by pattern and read back."""
    root = scratch(spark)
    sinks.write_table(daily_by_priority(spark, d), f"{root}/daily_run", fmt="csv", partition_by=PRIORITY)
    newest = tables.find_results(spark, root).first()["result"]  # one row per result folder
    files = tables.find_files(spark, f"{root}/{newest}", ["*.none", "*.csv"])
    part = lambda c: F.regexp_extract(F.url_decode(c), "o_orderpriority=([^/]+)/", 1)
    back = spark.read.schema("ts date, y double, o_orderpriority string").option("header", True).csv(f"{root}/{newest}")
    found = back.withColumn("_p", part(F.input_file_name())).join(files.select(part("path").alias("_p")).distinct(), "_p", "left_semi")
    return resolve_forecast(found).groupBy(F.col("o_orderpriority").alias("series")).agg(F.count(F.lit(1)).alias("n"))
