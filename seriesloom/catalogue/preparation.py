"""Preparation queries: raw layouts written as text and brought back to clean frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalogue.base import PRIORITY, SHIP, interpolated, orders, query, r, rounded, scratch, ship_daily
from seriesloom.catalogue.windows import trailing
from seriesloom.plans import forecasting, prepare
from seriesloom.sources.layouts import LAYOUTS
from seriesloom.sources.sinks import write_table
from seriesloom.sources.tables import read_table


@query("""SELECT p_partkey, round(p_retailprice, 2) AS discounted_price, round(p_retailprice * 2, 2) AS actual_price, 50.0::DOUBLE AS discount_percentage,
CASE WHEN p_type <> 'ECONOMY' THEN p_size / 10.0::DOUBLE END AS rating, CAST(p_size * 1000 AS DOUBLE) AS rating_count,
round(p_retailprice * p_size * 1000, 2) AS daily_sales,
DATE '2024-12-31' - CAST(count(*) OVER () - row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS date FROM part""")
def prepare_product_prices(spark, d):
    money = lambda c: F.concat(F.lit("₹"), F.format_number(c, 2))
    raw = read_table(spark, d, "part").select(
        "p_partkey", money(F.col("p_retailprice")).alias("discounted_price"), money(F.col("p_retailprice") * 2).alias("actual_price"),
        F.lit("50%").alias("discount_percentage"), F.when(F.col("p_type") != "ECONOMY", (F.col("p_size") / 10).cast("string")).otherwise("|").alias("rating"),
        F.format_number(F.col("p_size") * 1000, 0).alias("rating_count"))
    return rounded(prepare.prepare_product_prices(raw, order=["p_partkey"], end="2024-12-31"), "discounted_price", "actual_price", "daily_sales", digits=2)


VEHICLES = """SELECT o_orderkey, o_orderdate AS saledate, CASE WHEN year(o_orderdate) <= 1999 THEN CAST(year(o_orderdate) AS DOUBLE) END AS "year", o_totalprice AS sellingprice,
CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey AS DOUBLE) END AS odometer, CAST(o_custkey AS DOUBLE) AS mmr FROM orders WHERE o_orderstatus <> 'P'"""


def raw_vehicles(spark, d):
    t = orders(spark, d)
    shown = F.concat(F.date_format("o_orderdate", "EEE MMM dd yyyy HH:mm:ss"), F.lit(" GMT+0000 (UTC)"))
    return t.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", shown).otherwise("pending").alias("saledate"), F.year("ts").cast("string").alias("year"),
        F.col("o_totalprice").cast("string").alias("sellingprice"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string")).otherwise("none").alias("odometer"),
        F.col("o_custkey").cast("string").alias("mmr"))


@query(VEHICLES)
def prepare_vehicle_sales(spark, d):
    """Times of pending orders and distances of low-priority ones are no values at all."""
    out = prepare.prepare_vehicle_sales(raw_vehicles(spark, d), this_year=1998)
    return out.withColumn("saledate", F.expr("to_utc_timestamp(saledate, current_timezone())").cast("timestamp_ntz"))


@query(f"""WITH v AS ({VEHICLES}) SELECT vin, saledate, "year", sellingprice, odometer, mmr, 'saledate' AS ts_name, 'sellingprice' AS y_name FROM (SELECT CAST(o_orderkey AS VARCHAR) AS vin, * FROM v)""")
def layout_routing(spark, d):
    """A file under a known layout's name is read and prepared by that layout."""
    schema = [c.split()[0] for c in LAYOUTS["vehicle_sales"].schema.split(", ")]
    raw = raw_vehicles(spark, d).withColumn("vin", F.col("o_orderkey").cast("string"))
    raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in schema])
    out, ts, y = prepare.prepare_dataset(spark, "car_prices", write_table(raw, scratch(spark), fmt="csv"), this_year=1998)
    named = out.select("vin", "saledate", "year", "sellingprice", "odometer", "mmr", F.lit(ts).alias("ts_name"), F.lit(y).alias("y_name"))
    return named.withColumn("saledate", F.expr("to_utc_timestamp(saledate, current_timezone())").cast("timestamp_ntz"))


GENERIC = f"""x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ts, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS y FROM orders),
{interpolated("x", (), "ts, o_orderkey")},
b AS (SELECT o_orderkey, ts, coalesce(y, v1) AS y FROM filled),
lim AS (SELECT avg(y) - 3 * stddev_samp(y) AS lo, avg(y) + 3 * stddev_samp(y) AS hi FROM b),
cap AS (SELECT count(*) FILTER (WHERE y > hi OR y < lo) < 0.05::DOUBLE * count(*) AS cap FROM b, lim),
c AS (SELECT o_orderkey, ts, CASE WHEN cap THEN least(greatest(y, lo), hi) ELSE y END AS y FROM b, lim, cap),
last_rows AS (SELECT ts, arg_max(y, o_orderkey) AS y, max(o_orderkey) AS o_orderkey FROM c GROUP BY 1)"""


@query(f"""WITH {GENERIC}, facts AS (SELECT max(ts) - min(ts) + 1 AS days, count(*) AS present FROM last_rows),
spine AS (SELECT CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM last_rows),
gapped AS (SELECT spine.ts, last_rows.y FROM spine LEFT JOIN last_rows USING (ts)),
n2 AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t FROM gapped),
k2 AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
 last_value(y IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
 first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
 first_value(y IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM n2)
SELECT ts, round(CASE WHEN y IS NOT NULL THEN y ELSE v0 + (v1 - v0) * (CAST(t - t0 AS DOUBLE) / (t1 - t0)) END, 6) AS y, 'resampled_D' AS action FROM k2, facts
WHERE days > present AND (days - present) * 100.0 / days < 20
UNION ALL SELECT ts, round(y, 6), 'deduplicated' FROM last_rows, facts WHERE (days - present) * 100.0 / days >= 20
UNION ALL SELECT ts, round(y, 6), 'regular' FROM c, facts WHERE days = present""")
def prepare_generic(spark, d):
    """Orders with the price of pending ones unknown: filled, capped and brought to days."""
    t = orders(spark, d).select("o_orderkey", "ts", F.when(F.col("o_orderstatus") != "P", F.col("y")).alias("y"))
    out = prepare.prepare_generic(t, ts="ts", y="y", tie=["o_orderkey"])
    return rounded(out.select("ts", "y", "action"), "y", digits=6)


@query(f"""WITH {SHIP} SELECT ts, y, CAST(year(ts) AS INTEGER) AS "year", CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, {", ".join(f"lag(y, {k}) OVER (ORDER BY ts) AS y_lag_{k}" for k in range(1, 8))},
{", ".join(trailing("avg", k, f"y_rolling_mean_{k}") for k in (7, 14, 30))} FROM daily""")
def prepare_features(spark, d):
    out = prepare.prepare_features(ship_daily(spark, d), ts="ts", y="y", grain="bin")
    keep = ["ts", "y", "year", "day_of_week", *[f"y_lag_{k}" for k in range(1, 8)]]
    means = [f"y_rolling_mean_{k}" for k in (7, 14, 30)]
    return rounded(out.select(*keep, *means), *means)


@query(f"""WITH {SHIP}, q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM daily),
c AS (SELECT ts, CASE WHEN y < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) WHEN y > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE y END AS y FROM daily, q),
f AS (SELECT ts, y, lag(y, 1) OVER (ORDER BY ts) AS y_lag1, lag(y, 7) OVER (ORDER BY ts) AS y_lag7, lag(y, 30) OVER (ORDER BY ts) AS y_lag30,
{trailing("avg", 7, "y_rolling_7d")}, {trailing("avg", 30, "y_rolling_30d")} FROM c),
n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER () AS n FROM f WHERE y_lag30 IS NOT NULL)
SELECT ts, y, CAST(quarter(ts) AS INTEGER) AS "quarter", y_lag1, y_lag7, y_lag30, y_rolling_7d, y_rolling_30d, CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM n""")
def prepare_legacy(spark, d):
    out = prepare.prepare_legacy(ship_daily(spark, d), ts="ts", y="y", grain="bin")
    return rounded(out.select("ts", "y", "quarter", "y_lag1", "y_lag7", "y_lag30", "y_rolling_7d", "y_rolling_30d", "split"), "y_rolling_7d", "y_rolling_30d")


@query()
def forecast_scores(spark, d):
    """Orders brought to days per priority, split, forecast by several models, blended and scored."""
    run = forecasting.forecast_run(orders(spark, d), ts="ts", y="y", keys=PRIORITY, how="sum", models=["arima", "ets", "lr"], steps=30)
    return run.scores


@query("""WITH p AS (SELECT DISTINCT o_orderpriority FROM orders) SELECT o_orderpriority, m AS requested, s AS status FROM p,
(VALUES ('lr', 'ok'), ('arima', 'ok'), ('no_such_model', 'unknown model')) AS v(m, s)""")
def model_status(spark, d):
    """A run with an unknown model still gives the others' forecasts."""
    from seriesloom.catalogue.base import daily_by_priority
    from seriesloom.models.registry import run_models
    _, status = run_models(daily_by_priority(spark, d), ["lr", "arima", "no_such_model"], ts="ts", y="y", keys=PRIORITY, steps=5)
    return status.drop("message")
