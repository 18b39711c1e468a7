"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalogue.base import DAILY_BY, PRIORITY, daily_by_priority, events, orders, query, r, rounded
from seriesloom.functions import cleaning as text
from seriesloom.operators import clean, frames
from seriesloom.operators.split import chrono_split
from seriesloom.sources.tables import read_table


@query("""SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN round(p_retailprice, 2) END AS price FROM part""")
def clean_price(spark, d):
    """Prices written as ₹1,099.00; the economy parts carry their name instead."""
    t = read_table(spark, d, "part")
    raw = F.when(F.col("p_type") != "ECONOMY", F.concat(F.lit("₹"), F.format_number("p_retailprice", 2))).otherwise(F.col("p_name"))
    return t.select("p_partkey", r(text.price(raw), 2).alias("price"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' THEN round(l_discount * 100) END AS pct FROM lineitem""")
def clean_percent(spark, d):
    t = read_table(spark, d, "lineitem")
    raw = F.when(F.col("l_returnflag") != "R", F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))).otherwise(" ")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", text.percent(raw).alias("pct"))


@query("""SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN p_size / 10.0::DOUBLE END AS rating FROM part""")
def clean_rating(spark, d):
    t = read_table(spark, d, "part")
    raw = F.when(F.col("p_type") != "ECONOMY", (F.col("p_size") / 10).cast("string")).otherwise("|")
    return t.select("p_partkey", text.rating(raw).alias("rating"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN round(floor(o_totalprice), 0) END AS n FROM orders""")
def clean_count(spark, d):
    t = read_table(spark, d, "orders")
    raw = F.when(F.col("o_orderstatus") != "F", F.format_number(F.floor("o_totalprice"), 0)).otherwise("")
    return t.select("o_orderkey", text.count_text(raw).alias("n"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS amount, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k FROM events""")
def coerce_numeric(spark, d):
    amount = F.when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise(F.col("event_type"))
    t = events(spark, d).select("event_id", amount.alias("amount"), F.regexp_extract("props", r"(\d+)", 1).alias("k"))
    return clean.coerce_numbers(t, ["amount", "k"])


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1996 AND 2000 THEN CAST(year(o_orderdate) AS INTEGER) END AS model_year FROM orders""")
def valid_range(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", text.within(F.year("o_orderdate"), 1996, 2000).alias("model_year"))


@query("""SELECT event_id, date_trunc('second', ts) AS ts FROM events WHERE event_type <> 'error'""")
def parse_time_lenient(spark, d):
    """Times as text; error events carry their type instead and fall out."""
    shown = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("event_type"))
    t = events(spark, d).select("event_id", shown.alias("ts"))
    return clean.parse_time(t, ts="ts", lenient=True).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT o_orderkey, o_orderdate AS ts FROM orders""")
def parse_time_strict(spark, d):
    t = read_table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"))
    return clean.parse_time(t, ts="ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT event_id, date_trunc('second', ts) + INTERVAL 8 HOUR AS ts FROM events""")
def parse_time_offsets(spark, d):
    """Times written with weekday, offset and zone name; the offset decides."""
    shown = F.concat(F.date_format("ts", "EEE MMM dd yyyy HH:mm:ss"), F.lit(" GMT-0800 (PST)"))
    t = events(spark, d).select("event_id", shown.alias("ts"))
    return clean.parse_time(t, ts="ts", lenient=True).withColumn("ts", F.expr("to_utc_timestamp(ts, current_timezone())").cast("timestamp_ntz"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_quantity, 2) AS daily_sales FROM lineitem""")
def derived_measure(spark, d):
    t = read_table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", r(F.col("l_extendedprice") * F.col("l_quantity"), 2).alias("daily_sales"))


@query("""SELECT p_partkey, p_retailprice, DATE '2024-12-31' - CAST(count(*) OVER () - row_number() OVER (ORDER BY p_retailprice, p_partkey) AS INTEGER) AS date FROM part""")
def synthetic_index(spark, d):
    t = read_table(spark, d, "part").select("p_partkey", "p_retailprice")
    return clean.synthetic_index(t, order=["p_retailprice", "p_partkey"], end="2024-12-31")


@query(f"""WITH {DAILY_BY}, x AS (SELECT *, lag(y, 7) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS y_lag_7 FROM daily) SELECT * FROM x WHERE y_lag_7 IS NOT NULL""")
def drop_null_rows(spark, d):
    from seriesloom.operators.lags import add_lags
    return add_lags(daily_by_priority(spark, d), ts="ts", y="y", keys=PRIORITY, grain="bin", lags=[7]).dropna()


@query("""SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events""")
def distinct_rows(spark, d):
    return events(spark, d).select("user_id", "event_type", F.to_date("ts").alias("day")).dropDuplicates()


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1),
l AS (SELECT event_type, m - 3 * sd AS lo, m + 3 * sd AS hi FROM s),
c AS (SELECT event_type, lo, hi, count(*) FILTER (WHERE value > hi OR value < lo) < 0.05::DOUBLE * count(*) AS cap FROM events JOIN l USING (event_type) GROUP BY 1, 2, 3)
SELECT event_id, event_type, round(CASE WHEN cap THEN least(greatest(value, lo), hi) ELSE value END, 4) AS value FROM events JOIN c USING (event_type)""")
def cap_sigma(spark, d):
    t = events(spark, d).select("event_id", "event_type", "value")
    return rounded(clean.cap_sigma(t, y="value", keys=["event_type"]), "value")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, event_type, round(CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE value END, 6) AS value
FROM events JOIN q USING (event_type)""")
def cap_iqr(spark, d):
    t = events(spark, d).select("event_id", "event_type", "value")
    return rounded(clean.cap_iqr(t, y="value", keys=["event_type"]), "value", digits=6)


@query(f"""WITH {DAILY_BY}, n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM daily),
s AS (SELECT o_orderpriority, ts, y, CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM n),
l AS (SELECT o_orderpriority, min(y) AS lo, max(y) AS hi FROM s WHERE split = 'train' GROUP BY 1)
SELECT s.o_orderpriority, ts, split, round((y - lo) / (hi - lo), 8) AS scaled, round(y, 2) AS y FROM s JOIN l ON s.o_orderpriority = l.o_orderpriority""")
def minmax_scale(spark, d):
    """Scaled by the training rows' range and back again."""
    t = chrono_split(daily_by_priority(spark, d), ts="ts", keys=PRIORITY, grain="bin")
    limits = clean.scale_limits(t.where("split = 'train'"), y="y", keys=PRIORITY)
    there = clean.minmax_scale(t, limits, y="y", keys=PRIORITY, out="scaled")
    back = clean.minmax_unscale(there, limits, y="scaled", keys=PRIORITY, out="y")
    return rounded(rounded(back, "scaled", digits=8), "y", digits=2)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS l_quantity, l_discount, l_extendedprice FROM lineitem""")
def narrow_integers(spark, d):
    t = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice")
    return clean.narrow_integers(t, skip=["l_linenumber"])


@query("""SELECT 'l_quantity' AS "column", bool_and(l_quantity = floor(l_quantity)) AS whole FROM lineitem
UNION ALL SELECT 'l_discount', bool_and(l_discount = floor(l_discount)) FROM lineitem
UNION ALL SELECT 'l_extendedprice', bool_and(l_extendedprice = floor(l_extendedprice)) FROM lineitem""")
def whole_number_columns(spark, d):
    return clean.whole_number_columns(read_table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"))


@query("""SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2""")
def model_contract(spark, d):
    from seriesloom.operators.timeaxis import to_grain
    t = to_grain(orders(spark, d), ts="ts", y="y", keys=PRIORITY, how="sum")
    return rounded(clean.to_model_contract(t, ts="ts", y="y", keys=PRIORITY), "y", digits=2)


@query("""SELECT CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) AS forecast, o_orderkey FROM orders""")
def normalise_forecast(spark, d):
    """A frame without known names: the first column is the date, the first number the forecast."""
    t = orders(spark, d).select(F.col("ts").alias("unnamed"), r("y", 2).alias("number"), "o_orderkey")
    return frames.normalise_forecast(t)


@query("""SELECT CAST(o_orderdate AS DATE) AS saledate, o_totalprice AS forecast, o_totalprice * 0.5::DOUBLE AS lower_bound, o_totalprice * 1.5::DOUBLE AS upper_bound, o_orderkey FROM orders""")
def resolve_forecast(spark, d):
    t = orders(spark, d).select(
        F.col("ts").alias("date"), F.col("y").alias("my_prediction"), (F.col("y") * 0.5).alias("lower_ci"), (F.col("y") * 1.5).alias("upper_ci"), "o_orderkey")
    return clean.rename_time(frames.resolve_forecast(t), wanted="saledate")
