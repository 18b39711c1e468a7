"""Time-axis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalogue.base import (
    DAILY, DAILY_BY, PRIORITY, SHIP, daily, daily_by_priority, events, interpolated, orders, q0, query, r, rounded, ship_daily)
from seriesloom.functions.calendar import add_date_parts, add_time_features, iso_day, month_name, weekday_name
from seriesloom.models.leastsq import model_features
from seriesloom.operators import timeaxis as axis
from seriesloom.operators.fill import fill_gaps
from seriesloom.operators.profile import union_all

WEEK_END = "CAST(date_trunc('week', o_orderdate) AS DATE) + 6"


@query(f"WITH {DAILY} SELECT ts, y FROM daily")
def daily_grain(spark, d):
    return daily(spark, d)


@query(f"""WITH bins AS (SELECT {WEEK_END} AS ts, avg(o_totalprice) AS y FROM orders GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY)) AS DATE) AS ts FROM bins),
gapped AS (SELECT spine.ts, bins.y FROM spine LEFT JOIN bins USING (ts)), {interpolated("gapped")}
SELECT ts, round(y, 7) AS y FROM filled""")
def weekly_resample(spark, d):
    bins = axis.to_grain(orders(spark, d), ts="ts", y="y", freq="W", empty_bins=True)
    return rounded(fill_gaps(bins, ["y"], ts="ts", grain="bin", method="linear"), "y", digits=7)


@query(f"""WITH bins AS (SELECT o_orderpriority, last_day(CAST(o_orderdate AS DATE)) AS ts, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2),
ends AS (SELECT o_orderpriority, min(date_trunc('month', ts)) AS lo, max(date_trunc('month', ts)) AS hi FROM bins GROUP BY 1),
spine AS (SELECT o_orderpriority, last_day(CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS ts FROM ends),
gapped AS (SELECT spine.o_orderpriority, spine.ts, bins.y FROM spine LEFT JOIN bins USING (o_orderpriority, ts)), {interpolated("gapped", PRIORITY)}
SELECT o_orderpriority, ts, round(y, 7) AS y FROM filled""")
def monthly_resample(spark, d):
    bins = axis.to_grain(orders(spark, d), ts="ts", y="y", keys=PRIORITY, freq="M", empty_bins=True)
    return rounded(fill_gaps(bins, ["y"], ts="ts", keys=PRIORITY, grain="bin", method="linear"), "y", digits=7)


@query("""SELECT event_type, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS y FROM events GROUP BY 1, 2""")
def hourly_grain(spark, d):
    t = events(spark, d).withColumn("y", F.col("value"))
    out = axis.to_grain(t, ts="ts", y="y", keys=["event_type"], freq="H", how="sum")
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "y", digits=2)


@query("""WITH ends AS (SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1),
spine AS (SELECT o_orderpriority, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM ends)
SELECT o_orderpriority, ts FROM spine ANTI JOIN (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ts FROM orders) USING (o_orderpriority, ts)""")
def calendar_gaps(spark, d):
    return axis.calendar_gaps(orders(spark, d), ts="ts", keys=PRIORITY)


@query("""WITH days AS (SELECT DISTINCT o_orderpriority, CAST(o_orderdate AS DATE) AS ts FROM orders),
s AS (SELECT o_orderpriority, CAST(max(ts) - min(ts) + 1 AS BIGINT) AS days, count(*) AS days_present FROM days GROUP BY 1)
SELECT o_orderpriority, days, days_present, days - days_present AS days_missing, round((days - days_present) * 100.0::DOUBLE / days, 6) AS missing_pct FROM s""")
def gap_share(spark, d):
    return rounded(axis.gap_share(orders(spark, d), ts="ts", keys=PRIORITY), "missing_pct", digits=6)


@query("""WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders),
times AS (
  SELECT DISTINCT 'day' AS kind, CAST(d AS TIMESTAMP) AS ts FROM days
  UNION SELECT 'week', CAST(CAST(date_trunc('week', d) AS DATE) + 6 AS TIMESTAMP) FROM days
  UNION SELECT 'month_end', CAST(last_day(d) AS TIMESTAMP) FROM days
  UNION SELECT 'month_start', CAST(date_trunc('month', d) AS TIMESTAMP) FROM days
  UNION SELECT 'year', CAST(date_trunc('year', d) AS TIMESTAMP) FROM days
  UNION SELECT 'event', ts FROM events
  UNION SELECT 'event_hour', date_trunc('hour', ts) FROM events),
steps AS (SELECT kind, ts, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY kind ORDER BY ts) AS s FROM times),
f AS (SELECT kind, count(*) AS n, min(s) AS lo, max(s) AS hi, bool_and(day(ts) = 1) AS starts, bool_and(CAST(ts AS DATE) = last_day(ts)) AS ends,
  max(year(ts) * 12 + month(ts)) - min(year(ts) * 12 + month(ts)) + 1 AS months FROM steps GROUP BY 1)
SELECT kind, CASE WHEN n < 3 THEN NULL
  WHEN lo = hi THEN CASE
    WHEN lo % 604800 = 0 THEN CASE WHEN lo = 604800 THEN '' ELSE CAST(CAST(lo / 604800 AS BIGINT) AS VARCHAR) END || 'W'
    WHEN lo % 86400 = 0 THEN CASE WHEN lo = 86400 THEN '' ELSE CAST(CAST(lo / 86400 AS BIGINT) AS VARCHAR) END || 'D'
    WHEN lo % 3600 = 0 THEN CASE WHEN lo = 3600 THEN '' ELSE CAST(CAST(lo / 3600 AS BIGINT) AS VARCHAR) END || 'H'
    WHEN lo % 60 = 0 THEN CASE WHEN lo = 60 THEN '' ELSE CAST(CAST(lo / 60 AS BIGINT) AS VARCHAR) END || 'T'
    WHEN lo % 1 = 0 THEN CASE WHEN lo = 1 THEN '' ELSE CAST(CAST(lo AS BIGINT) AS VARCHAR) END || 'S' END
  WHEN starts AND months = n THEN 'MS' WHEN ends AND months = n THEN 'M' END AS freq FROM f""")
def infer_frequency(spark, d):
    day, stamp = F.col("ts"), "timestamp_ntz"
    o, e = orders(spark, d), events(spark, d)
    kinds = {
        "day": day, "week": axis.bin_of(day, "W"), "month_end": axis.bin_of(day, "M"),
        "month_start": F.trunc(day, "month"), "year": F.trunc(day, "year")}
    frames = [o.select(F.lit(k).alias("kind"), c.cast(stamp).alias("ts")) for k, c in kinds.items()]
    frames += [e.select(F.lit("event").alias("kind"), F.col("ts").cast(stamp).alias("ts")),
               e.select(F.lit("event_hour").alias("kind"), axis.bin_of("ts", "H").cast(stamp).alias("ts"))]
    return axis.infer_frequency(union_all(frames), ts="ts", keys=["kind"])


@query("""WITH times AS (SELECT DISTINCT event_type, ts FROM events),
steps AS (SELECT event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts) AS s FROM times),
m AS (SELECT event_type, quantile_cont(s, 0.5) / 86400 AS median_days FROM steps GROUP BY 1)
SELECT event_type, round(median_days, 8) AS median_days,
  CASE WHEN floor(median_days) < 2 THEN 'D' WHEN floor(median_days) < 8 THEN 'W' WHEN floor(median_days) < 32 THEN 'M' END AS freq_class FROM m""")
def frequency_class(spark, d):
    return rounded(axis.frequency_class(events(spark, d), ts="ts", keys=["event_type"]), "median_days", digits=8)


REGULAR_PLAN = """last_rows AS (SELECT CAST(o_orderdate AS DATE) AS ts, arg_max(o_totalprice, o_orderkey) AS y FROM orders GROUP BY 1),
facts AS (SELECT max(ts) - min(ts) + 1 AS days, count(*) AS present FROM last_rows),
spine AS (SELECT CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM last_rows),
gapped AS (SELECT spine.ts, last_rows.y FROM spine LEFT JOIN last_rows USING (ts))"""


@query(f"""WITH {REGULAR_PLAN}, {interpolated("gapped")}
SELECT ts, round(filled.y, 6) AS y, 'resampled_D' AS action FROM filled, facts WHERE days > present AND (days - present) * 100.0 / days < 20
UNION ALL SELECT ts, round(last_rows.y, 4), 'deduplicated' FROM last_rows, facts WHERE (days - present) * 100.0 / days >= 20
UNION ALL SELECT CAST(o_orderdate AS DATE), round(o_totalprice, 4), 'regular' FROM orders, facts WHERE days = present""")
def regularise(spark, d):
    return rounded(axis.regularise(orders(spark, d), ts="ts", y="y", tie=["o_orderkey"]), "y", digits=6)


REGULAR_PLAN_BY = """last_rows AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ts, arg_max(o_totalprice, o_orderkey) AS y FROM orders GROUP BY 1, 2),
facts AS (SELECT o_orderpriority, min(ts) AS lo, max(ts) AS hi, max(ts) - min(ts) + 1 AS days, count(*) AS present FROM last_rows GROUP BY 1),
plan AS (SELECT *, CASE WHEN days = present THEN 'regular' WHEN (days - present) * 100.0 / days < 20 THEN 'resampled_D' ELSE 'deduplicated' END AS action FROM facts),
spine AS (SELECT o_orderpriority, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM plan WHERE action = 'resampled_D'),
gapped AS (SELECT spine.o_orderpriority, spine.ts, last_rows.y FROM spine LEFT JOIN last_rows USING (o_orderpriority, ts))"""


@query(f"""WITH {REGULAR_PLAN_BY}, {interpolated("gapped", PRIORITY)}
SELECT o_orderpriority, ts, round(y, 6) AS y, 'resampled_D' AS action FROM filled
UNION ALL SELECT l.o_orderpriority, l.ts, round(l.y, 6), action FROM last_rows l JOIN plan USING (o_orderpriority) WHERE action = 'deduplicated'
UNION ALL SELECT o_orderpriority, CAST(o_orderdate AS DATE), round(o_totalprice, 6), action FROM orders JOIN plan USING (o_orderpriority) WHERE action = 'regular'""")
def regularise_by_priority(spark, d):
    return rounded(axis.regularise(orders(spark, d), ts="ts", y="y", keys=PRIORITY, tie=["o_orderkey"]), "y", digits=6)


@query("""SELECT CAST(l_shipdate AS DATE) AS ts, arg_max(l_orderkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS l_orderkey,
round(max_by(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)), 2) AS l_extendedprice FROM lineitem GROUP BY 1""")
def keep_last(spark, d):
    from seriesloom.sources.tables import read_table
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = read_table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("ts"), *tie)
    return axis.keep_last(rows, ts="ts", tie=tie).select("ts", "l_orderkey", r("l_extendedprice", 2).alias("l_extendedprice"))


@query("""WITH ends AS (SELECT o_orderpriority, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1)
SELECT o_orderpriority, CAST(i AS INTEGER) AS step, hi + CAST(i AS INTEGER) AS ts FROM ends, generate_series(1, 30) AS g(i)""")
def future_dates(spark, d):
    return axis.future_dates(orders(spark, d), ts="ts", keys=PRIORITY, steps=30)


@query(f"""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS "year", CAST(month(o_orderdate) AS INTEGER) AS "month",
CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year, CAST(quarter(o_orderdate) AS INTEGER) AS "quarter",
CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend,
{q0("sin(2 * pi() * month(o_orderdate) / 12)")} AS month_sin, {q0("cos(2 * pi() * month(o_orderdate) / 12)")} AS month_cos,
{q0("sin(2 * pi() * (isodow(o_orderdate) - 1) / 7)")} AS day_of_week_sin, {q0("cos(2 * pi() * (isodow(o_orderdate) - 1) / 7)")} AS day_of_week_cos
FROM orders""")
def time_features(spark, d):
    out = add_time_features(orders(spark, d).select("o_orderkey", "ts"), ts="ts").drop("ts")
    return rounded(out, "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos", digits=6)


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS "year", CAST(month(o_orderdate) AS INTEGER) AS "month", CAST(day(o_orderdate) AS INTEGER) AS "day",
CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dayofweek, CAST(quarter(o_orderdate) AS INTEGER) AS "quarter", strftime(o_orderdate, '%Y-%m-%d') AS day_text,
strftime(o_orderdate, '%B') AS month_name, strftime(o_orderdate, '%A') AS day_name, CAST(o_orderdate AS DATE) + 7 AS week_later FROM orders""")
def date_parts(spark, d):
    out = add_date_parts(orders(spark, d).select("o_orderkey", "ts"), ts="ts")
    return out.withColumns({
        "day_text": iso_day("ts"), "month_name": month_name("ts"), "day_name": weekday_name("ts"), "week_later": F.date_add("ts", 7)}).drop("ts")


LAG_COLUMNS = ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in range(1, 13))


@query(f"""WITH {SHIP}, x AS (SELECT ts, y, {LAG_COLUMNS} FROM daily WINDOW w AS (ORDER BY ts))
SELECT *, CAST(month(ts) AS DOUBLE) AS "month", CAST(dayofyear(ts) AS DOUBLE) AS dayofyear, CAST(isodow(ts) - 1 AS DOUBLE) AS dayofweek,
{q0("sin(2 * pi() * month(ts) / 12)")} AS month_sin, {q0("cos(2 * pi() * month(ts) / 12)")} AS month_cos,
{q0("sin(2 * pi() * dayofyear(ts) / 365)")} AS day_sin, {q0("cos(2 * pi() * dayofyear(ts) / 365)")} AS day_cos FROM x WHERE lag_12 IS NOT NULL""")
def model_feature_rows(spark, d):
    out = model_features(ship_daily(spark, d), ts="ts", y="y", grain="bin")
    return rounded(out, "month_sin", "month_cos", "day_sin", "day_cos", digits=6)


@query(f"WITH {DAILY_BY} SELECT o_orderpriority, CAST(min(ts) AS VARCHAR) AS first_day, CAST(max(ts) AS VARCHAR) AS last_day, count(*) AS bins FROM daily GROUP BY 1")
def grain_span(spark, d):
    return daily_by_priority(spark, d).groupBy(*PRIORITY).agg(
        iso_day(F.min("ts")).alias("first_day"), iso_day(F.max("ts")).alias("last_day"), F.count(F.lit(1)).alias("bins"))


@query("""SELECT CAST(i AS INTEGER) AS step, CAST(max(o_orderdate) AS DATE) + CAST(i AS INTEGER) AS date FROM orders, generate_series(1, 30) AS g(i) GROUP BY i""")
def future_dates_from_day(spark, d):
    """Thirty days after the day of the newest order."""
    newest = orders(spark, d).agg(F.max("ts").cast("string")).first()[0]
    return axis.future_dates_from(spark, newest)
