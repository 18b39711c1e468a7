"""Window queries: lags, rolling statistics, fills, decomposition, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalogue.base import (
    DAILY_BY, PRIORITY, SHIP, daily_by_priority, events, interpolated, orders, query, r, rounded, ship_daily)
from seriesloom.operators import lags as lag
from seriesloom.operators import split as parts
from seriesloom.operators.decompose import seasonal_decompose
from seriesloom.operators.fill import fill_gaps
from seriesloom.operators.timeaxis import step_lengths

SHIP_WINDOW = f"WITH {SHIP} SELECT ts, y, %s FROM daily WINDOW w AS (ORDER BY ts)"


def trailing(stat: str, k: int, alias: str, digits: int = 4) -> str:
    frame = f"OVER (ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(y) {frame} = {k} THEN round({stat}(y) {frame}, {digits}) END AS {alias}"


@query(SHIP_WINDOW % ", ".join(f"lag(y, {k}) OVER w AS y_lag_{k}" for k in range(1, 8)))
def lags(spark, d):
    return lag.add_lags(ship_daily(spark, d), ts="ts", y="y", grain="bin")


@query(SHIP_WINDOW % ", ".join(f"lag(y, {k}) OVER w AS y_lag{k}" for k in (1, 7, 30)))
def named_lags(spark, d):
    return lag.add_lags(ship_daily(spark, d), ts="ts", y="y", grain="bin", lags=(1, 7, 30), name="{y}_lag{k}")


EVENT_LAGS = ", ".join(f"lag(value, {k}) OVER w AS value_lag_{k}" for k in range(1, 4))


@query(f"""SELECT event_id, value, {EVENT_LAGS}, CASE WHEN count(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
THEN round(avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) END AS value_rolling_mean_7
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def raw_row_windows(spark, d):
    """Lags and a rolling mean over raw rows: positions by range, windows by blocks."""
    from seriesloom.operators.lags import full_frame
    from seriesloom.operators.ordering import ordered_columns
    t = events(spark, d).select("event_id", "event_type", "ts", "value")

    def build(w):
        out = {f"value_lag_{k}": F.lag("value", k).over(w) for k in range(1, 4)}
        return out | {"value_rolling_mean_7": r(full_frame(F.avg("value"), "value", w.rowsBetween(-6, 0), 7))}
    return ordered_columns(t, build, ts="ts", keys=["event_type"], tie=["event_id"], back=7).drop("event_type", "ts")


@query(SHIP_WINDOW % ", ".join(trailing("avg", k, f"y_rolling_mean_{k}") for k in (7, 14, 30)))
def rolling_mean(spark, d):
    out = lag.add_rolling(ship_daily(spark, d), ts="ts", y="y", grain="bin")
    return rounded(out, *[f"y_rolling_mean_{k}" for k in (7, 14, 30)])


@query(SHIP_WINDOW % (trailing("avg", 12, "y_rolling_mean_12") + ", " + trailing("stddev_samp", 12, "y_rolling_std_12")))
def rolling_std(spark, d):
    out = lag.add_rolling(ship_daily(spark, d), ts="ts", y="y", grain="bin", windows=(12,), std=True)
    return rounded(out, "y_rolling_mean_12", "y_rolling_std_12")


@query(SHIP_WINDOW % "round(avg(y) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS y_rolling_mean_7")
def rolling_partial(spark, d):
    out = lag.add_rolling(ship_daily(spark, d), ts="ts", y="y", grain="bin", windows=(7,), partial=True)
    return rounded(out, "y_rolling_mean_7")


@query(f"""WITH {DAILY_BY}, n AS (SELECT o_orderpriority, ts, y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) AS t,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM daily),
k AS (SELECT *, CAST(least(30, greatest(7, n // 10)) AS BIGINT) AS k FROM n),
m AS (SELECT a.o_orderpriority, a.ts, any_value(a.y) AS y, any_value(a.k) AS k, any_value(a.n) AS n, count(b.y) AS c, sum(b.y) AS s
  FROM k a JOIN k b ON a.o_orderpriority = b.o_orderpriority AND b.t BETWEEN a.t - a.k // 2 AND a.t + (a.k - 1) // 2 GROUP BY 1, 2)
SELECT o_orderpriority, ts, y, CASE WHEN c = k AND n >= 14 THEN round(s / k, 3) END AS trend_ma,
  CASE WHEN c = k AND n >= 14 THEN round(y - s / k, 3) END AS detrended FROM m""")
def centred_trend(spark, d):
    out = lag.centred_trend(daily_by_priority(spark, d), ts="ts", y="y", keys=PRIORITY)
    return rounded(out, "trend_ma", "detrended", digits=3)


@query("""WITH n AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t,
  count(*) OVER (PARTITION BY event_type) AS n FROM events),
k AS (SELECT *, CAST(least(30, greatest(7, n // 10)) AS BIGINT) AS k FROM n),
m AS (SELECT a.event_id, any_value(a.value) AS value, any_value(a.k) AS k, any_value(a.n) AS n, count(b.value) AS c, sum(b.value) AS s
  FROM k a JOIN k b ON a.event_type = b.event_type AND b.t BETWEEN a.t - a.k // 2 AND a.t + (a.k - 1) // 2 GROUP BY 1)
SELECT event_id, CASE WHEN c = k AND n >= 14 THEN round(s / k, 6) END AS trend_ma,
  CASE WHEN c = k AND n >= 14 THEN round(value - s / k, 6) END AS detrended FROM m""")
def centred_trend_rows(spark, d):
    """The trend of raw rows: positions by range, neighbours by blocks."""
    t = events(spark, d).select("event_id", "event_type", "ts", "value")
    out = lag.centred_trend(t, ts="ts", y="value", keys=["event_type"], tie=["event_id"], grain="row")
    return rounded(out, "trend_ma", "detrended", digits=6).select("event_id", "trend_ma", "detrended")


OPEN_PRICE = "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END"


def open_prices(spark, d):
    """Orders whose price counts as unknown while they are pending."""
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return orders(spark, d).select("o_orderkey", "ts", known.alias("y"))


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ts, {OPEN_PRICE} AS y FROM orders)
SELECT o_orderkey, ts, coalesce(last_value(y IGNORE NULLS) OVER (ORDER BY ts, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (ORDER BY ts, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM x""")
def fill_forward_backward(spark, d):
    return fill_gaps(open_prices(spark, d), ["y"], ts="ts", tie=["o_orderkey"])


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ts, {OPEN_PRICE} AS y FROM orders), {interpolated("x", (), "ts, o_orderkey")}
SELECT o_orderkey, ts, round(y, 6) AS y FROM filled""")
def interpolate(spark, d):
    out = fill_gaps(open_prices(spark, d), ["y"], ts="ts", tie=["o_orderkey"], method="linear")
    return rounded(out, "y", digits=6)


@query("""WITH times AS (SELECT DISTINCT event_type, ts FROM events)
SELECT event_type, ts, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts), 3) AS step_seconds FROM times""")
def time_steps(spark, d):
    return rounded(step_lengths(events(spark, d), ts="ts", keys=["event_type"]), "step_seconds", digits=3)


@query(f"""WITH {SHIP}, n AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS t,
  CASE WHEN count(y) OVER w = 7 THEN sum(y) OVER w / 7 END AS trend FROM daily WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
p AS (SELECT t % 7 AS phase, avg(y - trend) AS m FROM n GROUP BY 1),
s AS (SELECT phase, m - (SELECT avg(m) FROM p) AS seasonal FROM p)
SELECT ts, y, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(y - trend - seasonal, 4) AS residual FROM n JOIN s ON t % 7 = phase""",
       name="seasonal_decompose")
def seasonal_decompose_query(spark, d):
    out = seasonal_decompose(ship_daily(spark, d), ts="ts", y="y", grain="bin", period=7)
    return rounded(out, "trend", "seasonal", "residual")


@query(f"""WITH {DAILY_BY}, m AS (SELECT o_orderpriority, last_day(ts) AS ts, round(sum(y), 2) AS y FROM daily GROUP BY 1, 2),
n AS (SELECT o_orderpriority, ts, y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS t,
  CASE WHEN count(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
    (sum(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(y, 6) OVER w + lead(y, 6) OVER w) / 2) / 12 END AS trend
  FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY ts)),
p AS (SELECT o_orderpriority, t % 12 AS phase, avg(y - trend) AS m FROM n GROUP BY 1, 2),
s AS (SELECT o_orderpriority, phase, m - avg(m) OVER (PARTITION BY o_orderpriority) AS seasonal FROM p)
SELECT n.o_orderpriority, ts, y, round(trend, 5) AS trend, round(seasonal, 2) AS seasonal, round(y - trend - seasonal, 2) AS residual
FROM n JOIN s ON n.o_orderpriority = s.o_orderpriority AND t % 12 = phase""")
def decompose_even_period(spark, d):
    from seriesloom.catalogue.base import total
    months = total(daily_by_priority(spark, d), PRIORITY, "M")
    out = seasonal_decompose(months, ts="ts", y="y", keys=PRIORITY, grain="bin", period=12)
    return rounded(rounded(out, "seasonal", "residual", digits=2), "trend", digits=5)


SEQUENCE_LAGS = ", ".join(f"lag(y, {k}) OVER w AS y{k}" for k in range(1, 8))


@query(f"""WITH {DAILY_BY}, x AS (SELECT o_orderpriority, ts, y AS label, {SEQUENCE_LAGS} FROM daily WINDOW w AS (PARTITION BY o_orderpriority ORDER BY ts))
SELECT o_orderpriority, ts, label, CAST(p AS INTEGER) AS place, [y7, y6, y5, y4, y3, y2, y1][p + 1] AS input FROM x, range(7) AS g(p) WHERE y7 IS NOT NULL""")
def sequence_windows(spark, d):
    out = lag.sequences(daily_by_priority(spark, d), ts="ts", y="y", keys=PRIORITY, grain="bin", n_steps=7)
    return out.select(*PRIORITY, "ts", "label", F.posexplode("inputs").alias("place", "input"))


@query(f"""WITH {DAILY_BY}, x AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts DESC) AS b, max(ts) OVER (PARTITION BY o_orderpriority) AS last_ts FROM daily)
SELECT o_orderpriority, last_ts, CAST(20 - b AS INTEGER) AS place, y FROM x WHERE b <= 20""")
def last_n(spark, d):
    out = lag.last_values(daily_by_priority(spark, d), ts="ts", y="y", keys=PRIORITY, grain="bin", n=20)
    return out.select(*PRIORITY, "last_ts", F.posexplode("last_values").alias("place", "y"))


@query("""WITH x AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS t,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM x""")
def chrono_split(spark, d):
    out = parts.chrono_split(orders(spark, d).select("o_orderkey", *PRIORITY, "ts"), ts="ts", keys=PRIORITY, tie=["o_orderkey"])
    return out.drop("ts")


@query(f"""WITH {DAILY_BY}, x AS (SELECT o_orderpriority, ts, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS t,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM daily),
f AS (SELECT *, CAST(fold AS INTEGER) AS k, n - (5 - fold + 1) * (n // 6) AS start FROM x, generate_series(1, 5) AS g(fold))
SELECT o_orderpriority, ts, k AS fold, CASE WHEN t < start THEN 'train' ELSE 'test' END AS role FROM f WHERE t < start + n // 6""")
def cv_folds(spark, d):
    return parts.cv_folds(daily_by_priority(spark, d).drop("y"), ts="ts", keys=PRIORITY, grain="bin")
