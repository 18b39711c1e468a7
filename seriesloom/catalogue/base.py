"""Registry, shared input frames and the SQL for them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.timeaxis import to_grain
from seriesloom.session import use_checkpoint_dir
from seriesloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return add


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(c, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def q0(expr: str, digits: int = 6) -> str:
    """SQL rounding without a negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END"


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, so that every executor can reach it."""
    return f"{use_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


# ---- shared series -------------------------------------------------------------------

PRIORITY = ("o_orderpriority",)


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their day as ``ts`` and price as ``y``."""
    t = read_table(spark, d, "orders")
    return t.withColumn("ts", F.to_date("o_orderdate")).withColumn("y", F.col("o_totalprice"))


def total(df: DataFrame, keys: Sequence[str] = (), freq: str = "D") -> DataFrame:
    """Sums per bin, exact to the cent whatever the order of adding."""
    return rounded(to_grain(df, ts="ts", y="y", keys=keys, freq=freq, how="sum"), "y", digits=2)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return total(orders(spark, d))


def daily_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return total(orders(spark, d), PRIORITY)


def ship_daily(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lineitem")
    return total(t.select(F.to_date("l_shipdate").alias("ts"), F.col("l_quantity").alias("y")))


def segment_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Order value per market segment and month; the adaptive join picks the side to broadcast by size."""
    customers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return total(orders(spark, d).join(customers, "o_custkey"), ("c_mktsegment",), "M")


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS ts, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1)"
DAILY_BY = "daily AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ts, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2)"
SHIP = "daily AS (SELECT CAST(l_shipdate AS DATE) AS ts, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 1)"
MONTHLY_BY = """monthly AS (SELECT c_mktsegment, last_day(CAST(o_orderdate AS DATE)) AS ts, round(sum(o_totalprice), 2) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def by(keys: Sequence[str]) -> str:
    return "PARTITION BY " + ", ".join(keys) if keys else ""


def interpolated(source: str, keys: Sequence[str] = (), order: str = "ts", y: str = "y") -> str:
    """CTEs that end in ``filled``: ``source`` with ``y`` interpolated by position."""
    part, cols = by(keys), "".join(f"{k}, " for k in keys)
    return f"""
numbered AS (SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS t FROM {source}),
known AS (SELECT *,
    last_value(CASE WHEN {y} IS NOT NULL THEN t END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
    last_value({y} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
    first_value(CASE WHEN {y} IS NOT NULL THEN t END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
    first_value({y} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
  FROM numbered WINDOW w AS ({part} ORDER BY t)),
filled AS (SELECT * REPLACE (CASE WHEN {y} IS NOT NULL THEN {y} WHEN t0 IS NULL THEN NULL WHEN t1 IS NULL THEN v0
    ELSE v0 + (v1 - v0) * (CAST(t - t0 AS DOUBLE) / (t1 - t0)) END AS {y}) FROM known)"""
