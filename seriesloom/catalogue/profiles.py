"""Profile, detection and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalogue.base import PRIORITY, daily_by_priority, events, orders, query, r, rounded
from seriesloom.operators import profile as prof
from seriesloom.operators import validate as check
from seriesloom.operators.clean import pick_target
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.sources.tables import peek, read_table

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def described(table: str, columns, group: str = "") -> str:
    """SQL of the numeric description, a row per column."""
    head, tail = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    return " UNION ALL ".join(f"""SELECT {head}'{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {table} {tail}""" for c in columns)


STATS = ("mean", "std", "min", "q25", "q50", "q75", "max")


@query(described("lineitem", NUMBERS))
def describe(spark, d):
    return rounded(prof.describe(read_table(spark, d, "lineitem"), NUMBERS), *STATS)


@query(described("events", ["value", "user_id"], "event_type"))
def describe_by_series(spark, d):
    return rounded(prof.describe(events(spark, d), ["value", "user_id"], keys=["event_type"]), *STATS)


KNOWN = {"o_totalprice": "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END", "o_orderdate": "o_orderdate", "o_orderpriority": "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END"}


def with_unknowns(spark, d):
    """Orders with the price of pending orders and the lowest priority left blank."""
    return read_table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({e}) AS nulls FROM orders HAVING count(*) > count({e})""" for c, e in KNOWN.items()))
def null_counts(spark, d):
    return prof.null_counts(with_unknowns(spark, d))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({e}) AS known, count(*) AS total, round(count({e}) * 100.0::DOUBLE / count(*), 6) AS known_pct FROM orders""" for c, e in KNOWN.items()))
def completeness(spark, d):
    return rounded(prof.completeness(with_unknowns(spark, d)), "known_pct", digits=6)


@query("""SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS "columns" FROM lineitem""")
def table_shape(spark, d):
    return prof.shape(read_table(spark, d, "lineitem"))


LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
    "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


def profiled(i: int, column: str, kind: str) -> str:
    """SQL of the profile row of one column."""
    stats = {"mean": f"avg({column})", "std": f"stddev_samp({column})", "min": f"min({column})", "max": f"max({column})"}
    stats |= {f"q{q}": f"quantile_cont(CAST({column} AS DOUBLE), 0.{q})" for q in (25, 50, 75)}
    texts = kind in ("string", "timestamp_ntz")
    cells = ", ".join(f"{'NULL::DOUBLE' if texts else f'round(CAST({e} AS DOUBLE), 4)'} AS {name}" for name, e in stats.items())
    return f"""SELECT CAST({i} AS INTEGER) AS position, '{column}' AS "column", '{kind}' AS type, count(*) AS total, count({column}) AS known, count(*) - count({column}) AS nulls, {cells} FROM lineitem"""


@query(" UNION ALL ".join(profiled(i, c, k) for i, (c, k) in enumerate(LINEITEM.items())))
def dataset_profile(spark, d):
    """Types, completeness and description of all columns."""
    return rounded(prof.profile(read_table(spark, d, "lineitem")), *STATS)


@query("""SELECT event_type, min(ts) AS start, max(ts) AS "end", CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS BIGINT) AS days,
strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS range_text FROM events GROUP BY 1""")
def time_range(spark, d):
    return prof.time_range(events(spark, d), ts="ts", keys=["event_type"])


@query("""WITH t AS (SELECT CASE WHEN l_orderkey % 11 <> 0 THEN l_shipdate END AS ts FROM lineitem)
SELECT count(*) AS "rows", CAST(count(DISTINCT ts) + (count(*) > count(ts))::INTEGER AS BIGINT) AS distinct_times,
CAST(count(*) - count(DISTINCT ts) - (count(*) > count(ts))::INTEGER AS BIGINT) AS duplicates FROM t""")
def duplicate_times(spark, d):
    """Ship dates, unknown for every eleventh order; all unknown ones count as one time."""
    t = read_table(spark, d, "lineitem").withColumn("ts", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_shipdate")))
    return prof.duplicate_times(t, ts="ts")


@query("""SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def target_stats(spark, d):
    return rounded(prof.target_stats(orders(spark, d), y="y", keys=PRIORITY), "mean", "std")


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT event_type, count(*) AS "rows", count(*) FILTER (WHERE abs((value - m) / sd) > 3) AS outliers, round(count(*) FILTER (WHERE abs((value - m) / sd) > 3) * 100.0::DOUBLE / count(*), 6) AS outlier_pct
FROM events JOIN s USING (event_type) GROUP BY 1""")
def outlier_share(spark, d):
    return rounded(prof.outlier_share(events(spark, d), y="value", keys=["event_type"]), "outlier_pct", digits=6)


@query(" UNION ALL ".join(f"""SELECT l_returnflag, '{c}' AS "column", {p}::DOUBLE AS q, round(quantile_cont({c}, {p}), 4) AS quantile FROM lineitem GROUP BY 1""" for c in ("l_extendedprice", "l_quantity") for p in (0.25, 0.5, 0.75)))
def quantiles(spark, d):
    out = exact_quantiles(read_table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], keys=["l_returnflag"])
    return rounded(out, "quantile")


MOMENTS = """m AS (SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.5) AS median, var_samp(value) AS variance, skewness(value) AS skewness, kurtosis(value) AS kurtosis FROM events GROUP BY 1)"""
MOMENT_COLUMNS = "round(mean, 4) AS mean, round(median, 4) AS median, round(variance, 4) AS variance, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis"


def tidy(df):
    return rounded(rounded(df, "mean", "median", "variance"), "skewness", "kurtosis", digits=6)


@query(f"WITH {MOMENTS} SELECT event_type, {MOMENT_COLUMNS} FROM m")
def moments(spark, d):
    return tidy(prof.moments(events(spark, d), y="value", keys=["event_type"]))


@query(f"""WITH {MOMENTS} SELECT event_type, {MOMENT_COLUMNS}, CASE WHEN skewness < -1 THEN 'heavily left-skewed' WHEN skewness < -0.5 THEN 'moderately left-skewed'
WHEN skewness < 0.5 THEN 'approximately symmetric' WHEN skewness < 1 THEN 'moderately right-skewed' ELSE 'heavily right-skewed' END AS skew_class,
CASE WHEN kurtosis < -1 THEN 'platykurtic' WHEN kurtosis < 1 THEN 'mesokurtic' ELSE 'leptokurtic' END AS tail_class FROM m""")
def shape_verdict(spark, d):
    return tidy(prof.shape_verdict(events(spark, d), y="value", keys=["event_type"]))


def histogram_sql(table: str, column: str, bins: int) -> str:
    return f"""WITH e AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {table}),
c AS (SELECT CAST(least({bins - 1}, floor(({column} - lo) * {bins} / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM {table}, e GROUP BY 1)
SELECT '{column}' AS "column", CAST(b AS INTEGER) AS bin, round(lo + (hi - lo) / {bins} * b, 4) AS lower, round(lo + (hi - lo) / {bins} * (b + 1), 4) AS upper, coalesce(n, 0) AS n
FROM e, range({bins}) AS g(b) LEFT JOIN c ON bin = b"""


@query(histogram_sql("lineitem", "l_extendedprice", 50))
def histogram(spark, d):
    return rounded(prof.histogram(read_table(spark, d, "lineitem"), ["l_extendedprice"]), "lower", "upper")


@query(histogram_sql("events", "value", 30))
def histogram_30(spark, d):
    return rounded(prof.histogram(events(spark, d), ["value"], bins=30), "lower", "upper")


@query(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in NUMBERS for b in NUMBERS))
def correlation_matrix(spark, d):
    return rounded(prof.correlation_matrix(read_table(spark, d, "lineitem"), NUMBERS), "corr", digits=6)


@query(f"""WITH v AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, var_samp({c}) AS v FROM lineitem" for c in NUMBERS)})
SELECT arg_max(c, v) AS "column", round(max(v), 2) AS variance FROM v""")
def target_by_variance(spark, d):
    return rounded(prof.highest_variance(read_table(spark, d, "lineitem"), NUMBERS), "variance", digits=2)


@query("""SELECT CAST(month(o_orderdate) AS INTEGER) AS "month", strftime(o_orderdate, '%B') AS month_name, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2""")
def month_pattern(spark, d):
    return rounded(prof.month_pattern(orders(spark, d), ts="ts", y="y"), "mean")


@query("""SELECT o_orderpriority, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, strftime(o_orderdate, '%A') AS day_name, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2, 3""")
def weekday_pattern(spark, d):
    return rounded(prof.weekday_pattern(orders(spark, d), ts="ts", y="y", keys=PRIORITY), "mean")


@query("""SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 3""")
def top_categories(spark, d):
    return prof.top_categories(read_table(spark, d, "part"), category="p_brand")


@query("""SELECT p_type, round(avg(p_retailprice), 4) AS avg_price, round(avg(p_size), 4) AS avg_size, round(avg(p_retailprice - p_size), 4) AS avg_discount FROM part GROUP BY 1""")
def category_means(spark, d):
    out = prof.means(read_table(spark, d, "part"), {
        "avg_price": "p_retailprice", "avg_size": "p_size", "avg_discount": F.col("p_retailprice") - F.col("p_size")}, keys=["p_type"])
    return rounded(out, "avg_price", "avg_size", "avg_discount")


@query("""SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def preview(spark, d):
    return peek(read_table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey"))


# ---- detection and validation ---------------------------------------------------------


def readable(c: str) -> str:
    return f"count({c}) = count(TRY_CAST({c} AS TIMESTAMP))"


@query(f"""SELECT CAST(0 AS INTEGER) AS position, 'event_id' AS "column", false AS by_name, false AS by_values FROM events HAVING count(*) >= 0
UNION ALL SELECT 1, 'seen_at', false, {readable("CAST(ts AS VARCHAR)")} FROM events
UNION ALL SELECT 2, 'event_type', false, {readable("event_type")} FROM events
UNION ALL SELECT 3, 'day_of_month', true, false FROM events HAVING count(*) >= 0""")
def date_candidates(spark, d):
    t = events(spark, d).select("event_id", F.col("ts").cast("string").alias("seen_at"), "event_type", F.dayofmonth("ts").alias("day_of_month"))
    return check.date_candidates(t)


@query(f"""SELECT CASE WHEN {readable("CAST(ts AS VARCHAR)")} THEN 'seen_at' ELSE 'day_of_month' END AS "column" FROM events""")
def detect_date(spark, d):
    t = events(spark, d).select("event_id", "event_type", F.col("ts").cast("string").alias("seen_at"), F.dayofmonth("ts").alias("day_of_month"))
    return check.detect_date(t)


TARGETS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""WITH v AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, var_samp({c}) AS v FROM lineitem" for c in (*TARGETS, "l_orderkey", "l_partkey", "l_suppkey"))})
SELECT arg_max(c, v) AS "column" FROM v""")
def detect_target(spark, d):
    return check.detect_target(read_table(spark, d, "lineitem"))


@query("""SELECT CAST(o_orderdate AS DATE) AS ts, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1""")
def daily_total_detected(spark, d):
    """The daily total with time and target columns found by name alone."""
    t = read_table(spark, d, "orders")
    ts, y = check.detect_by_name(t)
    return t.groupBy(F.to_date(ts).alias("ts")).agg(r(F.sum(y), 2).alias("y"))


@query("""SELECT CAST(ts AS DATE) AS ts, round(sum(value), 2) AS y FROM events GROUP BY 1""")
def daily_total_first_date(spark, d):
    """The daily total with the first column as time if it reads as one."""
    t = events(spark, d).select(F.col("ts").cast("string").alias("seen_at"), "event_id", "user_id", "value")
    ts, y = check.detect_first_date(t)
    return t.groupBy(F.to_date(ts).alias("ts")).agg(r(F.sum(y), 2).alias("y"))


@query("""SELECT CAST(o_orderdate AS DATE) AS ts, max(o_orderkey) AS top FROM orders GROUP BY 1""")
def daily_max_fallback(spark, d):
    """Columns that do not exist give way to a date by name and the first number."""
    t = read_table(spark, d, "orders")
    ts, y = check.fallback_columns(t, "no_such_time", "no_such_target")
    return t.groupBy(F.to_date(ts).alias("ts")).agg(F.max(pick_target(t, y)).alias("top"))


REPORT = """r AS (SELECT o_orderpriority AS k, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS y, CAST(o_orderdate AS DATE) AS ts FROM orders),
f AS (SELECT k, count(*) AS n, count(y) AS known, count(*) - count(DISTINCT ts) AS repeats, max(ts) - min(ts) + 1 AS days, count(DISTINCT ts) AS present,
  min(ts) AS lo, max(ts) AS hi, avg(y) AS m, stddev_samp(y) AS sd, min(y) AS least_y, max(y) AS most_y FROM r GROUP BY 1),
o AS (SELECT f.k, count(*) FILTER (WHERE abs((y - m) / sd) > 3) AS far FROM r JOIN f ON r.k = f.k GROUP BY 1)"""


@query(f"""WITH {REPORT}
SELECT f.k AS o_orderpriority, true AS is_valid,
(CASE WHEN repeats > 0 THEN 'repeated_times:ts:' || repeats || '|' ELSE '' END)
|| (CASE WHEN days > present THEN format('missing_days:ts:{{}}:{{:.2f}}|', days - present, (days - present) * 100.0::DOUBLE / days) ELSE '' END)
|| (CASE WHEN n > known THEN format('missing_values:y:{{}}:{{:.2f}}|', n - known, (n - known) * 100.0::DOUBLE / n) ELSE '' END)
|| (CASE WHEN n < 30 THEN format('few_rows:{{}}|', n) ELSE '' END)
|| (CASE WHEN far > 0 THEN format('outliers:y:{{}}:{{:.2f}}|', far, far * 100.0::DOUBLE / n) ELSE '' END) AS warnings,
CAST(0 AS INTEGER) AS n_errors, n AS "rows", strftime(lo, '%Y-%m-%d') AS start_date, strftime(hi, '%Y-%m-%d') AS end_date, CAST(days - 1 AS BIGINT) AS date_range_days,
round(m, 4) AS target_mean, round(sd, 4) AS target_std, least_y AS target_min, most_y AS target_max,
round((days - present) * 100.0::DOUBLE / days, 6) AS missing_dates_percentage, round((n - known) * 100.0::DOUBLE / n, 6) AS missing_target_percentage
FROM f JOIN o ON f.k = o.k""")
def validation_report(spark, d):
    """Orders per priority, with the price of pending orders unknown."""
    t = orders(spark, d).withColumn("y", F.when(F.col("o_orderstatus") != "P", F.col("y")))
    out = check.validate(t, ts="ts", y="y", keys=PRIORITY)
    percent = lambda w: F.when(w["percent"].isNotNull(), F.format_string("%.2f", w["percent"]))
    line = lambda w: F.concat(F.concat_ws(":", w["code"], w["column"], w["count"].cast("string"), percent(w)), F.lit("|"))
    lines = F.array_join(F.transform("warnings", line), "")
    flat = out.select(*PRIORITY, "is_valid", lines.alias("warnings"), F.size("errors").alias("n_errors"), "statistics.*")
    return rounded(rounded(flat, "target_mean", "target_std"), "missing_dates_percentage", "missing_target_percentage", digits=6)


@query("""SELECT 'PASSED' AS verdict, CAST(0 AS INTEGER) AS n_errors,
CAST((count(*) > count(DISTINCT o_orderdate))::INTEGER + (max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) + 1 > count(DISTINCT CAST(o_orderdate AS DATE)))::INTEGER + (count(*) < 30)::INTEGER AS INTEGER) AS n_warnings FROM orders""")
def validation_summary(spark, d):
    """The whole table with its time and target columns detected."""
    report = check.validate(read_table(spark, d, "orders"))
    return check.report_summary(report).select("verdict", "n_errors", "n_warnings")


@query("""SELECT 'FAILED' AS verdict, CAST(1 AS INTEGER) AS n_errors, 'unreadable_times' AS error, count(*) AS rows_hit FROM events WHERE try_cast(event_type AS TIMESTAMP) IS NULL HAVING count(*) > 0""")
def validation_bad_time(spark, d):
    """A text column that holds no times, named as the time column."""
    report = check.validate(events(spark, d), ts="event_type", y="value")
    error = F.from_json("report_json", f"errors array<{check.FINDING}>")["errors"][0]
    return check.report_summary(report).select("verdict", "n_errors", error["code"].alias("error"), error["count"].alias("rows_hit"))


@query("""SELECT count(*) < 0 AS is_summary FROM events""")
def summary_file_check(spark, d):
    """A forecast frame starts with dates, not with model names."""
    return check.looks_like_models(daily_by_priority(spark, d).select("ts", "y"))
