"""The whole way in one query: grain, gaps, fill, lag, split, regression, forecast scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.catalogue.base import PRIORITY, interpolated, orders, query, rounded
from seriesloom.models.leastsq import least_squares
from seriesloom.operators.fill import fill_gaps
from seriesloom.operators.lags import add_lags
from seriesloom.operators.metrics import score
from seriesloom.operators.ordering import join_on_keys
from seriesloom.operators.split import chrono_split
from seriesloom.operators.timeaxis import to_grain


@query(f"""WITH daily AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
ends AS (SELECT o_orderpriority, min(ts) AS lo, max(ts) AS hi FROM daily GROUP BY 1),
spine AS (SELECT o_orderpriority, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM ends),
gapped AS (SELECT spine.o_orderpriority, spine.ts, daily.y FROM spine LEFT JOIN daily USING (o_orderpriority, ts)), {interpolated("gapped", PRIORITY)},
n AS (SELECT o_orderpriority, ts, y, t, lag(y) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS b, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM filled),
s AS (SELECT *, t < floor(n * 0.8::DOUBLE) AS train FROM n),
f AS (SELECT o_orderpriority, regr_intercept(y, b) AS a, regr_slope(y, b) AS s FROM s WHERE train AND b IS NOT NULL GROUP BY 1)
SELECT s.o_orderpriority, count(*) AS n_test, round(any_value(f.s), 6) AS slope, round(avg(abs(y - a - f.s * b)), 2) AS mae, round(sqrt(avg((y - a - f.s * b) ** 2)), 2) AS rmse
FROM s JOIN f ON s.o_orderpriority = f.o_orderpriority WHERE NOT train GROUP BY 1""")
def flagship(spark, d):
    where = {"ts": "ts", "keys": PRIORITY}
    days = to_grain(orders(spark, d), y="y", how="sum", empty_bins=True, **where)
    filled = fill_gaps(days, ["y"], grain="bin", method="linear", **where)
    split = chrono_split(filled, grain="bin", **where)
    rows = add_lags(split, y="y", lags=[1], name="lag_{k}", grain="bin", **where).dropna()
    fitted = least_squares(rows.where("split = 'train'"), ["lag_1"], "y", keys=PRIORITY)
    guess = F.col("intercept") + F.col("coef")[0] * F.col("lag_1")
    test = join_on_keys(rows.where("split = 'test'"), fitted.select(*PRIORITY, "intercept", "coef"), PRIORITY).withColumn("forecast", guess)
    sized = test.withColumn("n_test", F.count(F.lit(1)).over(Window.partitionBy(*PRIORITY)))
    scores = score(sized, by=[*PRIORITY, "n_test", "coef"], actual="y")
    out = scores.select(*PRIORITY, "n_test", F.col("coef")[0].alias("slope"), "mae", "rmse")
    return rounded(rounded(out, "slope", digits=6), "mae", "rmse", digits=2)
