"""Hand-made frames with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import cleaning
from seriesloom.operators import clean, frames, lags, metrics, profile, timeaxis, validate
from seriesloom.operators.decompose import centred_mean
from seriesloom.operators.fill import fill_gaps
from seriesloom.operators.ordering import series_window
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.operators.split import chrono_split, cv_folds
from seriesloom.plans import prepare


def series(spark, values, start=dt.date(2024, 1, 1), key=None):
    rows = [(start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ts date, y double")
    return df if key is None else df.withColumn("k", F.lit(key))


def column(df, name="y", order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("grain", ["bin", "row"])
def test_interpolation_by_position(spark, grain):
    df = series(spark, [None, 1, None, None, 4, None])
    line = fill_gaps(df, ["y"], ts="ts", grain=grain, method="linear")
    assert column(line) == [None, 1, 2, 3, 4, 4]
    assert column(fill_gaps(df, ["y"], ts="ts", grain=grain, method="linear_bfill")) == [1, 1, 2, 3, 4, 4]
    assert column(fill_gaps(df, ["y"], ts="ts", grain=grain)) == [1, 1, 1, 1, 4, 4]


@pytest.mark.parametrize("grain", ["bin", "row"])
def test_rolling_needs_a_full_frame(spark, grain):
    out = lags.add_rolling(series(spark, [1, 2, None, 4, 5, 6]), ts="ts", y="y", grain=grain, windows=(3,))
    assert column(out, "y_rolling_mean_3") == [None, None, None, None, None, 5]


def test_centred_mean_of_odd_width(spark):
    df = series(spark, [1, 2, 4, 8, 16, 32, 64, 128])
    out = df.withColumn("m", centred_mean("y", series_window([], ["ts"]), 5))
    assert [None if v is None else round(v, 9) for v in column(out, "m")] == [None, None, 6.2, 12.4, 24.8, 49.6, None, None]


def test_moments_and_quantiles(spark):
    df = series(spark, [1, 2, 2, 3, 9, 12])
    for grain in ("bin", "row"):
        got = profile.moments(df, y="y", grain=grain).first()
        assert got["skewness"] == pytest.approx(1.0692874521)
        assert got["kurtosis"] == pytest.approx(-0.7963193053)
        assert got["median"] == 2.5
        assert exact_quantiles(df, ["y"], qs=[0.25], grain=grain).first()["quantile"] == 2.0


def test_bins(spark):
    rows = [("2024-01-01", 1.0), ("2024-01-03", 2.0), ("2024-01-09", 3.0), ("2024-01-20", 4.0)]
    df = spark.createDataFrame(rows, "ts string, y double").withColumn("ts", F.to_date("ts"))
    week = timeaxis.to_grain(df, ts="ts", y="y", freq="W", empty_bins=True)
    assert [(str(r["ts"]), r["y"]) for r in week.orderBy("ts").collect()] == [("2024-01-07", 1.5), ("2024-01-14", 3.0), ("2024-01-21", 4.0)]
    month = timeaxis.to_grain(df, ts="ts", y="y", freq="M").first()
    assert (str(month["ts"]), month["y"]) == ("2024-01-31", 2.5)


@pytest.mark.parametrize(("n", "share", "train"), [(10, 0.9, 0), (365, 0.2, 292)])
def test_split_sizes(spark, n, share, train):
    for grain in ("bin", "row"):
        out = chrono_split(series(spark, range(n)), ts="ts", grain=grain, test_size=share)
        assert out.where("split = 'train'").count() == train


def test_folds_never_train_on_later_rows(spark):
    out = cv_folds(series(spark, range(20)), ts="ts", grain="bin")
    edges = out.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("b"))
    assert all(r["a"] < r["b"] for r in edges.collect()) and edges.count() == 5


def test_keep_last_by_tie_break(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 5.0), ("2024-01-01", 2, 7.0)], "ts string, id int, y double")
    assert timeaxis.keep_last(df, ts="ts", tie=["id"]).first()["y"] == 7.0


def test_scores_with_a_zero_actual(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "actual double, forecast double")
    plain, guarded = metrics.score(df).first(), metrics.score(df, guarded=True).first()
    assert plain["mape"] is None and plain["mae"] == 1 and plain["r2"] == pytest.approx(1 - 3 / 8)
    assert guarded["mape"] == pytest.approx(37.5)
    assert guarded["smape"] == pytest.approx((2 + 2 / 3 + 2 / 9) / 3 * 100)


def test_blend_cuts_to_the_shortest(spark):
    rows = [("a", i, dt.date(2024, 1, i), 1.0) for i in range(1, 31)] + [("b", i, dt.date(2024, 1, i), 5.0) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "model string, step int, date date, forecast double")
    out = metrics.blend(df, models=["a", "b"], weights=[1, 3])
    assert out.count() == 20 and {r["forecast"] for r in out.collect()} == {4.0}
    alone = metrics.blend(df, models=["a"])
    assert alone.count() == 30 and {r["forecast"] for r in alone.collect()} == {1.0}


def test_text_to_numbers(spark):
    df = spark.createDataFrame([("₹1,099", "64%", "4.2", "24,269"), ("abc", " ", "|", ""), (None, None, None, None)], "p string, d string, r string, n string")
    out = df.select(cleaning.price("p"), cleaning.percent("d"), cleaning.rating("r"), cleaning.count_text("n")).collect()
    assert tuple(out[0]) == (1099.0, 64.0, 4.2, 24269.0)
    assert tuple(out[1]) == (None,) * 4 and tuple(out[2]) == (None,) * 4
    years = spark.createDataFrame([(1899,), (1900,), (2026,)], "y int").select(cleaning.within("y", 1900, 2025))
    assert [r[0] for r in years.collect()] == [None, 1900, None]


def test_offset_times_become_utc(spark):
    df = spark.createDataFrame([("Tue Dec 16 2014 12:30:00 GMT-0800 (PST)",), ("no time",)], "ts string")
    out = clean.parse_time(df, ts="ts", lenient=True).select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("t")).collect()
    assert [r["t"] for r in out] == ["2014-12-16 20:30"]


def test_strict_time_fails(spark):
    df = spark.createDataFrame([("no time",)], "ts string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        clean.parse_time(df, ts="ts").collect()


def test_validation_branches(spark):
    empty = spark.createDataFrame([], "ts date, y double")
    assert validate.validate(empty, ts="ts", y="y").first()["errors"][0]["code"] == "empty_table"
    no_date = spark.createDataFrame([(1, 2.0)], "a int, y double")
    assert validate.validate(no_date).first()["errors"][0]["code"] == "no_date_column"
    text = spark.createDataFrame([("2024-01-01", "x")], "ts string, y string")
    assert validate.validate(text, ts="ts", y="y").first()["errors"] == [("target_not_numeric", "y", None, None)]
    assert validate.validate(text, ts="ts", y="z").first()["errors"] == [("target_column_not_found", "z", None, None)]
    few = validate.validate(series(spark, range(29)), ts="ts", y="y").first()
    assert few["is_valid"] and few["warnings"] == [("few_rows", None, 29, None)]
    assert few["statistics"]["rows"] == 29 and few["statistics"]["end_date"] == "2024-01-29"


def test_detection_rules(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 5.0, 900.0)], "id int, seen string, price double, noise double")
    assert validate.detect_date(df).first()["column"] == "seen"
    assert validate.detect_by_name(df) == (None, "price")
    assert validate.fallback_columns(df, "gone", "gone") == (None, "id")
    two = df.unionByName(spark.createDataFrame([(2, "2024-01-02", 6.0, 100.0)], df.schema))
    assert validate.detect_target(two).first()["column"] == "noise"


def test_forecast_names():
    assert frames.forecast_column(["date", "pred", "prediction"]) == "prediction"
    assert frames.forecast_column(["date", "my_forecast"]) == "my_forecast"
    assert frames.bound_columns(["x_lower", "x_upper"]) == ("x_lower", "x_upper")


def test_narrowing(spark):
    df = spark.createDataFrame([(1.0, 1.5, 2.0), (None, 2.0, 3.0)], "a double, b double, y double")
    assert dict(clean.narrow_integers(df, skip=["y"]).dtypes) == {"a": "bigint", "b": "double", "y": "double"}


def test_frequency_names(spark):
    for step, name in ((1, "D"), (7, "W"), (2, "2D")):
        days = spark.createDataFrame([(dt.date(2024, 1, 7) + dt.timedelta(days=step * i),) for i in range(5)], "ts date")
        assert timeaxis.infer_frequency(days, ts="ts").first()["freq"] == name
    two = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "ts date")
    assert timeaxis.infer_frequency(two, ts="ts").first()["freq"] is None


def test_texts_stay_where_nothing_is_averaged(spark):
    """A series that is not resampled keeps its other columns; an averaged one loses them."""
    days = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i), f"{k}{i}") for k in ("whole", "gap") for i in range(40) if k == "whole" or i % 10 != 5]
    out = prepare.prepare_generic(spark.createDataFrame(days, "k string, ts date, y double, note string"), ts="ts", y="y", keys=["k"])
    notes = {(r["k"], r["action"]): r["n"] for r in out.groupBy("k", "action").agg(F.count("note").alias("n")).collect()}
    assert notes == {("whole", "regular"): 40, ("gap", "resampled_D"): 0}


def test_date_is_found_by_name_before_values_are_read(spark):
    """Only text columns before the first hit by name or type are parsed."""
    plan = lambda df: validate.detect_date(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    wide = spark.createDataFrame([("2024-01-01", "x", "2024-01-02")], "order_date string, note string, seen string")
    assert validate.detect_date(wide).first()["column"] == "order_date" and "seen" not in plan(wide) and "note" not in plan(wide)
    late = wide.select("note", "seen", "order_date")
    assert validate.detect_date(late).first()["column"] == "seen" and plan(late).count("order_date#") <= 1  # the scan only
    assert validate.detect_date(late.select("note", "order_date")).first()["column"] == "order_date"
    assert validate.detect_date(late.select("note")).first()["column"] is None
    typed = wide.selectExpr("1 AS n", "current_date() AS d", "seen")
    assert validate.detect_date(typed).first()["column"] == "d"
