"""Models against direct computations on small series, and their properties."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.models import arima, leastsq, registry, smoothing, trees
from seriesloom.models.stationarity import adf, p_value
from seriesloom.models.trendseason import trend_season
from seriesloom.operators import correlate
from seriesloom.operators.decompose import seasonal_decompose
from seriesloom.plans.forecasting import forecast_run

RNG = np.random.default_rng(11)
START = dt.date(2023, 1, 1)


def frame(spark, **named):
    rows = [(k, START + dt.timedelta(days=i), float(v)) for k, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts date, y double")


W = {"ts": "ts", "y": "y", "keys": ["k"]}


def walk(n, phi=0.6):
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + RNG.normal()
    return y + 10


def test_noiseless_regression_and_its_forecast(spark):
    y = 8.0 * 0.5 ** np.arange(12)
    fitted = leastsq.fit_lag_regression(frame(spark, a=y), n_lags=1, calendar=False, **W)
    row = fitted.first()
    assert row["coef"][0] == pytest.approx(0.5) and row["intercept"] == pytest.approx(0, abs=1e-9)
    out = leastsq.forecast_lag_regression(fitted, keys=["k"], steps=3, n_lags=1, calendar=False).orderBy("step").collect()
    assert [r["forecast"] for r in out] == pytest.approx([y[-1] / 2, y[-1] / 4, y[-1] / 8])
    assert [r["date"] for r in out] == [START + dt.timedelta(days=11 + i) for i in (1, 2, 3)]


@pytest.mark.parametrize("n_lags", [2, 15])
def test_regression_matches_a_direct_solve(spark, n_lags):
    """Few inputs take the summed path, many the matrix path."""
    y = {k: walk(120) for k in "ab"}
    rows = leastsq.model_features(frame(spark, **y), n_lags=n_lags, calendar=False, **W)
    got = {r["k"]: r for r in leastsq.least_squares(rows, leastsq.lag_names(n_lags), "y", keys=["k"]).collect()}
    for k, v in y.items():
        x = np.column_stack([np.ones(len(v) - n_lags)] + [v[n_lags - i:len(v) - i] for i in range(1, n_lags + 1)])
        beta, sse, *_ = np.linalg.lstsq(x, v[n_lags:], rcond=None)
        assert [got[k]["intercept"], *got[k]["coef"]] == pytest.approx(beta, rel=1e-5, abs=1e-6)
        assert got[k]["sse"] == pytest.approx(sse[0], rel=1e-6) and got[k]["n"] == len(x)


def direct_adf(y):
    """The test on one series by plain regressions."""
    d, top = np.diff(y), int(np.ceil(12 * (len(y) / 100) ** 0.25))

    def fit(k, first):
        rows = np.arange(first, len(d))
        x = np.column_stack([np.ones(len(rows)), y[rows]] + [d[rows - i] for i in range(1, k + 1)])
        beta = np.linalg.lstsq(x, d[rows], rcond=None)[0]
        sse = ((d[rows] - x @ beta) ** 2).sum()
        return x, beta, sse
    aic = []
    for k in range(top + 1):
        x, _, sse = fit(k, top)
        aic.append(len(x) * np.log(sse / len(x)) + 2 * x.shape[1])
    k = int(np.argmin(aic))
    x, beta, sse = fit(k, k)
    error = np.sqrt(sse / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return beta[1] / error, k, len(x)


def test_adf_matches_direct_regressions(spark):
    y = {"still": walk(150, 0.3), "wander": np.cumsum(RNG.normal(size=90)), "short": walk(40)}
    got = {r["k"]: r for r in adf(frame(spark, **y), **W).collect()}
    for k, v in y.items():
        statistic, lags, n = direct_adf(v)
        assert (got[k]["lags"], got[k]["n_obs"]) == (lags, n)
        assert got[k]["statistic"] == pytest.approx(statistic, rel=1e-6)
    assert got["still"]["stationary"] and got["still"]["p_value"] < 0.01


def test_p_values_at_the_published_critical_points():
    assert p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    assert p_value(-2.86) == pytest.approx(0.05, abs=0.001)
    assert p_value(-2.57) == pytest.approx(0.10, abs=0.002)


def test_autocorrelations(spark):
    y = walk(80)
    c = y - y.mean()
    rho = np.array([(c[k:] * c[:len(c) - k]).sum() for k in range(11)]) / (c * c).sum()
    got = correlate.acf(frame(spark, a=y), grain="bin", n_lags=10, **W).orderBy("lag").collect()
    assert [r["acf"] for r in got] == pytest.approx(rho)
    want = [np.linalg.solve([[rho[abs(i - j)] for j in range(k)] for i in range(k)], rho[1:k + 1])[-1] for k in range(1, 11)]
    part = correlate.pacf(frame(spark, a=y), grain="bin", n_lags=10, **W).orderBy("lag").collect()
    assert [r["pacf"] for r in part] == pytest.approx(want)


def test_decomposition_adds_up(spark):
    y = np.tile([1.0, 5.0, 2.0, 4.0], 10) + np.arange(40)
    out = seasonal_decompose(frame(spark, a=y), grain="bin", period=4, **W).where("trend is not null").collect()
    assert all(r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["y"]) for r in out)
    assert max(abs(r["residual"]) for r in out) < 1e-9


def test_arima_recovers_an_autoregression(spark):
    y = 3 + 5.0 * 0.8 ** np.arange(40)
    row = arima.fit_arima(frame(spark, a=y), orders=[(1, 0, 0)], **W).first()
    assert row["coef"] == pytest.approx([3 * 0.2, 0.8], rel=1e-5)


def test_search_returns_the_lowest_aic(spark):
    df = frame(spark, a=walk(200), b=np.cumsum(RNG.normal(size=200)))
    every = arima.fit_arima(df, orders=arima.ARIMA_GRID, **W).toPandas()
    assert len(every) == 2 * 18
    best = arima.search_arima(df, **W).toPandas().set_index("k")
    for k, part in every.groupby("k"):
        assert best.loc[k, "aic"] == part["aic"].min()


def test_two_stage_arima_matches_a_direct_computation(spark):
    y = walk(160)
    row = arima.fit_arima(frame(spark, a=y), orders=[(1, 0, 1)], long_lags=6, **W).first()
    x = np.column_stack([np.ones(len(y) - 6)] + [y[6 - i:len(y) - i] for i in range(1, 7)])
    e = np.full(len(y), np.nan)
    e[6:] = y[6:] - x @ np.linalg.lstsq(x, y[6:], rcond=None)[0]
    z = np.column_stack([np.ones(len(y) - 7), y[6:-1], e[6:-1]])
    assert row["coef"] == pytest.approx(np.linalg.lstsq(z, y[7:], rcond=None)[0], rel=1e-5)
    ahead = arima.forecast_arima(arima.fit_arima(frame(spark, a=y), orders=[(1, 0, 1)], long_lags=6, **W), keys=["k"], steps=2).orderBy("step").collect()
    c, phi, theta = row["coef"]
    first = c + phi * y[-1] + theta * e[-1]
    assert [r["forecast"] for r in ahead] == pytest.approx([first, c + phi * first])


def test_seasonal_difference_repeats_a_pure_season(spark):
    y = np.tile(np.arange(12.0), 6)
    fitted = arima.fit_arima(frame(spark, a=y + RNG.normal(scale=1e-6, size=72)), orders=[(0, 0, 0, 0, 1, 0, 12)], **W)
    out = arima.forecast_arima(fitted, keys=["k"], steps=12).orderBy("step").collect()
    assert [r["forecast"] for r in out] == pytest.approx(y[:12], abs=1e-3)


def test_smoothing_by_hand(spark):
    y = [3.0, 5.0, 4.0, 6.0]
    row = smoothing.fit_smoothing(frame(spark, a=y), weights={"alpha": 0.5}, **W).first()
    level, sse = 3.0, 0.0
    for v in y[1:]:
        sse += (v - level) ** 2
        level = 0.5 * v + 0.5 * level
    assert (row["level"], row["sse"]) == (pytest.approx(level), pytest.approx(sse))


def test_smoothing_keeps_a_line_and_a_season(spark):
    y = 2.0 * np.arange(40) + np.tile([0.0, 3.0, -1.0, -2.0], 10)
    fitted = smoothing.fit_smoothing(frame(spark, a=y), trend="add", seasonal="add", period=4, **W)
    out = smoothing.forecast_smoothing(fitted, keys=["k"], steps=8, trend="add", seasonal="add", period=4).orderBy("step").collect()
    want = 2.0 * np.arange(40, 48) + np.tile([0.0, 3.0, -1.0, -2.0], 2)
    assert [r["forecast"] for r in out] == pytest.approx(want, abs=1.0)


def test_smoothing_search_is_no_worse_than_fixed_weights(spark):
    df = frame(spark, a=walk(60))
    searched = smoothing.fit_smoothing(df, **W).first()["sse"]
    assert all(searched <= smoothing.fit_smoothing(df, weights={"alpha": a}, **W).first()["sse"] + 1e-9 for a in (0.1, 0.5, 0.9))


def test_variants_follow_the_verdict(spark):
    df = frame(spark, still=walk(60), wander=np.cumsum(RNG.normal(size=60)) + np.arange(60), brief=np.cumsum(np.arange(20.0)))
    verdict = spark.createDataFrame([("still", True), ("wander", False), ("brief", False)], "k string, stationary boolean")
    out = smoothing.choose_variants(df, verdict, keys=["k"]).collect()
    assert sorted((r["k"], r["trend"] or "", r["seasonal"] or "") for r in out) == [
        ("brief", "add", ""), ("still", "", ""), ("wander", "add", ""), ("wander", "add", "add")]


def test_trend_and_season_follow_a_clean_series(spark):
    days = np.arange(800)
    y = 50 + 0.05 * days + 5 * np.sin(2 * np.pi * days / 7)
    out = trend_season(frame(spark, a=y), yearly=False, steps=14, **W).orderBy("step").collect()
    ahead = np.arange(800, 814)
    assert [r["forecast"] for r in out] == pytest.approx(50 + 0.05 * ahead + 5 * np.sin(2 * np.pi * ahead / 7), abs=1.5)
    assert all(r["forecast_lower"] < r["forecast"] < r["forecast_upper"] for r in out)


def test_holidays_lift_their_days(spark):
    y = np.full(400, 10.0)
    special = np.arange(20, 400, 40)
    y[special] += 6
    holidays = spark.createDataFrame([(START + dt.timedelta(days=int(i)), "fair") for i in [*special, 405]], "ds date, holiday string")
    out = trend_season(frame(spark, a=y), holidays=holidays, steps=10, yearly=False, weekly=False, **W).orderBy("step").collect()
    values = [r["forecast"] for r in out]
    assert values[5] == pytest.approx(16, abs=0.8) and values[0] == pytest.approx(10, abs=0.8)


def test_keyed_run_equals_single_runs(spark):
    y = {k: walk(70) for k in "abc"}
    both = leastsq.fit_lag_regression(frame(spark, **y), n_lags=2, calendar=False, **W)
    together = {r["k"]: r["coef"] for r in both.collect()}
    for k, v in y.items():
        alone = leastsq.fit_lag_regression(frame(spark, **{k: v}), ts="ts", y="y", n_lags=2, calendar=False).first()
        assert together[k] == pytest.approx(alone["coef"])


def test_trees_forecast_and_save(spark, tmp_path):
    df = frame(spark, a=np.tile([1.0, 4.0], 60), b=np.tile([10.0, 40.0], 60))
    model = registry.MODELS["rf"](n_lags=2, options={"numTrees": 5, "calendar": False}, **W)
    model.fit(df)
    fitted, scales = model.model, model.scales
    out = trees.forecast_trees(fitted, scales, df, steps=4, n_lags=2, calendar=False, **W)
    got = {k: [r["forecast"] for r in out.where(F.col("k") == k).orderBy("step").collect()] for k in "ab"}
    assert got["a"] == pytest.approx([1, 4, 1, 4], abs=0.3) and got["b"] == pytest.approx([10, 40, 10, 40], abs=3)
    again = registry.MODELS["rf"](n_lags=2, **W).load(spark, model.save(str(tmp_path / "m")))
    assert again.model.getNumTrees == 5


def test_runs_isolate_failures(spark):
    def broken(**_):
        raise RuntimeError("no such thing")
    registry.register("broken", broken)
    df = frame(spark, a=walk(60), tiny=[1.0, 2.0])
    made, status = registry.run_models(df, ["lr", "broken", "nobody"], steps=3, **W)
    seen = {(r["requested"], r["k"]): r["status"] for r in status.collect()}
    assert seen == {("lr", "a"): "ok", ("lr", "tiny"): "no forecast", ("broken", "a"): "failed", ("broken", "tiny"): "failed",
                    ("nobody", "a"): "unknown model", ("nobody", "tiny"): "unknown model"}
    assert made.count() == 3
    del registry.MODELS["broken"]


def test_whole_run(spark):
    run = forecast_run(frame(spark, a=walk(120), b=walk(120)), models=["arima", "lr"], steps=5, **W)
    assert run.scores.count() == 6 and run.best.count() == 6
    assert {r["model"] for r in run.forecasts.select("model").distinct().collect()} == {"ARIMA(1,1,1)", "LR", "ensemble"}
    first = run.forecasts.agg(F.min("date")).first()[0]
    assert first == START + dt.timedelta(days=96)


def test_grid_search_ranks_by_error(spark):
    df = frame(spark, a=walk(80))
    out = trees.grid_search(df, grid={"numTrees": (3,), "maxDepth": (1, 3)}, n_splits=2, n_lags=2, calendar=False, **W).orderBy("rank").collect()
    assert len(out) == 2 and out[0]["neg_mse"] >= out[1]["neg_mse"]


@pytest.mark.parametrize("level", [0.0, 1e6, 1e9])
@pytest.mark.parametrize("wide", [False, True])
def test_least_squares_on_a_high_level(spark, monkeypatch, level, wide):
    """Slopes and errors are those of a direct solve of centred data, whatever the level."""
    monkeypatch.setattr(leastsq, "MOST_SUMS", 0 if wide else 100)
    rng = np.random.default_rng(4)
    y = np.zeros(300)
    for t in range(1, 300):
        y[t] = 0.5 * y[t - 1] + rng.normal()
    rows = [("a" if t < 150 else None, float(level + y[t - 1]), float(rng.normal()), float(level + y[t])) for t in range(1, 300)]
    rows.append(("a", float("nan"), 1.0, 1.0))
    df = spark.createDataFrame(rows, "k string, x1 double, x2 double, y double").repartition(3)
    found = {r["k"]: r for r in leastsq.least_squares(df, ["x1", "x2"], "y", keys=["k"]).collect()}
    for k in ("a", None):
        part = np.array([r[1:] for r in rows[:-1] if r[0] == k])
        x, target = part[:, :2] - part[:, :2].mean(axis=0), part[:, 2] - part[:, 2].mean()
        beta, sse, _, _ = np.linalg.lstsq(x, target, rcond=None)
        assert found[k]["n"] == len(part)
        assert found[k]["coef"] == pytest.approx(list(beta), rel=1e-4) and found[k]["sse"] == pytest.approx(sse[0], rel=1e-4)
        assert found[k]["intercept"] == pytest.approx(part[:, 2].mean() - beta @ part[:, :2].mean(axis=0), rel=1e-4, abs=1e-6)
    assert leastsq.least_squares(df.where("k = 'none'"), ["x1", "x2"], "y").count() == 0


def test_a_bad_series_leaves_the_good_one(spark):
    bad = walk(60)
    bad[59] = float("nan")
    made, status = registry.run_models(frame(spark, a=walk(60), b=bad), ["arima", "lr"], steps=3, **W)
    seen = {(r["requested"], r["k"]): r["status"] for r in status.collect()}
    assert seen["arima", "a"] == seen["lr", "a"] == "ok"
    assert seen["lr", "b"] != "failed" and made.where("k = 'a'").count() == 6


def test_weights_go_with_names(spark):
    """The order of the models changes nothing, and a null key has its scores."""
    df = frame(spark, a=walk(120), b=[2 * v for v in walk(120)])
    df = df.withColumn("k", F.when(F.col("k") == "a", F.col("k")))
    runs = [forecast_run(df, models=names, weights={"lr": 1.0, "arima_search": 0.0, "ets": 3.0}, steps=5, options=None, **W) for names in (["lr", "arima_search", "ets"], ["ets", "lr", "arima_search"])]
    first, second = ({(r["k"], r["step"]): r["forecast"] for r in run.forecasts.where("model = 'ensemble'").collect()} for run in runs)
    assert len(first) == 10 and first == pytest.approx(second)
    single = {(r["k"], r["step"], r["requested"]): r["forecast"] for r in runs[0].forecasts.collect()}
    for (k, step), value in first.items():
        assert value == pytest.approx(0.25 * single[k, step, "lr"] + 0.75 * single[k, step, "ets"])
    assert {r["k"] for r in runs[0].scores.collect()} == {None, "a"}
    with pytest.raises(ValueError):
        forecast_run(df, models=["lr", "ets"], weights={"lr": 1.0}, steps=5, **W)


def arma(n, phi, theta, seed):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(1, n + 200):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return w[200:]


def test_third_stage_halves_the_error(spark):
    """Simulated ARMA(1, 1) series of 2,000 rows: the mean error of both coefficients."""
    truth = {f"{phi}|{theta}|{k}": (phi, theta) for phi, theta in ((0.6, 0.9), (0.5, -0.9), (-0.4, 0.95)) for k in range(3)}
    df = frame(spark, **{name: 5 + arma(2000, phi, theta, i) for i, (name, (phi, theta)) in enumerate(truth.items())})
    errors = {}
    for stage, refine in ((2, False), (3, True)):
        rows = arima.search_arima(df, orders=[(1, 0, 1)], refine=refine, **W).collect()
        assert len(rows) == len(truth)
        errors[stage] = np.mean([np.abs(np.array(r["coef"][1:]) - truth[r["k"]]).mean() for r in rows])
    assert errors[3] < 0.5 * errors[2], errors


def test_third_stage_is_a_minimum():
    """No small change of a coefficient lowers the sum of squares of plainly computed shocks."""
    w = arma(400, 0.5, 0.6, 7) + 2

    def squares(beta):
        e = np.zeros(len(w))
        for t in range(1, len(w)):
            e[t] = w[t] - beta[0] - beta[1] * w[t - 1] - beta[2] * e[t - 1]
        return e @ e, e

    beta, found = arima.third_stage(w, np.array([0.5, 0.3, 0.1]), [1], [1], True)
    least, plain = squares(beta)
    assert np.allclose(plain, found)
    for k in range(3):
        for step in (-1e-3, 1e-3):
            assert squares(beta + step * np.eye(3)[k])[0] > least
    seasonal, _ = arima.third_stage(w - 2, np.array([0.1, 1.5, 0.9]), [1], [1, 12], False)
    assert np.isfinite(seasonal).all()


def test_one_series_without_keys(spark):
    w = arma(300, 0.5, 0.6, 8)
    keyed = arima.search_arima(frame(spark, a=w), orders=[(1, 0, 1)], **W).first()
    alone = arima.search_arima(frame(spark, a=w).drop("k"), orders=[(1, 0, 1)], **{k: v for k, v in W.items() if k != "keys"}).first()
    assert np.allclose(keyed["coef"], alone["coef"]) and np.allclose(keyed["last_shocks"], alone["last_shocks"])
