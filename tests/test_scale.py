"""The row path on skewed input against plain computations in memory."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import lags, ordering, quantiles, timeaxis
from seriesloom.operators.fill import fill_gaps

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def skewed():
    """One key and one timestamp each hold more than a third of the rows; some values are unknown."""
    n = 3000
    key = np.where(RNG.random(n) < 0.6, "hot", RNG.choice(list("abc"), n))
    day = np.where(RNG.random(n) < 0.4, 0, RNG.integers(0, 50, n))
    y = np.round(RNG.normal(size=n), 3)
    y[RNG.random(n) < 0.3] = np.nan
    frame = pd.DataFrame({"k": key, "ts": [dt.date(2024, 1, 1) + dt.timedelta(days=int(d)) for d in day], "id": np.arange(n), "y": y})
    return frame.sort_values(["k", "ts", "id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def rows(spark, skewed):
    shuffled = skewed.sample(frac=1, random_state=1).astype({"y": object}).where(lambda f: f.notna(), None)
    return spark.createDataFrame(list(shuffled.itertuples(index=False, name=None)), "k string, ts date, id long, y double").repartition(6)


def by_id(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


def same(left, right):
    assert np.allclose(left.to_numpy(dtype=float), right.to_numpy(dtype=float), equal_nan=True)


def test_positions(rows, skewed):
    out = by_id(ordering.with_position(rows, ts="ts", keys=["k"], tie=["id"], size="n"))
    want = skewed.assign(t=skewed.groupby("k").cumcount(), n=skewed.groupby("k")["id"].transform("size")).sort_values("id")
    assert (out["t"].to_numpy() == want["t"].to_numpy()).all() and (out["n"].to_numpy() == want["n"].to_numpy()).all()


def test_positions_of_equal_rows(spark):
    copies = spark.range(2000).select(F.lit("k").alias("k"), F.lit(1).alias("ts"))
    out = ordering.with_position(copies, ts="ts", keys=["k"]).select("t").toPandas()
    assert sorted(out["t"]) == list(range(2000))


@pytest.mark.parametrize("block", [7, 100, 1_000_000])
def test_blocked_windows(rows, skewed, block):
    def build(w):
        return {"lag": F.lag("y", 3).over(w), "mean": lags.full_frame(F.avg("y"), "y", w.rowsBetween(-4, 0), 5), "ahead": F.lead("y", 2).over(w)}
    out = by_id(ordering.ordered_columns(rows, build, ts="ts", keys=["k"], tie=["id"], back=5, ahead=2, block_rows=block))
    group = skewed.groupby("k")["y"]
    want = skewed.assign(lag=group.shift(3), mean=group.transform(lambda s: s.rolling(5).mean()), ahead=group.shift(-2)).sort_values("id")
    for c in ("lag", "mean", "ahead"):
        same(out[c], want[c])


@pytest.mark.parametrize("block", [5, 1_000_000])
@pytest.mark.parametrize("method", ["ffill_bfill", "linear"])
def test_blocked_fills(rows, skewed, block, method):
    out = by_id(fill_gaps(rows, ["y"], ts="ts", keys=["k"], tie=["id"], method=method, block_rows=block))
    group = skewed.groupby("k")["y"]
    want = skewed.assign(y=group.transform(lambda s: s.ffill().bfill() if method == "ffill_bfill" else s.interpolate())).sort_values("id")
    same(out["y"], want["y"])


def test_exact_quantiles(rows, skewed):
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for grain in ("row", "bin"):
        out = quantiles.exact_quantiles(rows, ["y", "id"], keys=["k"], qs=qs, grain=grain).toPandas()
        assert len(out) == 4 * 2 * len(qs)
        for r in out.itertuples():
            assert r.quantile == pytest.approx(skewed.loc[skewed.k == r.k, r.column].quantile(r.q), abs=1e-9)


def test_quantiles_of_repeated_values(spark):
    df = spark.createDataFrame([(1.0,)] * 700 + [(2.0,)] * 300 + [(5.0,)], "y double")
    got = {r["q"]: r["quantile"] for r in quantiles.exact_quantiles(df, ["y"], qs=(0.5, 0.7, 0.9995)).collect()}
    flat = np.array([1.0] * 700 + [2.0] * 300 + [5.0])
    assert got == {q: pytest.approx(np.quantile(flat, q)) for q in got}


def test_split_of_row_and_bin_agree(rows):
    from seriesloom.operators.split import chrono_split
    a = by_id(chrono_split(rows, ts="ts", keys=["k"], tie=["id"]))
    b = by_id(chrono_split(rows, ts="ts", keys=["k"], tie=["id"], grain="bin"))
    assert (a["split"] == b["split"]).all()


def test_null_key_is_a_series(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 3.0)], "k string, ts int, y double")
    out = ordering.with_position(df, ts="ts", keys=["k"], size="n").toPandas()
    assert sorted(out["n"]) == [1, 2, 2]


def test_shuffle_partitions_do_not_matter(spark, rows):
    seen = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        seen.append(timeaxis.regularise(rows, ts="ts", y="y", keys=["k"], tie=["id"]).toPandas().sort_values(["k", "ts", "y"]).reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(seen[0], seen[1])


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_quantiles_by_range_and_by_window(spark, monkeypatch, few):
    """Counts that are placed by range and counts in one window give the same, exact quantiles."""
    import numpy as np

    from seriesloom.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW_CELLS", few)
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=5000), "b": rng.integers(0, 4, 3000).astype(float), None: np.array([7.0])}
    rows = [(k, float(v), None if i % 3 else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    found = {(r["k"], r["column"], r["q"]): r["quantile"] for r in quantiles.exact_quantiles(frame, ["v", "w"], keys=["k"], qs=(0.0, 0.1, 0.5, 0.999, 1.0)).collect()}
    expected = {(k, c, q): np.quantile(vs[:: 3 if c == "w" else 1], q) for k, vs in values.items() for c in "vw" for q in (0.0, 0.1, 0.5, 0.999, 1.0)}
    assert found.keys() == expected.keys() and all(np.isclose(found[k], expected[k]) for k in found)
    packed = {(r["k"], r["column"], r["q"]): r["quantile"] for r in quantiles.exact_quantiles(frame, ["v", "w"], keys=["k"], qs=(0.1, 0.5), grain="bin").collect()}
    assert packed.keys() == {k for k in expected if k[2] in (0.1, 0.5)} and all(np.isclose(packed[k], expected[k]) for k in packed)


def test_centred_trend_of_raw_rows(rows, skewed):
    """The reach differs by series, and windows lie across the borders of small blocks."""
    out = by_id(lags.centred_trend(rows, ts="ts", y="y", keys=["k"], tie=["id"], grain="row", block_rows=64))
    want = []
    for _, part in skewed.groupby("k"):
        y, n = part["y"].to_numpy(), len(part)
        k = min(30, max(7, n // 10))
        for t, i in enumerate(part["id"]):
            a, b = t - k // 2, t + (k - 1) // 2 + 1
            near = y[max(a, 0) : b]
            whole = n >= 14 and a >= 0 and b <= n and not np.isnan(near).any()
            want.append((i, near.mean() if whole else np.nan, y[t] - near.mean() if whole else np.nan))
    want = pd.DataFrame(want, columns=["id", "trend_ma", "detrended"]).sort_values("id").reset_index(drop=True)
    same(out[["trend_ma", "detrended"]], want[["trend_ma", "detrended"]])
    assert set(out.columns) == {"k", "ts", "id", "y", "trend_ma", "detrended"}


def test_centred_trend_of_dense_rows(spark):
    """Series without unknown values, of lengths around the limits."""
    series = {"a": 13, "b": 14, "c": 100, "d": 299, "e": 700}
    data = [(k, i, float(RNG.integers(-50, 50))) for k, n in series.items() for i in range(n)]
    out = lags.centred_trend(spark.createDataFrame(data, "k string, t int, y double").repartition(5), ts="t", y="y", keys=["k"], grain="row", block_rows=50)
    got = {(r["k"], r["t"]): r["trend_ma"] for r in out.collect()}
    for k, n in series.items():
        y, width = [v for c, _, v in data if c == k], min(30, max(7, n // 10))
        for t in range(n):
            a, b = t - width // 2, t + (width - 1) // 2 + 1
            want = sum(y[a:b]) / width if n >= 14 and a >= 0 and b <= n else None
            assert got[k, t] == (None if want is None else pytest.approx(want))
