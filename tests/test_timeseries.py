"""Time-series operators against numpy re-computations on tiny series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import blocks
from quire.operators import timeseries as ts
from quire.operators.ols import grouped_ols


def _series(spark, values: dict[str, np.ndarray]):
    rows = [(k, i + 1, float(v)) for k, arr in values.items() for i, v in enumerate(arr)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "t", "value"]))


def _ref_smooth(x, w):
    n = len(x)
    s = np.full(n, np.nan)
    for i in range(w, n - w):
        s[i] = x[i - w:i + w + 1].mean()
    d = s[w + 1] - s[w]
    for i in range(w - 1, -1, -1):
        s[i] = s[i + 1] - d
    d = s[n - w - 1] - s[n - w - 2]
    for i in range(n - w, n):
        s[i] = s[i - 1] + d
    return s


@pytest.mark.parametrize("w", [1, 2])
def test_smooth_matches_reference_rule_and_keeps_lines(spark, w):
    rng = np.random.default_rng(1)
    noisy = rng.normal(10, 2, 30)
    line = 3.0 + 0.5 * np.arange(1, 21)
    out = ts.smooth(_series(spark, {"a": noisy, "line": line}), w).toPandas().sort_values(["series_id", "t"])
    got = out[out.series_id == "a"]["smoothed"].to_numpy()
    assert np.allclose(got, _ref_smooth(noisy, w))
    assert np.allclose(out[out.series_id == "line"]["smoothed"].to_numpy(), line)


def _ref_acf(x, K):
    xc = x - x.mean()
    c0 = (xc * xc).sum()
    return np.array([(xc[: len(x) - k] * xc[k:]).sum() / c0 for k in range(K + 1)])


def test_acf_pacf_ljung_box(spark):
    rng = np.random.default_rng(2)
    n, phi = 60, 0.6
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + rng.normal()
    a = ts.acf(_series(spark, {"ar": x}), "value").toPandas().sort_values("lag")
    K = int(math.floor(10 * math.log10(n)))
    assert a["lag"].max() == K and math.isclose(a["acf"].iloc[0], 1.0)
    assert np.allclose(a["acf"].to_numpy(), _ref_acf(x, K))
    p = ts.pacf(ts.acf(_series(spark, {"ar": x}), "value")).toPandas().sort_values("lag")
    assert math.isclose(p["pacf"].iloc[0], a["acf"].iloc[1])
    r = _ref_acf(x, K)
    lb = ts.ljung_box(ts.acf(_series(spark, {"ar": x}), "value")).toPandas().sort_values("lag")
    q = n * (n + 2) * np.cumsum(r[1:] ** 2 / (n - np.arange(1, K + 1)))
    assert np.allclose(lb["q"].to_numpy(), q)


def test_grouped_ols_matches_lstsq(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(80, 3))
    y = 1.5 + X @ np.array([2.0, -1.0, 0.5]) + rng.normal(0, 0.1, 80)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y, g="x", one=1.0)
    fit = grouped_ols(spark.createDataFrame(pdf), ["g"], "y", ["one", "a", "b", "c"]).first()
    A = np.column_stack([np.ones(80), X])
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(fit["coef"], beta)
    resid = y - A @ beta
    s2 = resid @ resid / (80 - 4)
    assert np.allclose(fit["se"], np.sqrt(np.diag(np.linalg.inv(A.T @ A)) * s2))


def _ref_kpss(x):
    n = len(x)
    e = x - x.mean()
    s = np.cumsum(e)
    eta = (s ** 2).sum() / n ** 2
    l = int(3 * math.sqrt(n) / 13)
    s2 = (e ** 2).sum() / n
    for i in range(1, l + 1):
        s2 += 2 / n * (1 - i / (l + 1)) * (e[i:] * e[:-i]).sum()
    return eta / s2, l


def test_kpss_matches_formula(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=90).cumsum()
    got = ts.kpss(_series(spark, {"rw": x}), "value").first()
    stat, l = _ref_kpss(x)
    assert got["lags"] == l and math.isclose(got["stat"], stat, rel_tol=1e-9)
    assert 0.01 <= got["p_value"] <= 0.1


def test_adf_matches_regression(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=70)
    got = ts.adf(_series(spark, {"wn": x}), "value").first()
    N = len(x)
    k = int(math.floor((N - 1) ** (1 / 3) + 1e-12))
    d = np.diff(x)
    rows, ys = [], []
    for t in range(k + 2, N + 1):          # 1-based time of the response difference
        i = t - 1                           # index into d of x_t - x_{t-1}
        rows.append([1.0, x[t - 2], t - 1] + [d[i - 1 - j] for j in range(1, k + 1)])
        ys.append(d[i - 1])
    A, yv = np.array(rows), np.array(ys)
    beta = np.linalg.lstsq(A, yv, rcond=None)[0]
    res = yv - A @ beta
    s2 = res @ res / (len(yv) - A.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(A.T @ A)) * s2)
    assert got["k"] == k and math.isclose(got["stat"], beta[1] / se[1], rel_tol=1e-8)
    row = [float(np.interp(N - 1, ts.ADF_T, col)) for col in ts.ADF_CRIT]
    assert math.isclose(got["p_value"], float(np.interp(beta[1] / se[1], row, ts.ADF_P)))
    big = ts.adf(_series(spark, {"wn": rng.normal(size=400)}), "value").first()
    assert big["p_value"] <= 0.05          # long white noise: unit root rejected
    walk = ts.adf(_series(spark, {"rw": rng.normal(size=400).cumsum()}), "value").first()
    assert walk["p_value"] > 0.05


def test_ar1_recovered_and_forecast(spark):
    rng = np.random.default_rng(8)
    n, phi = 400, 0.7
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = 2.0 + phi * x[i - 1] + rng.normal(0, 0.5)
    df = _series(spark, {"ar": x})
    cands = ts.ar_candidates(df, "value", max_p=3).toPandas()
    c1 = cands[(cands.d == 0) & (cands.p == 1)].iloc[0]
    assert abs(c1["coef"][1] - phi) < 0.08
    best = cands[cands.d == 0].sort_values("aicc").iloc[0]
    assert best["p"] >= 1
    model = ts.ar_select(df, "value", 3)
    fc = ts.ar_forecast(df, model, 3).toPandas().sort_values("step")
    row = model.first()
    c = row["coef"]
    hist = list(x) if row["d"] == 0 else list(np.diff(x))
    lvl = x[-1]
    for s in range(3):
        nxt = c[0] + sum(c[i] * hist[-i] for i in range(1, row["p"] + 1))
        hist.append(nxt)
        lvl = nxt if row["d"] == 0 else lvl + nxt
        assert math.isclose(fc["forecast"].iloc[s], lvl, rel_tol=1e-9)


def test_chi2_sf_known_points():
    assert math.isclose(ts.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(ts.chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(ts.chi2_sf(11.070497693516351, 5), 0.05, rel_tol=1e-6)


def test_trend_fit_reproduces_polynomial(spark):
    t = np.arange(1, 43)
    y = 100 + 3 * np.sin(0.5 * t) + 0.02 * (t - 20) ** 3
    df = _series(spark, {"s": y})
    fit = ts.trend_fit(df, "value")
    pred = ts.trend_predict(df, fit).toPandas().sort_values("t")
    assert np.allclose(pred["fitted"].to_numpy(), y, atol=1e-6)
    _ = F


def test_blocks_of_time_give_the_same_statistics(spark, monkeypatch):
    """Series cut into short blocks, with gaps and far-apart magnitudes."""
    rng = np.random.default_rng(11)
    df = _series(spark, {"a": rng.normal(size=50).cumsum(), "b": rng.normal(size=35), "big": np.full(40, 1e15), "tenth": np.full(40, 0.1)})
    stats = lambda: {
        "acf": ts.acf(df, "value").toPandas().sort_values(["series_id", "lag"])["acf"],
        "kpss": ts.kpss(df.where("series_id in ('a', 'b')"), "value").toPandas().sort_values("series_id")["stat"],
        "adf": ts.adf(df.where("series_id in ('a', 'b')"), "value").toPandas().sort_values("series_id")["stat"],
        "smooth": ts.smooth(df, 2).toPandas().sort_values(["series_id", "t"])["smoothed"]}
    whole = stats()
    monkeypatch.setattr(ts, "BLOCK_STEPS", 4)
    monkeypatch.setattr(blocks, "BLOCK_STEPS", 4)
    for name, values in stats().items():
        assert np.allclose(values, whole[name], equal_nan=True), name
    total = ts.running_sum(df, "value").where("series_id = 'tenth'").agg(F.max("_cum")).first()[0]
    assert math.isclose(total, 4.0)


def test_lags_look_at_times_not_positions(spark):
    df = spark.createDataFrame([("s", t, float(t)) for t in (1, 2, 4, 5, 9000)], "series_id string, t long, value double")
    got = {r["t"]: (r["_lag1"], r["_lagm1"]) for r in ts.lagged(df, "value", [1, -1]).collect()}
    assert got == {1: (None, 2.0), 2: (1.0, None), 4: (None, 5.0), 5: (4.0, None), 9000: (None, None)}


def test_chi2_tails_of_arrays():
    x, k = np.array([1.0, 3.84145882, 5.99146455, 0.0, np.nan, 18.307038, 2.0, 7.0]), np.array([2, 1, 2, 3, 2, 10, 0, 5])
    got = ts.chi2_tails(x, k)
    assert np.allclose(got, [math.exp(-0.5), 0.05, 0.05, 1.0, np.nan, 0.05, np.nan, 0.2206], atol=1e-4, equal_nan=True)


def test_standardised_residuals_unit_sd(spark):
    rng = np.random.default_rng(12)
    df = _series(spark, {"a": rng.normal(5, 3, 40), "b": rng.normal(0, 1, 25)})
    out = ts.standardised_residuals(df.withColumnRenamed("value", "r"), "r").toPandas()
    for _, g in out.groupby("series_id"):
        assert math.isclose(g["std_resid"].std(ddof=1), 1.0, rel_tol=1e-9)


def test_constant_series_give_nulls_not_errors(spark):
    df = _series(spark, {"flat": np.full(30, 4.0), "wave": np.sin(np.arange(30))})
    a = ts.acf(df, "value").toPandas()
    assert a[a.series_id == "flat"]["acf"].isna().all()
    k = ts.kpss(df, "value").toPandas().set_index("series_id")
    assert pd.isna(k.loc["flat", "stat"])
    m = ts.ar_select(df, "value", 2).toPandas()
    assert set(m["series_id"]) == {"flat", "wave"}


def _ref_arima(x, d, max_p, max_q):
    """Hannan-Rissanen with lstsq on explicit design matrices."""
    z = np.diff(x, n=d)
    mean = z.mean()
    z = z - mean
    m = ts.long_order(len(z))
    lag = lambda v, k: np.concatenate([np.full(k, np.nan), v[:len(v) - k]])
    full = np.column_stack([np.ones(len(z)), *[lag(z, k) for k in range(1, m + 1)]])
    ok = ~np.isnan(full).any(axis=1)
    long_ar = np.linalg.lstsq(full[ok], z[ok], rcond=None)[0]
    e = z - full @ long_ar
    design = np.column_stack([np.ones(len(z)), *[lag(z, k) for k in range(1, max_p + 1)],
                              *[lag(e, k) for k in range(1, max_q + 1)]])
    ok = ~np.isnan(design).any(axis=1)
    best = []
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            use = design[ok][:, [0, *range(1, 1 + p), *range(1 + max_p, 1 + max_p + q)]]
            beta = np.linalg.lstsq(use, z[ok], rcond=None)[0]
            rss, n, k = ((z[ok] - use @ beta) ** 2).sum(), ok.sum(), p + q + 2
            aicc = n * math.log(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
            roots = [r for c in ([-v for v in beta[1:1 + p]], list(beta[1 + p:])) for r in np.roots([*c[::-1], 1.0])]
            if all(abs(r) > 1.001 for r in roots):
                best.append((aicc, p + q, p, q, beta, mean, e))
    return min(best, key=lambda r: r[:3]), z


def _arma(rng, n, ar, ma):
    e, x = rng.normal(size=n + 50), np.zeros(n + 50)
    for i in range(5, n + 50):
        x[i] = e[i] + sum(c * x[i - k] for k, c in enumerate(ar, 1)) + sum(c * e[i - k] for k, c in enumerate(ma, 1))
    return x[50:]


@pytest.mark.parametrize("steps", [16, 4096])
def test_arima_orders_and_coefficients_equal_numpy(spark, monkeypatch, steps):
    monkeypatch.setattr(blocks, "BLOCK_STEPS", steps)
    rng = np.random.default_rng(21)
    series = {"arma": 1e6 + 5e4 * _arma(rng, 300, [0.6], [0.5]), "ma": 7 + _arma(rng, 200, [], [0.8]),
              "noise": rng.normal(3, 1, 80), "walk": _arma(rng, 250, [0.3], [0.4]).cumsum(),
              "bent": (rng.normal(size=400).cumsum() + 0.5).cumsum()}
    df = _series(spark, series)
    got = {r["series_id"]: r for r in ts.arima_select(df, "value", 3, 2).collect()}
    assert set(got) == set(series)
    assert got["walk"]["d"] == 1 and got["bent"]["d"] == 2 and got["ma"]["q"] + got["ma"]["p"] > 0
    fc = ts.arima_forecast(df, ts.arima_select(df, "value", 3, 2), 4).toPandas()
    for name, x in series.items():
        r = got[name]
        (aicc, _, p, q, beta, mean, e), z = _ref_arima(x, r["d"], 3, 2)
        assert (r["p"], r["q"]) == (p, q), name
        assert np.allclose([r["intercept"], *r["ar"], *r["ma"]], beta, rtol=1e-6, atol=1e-6 * max(1, abs(z).max()))
        assert math.isclose(r["aicc"], aicc, rel_tol=1e-6) and math.isclose(r["mean"], mean, rel_tol=1e-9, abs_tol=1e-9)
        z, e, levels = list(z), list(np.nan_to_num(e)), [np.diff(x, n=i)[-1] for i in range(r["d"])]
        for s in range(4):
            z.append(beta[0] + sum(beta[i] * z[-i] for i in range(1, p + 1)) + sum(beta[p + i] * e[-i] for i in range(1, q + 1)))
            e.append(0.0)
            step = z[-1] + mean
            for i in reversed(range(len(levels))):
                step = levels[i] = levels[i] + step
            have = fc[(fc.series_id == name) & (fc.step == s + 1)].iloc[0]
            assert math.isclose(have["forecast"], step, rel_tol=1e-6, abs_tol=1e-6) and have["t"] == len(x) + s + 1


def test_arima_of_odd_series(spark):
    """Constant, very short and empty series give a model without lags, not an error."""
    df = _series(spark, {"flat": np.full(30, 4.0), "two": np.array([1.0, 2.0]), "one": np.array([5.0])})
    got = {r["series_id"]: r for r in ts.arima_select(df, "value").collect()}
    assert got["flat"]["p"] == got["flat"]["q"] == 0 and got["flat"]["d"] == 0
    fc = ts.arima_forecast(df, ts.arima_select(df, "value"), 2).toPandas()
    assert np.allclose(fc[fc.series_id == "flat"]["forecast"], 4.0)
    assert ts.arima_select(df.limit(0), "value").count() == 0


def test_a_series_of_a_million_points_keeps_the_plan(spark):
    """Lags are data: the plans of a short and of a very long series have one shape."""
    df = spark.range(1_000_000).select(F.lit("long").alias("series_id"), (F.col("id") + 1).alias("t"),
                                       (F.sin(F.col("id") * 0.01) + F.rand(3)).alias("value")).checkpoint()
    x = np.array([r["value"] for r in df.select("t", "value").orderBy("t").collect()])
    got = ts.acf(df, "value")
    assert np.allclose(got.toPandas().sort_values("lag")["acf"], _ref_acf(x, 60))
    stat, l = _ref_kpss(x)
    k = ts.kpss(df, "value")
    row = k.first()
    assert row["lags"] == l == 230 and math.isclose(row["stat"], stat, rel_tol=1e-8)
    short = _series(spark, {"s": np.arange(40.0)})
    shape = lambda f: [ln.split("(")[0].strip(" +-:*") for ln in f._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    assert len(shape(ts.kpss(short, "value"))) == len(shape(k)) and len(k.columns) == 5
    assert all(len(ln) < 4000 for ln in k._jdf.queryExecution().optimizedPlan().toString().split("\n"))
