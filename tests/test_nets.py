"""Nets trained in passes against the same steps in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import nets as N


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] * x[:, 2])))
    return x, (rng.uniform(size=n) < p).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(4)


def in_numpy(x, y, hidden, seed, restart, threshold, sign_steps, max_steps):
    x = np.hstack([np.ones((len(x), 1)), x])
    r = N._Restart(N.start_weights(x.shape[1] * hidden + hidden + 1, seed, restart), sign_steps, threshold)
    for _ in range(max_steps):
        if r.done:
            break
        r.take(*N.error_and_slopes(x, y, r.w, hidden, r.curved))
    return r


def test_slopes_are_the_derivative():
    x, y = data(50)
    x = np.hstack([np.ones((50, 1)), x])
    w = N.start_weights(4 * 3 + 4, 1, 1)
    error, slope, _ = N.error_and_slopes(x, y, w, 3, False)
    _, same, matrix = N.error_and_slopes(x, y, w, 3, True)
    assert np.allclose(same, slope)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = (N.error_and_slopes(x, y, w + s, 3, False)[0] for s in (step, -step))
        assert np.isclose((up - down) / 2e-6, slope[i], atol=1e-5)
        up, down = (N.error_and_slopes(x, y, w + s, 3, False)[1] for s in (step, -step))
        assert np.allclose((up - down) / 2e-6, matrix[i], atol=1e-5)


def test_sign_steps_equal_numpy(spark):
    """Pure resilient propagation: every restart takes numpy's steps."""
    x, y = data(200, 1)
    fit = N.resilient_net(frame(spark, x, y), "y", ["a", "b", "c"], 2, restarts=3, sign_steps=10**9, max_steps=25)
    for i, error, slope, steps, reached in fit.restarts:
        r = in_numpy(x, y, 2, 1, i, 0.01, 10**9, 25)
        assert np.isclose(error, r.error, rtol=1e-6) and np.isclose(slope, r.slope, rtol=1e-4) and steps == 25 and not reached
    assert not fit.reached and fit.error == min(e for _, e, *_ in fit.restarts)


def test_threshold_ends_training_below_long_sign_runs(spark):
    x, y = data(300, 2)
    fit = N.resilient_net(frame(spark, x, y), "y", ["a", "b", "c"], 2, restarts=3, sign_steps=15, max_steps=250)
    assert any(reached and slope < 0.01 and steps < 250 for _, _, slope, steps, reached in fit.restarts)
    assert fit.reached == (fit.slope < 0.01) and all(reached == (slope < 0.01) for _, _, slope, _, reached in fit.restarts)
    full = np.hstack([np.ones((300, 1)), x])
    error, slope, _ = N.error_and_slopes(full, y, fit.weights, 2, False)
    assert np.isclose(error, fit.error, rtol=1e-9) and np.isclose(np.abs(slope).max(), fit.slope, rtol=1e-6)
    rival = min(in_numpy(x, y, 2, 1, i, 0.01, 10**9, 3000).error for i in (1, 2, 3))
    assert fit.error <= rival + 0.05
    got = frame(spark, x, y).select("a", "b", "c", fit.probability().alias("p")).toPandas()
    want = N.forward(np.hstack([np.ones((300, 1)), got[["a", "b", "c"]].to_numpy()]), fit.weights, 2)[1]
    assert np.allclose(got["p"], want)


@pytest.mark.parametrize("rows", [[], [(1.0, 0.0), (None, 1.0), (float("nan"), 1.0)]])
def test_odd_input(spark, rows):
    df = spark.createDataFrame(rows, "a double, y double")
    fit = N.resilient_net(df, "y", ["a"], 2, restarts=2, sign_steps=5, max_steps=60)
    assert len(fit.restarts) == 2 and len(fit.weights) == 2 * 2 + 3


def test_rows_of_one_part_are_trained_on_by_all_cores(spark):
    x, y = data(500)
    one = frame(spark, x, y).coalesce(1)
    with N.LogitData(one, "y", ["a", "b", "c"]) as kept:
        assert kept.n == 500
        assert kept.rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert kept.rows.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 150


def test_shared_products_change_nothing():
    x, y = data(200, 3)
    x = np.hstack([np.ones((200, 1)), x])
    w = N.start_weights(4 * 5 + 6, 1, 2)
    alone, shared = N.error_and_slopes(x, y, w, 5, True), N.error_and_slopes(x, y, w, 5, True, N.products(x))
    assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(alone, shared)) and np.allclose(shared[2], shared[2].T)


def with_categories(n=4000, seed=6):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 2, n)
    x = np.column_stack([a, b == 1, b == 2, c, rng.normal(size=n)]).astype(float)
    return x, (rng.uniform(size=n) < 1 / (1 + np.exp(-a + b - c))).astype(float)


def test_set_apart_columns_change_nothing(spark, monkeypatch):
    """Blocks of constant 0/1 columns hold every row once, in fewer columns, and measure the same."""
    monkeypatch.setattr(N, "ROWS_A_PATTERN", 64)
    x, y = with_categories()
    df = spark.createDataFrame(pd.DataFrame({**{f"x{i}": x[:, i] for i in range(5)}, "y": y})).repartition(3)
    with N.NetRows(df, "y", [f"x{i}" for i in range(5)]) as data:
        rows = data.rows.collect()
        assert sum(r["n"] for r in rows) == data.n == len(x)
        got = []
        for r in rows:
            pattern, lines = np.frombuffer(r["pattern"]), np.frombuffer(r["block"]).reshape(-1, r["n"])
            assert np.isnan(pattern).tolist() == [True, True, False, False, False, True] and len(lines) == 3
            whole = np.tile(pattern, (r["n"], 1))
            whole[:, [1, 5]] = lines[1:].T
            got.append(np.column_stack([lines[0], whole[:, 1:]]))
        assert (np.unique(np.concatenate(got), axis=0) == np.unique(np.column_stack([y, x]), axis=0)).all()
        points = [(N.start_weights(6 * 4 + 5, 1, r), r > 1) for r in (1, 2, 3)]
        for (w, curve), found in zip(points, N._measured(data, points, 4)):
            want = N.error_and_slopes(np.hstack([np.ones((len(x), 1)), x]), y, w, 4, curve)
            assert np.isclose(found[0], want[0], rtol=1e-12) and np.allclose(found[1], want[1], rtol=1e-9, atol=1e-9)
            assert (found[2] is None) == (not curve) and (not curve or np.allclose(found[2], want[2], rtol=1e-9, atol=1e-9))


def test_columns_of_many_values_are_not_set_apart():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(1000), rng.normal(size=1000), rng.integers(0, 2, 1000), rng.integers(0, 9, 1000), np.full(1000, 7.0)])
    apart, code = N._set_apart(x, 10)
    assert apart == [4, 2] and len(np.unique(code)) == 2
    assert N._set_apart(x[:50], 0)[0] == []
