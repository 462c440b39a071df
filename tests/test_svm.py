"""Machines fitted together against numpy Newton solutions, one machine at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import svm as V


def newton(z, sign, cost, steps=100):
    """Exact minimiser of |w|^2 / 2 + cost * sum of squared slacks."""
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        slack = 1 - sign * (z @ w)
        on = slack > 0
        slope = w - 2 * cost * z[on].T @ (sign[on] * slack[on])
        if np.abs(slope).max() < 1e-11:
            break
        w = w - np.linalg.solve(np.eye(len(w)) + 2 * cost * z[on].T @ z[on], slope)
    return w


def clouds(n, k, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(k, d))
    y = rng.integers(0, k, n)
    return centre[y] + spread * rng.normal(size=(n, d)), y


def frame(spark, x, y, parts=4):
    return spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, y))],
                                 "id long, x array<double>, y int").repartition(parts)


@pytest.mark.parametrize("sigma", [None, 0.1])
def test_pairs_equal_numpy_machines(spark, sigma):
    x, y = clouds(400, 4, 5, 0)
    model = V.fit_pairwise(frame(spark, x, y), "y", "x", cost=2.0, sigma=sigma, dim=40, tol=1e-9)
    assert model.gap <= 1e-9
    z, code = model.fmap(x), V.one_against_one(4)
    for m in range(code.shape[1]):
        used = code[y, m] != 0
        w = newton(z[used], code[y[used], m], 2.0)
        assert np.allclose(model.weights[:, m], w, atol=2e-4 * max(1, np.abs(w).max()))
    rough = V.fit_pairwise(frame(spark, x, y), "y", "x", cost=2.0, sigma=sigma, dim=40)   # the stated tolerance
    got = {r["id"]: r["prediction"] for r in rough.predict(frame(spark, x, y), "x", ["id"]).collect()}
    exact = np.column_stack([newton(z[code[y, m] != 0], code[y[code[y, m] != 0], m], 2.0) for m in range(6)])
    votes = np.zeros((len(x), 4))
    for m, (a, b) in enumerate([(a, b) for a in range(4) for b in range(a + 1, 4)]):
        ahead = z @ exact[:, m] > 0
        votes[ahead, a] += 1
        votes[~ahead, b] += 1
    assert np.mean([got[i] == v for i, v in enumerate(votes.argmax(1))]) >= 0.995


def test_gap_bounds_the_distance_to_the_optimum(spark):
    """The certificate holds at every tolerance, and tighter ones take more passes."""
    x, y = clouds(300, 2, 4, 1)
    z = np.hstack([x, np.ones((300, 1))])
    sign = np.where(y == 0, 1.0, -1.0)
    value = lambda w: w @ w / 600 + (np.maximum(0, 1 - sign * (z @ w)) ** 2).mean()  # noqa: E731  cost 1: ridge 1/300
    least, steps = value(newton(z, sign, 1.0)), []
    for tol in (1e-1, 1e-3, 1e-6):
        m = V.fit_pairwise(frame(spark, x, y), "y", "x", tol=tol)
        assert value(m.weights[:, 0]) - least <= tol * value(m.weights[:, 0]) + 1e-12 and m.gap <= tol
        steps.append(m.steps)
    assert steps == sorted(steps) and steps[-1] < 200


def test_grid_counts_equal_numpy(spark):
    x, y = clouds(240, 3, 4, 2, 0.8)
    df = frame(spark, x, y)
    got = {(r["sigma"], r["cost"]): r for r in V.cv_grid(df, "y", "x", "id", [0.05, 0.5], [1.0, 4.0], folds=3, dim=30, tol=1e-8).collect()}
    fold = {r["id"]: r["f"] for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("f")).collect()}
    fold = np.array([fold[i] for i in range(len(x))])
    for (sigma, cost), r in got.items():
        z, share = V.FeatureMap(4, sigma, 30, 7)(x), []
        for f in range(3):
            inside = fold != f
            w = np.column_stack([newton(z[inside], np.where(y[inside] == c, 1.0, -1.0), cost) for c in range(3)])
            share.append((z[~inside] @ w).argmax(1) == y[~inside])
        assert abs(r["cv_accuracy"] - np.mean([s.mean() for s in share])) < 1e-9
        assert r["gap"] <= 1e-8 and r["steps"] > 1
    assert sum(r["best"] for r in got.values()) >= 1


def test_finished_machines_leave_the_passes(spark, monkeypatch):
    seen = []
    whole = V._slacks
    monkeypatch.setattr(V, "_slacks", lambda rows, machines, open_, at: seen.append(len(open_)) or whole(rows, machines, open_, at))
    x, y = clouds(200, 4, 3, 3)
    V.fit_pairwise(frame(spark, x, y), "y", "x", cost=5.0, tol=1e-6)
    assert seen[0] == 6 and seen[-1] < 6 and seen == sorted(seen, reverse=True)


def test_odd_input(spark):
    schema = "id long, x array<double>, y int"
    one = spark.createDataFrame([(1, [1.0, 2.0], 3), (2, [0.0, 1.0], 3), (3, None, 3), (4, [1.0, 1.0], None)], schema)
    model = V.fit_pairwise(one, "y", "x")
    assert [r["prediction"] for r in model.predict(one, "x", ["id"]).collect()] == [3.0, 3.0, 3.0]
    grid = V.cv_grid(one.limit(0), "y", "x", "id", [0.1], [1.0], folds=2, dim=4).collect()
    assert len(grid) == 1 and grid[0]["cv_accuracy"] == 0.0
    few = spark.createDataFrame([(i, [float(i % 2)], i % 2) for i in range(4)], schema)   # folds without rows
    assert V.cv_grid(few, "y", "x", "id", [0.1], [1.0], folds=7, dim=4).first()["cv_accuracy"] >= 0
