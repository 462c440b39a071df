"""Model operators against numpy re-computations."""

import math

import numpy as np
import pandas as pd

from quire.operators import models as M
from quire.operators.svm import cv_grid


def _irls(X, y, w=None, iters=50):
    w = np.ones(len(y)) if w is None else w
    beta = np.zeros(X.shape[1])
    for _ in range(iters):
        mu = 1 / (1 + np.exp(-X @ beta))
        W = w * mu * (1 - mu)
        z = X @ beta + (y - mu) / (mu * (1 - mu))
        beta = np.linalg.solve(X.T @ (W[:, None] * X), X.T @ (W * z))
    mu = 1 / (1 + np.exp(-X @ beta))
    cov = np.linalg.inv(X.T @ ((w * mu * (1 - mu))[:, None] * X))
    return beta, np.sqrt(np.diag(cov)), cov


def _frame(n=600, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    c = 0.8 * a + 0.6 * rng.normal(size=n)
    z = -0.5 + 1.2 * a - 0.7 * b
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-z))).astype(float)
    return pd.DataFrame({"a": a, "b": b, "c": c, "y": y, "w": rng.choice([1.0, 10.0], n)})


def test_logit_matches_irls(spark):
    pdf = _frame()
    fit = M.logit_fit(spark.createDataFrame(pdf), "y", ["a", "b", "c"])
    X = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "c"]].to_numpy()])
    beta, se, _ = _irls(X, pdf.y.to_numpy())
    assert np.allclose(fit.coef, beta, atol=1e-6) and np.allclose(fit.se, se, rtol=1e-4)
    mu = 1 / (1 + np.exp(-X @ beta))
    ll = (pdf.y * np.log(mu) + (1 - pdf.y) * np.log(1 - mu)).sum()
    assert math.isclose(fit.aic, -2 * ll + 2 * 4, rel_tol=1e-6)


def test_weighted_logit_matches_irls(spark):
    pdf = _frame(seed=1)
    fit = M.logit_fit(spark.createDataFrame(pdf), "y", ["a", "b"], weight="w")
    X = np.column_stack([np.ones(len(pdf)), pdf[["a", "b"]].to_numpy()])
    beta, _, _ = _irls(X, pdf.y.to_numpy(), pdf.w.to_numpy())
    assert np.allclose(fit.coef, beta, atol=1e-6)


def test_vif_from_coefficient_covariance(spark):
    pdf = _frame(seed=2)
    df = spark.createDataFrame(pdf)
    fit = M.logit_fit(df, "y", ["a", "b", "c"])
    got = M.vif_table(df, fit).toPandas().set_index("term")["vif"]
    X = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "c"]].to_numpy()])
    _, _, cov = _irls(X, pdf.y.to_numpy())
    V = cov[1:, 1:]
    d = np.sqrt(np.diag(V))
    R = V / np.outer(d, d)
    exp = np.diag(np.linalg.inv(R))
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), exp, rtol=1e-4)
    assert got["a"] > got["b"]          # a and c are collinear


def test_stepwise_drops_noise_and_elimination_stops(spark):
    pdf = _frame(seed=3)
    pdf["noise"] = np.random.default_rng(9).normal(size=len(pdf))
    df = spark.createDataFrame(pdf)
    best, steps = M.stepwise_aic(df, "y", ["a", "b", "c", "noise"])
    assert "a" in best.features and "b" in best.features
    assert steps.count() >= 1
    fit, log = M.backward_eliminate(df, "y", ["a", "b", "c", "noise"], vif_max=2.0, p_max=0.05)
    assert all(p <= 0.05 for p in fit.p[1:])


def _aic(pdf, feats, w=None):
    X = np.column_stack([np.ones(len(pdf)), *[pdf[f] for f in feats]])
    y, w = pdf.y.to_numpy(), np.ones(len(pdf)) if w is None else w
    beta, _, _ = _irls(X, y, w)
    eta = X @ beta
    return -2 * (w * (y * eta - np.logaddexp(0, eta))).sum() + 2 * X.shape[1]


def test_score_equations_are_zero_for_every_candidate(spark):
    pdf = _frame(seed=4)
    sets = [["a"], ["a", "b"], ["b", "c"], ["a", "b", "c"], []]
    with M.LogitData(spark.createDataFrame(pdf).repartition(5), "y", ["a", "b", "c"], "w") as data:
        fits = data.fit(sets)
    for feats, fit in zip(sets, fits):
        X = np.column_stack([np.ones(len(pdf)), *[pdf[f] for f in feats]])
        mu = 1 / (1 + np.exp(-X @ np.array(fit.coef)))
        assert np.abs(X.T @ (pdf.w * (pdf.y - mu))).max() < 1e-6 and fit.converged
        assert math.isclose(fit.aic, _aic(pdf, feats, pdf.w.to_numpy()), rel_tol=1e-9)


def test_stepwise_takes_the_steps_of_single_fits(spark):
    """The trace equals a greedy search with one numpy fit per candidate."""
    rng = np.random.default_rng(13)
    pdf = _frame(seed=6)
    for i in range(4):
        pdf[f"n{i}"] = rng.normal(size=len(pdf)) + 0.3 * pdf["a"]
    feats = ["a", "b", "c", "n0", "n1", "n2", "n3"]
    best, steps = M.stepwise_aic(spark.createDataFrame(pdf), "y", feats)
    current, aic, trace = list(feats), _aic(pdf, feats), []
    while True:
        moves = [("-" + f, [x for x in current if x != f]) for f in current]
        moves += [("+" + f, current + [f]) for f in feats if f not in current]
        value, move, terms = min((_aic(pdf, t), m, t) for m, t in moves)
        if value >= aic - 1e-9:
            break
        aic, current = value, terms
        trace.append((move, ",".join(terms)))
    got = [(r["move"], r["terms"]) for r in steps.orderBy("step").collect()[1:]]
    assert got == trace and len(trace) >= 2 and math.isclose(best.aic, aic, rel_tol=1e-9)


def test_a_search_step_is_a_few_passes_whatever_its_candidates(spark, monkeypatch):
    """Passes over the rows do not grow with the number of candidates."""
    calls = []
    whole = M.LogitData.moments
    monkeypatch.setattr(M.LogitData, "moments", lambda self, c, b: calls.append(len(c)) or whole(self, c, b))
    pdf = _frame(seed=7)
    with M.LogitData(spark.createDataFrame(pdf), "y", ["a", "b", "c"]) as data:
        data.fit([["a"], ["b"], ["c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"]])
    assert calls[0] == 7 and len(calls) <= 9 and calls == sorted(calls, reverse=True)


def test_logit_odd_input(spark):
    pdf = _frame(n=60, seed=8)
    df = spark.createDataFrame(pdf)
    holes = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 0.0, 1.0)],
                                                 "a double, b double, c double, y double, w double"))
    assert np.allclose(M.logit_fit(holes, "y", ["a", "b"]).coef, M.logit_fit(df, "y", ["a", "b"]).coef)
    twice = M.logit_fit(df.selectExpr("*", "a as again"), "y", ["a", "again"])      # one column twice: a least-norm fit
    assert math.isclose(sum(twice.coef[1:]), M.logit_fit(df, "y", ["a"]).coef[1], rel_tol=1e-6)
    apart = M.logit_fit(df.selectExpr("*", "y * 2 - 1 as tells"), "y", ["tells"])   # separated: no finite optimum
    assert not apart.converged or apart.coef[1] > 5
    assert M.logit_fit(df.limit(0), "y", ["a"]).coef == [0.0, 0.0]


def test_cv_grid_finds_a_separable_problem(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = (np.linalg.norm(x, axis=1) > 1.8).astype(int)          # a ring: no plane separates it
    df = spark.createDataFrame([(i, list(map(float, v)), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    got = cv_grid(df, "y", "x", "id", [0.001, 0.3], [1.0, 10.0], folds=3, dim=200).toPandas()
    assert len(got) == 4 and got["best"].sum() >= 1
    assert got[got.sigma == 0.3]["cv_accuracy"].max() > 0.85 > got[got.sigma == 0.001]["cv_accuracy"].max()
