"""Triangular factors and block principal components against numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.operators import ols
from quire.operators.pca import pca_fit, pca_project, pca_variance


def test_near_collinear_designs_agree_with_qr(spark):
    """At a condition where the normal equations lose all digits, the factors keep eight."""
    rng = np.random.default_rng(0)
    t = np.linspace(0, 1, 300)
    x = np.column_stack([np.ones(300), t, t + 1e-7 * rng.normal(size=300), t ** 2])
    y = x @ [1.0, 2.0, -1.0, 0.5] + 1e-9 * rng.normal(size=300)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, g="s")
    got = ols.grouped_ols(spark.createDataFrame(pdf).repartition(7), ["g"], "y", list("abcd")).first()
    q, r = np.linalg.qr(x)
    want = np.linalg.solve(r, q.T @ y)
    assert np.allclose(got["coef"], want, rtol=1e-8, atol=1e-8)
    sums = ols.ols_from_sums(300.0, x.T @ x, x.T @ y, float(y @ y))[0]
    assert not np.allclose(sums, want, rtol=1e-8, atol=1e-8)      # what normal equations make of it


def test_factors_of_many_groups_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(ols, "GROUPS_AT_ONCE", 3)
    rng = np.random.default_rng(1)
    g = np.where(rng.uniform(size=3000) < 0.4, 0, rng.integers(1, 40, 3000))
    x = rng.normal(size=3000)
    y = g + 2 * x + rng.normal(size=3000)
    rows = [(None if a == 5 else int(a), f"k{a % 3}", 1.0, float(b), float(c), 1.0 + (i % 4)) for i, (a, b, c) in enumerate(zip(g, x, y))]
    df = spark.createDataFrame(rows, "n int, r string, one double, x double, y double, w double").repartition(6)
    got = {(r["n"], r["r"]): r for r in ols.grouped_ols(df.withColumnRenamed("n", "grp").withColumnRenamed("r", "kind"),
           ["grp", "kind"], "y", ["one", "x"], "w").withColumnRenamed("grp", "n_").select(
               F.col("n_").alias("n"), F.col("kind").alias("r"), F.col("n").alias("count"), "coef", "se", "rss").collect()}
    for a in np.unique(g):
        own = g == a
        w = np.array([r[5] for r in rows])[own]
        X = np.column_stack([np.ones(own.sum()), x[own]])
        beta = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * y[own]))
        r = got[(None if a == 5 else int(a), f"k{a % 3}")]
        assert r["count"] == own.sum() and np.allclose(r["coef"], beta)
        assert np.isclose(r["rss"], (w * (y[own] - X @ beta) ** 2).sum())


def test_odd_groups(spark):
    schema = "g string, one double, x double, y double"
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 1.0, 1.0, 5.0), ("b", 1.0, 1.0, 7.0), ("c", 1.0, None, 1.0)], schema)
    got = {r["g"]: r for r in ols.grouped_ols(df, ["g"], "y", ["one", "x"]).collect()}
    assert set(got) == {"a", "b"} and got["a"]["n"] == 1
    assert np.isclose(sum(got["b"]["coef"]), 6.0) and np.isclose(got["b"]["rss"], 2.0)
    assert ols.grouped_ols(df.limit(0), ["g"], "y", ["one", "x"]).count() == 0
    assert np.isclose(ols.grouped_ols(df.where("g = 'b'"), [], "y", ["one"]).first()["coef"][0], 6.0)


def _exact(x, k):
    value, vector = np.linalg.eigh(np.cov(x.T))
    return value[::-1][:k], vector[:, ::-1][:, :k], value.sum()


def test_components_equal_numpy(spark):
    """The top 35 of 784, to 1e-6, from products with blocks of vectors."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 784)) * (1.03 ** -np.arange(784)) + 3.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>").repartition(4)
    model = pca_fit(df, "x", 35)
    value, vector, total = _exact(x, 35)
    assert model.residual <= 1e-9 and model.passes < 40
    assert np.allclose(model.variance, value, rtol=1e-6) and np.isclose(model.total, total)
    assert np.allclose(np.abs((model.components * vector).sum(0)), 1, atol=1e-6)
    got = pca_project(model, df, "x", ["id"]).orderBy("id").toPandas()
    assert np.allclose(np.stack(got["pcs"]), x @ model.components)


def test_whole_and_degenerate_spectra(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [(None,), ([None] * 6,)], "x array<double>")
    model = pca_fit(df, "x", 6)
    assert np.allclose(model.variance, _exact(x, 6)[0])
    table = pca_variance(model, spark).toPandas()
    assert np.isclose(table["cumulative"].iloc[-1], 1) and len(table) == 6
    flat = spark.createDataFrame([([1.0, 2.0],)] * 5, "x array<float>")
    assert np.allclose(pca_fit(flat, "x", 2).variance, 0)
    assert pca_fit(df.limit(0), "x", 3).components.size == 0
