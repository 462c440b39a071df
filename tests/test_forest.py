"""Forests against the same trees grown in plain numpy, and odd input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import forest as R


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    flip = rng.uniform(size=n) < 0.05
    return pd.DataFrame({"id": np.arange(n), **{f"f{j}": x[:, j] for j in range(4)}, "y": np.where(flip, 1 - y, y)})


FEATURES = [f"f{j}" for j in range(4)]


def plain_tree(binned, y, w, tree, mtry, depth, seed):
    """One tree, node by node, from the definition."""
    found = {}

    def grow(node, rows, level):
        n, one = w[rows].sum(), (w * y)[rows].sum()
        found[node] = (-1, 0, one / max(n, 1))
        return n >= 2 and 0 < one < n and level < depth

    frontier = [(0, np.arange(len(y)))] if grow(0, np.arange(len(y)), 0) or True else []
    for level in range(depth):
        nodes = np.array(sorted(k for k, _ in frontier))
        if not len(nodes):
            break
        allowed = R.node_features(seed, tree, nodes, binned.shape[1], mtry)
        following = []
        for (node, rows), feats in zip(sorted(frontier, key=lambda k: k[0]), allowed):
            n, one = w[rows].sum(), (w * y)[rows].sum()
            best = (1e-9 * max(n, 1), None)
            for f in feats:
                for cut in range(R.BINS - 1):
                    l = rows[binned[rows, f] <= cut]
                    ln, lone = w[l].sum(), (w * y)[l].sum()
                    if 0 < ln < n:
                        gini = lambda a, b: 2 * b * (a - b) / a
                        gain = gini(n, one) - gini(ln, lone) - gini(n - ln, one - lone)
                        if gain > best[0] * (1 + 1e-12) + 1e-15:
                            best = (gain, (f, cut, l, np.setdiff1d(rows, l)))
            if best[1] is None or n < 2:
                continue
            f, cut, l, r = best[1]
            found[node] = (f, cut, found[node][2])
            for child, part in ((2 * node + 1, l), (2 * node + 2, r)):
                if grow(child, part, level + 1):
                    following.append((child, part))
        frontier = following
    return found


def test_trees_equal_plain_numpy(spark, monkeypatch):
    pdf = data(150)
    df = spark.createDataFrame(pdf).repartition(3)
    monkeypatch.setattr(R, "CELLS", 3000)       # several batches of trees a level
    got, _ = R.fit_forest(df, "y", FEATURES, "id", num_trees=6, mtry=2, max_depth=4, seed=5)
    keys = {r["id"]: r["k"] for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    key = np.array([keys[i] for i in pdf.id])
    binned = got.binned(pdf[FEATURES].to_numpy())
    for t in range(6):
        want = plain_tree(binned, pdf.y.to_numpy(), R.bootstrap_weights(key, t, 5).astype(float), t, 2, 4, 5)
        for node, (f, cut, share) in want.items():
            assert got.feature[t][node] == f and np.isclose(got.positive[t][node], share)
            assert f < 0 or got.cut[t][node] == cut
        assert (got.feature[t] >= 0).sum() == sum(f >= 0 for f, _, _ in want.values())


def test_out_of_bag_error_and_importance(spark):
    pdf = data()
    df = spark.createDataFrame(pdf)
    forest, counts = R.fit_forest(df, "y", FEATURES, "id", num_trees=60, mtry=2, max_depth=6)
    key = np.array([r["k"] for r in df.orderBy("id").select(F.xxhash64("id").alias("k")).collect()])
    ones, votes = forest.votes(forest.binned(pdf[FEATURES].to_numpy()), key)
    assert 15 < votes.mean() < 30                       # about 37% of the trees leave a row out
    vote = 2 * ones > votes
    want = {(a, b): int(((pdf.y == a) & (vote == b)).sum()) for a in (0, 1) for b in (0, 1)}
    assert counts == want
    table = R.oob_table(counts, spark).toPandas()
    assert table["error"].iloc[0] < 0.2 and table["n"].sum() == len(pdf)
    imp = forest.importances(spark).toPandas().set_index("feature")
    assert imp.loc[["f0", "f1"], "importance"].min() > imp.loc[["f2", "f3"], "importance"].max()
    assert np.isclose(imp["importance"].sum(), 1)
    fresh = data(400, 9)
    p = forest.probability(spark.createDataFrame(fresh)).toPandas()
    assert ((p["prob"] > 0.5) == (p["y"] == 1)).mean() > 0.85


def test_weights_are_poisson_and_do_not_depend_on_partitions():
    key = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 200_000)
    w = R.bootstrap_weights(key, 3, 100)
    share = np.bincount(w, minlength=5)[:5] / len(w)
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613, 0.0153], atol=0.005)
    assert (R.bootstrap_weights(key[:10], 3, 100) == w[:10]).all()
    assert (R.bootstrap_weights(key, 4, 100) != w).mean() > 0.5


@pytest.mark.parametrize("rows", [[], [(1, 2.0, 1.0), (2, 3.0, 1.0), (3, None, 0.0)]])
def test_odd_input(spark, rows):
    df = spark.createDataFrame(rows, "id long, f double, y double")
    forest, counts = R.fit_forest(df, "y", ["f"], "id", num_trees=4, max_depth=3)
    assert (forest.feature < 0).all() and sum(counts.values()) <= 2
    assert R.oob_table(counts, spark).count() == 4


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_every_core_has_rows_and_no_part_is_large(spark, monkeypatch, most):
    """One part of rows: a copy per group of trees; several parts: groups enough for the cores."""
    monkeypatch.setattr(R, "ROWS_A_TASK", most)
    pdf, cores = data(450), spark.sparkContext.defaultParallelism
    edges = [np.linspace(-2, 2, 9)] * 4
    with R.ForestRows(spark.createDataFrame(pdf).coalesce(1), "y", FEATURES, "id", edges) as rows:
        held = rows.rows.groupBy(F.spark_partition_id().alias("task"), "part", "group").agg(F.sum("n").alias("n")).toPandas()
        assert len(held) == held.task.nunique() == rows.rows.rdd.getNumPartitions() >= cores
        assert (held.groupby("group").n.sum() == 450).all() and held.n.max() <= (450 if most > 450 else 150)
        assert rows.summed(lambda total, key, y, bins: np.add.at(total, y.astype(int), 1), 2).tolist() == [
            (pdf.y == 0).sum(), (pdf.y == 1).sum()]


def fitted(df, **more):
    forest, counts = R.fit_forest(df, "y", FEATURES, "id", num_trees=20, mtry=2, max_depth=6, seed=3, **more)
    return [forest.feature, forest.cut, forest.positive, forest.decrease], counts


def coarse(n=900):
    pdf = data(n, 4)
    pdf[["f0", "f2"]] = pdf[["f0", "f2"]].round()
    return pdf


@pytest.mark.parametrize("parts", [1, 5])
def test_cells_give_the_trees_of_the_rows(spark, monkeypatch, parts):
    """Trees on weights per cell, from one or several parts of the rows, equal those on rows to the last bit."""
    df = spark.createDataFrame(pd.concat([coarse(), coarse(70)])).repartition(3)  # some keys come twice
    monkeypatch.setattr(R, "CELL_ROWS_A_TASK", 1000 // parts)
    monkeypatch.setattr(R, "BLOCK_ROWS", 20)
    monkeypatch.setattr(R, "SUMS_AT_ONCE", 20_000)
    monkeypatch.setattr(R, "ROWS_AT_ONCE", 64)
    found, counts = fitted(df)
    monkeypatch.setattr(R, "MOST_CELLS", 0)
    plain, same = fitted(df)
    assert all((a == b).all() for a, b in zip(found, plain)) and counts == same and sum(counts.values()) > 900


def test_more_cells_than_fit_are_seen(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_CELLS", 60)
    df, edges = spark.createDataFrame(data()), [np.linspace(-2, 2, 9)] * 4
    with R.CellRows(df, "y", FEATURES, "id", edges) as cells:
        assert not cells.fit
    monkeypatch.setattr(R, "MOST_CELLS", 6000)
    with R.CellRows(df, "y", FEATURES, "id", edges) as cells:
        want = np.unique(R.binned(edges, data()[FEATURES].to_numpy()), axis=0)
        assert cells.fit and cells.cells == len(want)


def test_passes_do_not_grow_with_the_depth(spark):
    df, sc = spark.createDataFrame(coarse()).repartition(3).cache(), spark.sparkContext
    jobs = []
    for depth in (2, 7):
        sc.setJobGroup(f"forest-{depth}", "")
        forest, _ = R.fit_forest(df, "y", FEATURES, "id", num_trees=5, mtry=2, max_depth=depth)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
        assert (forest.feature[:, 2 ** (depth - 1) - 1:] >= 0).any()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] <= jobs[0]


def test_equal_rows_are_judged_once_and_all_kept(spark):
    pdf = coarse()
    forest, _ = R.fit_forest(spark.createDataFrame(pdf), "y", FEATURES, "id", num_trees=10, mtry=2)
    both = pd.concat([pdf, pdf, pd.DataFrame({"id": [-1], "f0": [float("nan")], "f1": [9.0], "f2": [-9.0], "f3": [0.0], "y": [1.0]})])
    got = forest.probability(spark.createDataFrame(both)).toPandas()
    ones, total = forest.votes(forest.binned(both[FEATURES].to_numpy()))
    want = pd.DataFrame({"id": both.id, "prob": ones / total}).sort_values("id")
    assert list(got.columns) == [*both.columns, "prob"]
    assert np.allclose(got.sort_values("id")["prob"], want["prob"]) and (got.sort_values("id")["id"].to_numpy() == want["id"]).all()
