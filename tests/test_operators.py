"""Hand-worked frames and numpy/duckdb re-computations for the core operators."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import clean, evaluate as ev, features as fe, scorecard as sc
from quire.operators.quantile import grouped_quantiles
from quire.operators.rank import global_cumsum, global_ntile, global_rank, rank_within


def _scores(spark, n=200, hot=0.34, seed=0):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0, 1, n), 3)
    p[: int(n * hot)] = 0.5                      # one value holds a third of the rows
    y = (rng.uniform(0, 1, n) < p).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "p": p})
    return spark.createDataFrame(pdf), pdf


def test_global_rank_matches_row_number_with_hot_value(spark):
    df, pdf = _scores(spark)
    got = global_rank(df, [F.col("p").desc(), F.col("id")], num_partitions=7).toPandas()
    exp = pdf.sort_values(["p", "id"], ascending=[False, True]).reset_index(drop=True)
    exp["rank"] = np.arange(1, len(exp) + 1)
    m = got.merge(exp[["id", "rank"]], on="id", suffixes=("", "_exp"))
    assert (m["rank"] == m["rank_exp"]).all()


@pytest.mark.parametrize("n,k", [(200, 10), (7, 10), (23, 4), (1, 3)])
def test_global_ntile_equals_sql_ntile(spark, n, k):
    df, pdf = _scores(spark, n=n)
    got = global_ntile(df, [F.col("p").desc(), F.col("id")], k).toPandas().set_index("id")["tile"]
    exp = duckdb.sql(f"SELECT id, ntile({k}) OVER (ORDER BY p DESC, id) AS t FROM pdf").df().set_index("id")["t"]
    assert (got.sort_index().values == exp.sort_index().values).all()


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=60), st.integers(min_value=1, max_value=12))
def test_ntile_sizes_differ_by_at_most_one(spark, n, k):
    df, _ = _scores(spark, n=n, seed=n)
    sizes = global_ntile(df, [F.col("id")], k).groupBy("tile").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == n


def test_rank_within_groups(spark):
    df, pdf = _scores(spark)
    got = rank_within(df, ["y"], [F.col("p"), F.col("id")], size_col="size").toPandas()
    pdf = pdf.sort_values(["y", "p", "id"])
    pdf["r"] = pdf.groupby("y").cumcount() + 1
    m = got.merge(pdf[["id", "r"]], on="id")
    assert (m["rank"] == m["r"]).all()


def test_quantiles_are_r_type7(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 301), "x": rng.normal(0, 1, 301).round(2)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = grouped_quantiles(df, ["g"], "x", probs).toPandas()
    for (g, p), q in got.set_index(["g", "prob"])["q"].items():
        vals = pdf.loc[(pdf.g == g) & pdf.x.notna(), "x"].to_numpy()
        assert math.isclose(q, np.quantile(vals, p), rel_tol=1e-12, abs_tol=1e-12)


def test_global_cumsum(spark):
    df, pdf = _scores(spark)
    got = global_cumsum(df, [F.col("p"), F.col("id")], ["y"]).toPandas().sort_values(["p", "id"])
    assert (got["y_cum"].values == pdf.sort_values(["p", "id"])["y"].cumsum().values).all()


def test_bucketize_and_cut_edges(spark):
    pdf = pd.DataFrame({"x": [None, 24999.0, 25000.0, 75000.0, 75000.5, 300000.0, 300000.1,
                              350.0, 350.5, 370.0, 470.0, 471.0]})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    out = df.select("x", S.bucketize("x", [25000, 75000, 150000, 300000],
                                     ["a", "b", "c", "d", "e"]).alias("b"),
                    S.cut_bins("x", 350, 470, 20).alias("cut")).toPandas()
    b = dict(zip(out.x.fillna(-1), out.b))
    assert b[-1] is None and b[24999.0] == "a" and b[25000.0] == "b" and b[75000.0] == "b"
    assert b[75000.5] == "c" and b[300000.0] == "d" and b[300000.1] == "e"
    c = dict(zip(out.x.fillna(-1), out.cut))
    assert c[350.0] is None and c[350.5] == "(350,370]" and c[370.0] == "(350,370]"
    assert c[470.0] == "(450,470]" and c[471.0] is None


def test_round_half_even(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [0.5, 1.5, 2.5, -0.5, -1.5]}))
    assert [r[0] for r in df.select(S.round_even("x")).collect()] == [0.0, 2.0, 2.0, -0.0, -2.0]


def test_dedupe_first_keeps_first_occurrence(spark):
    pdf = pd.DataFrame({"id": [1, 1, 2, 2, 2, 3], "seq": [2, 1, 5, 3, 4, 1], "v": [10., 11., 20., 21., 22., 30.]})
    got = clean.dedupe_first(spark.createDataFrame(pdf), ["id"], "seq").toPandas().sort_values("id")
    assert got["v"].tolist() == [11.0, 21.0, 30.0]


def test_near_zero_variance_hand_worked(spark):
    pdf = pd.DataFrame({"a": [1] * 96 + [2] * 4, "b": list(range(100)), "c": [7] * 100,
                        "d": [1] * 50 + [2] * 50})
    got = clean.near_zero_variance(spark.createDataFrame(pdf), ["a", "b", "c", "d"]).toPandas().set_index("feature")
    assert got.loc["a", "freq_ratio"] == 24.0 and got.loc["a", "nzv"]
    assert not got.loc["b", "nzv"] and got.loc["c", "zero_var"] and got.loc["c", "nzv"]
    assert got.loc["d", "freq_ratio"] == 1.0 and not got.loc["d", "nzv"]


def test_null_tokens_and_constant_columns(spark):
    from quire.sources.readers import normalise_nulls
    pdf = pd.DataFrame({"id": [1, 2, 3, 4, 5], "s": ["", " ", "NA", "n/a", "x"], "k": ["z"] * 5})
    df = normalise_nulls(spark.createDataFrame(pdf), ("", " ", "NA", "n/a"))
    assert [r[0] for r in df.orderBy("id").select("s").collect()] == [None, None, None, None, "x"]
    rep = clean.constant_columns_report(df).toPandas().set_index("column")
    assert rep.loc["k", "dropped"] and not rep.loc["s", "dropped"] and rep.loc["s", "n_distinct"] == 2


def test_woe_properties(spark):
    rng = np.random.default_rng(5)
    n = 500
    pdf = pd.DataFrame({"x": rng.normal(0, 1, n), "g": rng.choice(["a", "b", "c"], n), "y": rng.integers(0, 2, n)})
    pdf.loc[:9, "x"] = np.nan
    pdf.loc[pdf.g == "c", "y"] = 0            # empty cell: no bad rows in level c
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    t = fe.woe_table(df, "y", ["x"], ["g"]).toPandas()
    assert t.groupby("feature")["n"].sum().eq(n).all()
    assert (t["iv"] >= -1e-12).all()
    assert t.loc[(t.feature == "g") & (t.bin == "c"), "woe"].iloc[0] == 0.0
    assert "NA" in set(t.loc[t.feature == "x", "bin"])
    model = fe.fit_woe(df, "y", ["x"], ["g"])
    out = model.transform(df).toPandas()
    assert out["g_woe"].notna().all() and out["x_woe"].notna().all()


def test_stratified_split_disjoint_and_ratio(spark):
    df, pdf = _scores(spark, n=400)
    out = fe.stratified_split(df, "y", "id", 0.7).toPandas()
    assert len(out) == 400 and out["id"].is_unique
    for y, g in out.groupby("y"):
        assert g["is_train"].sum() == round(0.7 * len(g))


def test_lift_gain_ends_at_100_and_lift_1(spark):
    df, _ = _scores(spark, n=257)
    lt = ev.lift_table(df, "y", "p", "id").toPandas().sort_values("bucket")
    assert math.isclose(lt["gain"].iloc[-1], 100.0) and math.isclose(lt["cumlift"].iloc[-1], 1.0)
    assert lt["total"].sum() == 257


def test_cutoff_sweep_matches_brute_force(spark):
    df, pdf = _scores(spark, n=300)
    start, stop, n = 0.0, 0.99, 100
    sw = ev.cutoff_sweep(df, "y", "p", start, stop, n).toPandas().sort_values("i")
    by = (stop - start) / (n - 1)
    for _, r in sw.iterrows():
        c = start + r["i"] * by
        pred = pdf.p >= c
        assert r["tp"] == int((pred & (pdf.y == 1)).sum()) and r["fp"] == int((pred & (pdf.y == 0)).sum())


def test_auc_equals_rank_sum(spark):
    df, pdf = _scores(spark, n=300)
    got = ev.auc_ks(df, "y", "p").first()
    r = pdf["p"].rank()
    P, N = pdf.y.sum(), (1 - pdf.y).sum()
    auc = (r[pdf.y == 1].sum() - P * (P + 1) / 2) / (P * N)
    assert math.isclose(got["auc"], auc, rel_tol=1e-9)


def test_score_points_monotone_and_anchor(spark):
    df = spark.createDataFrame(pd.DataFrame({"p": [1 / 11, 0.2, 0.5, 0.9]}))
    s = [r[0] for r in df.select(sc.score_points(F.col("p"))).collect()]
    assert math.isclose(s[0], 400.0) and all(a > b for a, b in zip(s, s[1:]))


def test_scorecard_cutoffs_brute_force(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"score": rng.uniform(330, 480, 400).round(1), "y": rng.integers(0, 2, 400),
                        "bal": rng.uniform(0, 1000, 400)})
    pdf.loc[:5, "score"] = [350.0, 370.0, 470.0, 349.9, 469.9, 470.1]
    got = sc.scorecard_cutoffs(spark.createDataFrame(pdf), "y", "score", "bal", 350, 470, 20).toPandas()
    for _, r in got.iterrows():
        c = -np.inf if r["cutoff"] == "No_Cutoffs" else float(r["cutoff"][:-1])
        acc = pdf[pdf.score >= c]
        assert math.isclose(r["default_pct"], acc.y.mean() * 100)
        assert math.isclose(r["credit_risk"], acc.loc[acc.y == 1, "bal"].sum())
        assert r["customer_loss"] == (pdf.y == 0).sum() - (acc.y == 0).sum()


def test_quantiles_keep_a_null_group(spark):
    pdf = pd.DataFrame({"g": ["a", "a", "a", None, None], "x": [1.0, 2.0, 3.0, 10.0, 20.0]})
    got = grouped_quantiles(spark.createDataFrame(pdf), ["g"], "x", [0.5]).toPandas()
    res = {(None if pd.isna(g) else g): q for g, q in zip(got["g"], got["q"])}
    assert res == {"a": 2.0, None: 15.0}


def test_rank_within_null_group(spark):
    pdf = pd.DataFrame({"g": [None, None, "b"], "v": [2.0, 1.0, 5.0]})
    got = rank_within(spark.createDataFrame(pdf), ["g"], [F.col("v")]).toPandas()
    assert sorted(got["rank"].tolist()) == [1, 1, 2]


def test_edge_cases_empty_single_one_class(spark):
    schema = "id long, y int, p double"
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, 1, 0.4)], schema)
    only_pos = spark.createDataFrame([(i, 1, i / 10) for i in range(1, 6)], schema)
    # empty input: zero-count sweeps, no quantiles, empty lift
    sw = ev.cutoff_sweep(empty, "y", "p", 0.1, 0.9, 5).toPandas()
    assert len(sw) == 5 and (sw["tp"] == 0).all() and sw["sensitivity"].isna().all()
    assert grouped_quantiles(empty, [], "p", [0.5]).count() == 0
    assert ev.lift_table(empty, "y", "p", "id").count() == 0
    # single row
    q = grouped_quantiles(one, [], "p", [0.0, 0.5, 1.0]).toPandas()
    assert (q["q"] == 0.4).all()
    assert global_ntile(one, [F.col("p")], 10).first()["tile"] == 1
    # one class only: specificity undefined, sensitivity defined
    c = ev.confusion_at_cutoff(only_pos, "y", "p", 0.3).first()
    assert c["specificity"] is None and c["sensitivity"] == 0.6
    ak = ev.auc_ks(only_pos, "y", "p").first()
    assert ak["auc"] is None or math.isnan(ak["auc"])


def _trim_ref(v, trim=0.1):
    v = np.sort(v)
    k = int(np.floor(len(v) * trim))
    return v[k:len(v) - k].mean()


def test_trimmed_mean_with_a_hot_value(spark):
    from quire.operators.profile import trimmed_mean
    rng = np.random.default_rng(31)
    n = 40000
    x = rng.normal(size=n).round(3)
    x[: n // 10] = 1.5                              # a tie block near a trim point
    g = rng.choice(["a", "b"], n)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x}))
    got = trimmed_mean(df, ["g"], "x", 0.1).toPandas().set_index("g")["trimmed"]
    for gg in ["a", "b"]:
        assert math.isclose(got[gg], _trim_ref(x[g == gg]), rel_tol=1e-12)


@pytest.mark.parametrize("n,ratio", [(5, 0.7), (400, 0.7), (3001, 0.3), (20000, 0.8)])
def test_hash_split_equals_ranking_every_row(spark, n, ratio):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"id": np.arange(n), "y": rng.integers(0, 2, n)})
    df = spark.createDataFrame(pdf)
    got = fe.stratified_split(df, "y", "id", ratio).toPandas().set_index("id")["is_train"]
    import hashlib
    pdf["h"] = [hashlib.md5(f"1:{i}".encode()).hexdigest() for i in pdf["id"]]
    pdf = pdf.sort_values(["h", "id"])
    pdf["r"] = pdf.groupby("y").cumcount() + 1
    size = pdf.groupby("y")["id"].transform("size")
    want = pdf.assign(w=pdf["r"] <= (size * ratio).round()).set_index("id")["w"]
    assert (got.sort_index() == want.sort_index()).all()
    sample = fe.hash_sample(df, "id", ratio).toPandas()["id"]
    assert sorted(sample) == sorted(pdf["id"].head(int(np.floor(n * ratio))))


def test_hash_split_keeps_repeated_keys_together(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(2000)], "k long, v long")
    got = fe.shuffle_split(df, "k", 0.555).toPandas()
    assert len(got) == 2000 and got.groupby("k")["is_train"].nunique().max() == 1
    assert 1110 <= got["is_train"].sum() < 1110 + 40
    assert fe.shuffle_split(df.limit(0), "k", 0.5).count() == 0
    assert not fe.shuffle_split(df, "k", 0.0).where("is_train").count()


def test_two_digit_year_pivot(spark):
    df = spark.createDataFrame(pd.DataFrame({"s": ["Dec-11", "Jan-68", "Jan-69", "Mar-99", "bad"]}))
    got = [r[0] for r in df.select(S.parse_two_digit_year_date("s", "MMM-yy")).collect()]
    assert [d.isoformat() if d else None for d in got] == ["2011-12-01", "2068-01-01", "1969-01-01", "1999-03-01", None]


def test_drop_near_zero_variance_from_train_and_test(spark):
    pdf = pd.DataFrame({"a": [1] * 96 + [2] * 4, "b": list(range(100)), "c": [7] * 100})
    train = spark.createDataFrame(pdf)
    test = spark.createDataFrame(pdf.head(10))
    rep = clean.near_zero_variance(train, ["a", "b", "c"])
    tr, te = clean.drop_near_zero_variance(rep, train, test)
    assert tr.columns == ["b"] and te.columns == ["b"]


@pytest.mark.parametrize("start,stop", [(0.6, 0.4), (0.5, 0.5)])
def test_cutoff_sweep_degenerate_grids(spark, start, stop):
    df, pdf = _scores(spark, n=120)
    sw = ev.cutoff_sweep(df, "y", "p", start, stop, 7).toPandas().sort_values("i")
    by = (stop - start) / 6
    for _, r in sw.iterrows():
        pred = pdf.p >= start + r["i"] * by
        assert r["tp"] == int((pred & (pdf.y == 1)).sum()) and r["fp"] == int((pred & (pdf.y == 0)).sum())


def test_caps_keep_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (7.0,), (1000.0,)], "x double")
    assert [r[0] for r in clean.cap_constant(df, {"x": 6.0}).collect()] == [None, 5.0, 6.0, 6.0]
    assert clean.iqr_cap(df, ["x"]).where("x IS NULL").count() == 1


def test_all_null_column_is_zero_variance(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {r["feature"]: (r["zero_var"], r["nzv"]) for r in clean.near_zero_variance(df, ["a", "b"]).collect()}
    assert got == {"a": (False, False), "b": (True, True)}


def test_constant_columns_without_distinct_counts(spark):
    df = spark.createDataFrame([(1, None, "x", None, 1), (1, None, "x", "a", 2)], "a int, b string, c string, d string, e int")
    assert clean.constant_columns(df) == ["a", "b", "c"]


def test_woe_beyond_the_training_range_and_null_level(spark):
    rows = [(float(i), "NA" if i % 3 else None, int(i % 7 == 0 or (i > 900 and i % 2))) for i in range(1, 1001)]
    train = spark.createDataFrame(rows, "x double, g string, y int")
    model = fe.fit_woe(train, "y", ["x"], ["g"])
    test = spark.createDataFrame([(1000.0, "NA"), (1001.0, None), (-5.0, "new"), (1.0, None)], "x double, g string")
    got = [tuple(r) for r in model.transform(test).select("x_woe", "g_woe").collect()]
    assert got[0][0] == got[1][0] != 0.0 and got[2][0] == got[3][0] != 0.0
    assert got[0][1] != got[1][1] == got[3][1] and got[2][1] == 0.0


def test_wide_woe_feature_is_joined(spark, monkeypatch):
    train = spark.createDataFrame([(f"g{i % 9}" if i % 9 else None, int(i % 4 == 0 or i % 9 == 1)) for i in range(400)], "g string, y int")
    small = fe.fit_woe(train, "y", [], ["g"]).transform(train).select("g", "g_woe").distinct().collect()
    monkeypatch.setattr(fe, "MAX_MAP_CELLS", 2)
    model = fe.fit_woe(train, "y", [], ["g"])
    assert list(model.wide) == ["g"]
    assert sorted(map(str, model.transform(train).select("g", "g_woe").distinct().collect())) == sorted(map(str, small))


def test_levels_that_clean_to_one_name(spark):
    df = spark.createDataFrame([("A",), ("B C",), ("B-C",), ("B.C",)], "g string")
    out = fe.dummy_code(df, fe.fit_levels(df, ["g"]))
    assert out.columns == ["g.xB.C", "g.xB.C.1", "g.xB.C.2"]
    assert [sum(r) for r in out.collect()] == [0, 1, 1, 1]
    _, vec = fe.sparse_dummies(df, ["g"])
    assert len({str(r["g_vec"]) for r in vec.collect()}) == 4


def test_scores_of_certain_and_missing_probabilities(spark):
    df = spark.createDataFrame([(0, 0.0, 10.0), (1, 1.0, 10.0), (0, None, 10.0), (1, None, 10.0), (0, 0.5, 10.0)], "y int, p double, e double")
    s = df.withColumn("score", sc.score_points(F.col("p")))
    assert [r["score"] for r in s.collect()][:3] == [math.inf, -math.inf, None]
    cut = {r["cutoff"]: r for r in sc.scorecard_cutoffs(s, "y", "score", "e", 350, 390, 20).collect()}
    assert cut["390+"]["customer_loss"] == 1 and cut["No_Cutoffs"]["credit_risk"] == 10.0
    b = sc.credit_benefit(s, "y", "score", "e", 350).first()
    assert b["customer_loss_pct"] == 50.0 and b["credit_saved"] == 10.0


def test_missing_scores_are_in_no_cell(spark):
    df = spark.createDataFrame([(1, None), (0, None), (1, 0.7), (0, 0.2)], "y int, p double")
    for grid in ((0.0, 1.0), (1.0, 0.0)):
        sw = ev.cutoff_sweep(df, "y", "p", *grid, 5).toPandas()
        assert ((sw.tp + sw.fp + sw.tn + sw.fn) == 2).all()


def test_fixed_tolerance_cutoff(spark):
    sweep = spark.createDataFrame([(0, 0.1, 0.9, 0.5), (1, 0.2, 0.70, 0.695), (2, 0.3, 0.6, 0.8)], "i int, cutoff double, sensitivity double, specificity double")
    assert ev.cutoff_within(sweep, 0.01).first()["i"] == 1 and ev.cutoff_within(sweep, 0.001).count() == 0


def test_levels_come_from_the_data(spark):
    from quire.operators import aggregate as agg
    df = spark.createDataFrame([("a", "x"), ("a", "new level"), ("b", "x")], "r string, c string")
    assert agg.crosstab(df, "r", "c").orderBy("r").collect()[0].asDict() == {"r": "a", "new level": 1, "x": 1}
    assert agg.crosstab_long(df, "r", "c").count() == 3


def test_array_covariance(spark):
    from quire.operators import aggregate as agg
    x = np.random.default_rng(0).normal(1e6, 1, (300, 5))
    got = agg.array_covariance(spark.createDataFrame([(list(map(float, r)),) for r in x] + [(None,)], "v array<double>"), "v", 5).collect()
    want = np.cov(x.T)
    assert len(got) == 15 and all(math.isclose(r["cov"], want[r["i"], r["j"]], rel_tol=1e-6, abs_tol=1e-9) for r in got)


def test_evaluate_binary_without_scores_and_with_one(spark):
    from quire.operators.evaluate import evaluate_binary
    schema = "y int, p double"
    assert evaluate_binary(spark.createDataFrame([], schema), "y", "p").count() == 0
    assert evaluate_binary(spark.createDataFrame([(1, None)], schema), "y", "p").count() == 0
    one = evaluate_binary(spark.createDataFrame([(1, 0.4), (0, 0.4), (1, 0.4)], schema), "y", "p").first()
    assert (one["cutoff"], one["tp"], one["fp"], one["tn"], one["fn"]) == (0.4, 2, 1, 0, 0)
    near = evaluate_binary(spark.createDataFrame([(1, 0.4005), (0, 0.4)], schema), "y", "p").first()
    assert near["accuracy"] == 1.0 and near["tolerance"] == 0.0


def test_last_month_stays_when_complete(spark, sf_dir, tmp_path):
    import shutil
    from quire.plans.standins import segment_orders
    for t in ("customer", "nation", "region"):
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    seen = {}
    for name, end in (("whole", "1995-03-31"), ("part", "1995-03-30")):
        orders.where(F.col("o_orderdate").cast("date") <= F.lit(end)).write.mode("overwrite").parquet(
            str(tmp_path / "orders.parquet"))
        seen[name] = str(segment_orders(spark, str(tmp_path)).agg(F.max("month")).first()[0])
        spark.catalog.clearCache()
    assert seen == {"whole": "1995-03-01", "part": "1995-02-01"}
