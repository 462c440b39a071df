"""The reference's end-to-end analyses composed from the operators.

Each function takes (spark, sf_dir) and returns a dict of DataFrames (lazy
plans, except where a fit needs the previous step's numbers).  The stand-ins
for the reference inputs are described in ``quire.plans.standins``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import aggregate as agg
from quire.operators import clean, evaluate, features as fe, models as M, pca, scorecard as sc, svm
from quire.operators import timeseries as ts
from quire.plans.standins import applicants, investments, materialised, segment_orders, segment_series


def investment_study(spark: SparkSession, d: str, amount_lo: float = 5000, amount_hi: float = 50000,
                     mean_lo: float = 40000, mean_hi: float = 60000) -> dict[str, DataFrame]:
    """Funding type -> countries -> sectors -> companies (one lazy plan per answer)."""
    inv = investments(spark, d)
    means = inv.groupBy("round_type").agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount"))
    chosen = agg.arg_max(means.filter(F.col("mean_amount").between(mean_lo, mean_hi)), "round_type", "mean_amount")
    chosen_type = chosen.first()["round_type"]
    typed = inv.filter(F.col("round_type") == chosen_type)
    countries = agg.top_k(typed.groupBy("country").agg(F.sum("amount").alias("total")),
                          [F.col("total").desc(), F.col("country")], 9)
    window = typed.filter(F.col("amount").between(amount_lo, amount_hi))
    sector_counts = window.groupBy("country", "sector").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    top3 = agg.top_k_per_group(sector_counts, ["country"], [F.col("n").desc(), F.col("sector")], 3, "sector_rank")
    per_company = window.groupBy("country", "sector", "company").agg(F.sum("amount").alias("company_total"))
    best_company = agg.top_k_per_group(
        per_company.join(top3.filter(F.col("sector_rank") <= 2).select("country", "sector", "sector_rank"),
                         ["country", "sector"]),
        ["country", "sector_rank"], [F.col("company_total").desc(), F.col("company")], 1, "company_rank")
    return {"type_means": means, "chosen_type": chosen, "top_countries": countries,
            "top_sectors": top3, "top_companies": best_company}


def credit_scoring_study(spark: SparkSession, d: str, split_ratio: float = 0.7, negatives_kept: float = 0.1,
                         negative_weight: float = 10.0, cutoff_start: float = 350, cutoff_stop: float = 470
                         ) -> dict[str, DataFrame]:
    """Clean -> WOE/IV -> stratified split -> balanced weighted logit with stepwise and
    VIF/p-value elimination -> evaluator -> lift -> scorecard -> cutoff table -> benefit.
    WOE and scaling are fitted on the training part only.  The applicants are joined once:
    every later step reads them again, and a join of its own sends customers through the driver."""
    a = applicants(spark, d)
    numeric, categorical = ["o_totalprice", "c_acctbal"], ["c_mktsegment", "o_orderpriority", "n_name"]
    a = materialised(clean.drop_invalid(a, F.col("o_totalprice") > 0).select("app_id", "y", *numeric, *categorical))
    split = fe.stratified_split(a, "y", "app_id", split_ratio)
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    woe = fe.fit_woe(train, "y", numeric, categorical)
    iv = fe.iv_rank(fe.woe_table(train, "y", numeric, categorical))
    feats = [f"{c}_woe" for c in numeric + categorical]
    train_w, test_w = woe.transform(train), woe.transform(test)
    balanced = fe.balance_weights(train_w, "y", "app_id", negatives_kept, negative_weight)
    step_fit, steps = M.stepwise_aic(balanced, "y", feats, weight="weights")
    final, eliminated = M.backward_eliminate(balanced, "y", step_fit.features, weight="weights")
    scored = M.score_with(final, test_w, out="p_bad")
    record = evaluate.evaluate_binary(scored, "y", "p_bad")
    cutoff_prob = record.first()["cutoff"]
    lift = evaluate.lift_table(scored, "y", "p_bad", "app_id")
    points = scored.withColumn("score", sc.score_points(F.col("p_bad")))
    cut_score = sc.cutoff_score(cutoff_prob)
    return {
        "iv": iv, "stepwise": steps, "elimination": eliminated,
        "coefficients": final.table(spark), "evaluation": record, "lift": lift,
        "score_bins": sc.score_bins(points, "score", cutoff_start, cutoff_stop, 20),
        "cutoffs": sc.scorecard_cutoffs(points, "y", "score", "o_totalprice", cutoff_start, cutoff_stop, 20),
        "score_by_outcome": points.groupBy("y").agg(F.avg("score").alias("mean_score")),
        "benefit": sc.credit_benefit(points, "y", "score", "o_totalprice", cut_score),
    }


def forecasting_study(spark: SparkSession, d: str, horizon: int = 6, width: int = 1, best: int = 2,
                      add_back_residual_ar: bool = False) -> dict[str, DataFrame]:
    """Segment CoV -> best segments -> monthly series -> smoothing -> trend regression ->
    residual ACF/PACF, tests -> AR rival -> hold-out MAPE, for the best segments and both
    measures at once.  With ``add_back_residual_ar`` the AR model fitted on the residual
    (local) series is forecast and added to the classical forecast."""
    so = segment_orders(spark, d)
    cov = agg.segment_cov(so, ["segment"], "month", "o_totalprice")
    top = agg.top_k(cov, [F.col("cov").asc(), F.col("segment")], best)
    keep = [r["segment"] for r in top.select("segment").collect()]
    series = ts.holdout(segment_series(spark, d), horizon)
    series = series.filter(F.split("series_id", r"\|")[0].isin(keep))
    train = ts.smooth(series.filter(~F.col("is_test")), width)
    fit = ts.trend_fit(train, "smoothed")
    fitted = ts.trend_predict(series, fit)
    local = ts.trend_predict(train, fit).withColumn("local", F.col("value") - F.col("fitted"))
    acf = ts.acf(local, "local")
    model = ts.ar_select(series.filter(~F.col("is_test")), "value")
    ar = ts.ar_forecast(series.filter(~F.col("is_test")), model, horizon)
    test = series.filter(F.col("is_test"))
    classical = fitted.filter(F.col("is_test")).select("series_id", "t", "value", F.lit("classical").alias("model"),
                                                        F.col("fitted").alias("forecast"))
    if add_back_residual_ar:
        local_series = local.select("series_id", "t", F.col("local").alias("value"))
        resid_model = ts.ar_select(local_series, "value")
        resid_fc = ts.ar_forecast(local_series, resid_model, horizon).select(
            "series_id", "t", F.col("forecast").alias("_resid"))
        classical = classical.join(resid_fc, ["series_id", "t"], "left").withColumn(
            "forecast", F.col("forecast") + F.coalesce(F.col("_resid"), F.lit(0.0))).drop("_resid")
    classical = classical.drop("t")
    rival = ar.join(test.select("series_id", "t", "value"), ["series_id", "t"]).select(
        "series_id", "value", F.lit("ar").alias("model"), "forecast")
    return {"segment_cov": cov, "best_segments": top, "fit": fit, "fitted": fitted, "acf": acf,
            "pacf": ts.pacf(acf), "ljung_box": ts.ljung_box_pvalues(ts.ljung_box(acf)),
            "kpss": ts.kpss(local, "local"), "adf": ts.adf(local, "local"), "ar_model": model,
            "mape": ts.mape(classical.unionByName(rival), "value", "forecast", ["series_id", "model"])}


def digits_study(spark: SparkSession, d: str, k: int = 35, sample: float = 0.3) -> dict[str, DataFrame]:
    """Near-zero-variance screen -> PCA -> linear and random-Fourier SVMs on a hash sample."""
    from quire.sources.tables import load
    e = load(spark, d, "embeddings")
    dims = [f"e{i}" for i in range(64)]
    wide = e.select("vec_id", "label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    nzv = clean.near_zero_variance(wide, dims)
    components = pca.pca_fit(e, "embedding", k)
    labelled = e.withColumn("label", F.col("label").cast("double"))
    model = svm.fit_pairwise(fe.hash_sample(labelled, "vec_id", sample), "label", "embedding")
    pred = model.predict(labelled, "embedding", ["label"])
    return {"nzv": nzv, "pca_variance": pca.pca_variance(components, spark),
            "confusion": evaluate.confusion_multiclass(pred, "label", "prediction")}


def attrition_study(spark: SparkSession, d: str, split_ratio: float = 0.7) -> dict[str, DataFrame]:
    """Join -> scale numbers and dummy-code categories (fitted on train) -> stratified split ->
    logit with stepwise AIC and VIF/p-value elimination -> cutoff sweep 0.01..0.80 ->
    confusion at the optimal cutoff -> KS (from probabilities and from hard predictions) -> lift."""
    from quire.plans.standins import attrition
    a = attrition(spark, d)
    numeric, categorical = ["n_chars", "n_words", "n_lines", "quality"], ["lang"]
    split = fe.stratified_split(a, "y", "doc_id", split_ratio, seed=100)
    train = split.filter("is_train")
    scale = fe.fit_zscore(train, numeric)
    levels = fe.fit_levels(train, categorical)
    prep = fe.dummy_code(fe.apply_zscore(split, scale), levels)
    feats = numeric + [c for c in prep.columns if ".x" in c]
    renamed = {c: c.replace(".", "_") for c in feats}
    prep = prep.withColumnsRenamed(renamed)
    feats = [renamed.get(c, c) for c in feats]
    train, test = prep.filter("is_train"), prep.filter("NOT is_train")
    step_fit, steps = M.stepwise_aic(train, "y", feats)
    final, eliminated = M.backward_eliminate(train, "y", step_fit.features)
    scored = M.score_with(final, test, out="prob")
    sweep = evaluate.cutoff_sweep(scored, "y", "prob", 0.01, 0.80, 100)
    best = evaluate.optimal_cutoff(sweep)
    cut = best.first()["cutoff"]
    hard = scored.withColumn("pred", (F.col("prob") >= F.lit(cut)).cast("double"))
    return {"coefficients": final.table(spark), "stepwise": steps, "elimination": eliminated,
            "sweep": sweep, "optimal": best,
            "confusion": evaluate.confusion_at_cutoff(scored, "y", "prob", cut),
            "ks_prob": evaluate.auc_ks(scored, "y", "prob"),
            "ks_hard": evaluate.auc_ks(hard, "y", "pred"),
            "lift": evaluate.lift_table(scored, "y", "prob", "doc_id")}
