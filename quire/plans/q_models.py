"""Queries for §2.8: model fits and their tables (rows-only checks; the numpy
re-computations live in tests), plus logit scoring with fixed coefficients (SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.operators import evaluate as ev
from quire.operators import features as fe
from quire.operators import models as M
from quire.operators import forest, nets, svm
from quire.plans.catalog import register
from quire.plans.standins import APPLICANTS_SQL, applicants, materialised
from quire.sources.tables import load

NUMERIC = ["o_totalprice", "c_acctbal", "order_year"]
CATEGORICAL = ["c_mktsegment", "o_orderpriority"]


def model_frame(spark, d):
    """Applicants with z-scored numbers and dummy-coded categories (first level dropped)."""
    a = materialised(applicants(spark, d).select("app_id", "y", *NUMERIC, *CATEGORICAL))
    a = fe.zscore(a, NUMERIC)
    levels = fe.fit_levels(a, CATEGORICAL)
    a = fe.dummy_code(a, levels)
    feats = NUMERIC + [c for c in a.columns if ".x" in c]
    renamed = {c: c.replace(".", "_") for c in feats}
    a = a.withColumnsRenamed(renamed)
    return a, [renamed.get(c, c) for c in feats]


@register("logit_coefficients")
def q_logit_coefficients(spark, d):
    a, feats = model_frame(spark, d)
    fit = M.logit_fit(a, "y", feats)
    return fit.table(spark).withColumn("aic", F.lit(fit.aic))


@register("weighted_logit")
def q_weighted_logit(spark, d):
    a, feats = model_frame(spark, d)
    bal = fe.balance_weights(a, "y", "app_id", fraction=0.5, weight=2.0)
    fit = M.logit_fit(bal, "y", feats, weight="weights")
    return fit.table(spark).withColumn("aic", F.lit(fit.aic))


@register("stepwise_aic")
def q_stepwise_aic(spark, d):
    a, feats = model_frame(spark, d)
    _, steps = M.stepwise_aic(a, "y", feats)
    return steps


@register("vif_table")
def q_vif_table(spark, d):
    a, feats = model_frame(spark, d)
    fit = M.logit_fit(a, "y", feats)
    return M.vif_table(a, fit)


@register("backward_eliminate")
def q_backward_eliminate(spark, d):
    a, feats = model_frame(spark, d)
    fit, steps = M.backward_eliminate(a, "y", feats, vif_max=2.0, p_max=0.05)
    kept = fit.table(spark).withColumn("status", F.lit("kept")).select(
        "term", "status", "estimate", "p_value")
    dropped = steps.select(F.col("dropped").alias("term"), F.concat(F.lit("dropped:"), "reason").alias("status"),
                           F.lit(None).cast("double").alias("estimate"), "p_value")
    return kept.unionByName(dropped)


# Coefficients of a deployed logit used to score new rows.
SCORE_INTERCEPT = -1.2
SCORE_COEF = {"o_totalprice": 2.0e-6, "c_acctbal": -4.0e-5}


@register("logit_score", sql=f"""
WITH {APPLICANTS_SQL}
SELECT app_id, round(1.0 / (1.0 + exp(-({SCORE_INTERCEPT} + {SCORE_COEF['o_totalprice']!r} * o_totalprice
                                      + {SCORE_COEF['c_acctbal']!r} * c_acctbal))), 6) AS prob FROM applicants""")
def q_logit_score(spark, d):
    a = applicants(spark, d)
    return a.select("app_id", r6(M.logit_predict_expr(SCORE_INTERCEPT, SCORE_COEF)).alias("prob"))


# The reference's forest; the depth is the operator's default.
FOREST_TREES, FOREST_MTRY = 1000, 5


def _rf(spark, d):
    a, feats = model_frame(spark, d)
    split = fe.shuffle_split(a, "app_id", 0.8, seed=11)
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    found, counts = forest.fit_forest(train, "y", feats, "app_id", FOREST_TREES, FOREST_MTRY)
    return found, counts, test


@register("random_forest_importance")
def q_random_forest_importance(spark, d):
    return _rf(spark, d)[0].importances(spark)


@register("random_forest_oob")
def q_random_forest_oob(spark, d):
    """Out-of-bag confusion: every row judged by the trees whose sample left it out."""
    return forest.oob_table(_rf(spark, d)[1], spark)


@register("random_forest_eval")
def q_random_forest_eval(spark, d):
    """Hold-out evaluation of the forest: optimal-cutoff record plus AUC and KS."""
    found, _, test = _rf(spark, d)
    scored = materialised(found.probability(test).select("app_id", "y", "prob"))
    best = ev.evaluate_binary(scored, "y", "prob", n=100, start=0.01, stop=0.99)
    ak = ev.auc_ks(scored, "y", "prob").first()
    return best.withColumns({"auc": F.lit(ak["auc"]), "ks": F.lit(ak["ks"])})


# The reference's net for the demographic file.
NET_HIDDEN, NET_RESTARTS, NET_THRESHOLD = 5, 5, 0.01
#: guard against nets that do not settle; the result says whether the threshold was reached
NET_MOST_PASSES = 300


def _net(spark, d):
    a, feats = model_frame(spark, d)
    return a, nets.resilient_net(a, "y", feats, NET_HIDDEN, NET_RESTARTS, NET_THRESHOLD,
                                  max_steps=NET_MOST_PASSES)


@register("mlp_scores")
def q_mlp_scores(spark, d):
    """Every row scored by the best of five nets, with its error and whether the threshold was reached."""
    a, net = _net(spark, d)
    return a.select("app_id", "y", net.probability().alias("prob"), F.lit(net.error).alias("train_loss"),
                    F.lit(net.reached).alias("reached"))


@register("mlp_restarts")
def q_mlp_restarts(spark, d):
    """Error, largest slope and passes of each of the five nets."""
    _, net = _net(spark, d)
    return net.restart_table(spark)


def _digits(spark, d):
    e = load(spark, d, "embeddings")
    e = e.withColumn("x", fe.scale_array("embedding", 1.0)).withColumn("label", F.col("label").cast("double"))
    split = fe.shuffle_split(e, "vec_id", 0.8, seed=5)
    return split


def _judged(split, cost, sigma=None, sample=None):
    """Confusion on the test part of machines for all class pairs fitted on (a sample of) the train part."""
    train = split.filter("is_train") if sample is None else sample
    model = svm.fit_pairwise(train, "label", "x", cost, sigma)
    pred = model.predict(split.filter("NOT is_train"), "x", ["label"])
    return ev.confusion_multiclass(pred, "label", "prediction").withColumns(
        {"gap": F.lit(model.gap), "steps": F.lit(model.steps)})


@register("svm_linear")
def q_svm_linear(spark, d):
    return _judged(_digits(spark, d), 1.0)


@register("svm_rff")
def q_svm_rff(spark, d):
    return _judged(_digits(spark, d), 1.0, sigma=0.5)


# The reference's grid and sample.
GRID_SIGMAS, GRID_COSTS, GRID_FOLDS, GRID_SAMPLE = [0.01, 0.02, 0.03, 0.04, 0.05], [1.0, 2.0, 3.0, 4.0, 5.0], 5, 0.3


@register("cv_grid")
def q_cv_grid(spark, d):
    """Cross-validated grid over kernel width and cost on a hash sample of the training part."""
    s = fe.hash_sample(_digits(spark, d).filter("is_train"), "vec_id", GRID_SAMPLE, seed=3)
    return svm.cv_grid(s, "label", "x", "vec_id", GRID_SIGMAS, GRID_COSTS, GRID_FOLDS)


@register("svm_tuned")
def q_svm_tuned(spark, d):
    """The machine refitted on the sample at the grid's best pair, judged on the test part."""
    split = materialised(_digits(spark, d).select("vec_id", "x", "label", "is_train"))
    s = fe.hash_sample(split.filter("is_train"), "vec_id", GRID_SAMPLE, seed=3)
    best = svm.cv_grid(s, "label", "x", "vec_id", GRID_SIGMAS, GRID_COSTS, GRID_FOLDS).where("best") \
        .orderBy("sigma", "cost").first()
    out = _judged(split, best["cost"], best["sigma"], sample=s)
    return out.withColumns({"sigma": F.lit(best["sigma"]), "cost": F.lit(best["cost"])})


@register("attrition_evaluation")
def q_attrition_evaluation(spark, d):
    """Attrition model judged on the hold-out: optimal cutoff on the 0.01..0.80 sweep,
    confusion there, KS from probabilities and from the hard predictions."""
    from quire.plans.case_studies import attrition_study
    out = attrition_study(spark, d)
    best = out["optimal"].select("cutoff", "accuracy", "sensitivity", "specificity")
    kp, kh = out["ks_prob"].first(), out["ks_hard"].first()
    return best.withColumns({"auc": F.lit(kp["auc"]), "ks": F.lit(kp["ks"]), "ks_hard": F.lit(kh["ks"])})
