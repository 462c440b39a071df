"""Queries for §2.9: confusion tables, cutoff sweeps, optimal cutoff, ROC/AUC/KS, lift.

All use the deterministic score ``p`` of the applicant stand-in, so DuckDB can
recompute every number."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.operators import evaluate as ev
from quire.plans.catalog import register
from quire.plans.standins import APPLICANTS_SQL, applicants, materialised
from quire.sources.tables import load

_RATES_SQL = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
       round((tp + tn) * 1.0 / (tp + fp + tn + fn), 6) AS accuracy,
       round(tp * 1.0 / nullif(tp + fn, 0), 6) AS sensitivity, round(tn * 1.0 / nullif(tn + fp, 0), 6) AS specificity"""


def _rounded(df):
    return df.select(*[r6(c).alias(c) if c in ("accuracy", "sensitivity", "specificity", "cutoff", "tolerance")
                       else F.col(c) for c in df.columns])


@register("confusion_at_cutoff", sql=f"""
WITH {APPLICANTS_SQL},
c AS (SELECT 1 AS positive, count(*) FILTER (WHERE p >= 0.33 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.33 AND y = 0) AS fp,
             count(*) FILTER (WHERE p < 0.33 AND y = 0) AS tn, count(*) FILTER (WHERE p < 0.33 AND y = 1) AS fn FROM applicants
      UNION ALL
      SELECT 0, count(*) FILTER (WHERE 1 - p >= 0.6 AND y = 0), count(*) FILTER (WHERE 1 - p >= 0.6 AND y = 1),
             count(*) FILTER (WHERE 1 - p < 0.6 AND y = 1), count(*) FILTER (WHERE 1 - p < 0.6 AND y = 0) FROM applicants)
SELECT positive, CAST(CASE positive WHEN 1 THEN 0.33 ELSE 0.6 END AS DOUBLE) AS cutoff, {_RATES_SQL} FROM c""")
def q_confusion(spark, d):
    a = applicants(spark, d)
    one = ev.confusion_at_cutoff(a, "y", "p", 0.33, positive=1).withColumn("positive", F.lit(1))
    zero = ev.confusion_at_cutoff(a.withColumn("q", 1 - F.col("p")), "y", "q", 0.6, positive=0) \
        .withColumn("positive", F.lit(0))
    return _rounded(one.unionByName(zero))


@register("confusion_multiclass", sql="""
WITH pr AS (SELECT label, list_position(embedding, list_max(embedding)) - 1 AS prediction FROM embeddings),
cells AS (SELECT label, CAST(prediction AS INTEGER) AS prediction, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY 1, 2)
SELECT label, prediction, n, round(sum(CASE WHEN label = prediction THEN n ELSE 0 END) OVER () * 1.0 / sum(n) OVER (), 6) AS accuracy
FROM cells""")
def q_confusion_multiclass(spark, d):
    e = load(spark, d, "embeddings")
    pred = (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int")
    out = ev.confusion_multiclass(e.select("label", pred.alias("prediction")), "label", "prediction")
    return out.select("label", "prediction", "n", r6("accuracy").alias("accuracy"))


def _sweep_sql(start_sql: str, by_sql: str, n: int = 100) -> str:
    return f"""
grid AS (SELECT i, {start_sql} + CAST(i AS DOUBLE) * {by_sql} AS cutoff FROM range(0, {n}) t(i)),
sw AS (SELECT g.i, g.cutoff,
              count(*) FILTER (WHERE a.p >= g.cutoff AND a.y = 1) AS tp, count(*) FILTER (WHERE a.p >= g.cutoff AND a.y = 0) AS fp,
              count(*) FILTER (WHERE a.p < g.cutoff AND a.y = 0) AS tn, count(*) FILTER (WHERE a.p < g.cutoff AND a.y = 1) AS fn
       FROM grid g, applicants a GROUP BY g.i, g.cutoff),
rates AS (SELECT CAST(i AS INTEGER) AS i, cutoff, {_RATES_SQL},
                 tp * 1.0 / nullif(tp + fn, 0) AS sens_raw, tn * 1.0 / nullif(tn + fp, 0) AS spec_raw FROM sw)"""


_HR_START, _HR_STOP = 0.01, 0.80
_HR_BY = (_HR_STOP - _HR_START) / 99


@register("cutoff_sweep", sql=f"""
WITH {APPLICANTS_SQL}, {_sweep_sql(repr(_HR_START), repr(_HR_BY))}
SELECT i, round(cutoff, 6) AS cutoff, tp, fp, tn, fn, accuracy, sensitivity, specificity FROM rates""")
def q_cutoff_sweep(spark, d):
    sw = ev.cutoff_sweep(applicants(spark, d), "y", "p", _HR_START, _HR_STOP, 100)
    return _rounded(sw)


_OPT_SQL = """
SELECT round(cutoff, 6) AS cutoff, CAST(round(tol_steps * 0.01, 6) AS DOUBLE) AS tolerance, tp, fp, tn, fn, accuracy, sensitivity, specificity
FROM (SELECT *, CAST(ceil(round(abs(sens_raw - spec_raw) / 0.01, 9)) AS BIGINT) AS tol_steps FROM rates)
ORDER BY tol_steps NULLS LAST, i LIMIT 1"""


@register("optimal_cutoff", sql=f"WITH {APPLICANTS_SQL}, {_sweep_sql(repr(_HR_START), repr(_HR_BY))}" + _OPT_SQL)
def q_optimal_cutoff(spark, d):
    best = ev.optimal_cutoff(ev.cutoff_sweep(applicants(spark, d), "y", "p", _HR_START, _HR_STOP, 100))
    return _rounded(best.select("cutoff", "tolerance", "tp", "fp", "tn", "fn", "accuracy", "sensitivity", "specificity"))


@register("cutoff_within", sql=f"""WITH {APPLICANTS_SQL}, {_sweep_sql(repr(_HR_START), repr(_HR_BY))}
SELECT round(cutoff, 6) AS cutoff, CAST(0.1 AS DOUBLE) AS tolerance, tp, fp, tn, fn, accuracy, sensitivity, specificity
FROM rates WHERE abs(sens_raw - spec_raw) < 0.1 ORDER BY i LIMIT 1""")
def q_cutoff_within(spark, d):
    """The fixed-tolerance rule on the same sweep."""
    near = ev.cutoff_within(ev.cutoff_sweep(applicants(spark, d), "y", "p", _HR_START, _HR_STOP, 100), 0.1)
    return _rounded(near.select("cutoff", "tolerance", "tp", "fp", "tn", "fn", "accuracy", "sensitivity", "specificity"))


@register("evaluate_binary", sql=f"""
WITH {APPLICANTS_SQL}, mm AS (SELECT min(p) + 0.001 AS s, max(p) - 0.001 AS e FROM applicants),
{_sweep_sql("(SELECT s FROM mm)", "(SELECT (e - s) / 99 FROM mm)")}""" + _OPT_SQL)
def q_evaluate_binary(spark, d):
    scores = materialised(applicants(spark, d).select("y", "p"))     # min/max pass + sweep pass
    return _rounded(ev.evaluate_binary(scores, "y", "p", n=100))


_ROC_SQL = f"""{APPLICANTS_SQL},
sc AS (SELECT p AS score, sum(y) AS n_pos, sum(1 - y) AS n_neg FROM applicants GROUP BY p),
roc AS (SELECT score, n_pos, n_neg,
               sum(n_pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n_pos) OVER () AS tpr,
               sum(n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n_neg) OVER () AS fpr,
               n_pos * 1.0 / sum(n_pos) OVER () AS dp, n_neg * 1.0 / sum(n_neg) OVER () AS dn FROM sc)"""


@register("roc_points", sql=f"""
WITH {_ROC_SQL} SELECT round(score, 6) AS score, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc""")
def q_roc_points(spark, d):
    roc = ev.roc_points(materialised(applicants(spark, d).select("y", "p")), "y", "p")
    return roc.select(r6("score").alias("score"), F.col("n_pos").cast("long").alias("n_pos"),
                      F.col("n_neg").cast("long").alias("n_neg"), r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@register("ks_curve", sql=f"""
WITH {_ROC_SQL} SELECT round(score, 6) AS score, round(tpr - fpr, 6) AS ks_gap,
round((sum(n_pos + n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) * 1.0 / sum(n_pos + n_neg) OVER (), 6) AS population
FROM roc""")
def q_ks_curve(spark, d):
    kc = ev.ks_curve(materialised(applicants(spark, d).select("y", "p")), "y", "p")
    return kc.select(r6("score").alias("score"), r6("ks_gap").alias("ks_gap"), r6("population").alias("population"))


@register("auc", sql=f"WITH {_ROC_SQL} SELECT round(sum(dn * (tpr + tpr - dp) / 2), 6) AS auc FROM roc")
def q_auc(spark, d):
    return ev.auc_ks(materialised(applicants(spark, d).select("y", "p")), "y", "p").select(r6("auc").alias("auc"))


@register("ks_stat", sql=f"WITH {_ROC_SQL} SELECT round(max(tpr - fpr), 6) AS ks FROM roc")
def q_ks(spark, d):
    return ev.auc_ks(materialised(applicants(spark, d).select("y", "p")), "y", "p").select(r6("ks").alias("ks"))


@register("lift_table", sql=f"""
WITH {APPLICANTS_SQL},
t AS (SELECT y, ntile(10) OVER (ORDER BY p DESC, app_id) AS bucket FROM applicants),
g AS (SELECT bucket, count(*) AS total, sum(y) AS totalresp FROM t GROUP BY bucket)
SELECT CAST(bucket AS BIGINT) AS bucket, CAST(total AS BIGINT) AS total, CAST(totalresp AS BIGINT) AS totalresp,
       CAST(sum(totalresp) OVER (ORDER BY bucket) AS BIGINT) AS cumresp,
       round(sum(totalresp) OVER (ORDER BY bucket) * 100.0 / sum(totalresp) OVER (), 6) AS gain,
       round(sum(totalresp) OVER (ORDER BY bucket) * 100.0 / sum(totalresp) OVER () / (bucket * 10.0), 6) AS cumlift
FROM g""")
def q_lift_table(spark, d):
    lt = ev.lift_table(applicants(spark, d), "y", "p", "app_id", 10)
    return lt.select("bucket", "total", "totalresp", F.col("cumresp").cast("long").alias("cumresp"),
                     r6("gain").alias("gain"), r6("cumlift").alias("cumlift"))
