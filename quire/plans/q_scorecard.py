"""Queries for §2.10: scorecard points, bins, cutoff table and benefit."""

from __future__ import annotations


from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.operators import scorecard as sc
from quire.plans.catalog import register
from quire.plans.standins import APPLICANTS_SQL, applicants, materialised

_FACTOR, _OFFSET = sc.factor_offset()
_SCORE_SQL = f"({_OFFSET!r} + {_FACTOR!r} * ln((1.0 - p) / p))"
SCORED_SQL = f"{APPLICANTS_SQL},\nscored AS (SELECT *, {_SCORE_SQL} AS score FROM applicants)"
# The cutoff probability turned into the deployed cutoff score.
CUTOFF_PROB = 0.3


def scored(spark, d):
    return applicants(spark, d).withColumn("score", sc.score_points(F.col("p")))


@register("score_points", sql=f"WITH {SCORED_SQL} SELECT app_id, round(score, 6) AS score FROM scored")
def q_score_points(spark, d):
    return scored(spark, d).select("app_id", r6("score").alias("score"))


@register("score_bins", sql=f"""
WITH {SCORED_SQL}
SELECT CASE WHEN score > 350 AND score <= 470
            THEN '(' || CAST(350 + (ceil((score - 350) / 20.0) - 1) * 20 AS BIGINT) || ','
                 || CAST(350 + ceil((score - 350) / 20.0) * 20 AS BIGINT) || ']' END AS bin,
       CAST(count(*) AS BIGINT) AS n,
       round(any_value(m), 6) AS mean, round(any_value(s), 6) AS sd, round(any_value(lo), 6) AS min, round(any_value(hi), 6) AS max
FROM scored, (SELECT avg(score) AS m, stddev_samp(score) AS s, min(score) AS lo, max(score) AS hi FROM scored) st
GROUP BY 1""")
def q_score_bins(spark, d):
    s = materialised(scored(spark, d).select("score"))      # stats pass + bins pass
    st = sc.score_stats(s, "score").first()
    bins = sc.score_bins(s, "score", 350, 470, 20)
    return bins.select("bin", "n", *[F.lit(round(st[k], 6)).alias(k) for k in ("mean", "sd", "min", "max")])


@register("scorecard_cutoffs", sql=f"""
WITH {SCORED_SQL},
cuts AS (SELECT CAST(k AS INTEGER) AS cutoff_order, CASE WHEN k = 0 THEN 'No_Cutoffs' ELSE CAST(350 + (k - 1) * 20 AS VARCHAR) || '+' END AS cutoff,
                CASE WHEN k = 0 THEN -1e300 ELSE 350 + (k - 1) * 20 END AS c FROM range(0, 8) t(k))
SELECT cutoff, cutoff_order,
       round(sum(CASE WHEN s.score >= c AND s.y = 1 THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN s.score >= c THEN 1 ELSE 0 END), 0), 6) AS default_pct,
       round(sum(CASE WHEN s.score >= c AND s.y = 1 THEN s.o_totalprice ELSE 0 END), 2) AS credit_risk,
       CAST(sum(CASE WHEN s.y = 0 THEN 1 ELSE 0 END) - sum(CASE WHEN s.score >= c AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS customer_loss
FROM cuts, scored s GROUP BY cutoff, cutoff_order""")
def q_scorecard_cutoffs(spark, d):
    out = sc.scorecard_cutoffs(scored(spark, d), "y", "score", "o_totalprice", 350, 470, 20)
    return out.select("cutoff", "cutoff_order", r6("default_pct").alias("default_pct"),
                      r6("credit_risk", 2).alias("credit_risk"), "customer_loss")


@register("score_by_outcome", sql=f"""
WITH {SCORED_SQL} SELECT y, round(avg(score), 6) AS mean_score, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY y""")
def q_score_by_outcome(spark, d):
    return scored(spark, d).groupBy("y").agg(r6(F.avg("score")).alias("mean_score"),
                                             F.count(F.lit(1)).cast("long").alias("n"))


_CUT = sc.cutoff_score(CUTOFF_PROB)


@register("credit_benefit", sql=f"""
WITH {SCORED_SQL},
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_bad,
             count(*) FILTER (WHERE score >= {_CUT}) AS n_acc, count(*) FILTER (WHERE score >= {_CUT} AND y = 1) AS n_acc_bad,
             count(*) FILTER (WHERE y = 0) AS n_good, count(*) FILTER (WHERE score < {_CUT} AND y = 0) AS good_lost,
             sum(CASE WHEN y = 1 THEN o_totalprice ELSE 0 END) AS risk_all, sum(o_totalprice) AS exp_all,
             sum(CASE WHEN score >= {_CUT} AND y = 1 THEN o_totalprice ELSE 0 END) AS risk_acc,
             sum(CASE WHEN score >= {_CUT} THEN o_totalprice ELSE 0 END) AS exp_acc FROM scored)
SELECT CAST({_CUT!r} AS DOUBLE) AS cutoff_score, round(risk_all - risk_acc, 2) AS credit_saved,
       round(good_lost * 100.0 / n_good, 6) AS customer_loss_pct,
       round(n_bad * 100.0 / n - n_acc_bad * 100.0 / n_acc, 6) AS default_pct_reduced,
       round(risk_all / exp_all * 100, 6) AS credit_risk_pct_without,
       round(risk_acc / exp_acc * 100, 6) AS credit_risk_pct_with FROM a""")
def q_credit_benefit(spark, d):
    out = sc.credit_benefit(scored(spark, d), "y", "score", "o_totalprice", _CUT)
    return out.select("cutoff_score", r6("credit_saved", 2).alias("credit_saved"),
                      *[r6(c).alias(c) for c in ["customer_loss_pct", "default_pct_reduced",
                                                 "credit_risk_pct_without", "credit_risk_pct_with"]])


