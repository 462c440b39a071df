"""Application scorecard: points from probabilities, cutoff tables, financial benefit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import cut_bins
from quire.operators.evaluate import with_thresholds_cleared

# The reference's scaling (20 points to double the odds, 400 points at 10:1).
PDO, BASE_SCORE, BASE_ODDS = 20.0, 400.0, 10.0


def factor_offset(pdo: float = PDO, base: float = BASE_SCORE, odds: float = BASE_ODDS) -> tuple[float, float]:
    factor = pdo / math.log(2)
    return factor, base - factor * math.log(odds)


def score_points(p: Column, pdo: float = PDO, base: float = BASE_SCORE, odds: float = BASE_ODDS) -> Column:
    """score = offset + factor * ln((1 - p) / p), p = probability of bad; p = 0 scores
    +infinity, p = 1 -infinity, NULL stays NULL."""
    factor, offset = factor_offset(pdo, base, odds)
    inner = F.lit(offset) + F.lit(factor) * F.log(F.try_divide(F.lit(1.0) - p, p))
    return F.when(p == 0, F.lit(float("inf"))).when(p == 1, F.lit(float("-inf"))).otherwise(inner)


def cutoff_score(prob: float, pdo: float = PDO, base: float = BASE_SCORE, odds: float = BASE_ODDS) -> float:
    """The score of a probability cutoff, rounded half to even (R ``round``)."""
    factor, offset = factor_offset(pdo, base, odds)
    raw = offset + factor * math.log((1 - prob) / prob)
    return float(round(raw))


def score_stats(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"),
                  F.min(score).alias("min"), F.max(score).alias("max"))


def score_bins(df: DataFrame, score: str, start: float = 350, stop: float = 470, width: float = 20) -> DataFrame:
    """Counts per ``cut(score, seq(start, stop, width))`` bin (outside -> NULL bin)."""
    b = cut_bins(F.col(score), start, stop, width)
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def scorecard_cutoffs(df: DataFrame, label: str, score: str, exposure: str, start: float, stop: float,
                      step: float = 20) -> DataFrame:
    """For 'No_Cutoffs' and each cutoff start, start+step, ..., <= stop: default percentage
    of the accepted (score >= cutoff), exposure of accepted defaulters, and good
    customers lost.  One pass: each row is bucketed by how many cutoffs it clears,
    then the (few) bucket totals are reverse-cumulated.  Rows without a score are
    neither accepted nor lost: they are left out."""
    k = int(math.floor((stop - start) / step)) + 1
    bad = (F.col(label) == 1)
    rows = df.select(F.col(score).alias("score"), bad.cast("long").alias("bad"),
                     F.when(bad, F.col(exposure)).otherwise(0.0).alias("bad_exp"))
    buckets = with_thresholds_cleared(rows, "score", start, step, k) \
        .groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad"), F.sum("bad_exp").alias("exp_bad"))
    dense = df.sparkSession.range(0, k + 1).select(F.col("id").cast("int").alias("b")) \
        .join(buckets, "b", "left").fillna(0, subset=["n", "n_bad", "exp_bad"])
    w = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)   # k+1 rows
    wall = Window.partitionBy(F.lit(1))
    cum = dense.select("b", F.sum("n").over(w).alias("acc_n"), F.sum("n_bad").over(w).alias("acc_bad"),
                       F.sum("exp_bad").over(w).alias("acc_exp"),
                       (F.sum("n").over(wall) - F.sum("n_bad").over(wall)).alias("total_good"))
    label_txt = F.when(F.col("b") == 0, F.lit("No_Cutoffs")).otherwise(
        F.concat((F.lit(start) + (F.col("b") - 1) * F.lit(step)).cast("long").cast("string"), F.lit("+")))
    return cum.select(
        label_txt.alias("cutoff"), F.col("b").cast("int").alias("cutoff_order"),
        F.try_divide(F.col("acc_bad") * 100.0, F.col("acc_n").cast("double")).alias("default_pct"),
        F.col("acc_exp").alias("credit_risk"),
        (F.col("total_good") - (F.col("acc_n") - F.col("acc_bad"))).cast("long").alias("customer_loss"))


def credit_benefit(df: DataFrame, label: str, score: str, exposure: str, cutoff: float) -> DataFrame:
    """One row comparing 'accept everyone' with 'accept score >= cutoff'; rows without a
    score are left out of both."""
    df = df.where(F.col(score).isNotNull())
    bad = F.col(label) == 1
    acc = F.col(score) >= F.lit(cutoff)
    e = F.col(exposure)
    agg = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"),
        F.count_if(acc).alias("n_acc"), F.count_if(acc & bad).alias("n_acc_bad"),
        F.count_if(~bad).alias("n_good"), F.count_if(~acc & ~bad).alias("good_lost"),
        F.sum(F.when(bad, e).otherwise(0.0)).alias("risk_all"), F.sum(e).alias("exp_all"),
        F.sum(F.when(acc & bad, e).otherwise(0.0)).alias("risk_acc"), F.sum(F.when(acc, e).otherwise(0.0)).alias("exp_acc"))
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return agg.select(
        F.lit(float(cutoff)).alias("cutoff_score"),
        (F.col("risk_all") - F.col("risk_acc")).alias("credit_saved"),
        (d("good_lost", "n_good") * 100).alias("customer_loss_pct"),
        (d("n_bad", "n") * 100 - d("n_acc_bad", "n_acc") * 100).alias("default_pct_reduced"),
        (d("risk_all", "exp_all") * 100).alias("credit_risk_pct_without"),
        (d("risk_acc", "exp_acc") * 100).alias("credit_risk_pct_with"))
