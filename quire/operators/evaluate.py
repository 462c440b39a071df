"""Binary and multi-class model evaluation from (label, score) frames.

Every threshold-dependent measure is computed in one pass: each row is put in
the bucket "number of thresholds <= score", the (bucket, label) counts are
aggregated (at most thresholds+1 rows per label) and cumulated there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.rank import global_cumsum, global_ntile


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _positive(label: str, positive) -> Column:
    return (F.col(label) == F.lit(positive)).cast("int")


def confusion_at_cutoff(df: DataFrame, label: str, score: str, cutoff: float, positive=1) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, sensitivity, specificity at ``score >= cutoff``."""
    pred = F.col(score) >= F.lit(cutoff)
    act = _positive(label, positive) == 1
    out = df.agg(F.count_if(pred & act).alias("tp"), F.count_if(pred & ~act).alias("fp"),
                 F.count_if(~pred & ~act).alias("tn"), F.count_if(~pred & act).alias("fn"))
    return _rates(out.withColumn("cutoff", F.lit(float(cutoff))))


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.select(*[c for c in df.columns if c not in ("tp", "fp", "tn", "fn")],
                     *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")],
                     _div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                     _div(tp, tp + fn).alias("sensitivity"), _div(tn, tn + fp).alias("specificity"))


def confusion_multiclass(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, prediction, n) cells plus the overall accuracy on every row."""
    cells = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    w = Window.partitionBy(F.lit(1))
    acc = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w)
    return cells.withColumn("accuracy", acc)


def threshold_grid(start: float, stop: float, n: int) -> list[float]:
    """R ``seq(start, stop, length = n)``: start + i * by."""
    if n == 1:
        return [start]
    by = (stop - start) / (n - 1)
    return [start + i * by for i in range(n)]


def with_thresholds_cleared(df: DataFrame, score: str, start: float, by: float, n: int, out: str = "b") -> DataFrame:
    """Adds the number of the thresholds start + i*by (i < n, by > 0) that are <= score; rows
    without a score are left out.

    Each step is a projection of its own: a value used twice in one expression is
    written into the generated code twice, and nested steps multiply."""
    x, g = F.col("_x"), F.col("_g")
    t = lambda i: F.lit(float(start)) + i.cast("double") * F.lit(float(by))  # noqa: E731  same double expression as the grid
    rows = df.withColumn("_x", F.col(score).cast("double")).where(x.isNotNull())
    near = F.least(F.greatest(x, F.lit(start - by)), F.lit(start + n * by))  # infinite scores too
    rows = rows.withColumn("_g", (F.floor((near - F.lit(float(start))) / F.lit(float(by))) + 1).cast("int"))
    rows = rows.withColumn("_g", F.least(F.greatest(g, F.lit(0)), F.lit(n)))
    # the floating-point guess is off by at most one: settle it against the thresholds themselves
    rows = rows.withColumn("_g", g + ((g < n) & (t(g) <= x)).cast("int"))
    b = g - ((g > 0) & (t(g - 1) > x)).cast("int")
    # never NULL, and said so: a later join would push "b is not null" down as one huge expression
    return rows.withColumn(out, F.coalesce(b, F.lit(0))).drop("_x", "_g")


def _bucket_counts(df: DataFrame, label: str, score: str, start: float, by: float, n: int,
                   positive) -> DataFrame:
    """(b, n_pos, n_neg) with b = number of thresholds start + i*by (i < n) that are <= score;
    rows without a score are left out, as in ``confusion_at_cutoff``."""
    rows = with_thresholds_cleared(df.select(F.col(score).alias("score"), _positive(label, positive).alias("pos")),
                                   "score", start, by, n)
    return rows.groupBy("b").agg(F.sum("pos").alias("n_pos"), F.sum(1 - F.col("pos")).alias("n_neg"))


def cutoff_sweep(df: DataFrame, label: str, score: str, start: float, stop: float, n: int = 100,
                 positive=1) -> DataFrame:
    """(i, cutoff, tp, fp, tn, fn, accuracy, sensitivity, specificity) for the thresholds
    cutoff_i = start + i*(stop-start)/(n-1), i = 0..n-1, from ONE pass over the data:
    a row predicts positive at threshold i iff its bucket b > i, so tp_i is the
    reverse cumulative sum of the (at most n+1) bucket counts."""
    by = (stop - start) / (n - 1) if n > 1 else 1.0
    if by <= 0:
        return _sweep_direct(df, label, score, start, by, n, positive)
    counts = _bucket_counts(df, label, score, start, by, n, positive)
    dense = df.sparkSession.range(0, n + 1).select(F.col("id").cast("int").alias("b")) \
        .join(counts, "b", "left").fillna(0, subset=["n_pos", "n_neg"])
    # n+1 rows: a one-partition window is bounded by the grid, not by the data
    w = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(F.lit(1))
    cum = dense.select("b", F.sum("n_pos").over(w).alias("tp"), F.sum("n_neg").over(w).alias("fp"),
                       F.sum("n_pos").over(wall).alias("_P"), F.sum("n_neg").over(wall).alias("_N"))
    per_i = cum.filter(F.col("b") >= 1).select(
        (F.col("b") - 1).alias("i"),
        (F.lit(start) + (F.col("b") - 1).cast("double") * F.lit(by)).alias("cutoff"),
        "tp", "fp", (F.col("_N") - F.col("fp")).alias("tn"), (F.col("_P") - F.col("tp")).alias("fn"))
    return _rates(per_i)


def _sweep_direct(df: DataFrame, label: str, score: str, start: float, by: float, n: int, positive) -> DataFrame:
    """Degenerate or descending grids (all scores within the margin): conditional counts for
    each threshold, still one pass over the data."""
    pos = _positive(label, positive) == 1
    df = df.where(F.col(score).isNotNull())
    cuts = [start + i * by for i in range(n)]
    row = df.agg(*[F.count_if((F.col(score) >= F.lit(c)) & pos).alias(f"tp{i}") for i, c in enumerate(cuts)],
                 *[F.count_if((F.col(score) >= F.lit(c)) & ~pos).alias(f"fp{i}") for i, c in enumerate(cuts)],
                 F.count_if(pos).alias("P"), F.count_if(~pos).alias("N")).first()
    rows = [(i, float(c), int(row[f"tp{i}"]), int(row[f"fp{i}"]), int(row["N"] - row[f"fp{i}"]),
             int(row["P"] - row[f"tp{i}"])) for i, c in enumerate(cuts)]
    out = df.sparkSession.createDataFrame(rows, "i int, cutoff double, tp long, fp long, tn long, fn long")
    return _rates(out)


def optimal_cutoff(sweep: DataFrame, step: float = 0.01) -> DataFrame:
    """The reference's rule: grow a tolerance 0, step, 2*step, ... until some threshold has
    |sensitivity - specificity| <= tolerance; take the first (smallest) such threshold."""
    need = F.ceil(F.round(F.abs(F.col("sensitivity") - F.col("specificity")) / F.lit(step), 9)).cast("long")
    ranked = sweep.withColumn("tol_steps", need)
    best = ranked.orderBy(F.col("tol_steps").asc_nulls_last(), F.col("i").asc()).limit(1)
    return best.withColumn("tolerance", F.col("tol_steps") * F.lit(step))


def cutoff_within(sweep: DataFrame, tolerance: float) -> DataFrame:
    """The fixed-tolerance rule: the first (smallest) threshold with
    |sensitivity - specificity| < ``tolerance``; no row if there is none."""
    near = sweep.where(F.abs(F.col("sensitivity") - F.col("specificity")) < F.lit(tolerance))
    return near.orderBy("i").limit(1).withColumn("tolerance", F.lit(float(tolerance)))


def evaluate_binary(df: DataFrame, label: str, score: str, n: int = 100, positive=1,
                    start: float | None = None, stop: float | None = None, margin: float = 0.001) -> DataFrame:
    """Cutoff sweep over [min+margin, max-margin] (or [start, stop]), optimal cutoff,
    and the confusion measures there: one record.  Scores closer together than two
    margins are swept from the least to the greatest, a single score is itself the
    threshold; without scores there is no record."""
    if start is None or stop is None:
        mm = df.agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi")).first()
        if mm["lo"] is None:
            return df.sparkSession.createDataFrame([], "cutoff double, tolerance double, tp long, fp long, tn long, "
                                                       "fn long, accuracy double, sensitivity double, specificity double")
        start, stop = mm["lo"] + margin, mm["hi"] - margin
        if start > stop:
            start, stop = mm["lo"], mm["hi"]
        n = n if start < stop else 1
    best = optimal_cutoff(cutoff_sweep(df, label, score, start, stop, n, positive))
    return best.select("cutoff", "tolerance", "tp", "fp", "tn", "fn", "accuracy", "sensitivity", "specificity")


def score_counts(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(score, n_pos, n_neg) per distinct score (partial aggregation before the shuffle)."""
    pos = _positive(label, positive)
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(pos).alias("n_pos"), F.sum(1 - pos).alias("n_neg"))


def _roc(df: DataFrame, label: str, score: str, positive=1):
    sc = score_counts(df, label, score, positive)
    tot = sc.agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N")).first()
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    cum = global_cumsum(sc, [F.col("score").desc()], ["n_pos", "n_neg"])
    roc = cum.select("score", "n_pos", "n_neg",
                     _div(F.col("n_pos_cum"), F.lit(P)).alias("tpr"),
                     _div(F.col("n_neg_cum"), F.lit(N)).alias("fpr"))
    return roc, P, N


def roc_points(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(score, n_pos, n_neg, tpr, fpr) for predicting positive at score >= each distinct
    score.  Cumulative counts come from the balanced range-partitioned running sum;
    only the two class totals travel to the driver."""
    return _roc(df, label, score, positive)[0]


def ks_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """KS curve: TPR - FPR at every distinct score, with the share of rows at or above it."""
    roc, P, N = _roc(df, label, score, positive)
    return roc.select("score", "tpr", "fpr", (F.col("tpr") - F.col("fpr")).alias("ks_gap"),
                      _div(F.col("tpr") * F.lit(P) + F.col("fpr") * F.lit(N), F.lit(P + N)).alias("population"))


def auc_ks(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """AUC (trapezoids over the ROC steps; equals the tie-corrected rank-sum AUC) and
    KS = max(TPR - FPR), one row."""
    roc, P, N = _roc(df, label, score, positive)
    prev_tpr = F.col("tpr") - _div(F.col("n_pos"), F.lit(P))
    step_fpr = _div(F.col("n_neg"), F.lit(N))
    return roc.agg(F.sum(step_fpr * (F.col("tpr") + prev_tpr) / 2).alias("auc"),
                   F.max(F.col("tpr") - F.col("fpr")).alias("ks"))


def lift_table(df: DataFrame, label: str, score: str, key: str, groups: int = 10) -> DataFrame:
    """Gain/lift by score decile: bucket = ntile of descending score (ties by key);
    total, responders, cumulative responders, gain % and cumulative lift."""
    tiles = global_ntile(df.select(label, score, key), [F.col(score).desc(), F.col(key)], groups, "bucket")
    per = tiles.groupBy("bucket").agg(F.count(F.lit(1)).cast("long").alias("total"),
                                      F.sum(F.col(label)).cast("long").alias("totalresp"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)   # <= groups rows
    per = per.withColumn("cumresp", F.sum("totalresp").over(w)) \
             .withColumn("gain", F.try_divide(F.col("cumresp") * 100.0, F.sum("totalresp").over(Window.partitionBy(F.lit(1)))))
    return per.withColumn("cumlift", F.col("gain") / (F.col("bucket") * (100.0 / groups)))
