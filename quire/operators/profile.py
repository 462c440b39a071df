"""Inspection operators returning tables: shape, schema/head profile, summary, describe."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.quantile import running_counts, value_counts
from quire.operators.radix import column_quantile_values, quantile_ranks, select_ranks


def table_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long"))


def schema_profile(df: DataFrame, order_by: Sequence[str], n: int = 3, tail: bool = False) -> DataFrame:
    """(position, column, type, values): the first (or last) ``n`` values of each
    column under a declared sort key.  Only ``n`` rows are taken (a top-k)."""
    order = [F.col(c).desc() if tail else F.col(c).asc() for c in order_by]
    head = df.orderBy(*order).limit(n)
    head = head.withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    cols = df.columns
    as_text = head.select("_r", *[F.col(c).cast("string").alias(c) for c in cols])
    long = as_text.unpivot(["_r"], cols, "column", "v")
    vals = long.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.coalesce("v", F.lit("NA")).alias("v")))),
                                 lambda s: s.getField("v")), ", ").alias("values"))
    meta = df.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, type string")
    return meta.join(vals, "column", "left").select("position", "column", "type", "values")


def _stacked(wide: DataFrame, rows: Sequence[tuple[str, dict[str, Column]]]) -> DataFrame:
    """One row per (name, columns) from a frame of one row."""
    cells = [F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in values.items()]) for name, values in rows]
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """R ``summary`` for numeric columns, long form (column, stat, value):
    min, q1, median, mean, q3, max, n_null.  Quartiles by selection, the rest by one
    aggregate over all columns."""
    qs = column_quantile_values(df, cols, [0.25, 0.5, 0.75])
    x = lambda c: F.col(c).cast("double")
    wide = df.agg(*[a.alias(f"_{name}{i}") for i, c in enumerate(cols) for name, a in (
        ("min", F.min(x(c))), ("mean", F.avg(x(c))), ("max", F.max(x(c))), ("n_null", F.count(F.lit(1)) - F.count(x(c))))])
    rows = [(c, {"stat": F.lit(stat), "value": (F.lit(qs[c][probs[stat]]) if stat in probs else F.col(f"_{stat}{i}"))
                 .cast("double")})
            for probs in [{"q1": 0.25, "median": 0.5, "q3": 0.75}] for i, c in enumerate(cols)
            for stat in ("min", "q1", "median", "mean", "q3", "max", "n_null")]
    return _stacked(wide, rows)


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per level for categorical columns (the factor part of ``summary``)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "level")
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).cast("long").alias("n"))


def describe_table(df: DataFrame, cols: Sequence[str], trim: float = 0.1) -> DataFrame:
    """psych-style ``describe`` per column: n, mean, sd, median, trimmed, mad, min,
    max, range, skew, kurtosis, se.

    skew = Spark skewness * ((n-1)/n)^1.5 ; kurtosis = (Spark kurtosis + 3) * ((n-1)/n)^2 - 3;
    trimmed mean over ranks floor(trim*n)+1 .. n-floor(trim*n); mad = 1.4826 * median|x - median|.
    """
    cut = lambda n: [math.floor(n * trim) + 1, n - math.floor(n * trim)]
    middle = quantile_ranks([0.5])
    found = {c: s for (_, c), s in select_ranks(df, cols, lambda n: [*middle(n), *cut(n)] if n else []).items()}
    used = [c for c in cols if found[c].n]
    if not used:
        return df.sparkSession.createDataFrame([], "column string, n long, " + ", ".join(f"{s} double" for s in (
            "mean", "sd", "median", "trimmed", "mad", "min", "max", "range", "skew", "kurtosis", "se")))
    med = {c: found[c].quantile(0.5) for c in used}
    x = {c: F.col(c).cast("double") for c in used}
    away = df.select(*[F.abs(x[c] - F.lit(med[c])).alias(c) for c in used])
    mad = column_quantile_values(away, used, [0.5])
    mean = df.agg(*[F.avg(x[c]).alias(f"_{i}") for i, c in enumerate(used)]).first()
    aggs = []
    for i, c in enumerate(used):
        lo, hi = (found[c].at[r] for r in cut(found[c].n))
        dev = x[c] - F.lit(mean[i])
        count = lambda cond: F.sum(cond.cast("long"))
        aggs += [F.min(x[c]).alias(f"_min{i}"), F.max(x[c]).alias(f"_max{i}"), count(x[c] <= lo).alias(f"_lo{i}"),
                 count(x[c] < hi).alias(f"_hi{i}"),
                 F.sum(F.when((x[c] > lo) & (x[c] < hi), x[c])).alias(f"_mid{i}"),
                 *[F.sum(F.pow(dev, F.lit(float(k)))).alias(f"_m{k}{i}") for k in (2, 3, 4)]]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(used):
        n, (lo, hi) = found[c].n, (found[c].at[r] for r in cut(found[c].n))
        k = math.floor(n * trim)
        # of the rows equal to a trim point, those behind (before) it count
        kept = F.coalesce(F.col(f"_mid{i}"), F.lit(0.0)) + (F.col(f"_lo{i}") - k) * F.lit(lo) \
            + (F.lit(n - k) - F.col(f"_hi{i}")) * F.lit(hi)
        trimmed = F.lit(lo) if lo == hi else F.try_divide(kept, F.lit(float(n - 2 * k)))
        size, m2, m3, m4 = F.lit(float(n)), *(F.col(f"_m{j}{i}") for j in (2, 3, 4))
        sd = F.sqrt(F.try_divide(m2, F.lit(n - 1.0))) if n > 1 else F.lit(None).cast("double")
        ratio = (n - 1) / n
        rows.append((c, {
            "n": F.lit(n).cast("long"), "mean": F.lit(mean[i]), "sd": sd, "median": F.lit(med[c]), "trimmed": trimmed,
            "mad": F.lit(1.4826 * mad[c][0.5]), "min": F.col(f"_min{i}"), "max": F.col(f"_max{i}"),
            "range": F.col(f"_max{i}") - F.col(f"_min{i}"),
            "skew": F.try_divide(F.sqrt(size) * m3, F.pow(m2, 1.5)) * F.lit(ratio ** 1.5),
            "kurtosis": F.try_divide(size * m4, m2 * m2) * F.lit(ratio ** 2) - 3,
            "se": F.try_divide(sd, F.sqrt(size))}))
    return _stacked(wide, rows)


def _trimmed(run: DataFrame, groups: Sequence[str], trim: float) -> DataFrame:
    """(groups..., trimmed) from ``running_counts``: the part of each value's
    rows that lies between the trim points."""
    k = F.floor(F.col("n") * F.lit(trim))
    lo, hi = k + 1, F.col("n") - k
    overlap = F.greatest(F.lit(0), F.least(F.col("cum"), hi) - F.greatest(F.col("cum") - F.col("c") + 1, lo) + 1)
    return run.groupBy(*groups).agg((F.try_divide(F.sum(F.col("x") * overlap), F.sum(overlap))).alias("trimmed"))


def trimmed_mean(long: DataFrame, groups: Sequence[str], value: str, trim: float = 0.1) -> DataFrame:
    """Mean of the order statistics floor(trim*n)+1 .. n-floor(trim*n) per group."""
    return _trimmed(running_counts(value_counts(long, groups, value), groups), groups, trim)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, pct_null) plus a '__rows_with_null__' and '__total__' row; one pass."""
    cols = list(cols or df.columns)
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols],
                  F.sum(any_null.cast("long")).alias("__rows_with_null__"))
    wide = wide.withColumn("__total__", sum((F.col(c) for c in cols), F.lit(0)))
    names = cols + ["__rows_with_null__", "__total__"]
    long = wide.select("_n", *names).unpivot(["_n"], names, "column", "n_null")
    return long.select("column", F.col("n_null").cast("long").alias("n_null"),
                       F.try_divide(F.col("n_null") * 100.0, F.col("_n")).alias("pct_null"))


def invalid_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_blank, n_negative): blank strings (after trim) and negative numbers."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for c in cols:
        t = types[c]
        blank = (F.trim(F.col(c)) == "") if isinstance(t, T.StringType) else F.lit(False)
        neg = (F.col(c) < 0) if isinstance(t, T.NumericType) else F.lit(False)
        exprs += [F.sum(F.coalesce(blank, F.lit(False)).cast("long")).alias(f"{c}__b"),
                  F.sum(F.coalesce(neg, F.lit(False)).cast("long")).alias(f"{c}__n")]
    wide = df.agg(*exprs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__b").alias("n_blank"),
                     F.col(f"{c}__n").alias("n_negative")) for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
