"""Cleaning operators: constant/all-null/near-zero-variance columns, duplicates,
key checks, imputation, range filters, capping and IQR fences.

Column screens are a single aggregation over all columns (the reference loops
column by column); the kept column list is the only thing brought to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.quantile import column_quantiles, to_long
from quire.operators.radix import column_quantile_values


# ------------------------------------------------------------ column screens
def constant_columns_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_distinct, dropped): NULL counts as a value, <= 1 value -> dropped."""
    cols = list(cols or df.columns)
    # one narrow group-by of (column, value): counted before the shuffle, no row is
    # expanded to the width of the table once per column
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "_v")
    counts = long.groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_c")).groupBy("column").agg(
        F.count(F.lit(1)).alias("_n"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counts, "column", "left").select(
        "column", F.coalesce("_n", F.lit(0).cast("long")).alias("n_distinct")).withColumn(
        "dropped", F.col("n_distinct") <= 1)


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one value, NULL counting as one: smallest, largest
    and a null flag of every column in one pass, no distinct counts."""
    if not df.columns:
        return []
    row = df.agg(*[F.struct(F.min(F.col(f"`{c}`").cast("string")).alias("lo"), F.max(F.col(f"`{c}`").cast("string")).alias("hi"),
                            F.count_if(F.col(f"`{c}`").isNull()).alias("nulls")).alias(f"c{i}")
                   for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns)
            if row[i]["lo"] == row[i]["hi"] and (row[i]["lo"] is None or not row[i]["nulls"])]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def all_null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count(c).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_present").withColumn("dropped", F.col("n_present") == 0)


def drop_all_null(df: DataFrame) -> DataFrame:
    report = all_null_report(df).filter("dropped").select("column").collect()
    return df.drop(*[r["column"] for r in report])


def near_zero_variance(df: DataFrame, cols: Sequence[str], freq_cut: float = 95 / 5,
                       unique_cut: float = 10.0) -> DataFrame:
    """caret-style screen per feature: freq_ratio = most common / second most common
    count, pct_unique = distinct non-null values / rows * 100;
    nzv = (freq_ratio > freq_cut and pct_unique <= unique_cut) or zero_var."""
    long = to_long(df, cols, name_col="feature")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    per_feature = counts.groupBy("feature").agg(
        F.sum("cnt").alias("n_rows"),
        F.max(F.when(F.col("value").isNotNull(), F.col("cnt"))).alias("top"),
        F.count("value").alias("n_unique"))
    # one row per feature: a bounded broadcast
    # (a feature that is all NULL has no such value and stays, as zero-variance)
    there = F.col("value").isNotNull()
    second = counts.join(F.broadcast(per_feature), "feature") \
        .groupBy("feature", "top", "n_unique", "n_rows").agg(
        F.sum((there & (F.col("cnt") == F.col("top"))).cast("long")).alias("n_top"),
        F.max(F.when(there & (F.col("cnt") < F.col("top")), F.col("cnt"))).alias("below"))
    sec = F.when(F.col("n_top") > 1, F.col("top")).otherwise(F.col("below"))
    out = second.select(
        "feature",
        F.when(F.col("n_unique") <= 1, F.lit(0.0)).otherwise(F.col("top") / sec).alias("freq_ratio"),
        (F.col("n_unique") * 100.0 / F.col("n_rows")).alias("pct_unique"),
        (F.col("n_unique") <= 1).alias("zero_var"))
    return out.withColumn("nzv", ((F.col("freq_ratio") > freq_cut) & (F.col("pct_unique") <= unique_cut))
                          | F.col("zero_var"))


def drop_near_zero_variance(report: DataFrame, *frames: DataFrame) -> list[DataFrame]:
    """Drop the flagged features (one row per feature in the report) from every frame,
    e.g. the same list from train and test."""
    flagged = [r["feature"] for r in report.filter("nzv").select("feature").collect()]
    return [f.drop(*flagged) for f in frames]


# ------------------------------------------------------------ duplicates/keys
def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_distinct_rows, n_duplicate_rows (exact whole-row copies)."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return per_row.agg(F.sum("_c").cast("long").alias("n_rows"),
                       F.count(F.lit(1)).cast("long").alias("n_distinct_rows")).withColumn(
        "n_duplicate_rows", F.col("n_rows") - F.col("n_distinct_rows"))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the first row of each key under ``order`` (R ``!duplicated``).

    ``min_by`` is a partial aggregate: a key holding a third of the table costs
    one candidate row per task before the shuffle, not a giant sorted group."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    k = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                  F.count_distinct(k).cast("long").alias("n_keys")).select(
        "n_rows", "n_keys", (F.col("n_rows") == F.col("n_keys")).alias("is_unique"))


# ------------------------------------------------------------ imputation/filters
def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULLs by the column median (one selection for all columns, one number
    per column inlined as a literal)."""
    med = column_quantile_values(df, cols, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c][0.5]).cast("double"))
                           for c in cols})


def impute_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def drop_invalid(df: DataFrame, valid: Column) -> DataFrame:
    """Keep rows where the validity predicate is true (NULL -> dropped, as in R subset)."""
    return df.filter(valid)


def cap_constant(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """Values above the cap become the cap; NULL stays NULL."""
    return df.withColumns({c: _capped(F.col(c), F.lit(v)) for c, v in caps.items()})


def _capped(x: Column, cap: Column) -> Column:
    return F.when(x > cap, cap).otherwise(x)


def _fences(df: DataFrame, cols: Sequence[str], k: float) -> dict[str, tuple]:
    """{column: (q1, q3, iqr, lower, upper)} of the columns that have values."""
    found = column_quantile_values(df, cols, [0.25, 0.75])
    quartiles = {c: (q[0.25], q[0.75]) for c, q in found.items() if q[0.25] is not None}
    return {c: (q1, q3, q3 - q1, q1 - k * (q3 - q1), q3 + k * (q3 - q1)) for c, (q1, q3) in quartiles.items()}


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """(column, q1, q3, iqr, lower, upper, n_below, n_above) for every column: the
    quartiles by selection, the counts by one aggregate with the fences as literals."""
    fences = _fences(df, cols, k)
    schema = ("column string, q1 double, q3 double, iqr double, lower double, upper double, "
              "n_below long, n_above long")
    if not fences:
        return df.sparkSession.createDataFrame([], schema)
    x = lambda c: F.col(c).cast("double")
    outside = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    counts = df.agg(*[a for i, (c, f) in enumerate(fences.items())
                      for a in (outside(x(c) < f[3]).alias(f"_b{i}"), outside(x(c) > f[4]).alias(f"_a{i}"))])
    rows = [F.struct(F.lit(c).alias("column"), *[F.lit(float(v)).alias(n) for n, v in
                                                 zip(("q1", "q3", "iqr", "lower", "upper"), f)],
                     F.col(f"_b{i}").alias("n_below"), F.col(f"_a{i}").alias("n_above"))
            for i, (c, f) in enumerate(fences.items())]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def iqr_cap(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Cap each column at its upper fence Q3 + k*IQR (one number per column);
    NULL stays NULL."""
    fences = _fences(df, cols, k)
    upper = {c: fences[c][4] if c in fences else None for c in cols}
    return df.withColumns({c: _capped(F.col(c).cast("double"), F.lit(upper[c]).cast("double")) for c in cols})


def percentile_table(df: DataFrame, cols: Sequence[str], step: float = 0.01) -> DataFrame:
    """(column, pct, value): quantiles at 0%, 1%, ..., 100%."""
    n = int(round(1 / step))
    probs = [round(i * step, 10) for i in range(n + 1)]
    qs = column_quantiles(df, cols, probs)
    return qs.select("column", F.round(F.col("prob") * 100).cast("int").alias("pct"), F.col("q").alias("value"))


def columns_identical(left: DataFrame, right: DataFrame, key: str, pairs: Mapping[str, str]) -> DataFrame:
    """Full outer join on the key and count, per column pair, rows whose values differ
    (NULL-safe) or whose key is missing on one side; n_mismatch = 0 means identical."""
    l = left.select(F.col(key).alias("_k"), *[F.col(a).alias(f"_l_{a}") for a in pairs])
    r = right.select(F.col(key).alias("_k"), *[F.col(b).alias(f"_r_{b}") for b in pairs.values()])
    j = l.join(r, "_k", "full_outer")
    wide = j.agg(*[F.sum((~F.col(f"_l_{a}").eqNullSafe(F.col(f"_r_{b}"))).cast("long")).alias(f"{a}__{b}")
                   for a, b in pairs.items()])
    rows = [F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"),
                     F.col(f"{a}__{b}").alias("n_mismatch")) for a, b in pairs.items()]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
