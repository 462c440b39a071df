"""Grouped and whole-table aggregation, top-k, shares, contingency, correlation.

All aggregates are declared with ``groupBy().agg`` so Spark runs a partial
(map-side) aggregate before the shuffle: a hot key costs one partial row per
task, not a skewed reducer.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_agg(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def distinct_count_expr(c: str, include_null: bool = False) -> Column:
    """``count(DISTINCT c)``; with ``include_null`` NULL counts as one more value
    (R ``n_distinct``)."""
    base = F.count_distinct(F.col(c))
    if include_null:
        base = base + F.max(F.col(c).isNull().cast("int"))
    return base.cast("long")


def count_distinct(df: DataFrame, cols: Sequence[str], include_null: bool = False,
                   approx: bool = False) -> DataFrame:
    """One row: distinct count of each column (exact, or HyperLogLog++ when approx)."""
    if approx:
        return df.agg(*[F.approx_count_distinct(c).cast("long").alias(f"n_distinct_{c}") for c in cols])
    return df.agg(*[distinct_count_expr(c, include_null).alias(f"n_distinct_{c}") for c in cols])


def global_agg(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (column, n, sum, mean, sd, min, max) from one aggregation pass."""
    exprs = []
    for c in cols:
        exprs += [F.count(c).alias(f"{c}__n"), F.sum(c).alias(f"{c}__sum"),
                  F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__sd"),
                  F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
    wide = df.agg(*exprs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").cast("long").alias("n"),
                     F.col(f"{c}__sum").cast("double").alias("sum"), F.col(f"{c}__mean").alias("mean"),
                     F.col(f"{c}__sd").alias("sd"), F.col(f"{c}__min").alias("min"),
                     F.col(f"{c}__max").alias("max")) for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def arg_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """The ``key`` with the largest ``value``; ties go to the smallest key.
    A k=1 TakeOrdered: each task keeps its best row, the driver merges one row per task."""
    return df.select(key, value).orderBy(F.col(value).desc_nulls_last(), F.col(key).asc()).limit(1)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Distributed top-k (TakeOrderedAndProject: per-task heap, then merge of k·tasks rows)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Top k rows inside each group.  ``row_number() <= k`` lets Spark insert a
    per-task group limit before the shuffle, so a huge group ships only k rows
    per task.  ``order`` must end with a unique tie-break."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("long")))


def with_share(counts: DataFrame, count_col: str, within: Sequence[str] = (),
               share_col: str = "share") -> DataFrame:
    """count / total over already aggregated rows.  With ``within`` keys the totals come
    from a window partitioned by those keys; without, the grand total is one scalar
    aggregate inlined as a literal (no one-partition window over all levels)."""
    if within:
        return counts.withColumn(share_col, F.col(count_col) / F.sum(count_col).over(Window.partitionBy(*within)))
    total = counts.agg(F.sum(count_col)).first()[0]
    return counts.withColumn(share_col, F.try_divide(F.col(count_col).cast("double"), F.lit(total).cast("double")))


def prop_table(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n", share_col="prop")


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Two-way contingency table, one column per level found in the data (Spark refuses
    more than spark.sql.pivotMaxValues of them; ``crosstab_long`` has no such limit)."""
    out = df.groupBy(row).pivot(col).agg(F.count(F.lit(1)))
    levels = [c for c in out.columns if c != row]
    return out.fillna(0, subset=levels).select(row, *[F.col(f"`{v}`").cast("long").alias(v) for v in levels])


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """The non-zero cells of the contingency table: (row, col, n)."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).cast("long").alias("n"))


def segment_cov(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Per segment: number of periods and coefficient of variation of the period totals."""
    per_period = df.groupBy(*keys, period).agg(F.sum(value).alias("_v"))
    return per_period.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("n_periods"),
        F.avg("_v").alias("mean_value"),
        F.stddev_samp("_v").alias("sd_value"),
    ).withColumn("cov", F.try_divide(F.col("sd_value"), F.col("mean_value")))


def pairwise_stat(df: DataFrame, cols: Sequence[str], fn, name: str, diagonal: bool = True) -> DataFrame:
    """All column pairs (a <= b) of a two-argument aggregate, long form, one pass."""
    pairs = [(a, b) for a, b in combinations_with_replacement(cols, 2) if diagonal or a != b]
    wide = df.agg(*[fn(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"{a}__{b}").alias(name))
            for a, b in pairs]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return pairwise_stat(df, cols, F.corr, "corr")


def cov_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return pairwise_stat(df, cols, F.covar_samp, "cov")


def array_covariance(df: DataFrame, array_col: str, size: int) -> DataFrame:
    """(i, j, cov), i <= j from 0, of the elements of an array column of ``size`` numbers.

    Two passes: the means, then centred products.  A task adds up the products of
    its rows as one matrix and hands on size * (size + 1) / 2 sums; rows with a
    NULL array, or another length, are left out."""
    rows = df.select(F.transform(F.col(array_col), lambda x: x.cast("double")).alias("x")).where(F.size("x") == size)
    mean = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)]).first()
    n = mean["n"]
    centre = np.array([mean[f"m{i}"] or 0.0 for i in range(size)])
    at = np.triu_indices(size)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=float).reshape(-1, size) - centre
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (at[0].astype(np.int32), at[1].astype(np.int32), total[at])],
                                         ["i", "j", "s"])

    sums = rows.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return sums.select("i", "j", F.when(F.lit(n > 1), F.col("s") / F.lit(max(n - 1, 1))).alias("cov"))


def running_sum(df: DataFrame, value: str, order: Sequence[str], out: str,
                within: Sequence[str] = ()) -> DataFrame:
    """Cumulative sum over rows that are already aggregated (few rows)."""
    w = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))
