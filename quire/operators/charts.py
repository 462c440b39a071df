"""The numbers behind the reference's charts, as tables (no rendering)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.aggregate import with_share
from quire.operators.quantile import quantile_wide, quantiles_by
from quire.operators.rank import join_on_keys


def bar_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))


def share_within(df: DataFrame, category: str | Sequence[str], cls: str, facets: Sequence[str] = ()) -> DataFrame:
    """100%-stacked bar data: count of each class inside each category (and facet)."""
    cats = [category] if isinstance(category, str) else list(category)
    keys = [*facets, *cats]
    counts = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return with_share(counts, "n", within=keys)


def histogram_bin(x: Column, width: float) -> Column:
    """Bins of width w centred on multiples of w, right-closed: k = ceil(x/w - 0.5)."""
    return F.ceil(x / F.lit(width) - F.lit(0.5)).cast("long")


def histogram(df: DataFrame, col: str, width: float, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., bin, center, lo, hi, n) for non-null values."""
    k = histogram_bin(F.col(col), width)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*groups, k.alias("bin")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    return counts.select(*groups, "bin", (F.col("bin") * F.lit(width)).alias("center"),
                         ((F.col("bin") - 0.5) * F.lit(width)).alias("lo"),
                         ((F.col("bin") + 0.5) * F.lit(width)).alias("hi"), "n")


def histogram_share(df: DataFrame, col: str, width: float, cls: str) -> DataFrame:
    """Class shares inside each histogram bin."""
    k = histogram_bin(F.col(col), width)
    counts = df.filter(F.col(col).isNotNull()).groupBy(k.alias("bin"), cls).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    return with_share(counts, "n", within=["bin"])


def box_stats(df: DataFrame, group: str, value: str, k: float = 1.5) -> DataFrame:
    """Box-plot statistics per group: quartiles, whiskers at the most extreme points
    inside the 1.5 IQR fences, and the outlier count."""
    data = df.select(group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    found, few = quantiles_by(data, group, "_v", [0.25, 0.5, 0.75])
    qs = quantile_wide(found, [group], {0.25: "q1", 0.5: "median", 0.75: "q3"})
    fences = qs.select(group, "q1", "median", "q3",
                       (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("_lo"),
                       (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("_hi"))
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    ends = fences.select(group, "_lo", "_hi")
    second = join_on_keys(data, F.broadcast(ends) if few else ends, [group]).groupBy(group).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"))
    return join_on_keys(fences.drop("_lo", "_hi"), second, [group])


def segment_month_series(df: DataFrame, keys: Sequence[str], period: str, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys, period).agg(*[c.alias(n) for n, c in measures.items()])
