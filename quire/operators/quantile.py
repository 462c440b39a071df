"""Quantiles per group, R type 7 (= Spark ``percentile`` = DuckDB ``quantile_cont``).

Columns, and groups of a bounded number, go by radix selection (``radix``).  Groups
without a bound go by counts: rows are first counted per (group, value), so a hot
value collapses before the shuffle; a balanced running count over (group, value)
then tells which value holds each order statistic, and the two that bracket a
probability are interpolated.  No task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.operators.radix import column_quantile_values, quantile_ranks, select_ranks
from quire.operators.rank import global_cumsum, join_on_keys


def to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
            name_col: str = "column", value_col: str = "value") -> DataFrame:
    """Stack numeric columns into (ids..., column, value) as doubles."""
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(list(ids), list(cols), name_col, value_col)


def value_counts(df: DataFrame, groups: Sequence[str], value: str | Column) -> DataFrame:
    """(groups..., x, c): rows per distinct non-NULL value."""
    x = F.col(value) if isinstance(value, str) else value
    return (df.select(*groups, x.cast("double").alias("x")).where("x IS NOT NULL")
            .groupBy(*groups, "x").agg(F.count(F.lit(1)).alias("c")))


def running_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups..., x, c, cum, n): ``counts`` with the number of rows up to and
    including each value, and in the whole group."""
    keys = list(groups)
    run = global_cumsum(counts, [*keys, "x"], ["c"], suffix="_all")
    if not keys:
        run = run.withColumn("_one", F.lit(1))
    by = keys or ["_one"]
    size = run.groupBy(*by).agg(F.sum("c").alias("n"), F.min(F.col("c_all") - F.col("c")).alias("_before"))
    # a frame without groups has one row of totals
    out = join_on_keys(run, size if keys else F.broadcast(size), by).withColumn("cum", F.col("c_all") - F.col("_before"))
    return out.select(*keys, "x", "c", "cum", "n")


def quantiles_of(running: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(groups..., prob, q) from ``running_counts``."""
    h = lambda p: (F.col("n") - 1) * p["prob"] + 1
    need = F.transform(F.array(*[F.struct(F.lit(float(p)).alias("prob")) for p in probs]), lambda p: F.struct(
        p["prob"].alias("prob"), F.floor(h(p)).alias("lo"), (h(p) - F.floor(h(p))).alias("f")))
    holds = lambda r: (r > F.col("cum") - F.col("c")) & (r <= F.col("cum"))
    # the few order statistics that this value is
    here = F.filter(need, lambda s: holds(s["lo"]) | holds(s["lo"] + 1))
    at = running.select(*groups, "x", "c", "cum", "n", F.explode(here).alias("s"))
    both = at.groupBy(*groups, F.col("s.prob").alias("prob"), F.col("s.f").alias("_f")).agg(
        F.max(F.when(holds(F.col("s.lo")), F.col("x"))).alias("_a"),
        F.max(F.when(holds(F.col("s.lo") + 1), F.col("x"))).alias("_b"))
    a, b, f = F.col("_a"), F.col("_b"), F.col("_f")
    return both.select(*groups, "prob", F.when(b.isNull() | (f == 0), a).otherwise(a + (b - a) * f).alias("q"))


def grouped_quantiles(long_df: DataFrame, groups: Sequence[str], value: str,
                      probs: Sequence[float]) -> DataFrame:
    """(groups..., prob, q) for every group and probability; NULL values are ignored."""
    return quantiles_of(running_counts(value_counts(long_df, groups, value), groups), groups, probs)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], name_col: str = "column") -> DataFrame:
    """(column, prob, q) for several columns by radix selection; a column without values has no row."""
    found = column_quantile_values(df, cols, probs)
    rows = [(c, float(p), q) for c, qs in found.items() for p, q in qs.items() if q is not None]
    return df.sparkSession.createDataFrame(rows, f"`{name_col}` string, prob double, q double")


# Most groups whose quantiles are selected by radix, all groups in one pass; more go by counts.
MAX_RADIX_GROUPS = 1000


def quantiles_by(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> tuple[DataFrame, bool]:
    """(group, prob, q) of one column in the groups of another, and whether it has at
    most ``MAX_RADIX_GROUPS`` groups (then it may be broadcast)."""
    names = [r[0] for r in df.select(group).distinct().limit(MAX_RADIX_GROUPS + 1).collect()]
    if len(names) > MAX_RADIX_GROUPS:
        return grouped_quantiles(df, [group], value, probs), False
    found = select_ranks(df, [value], quantile_ranks(probs), group, names)
    rows = [(g, float(p), s.quantile(p)) for (g, _), s in found.items() for p in probs if s.n]
    return df.sparkSession.createDataFrame(rows, StructType([
        StructField(group, df.schema[group].dataType), StructField("prob", DoubleType()), StructField("q", DoubleType())])), True


def quantile_wide(qs: DataFrame, groups: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Pivot (groups, prob, q) to one column per probability with the given names."""
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("q"))).alias(n) for p, n in names.items()]
    return qs.groupBy(*groups).agg(*aggs)
