"""Exact global ranking without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.  Here
the frame is range-partitioned on the sort key, sorted inside each partition,
and tagged with ``monotonically_increasing_id`` (partition id in the high bits,
position in the low 33 bits).  The tagged frame is checkpointed to the shared
checkpoint folder so that the per-partition counts and the positions come from
one materialisation; the few counts are prefix-summed and broadcast back
(one row per range partition: a proven size bound).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import checkpoint_dir, shuffle_partitions

_LOW_BITS = (1 << 33) - 1


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys where NULL matches NULL (a NULL group stays a group,
    as in ``groupBy``); the right-hand key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_q_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_q_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_q_r_{k}" for k in keys])


def range_partitions(df: DataFrame, requested: int | None = None) -> int:
    """Number of range partitions: the shuffle setting, which is sized for the data."""
    return requested or shuffle_partitions(df.sparkSession)


def global_rank(df: DataFrame, order: Sequence, rank_col: str = "rank",
                total_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """1-based ``row_number`` under ``order`` (which must be a total order: add a unique
    tie-break column).  Optionally also attaches the row total as ``total_col``."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    order = _cols(order)
    n = range_partitions(df, num_partitions)
    tagged = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn("_q_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    tagged = tagged.select(
        "*",
        F.shiftright("_q_mid", 33).alias("_q_pid"),
        F.col("_q_mid").bitwiseAND(F.lit(_LOW_BITS)).alias("_q_pos"),
    )
    counts = tagged.groupBy("_q_pid").agg(F.count(F.lit(1)).alias("_q_cnt"))
    w = Window.orderBy("_q_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_q_pid",
        F.coalesce(F.sum("_q_cnt").over(w), F.lit(0)).alias("_q_off"),
        F.sum("_q_cnt").over(Window.partitionBy(F.lit(1))).alias("_q_tot"),
    )
    out = tagged.join(F.broadcast(offsets), "_q_pid").withColumn(
        rank_col, (F.col("_q_off") + F.col("_q_pos") + 1).cast("long"))
    if total_col:
        out = out.withColumn(total_col, F.col("_q_tot").cast("long"))
    return out.drop("_q_mid", "_q_pid", "_q_pos", "_q_off", "_q_tot")


def ntile_expr(rank: Column, total: Column, k: int) -> Column:
    """SQL ``NTILE(k)`` from a 1-based rank and the row total (larger tiles first)."""
    kk = F.lit(k)
    q = F.floor(total / kk)
    m = total - q * kk
    big = m * (q + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (q + 1)) + 1) \
            .otherwise(m + F.floor((rank - 1 - big) / q) + 1).cast("long")


def global_ntile(df: DataFrame, order: Sequence, k: int, tile_col: str = "tile",
                 keep_rank: bool = False) -> DataFrame:
    ranked = global_rank(df, order, rank_col="_q_rank", total_col="_q_total")
    out = ranked.withColumn(tile_col, ntile_expr(F.col("_q_rank"), F.col("_q_total"), k))
    if keep_rank:
        return out.withColumnRenamed("_q_rank", "rank").withColumnRenamed("_q_total", "total")
    return out.drop("_q_rank", "_q_total")


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence, rank_col: str = "rank",
                size_col: str | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY groups ORDER BY order)`` that stays balanced
    when one group holds most rows: the global rank over (groups, order) minus
    the group's first rank.  Group starts come from an aggregation, not a window."""
    ranked = global_rank(df, [F.col(g) for g in groups] + _cols(order), rank_col="_q_grank")
    starts = ranked.groupBy(*groups).agg(
        F.min("_q_grank").alias("_q_start"), F.count(F.lit(1)).alias("_q_size"))
    out = join_on_keys(ranked, starts, list(groups)).withColumn(
        rank_col, (F.col("_q_grank") - F.col("_q_start") + 1).cast("long"))
    if size_col:
        out = out.withColumn(size_col, F.col("_q_size").cast("long"))
    return out.drop("_q_grank", "_q_start", "_q_size")


def global_cumsum(df: DataFrame, order: Sequence, cols: Sequence[str], suffix: str = "_cum",
                  num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` under a total ``order`` without a one-task window.

    Range partitions are summed independently (a window partitioned by the range
    partition id), and each partition adds the totals of the partitions before it
    (one row per partition, broadcast)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    order = _cols(order)
    n = range_partitions(df, num_partitions)
    tagged = (df.repartitionByRange(n, *order)
                .withColumn("_q_pid", F.spark_partition_id())
                .checkpoint(eager=True))
    totals = tagged.groupBy("_q_pid").agg(*[F.sum(c).alias(f"_q_t_{c}") for c in cols])
    w_prev = Window.orderBy("_q_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_q_pid", *[F.coalesce(F.sum(f"_q_t_{c}").over(w_prev), F.lit(0)).alias(f"_q_o_{c}")
                                        for c in cols])
    w_local = Window.partitionBy("_q_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(c).over(w_local).alias(f"_q_l_{c}") for c in cols])
    out = local.join(F.broadcast(offsets), "_q_pid")
    out = out.withColumns({f"{c}{suffix}": F.col(f"_q_o_{c}") + F.col(f"_q_l_{c}") for c in cols})
    return out.drop("_q_pid", *[f"_q_o_{c}" for c in cols], *[f"_q_l_{c}" for c in cols])
