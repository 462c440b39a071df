"""Joins, reshaping and set operations.

Join strategy is left to Catalyst/AQE (broadcast when the runtime size is under
the threshold, otherwise sort-merge with skew splitting).  Explicit
``broadcast`` is used only for frames whose size is fixed by construction
(code lists, parameter grids), never for data that grows with the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str],
            how: str = "inner", keep_right_keys: bool = False) -> DataFrame:
    """Equi-join on differently named keys (R ``merge(by.x, by.y)``)."""
    cond = [left[a] == right[b] for a, b in zip(left_on, right_on)]
    out = left.join(right, cond, how)
    if not keep_right_keys:
        out = out.drop(*[right[b] for b in right_on if b not in left_on])
    return out


def anti_keys(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Keys of ``left`` missing from ``right`` (R ``setdiff`` on key sets)."""
    return left.select(left_on).distinct().join(
        right.select(F.col(right_on).alias(left_on)), left_on, "left_anti")


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 name: str = "variable", value: str = "value", drop_zero: bool = False,
                 drop_null: bool = False) -> DataFrame:
    """Wide -> long (tidyr ``gather`` / reshape2 ``melt``), optionally dropping 0 or NULL cells."""
    out = df.unpivot(list(ids), list(values), name, value)
    if drop_zero:
        out = out.filter(F.col(value) != 0)
    if drop_null:
        out = out.filter(F.col(value).isNotNull())
    return out


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def bind_by_key(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Column bind done as a key join (positional binding has no meaning in Spark)."""
    return left.join(right, key if isinstance(key, str) else list(key), "inner")


def wide_presence(df: DataFrame, row: str, col: str) -> DataFrame:
    """Wide 0/1-count table: one column per level found in the data."""
    out = df.groupBy(row).pivot(col).agg(F.count(F.lit(1)))
    levels = [c for c in out.columns if c != row]
    return out.fillna(0, subset=levels).select(row, *[F.col(f"`{v}`").cast("long").alias(v) for v in levels])
