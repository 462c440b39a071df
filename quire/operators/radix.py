"""Exact order statistics by radix selection: no sort, no shuffle of values, no key join.

A double becomes a 64-bit integer of the same order.  Each pass counts, in numpy
inside the tasks, the values per (column, key prefix) and keeps the least and the
greatest key of each prefix; Spark adds the counts up.  Only prefixes that hold a
wanted rank are refined by the next 13 bits, and one whose least and greatest key are
equal is done, so at most five passes read the columns, and usually two or three.

What leaves a task is bounded by 8,192 cells per refined prefix whatever the number
of rows, a value held by a third of them is one cell, and the driver receives one
row per wanted rank (the first pass: 8,192 per column at most).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import ship_package

#: bits that are left below each pass's prefix
SHIFTS = (51, 38, 25, 12, 0)
#: cells that a task gathers before it adds them up
HELD = 1 << 18


def order_key(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; NaN comes last, -0.0 equals 0.0."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def value_of(key: int) -> float:
    bits = np.int64(key) if key >= 0 else np.int64(key) ^ np.int64(0x7FFFFFFFFFFFFFFF)
    return float(np.array([bits], np.int64).view(np.float64)[0])


def _added_up(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    col, prefix, n, lo, hi = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((prefix, col))
    col, prefix, n, lo, hi = (x[order] for x in (col, prefix, n, lo, hi))
    at = np.flatnonzero(np.concatenate([[True], (np.diff(col) != 0) | (np.diff(prefix) != 0)]))
    return (col[at], prefix[at], np.add.reduceat(n, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at))


def _cells(df: DataFrame, cols: Sequence[str], level: int, active: dict[int, np.ndarray] | None,
           group: str | None, groups: dict) -> DataFrame:
    """(col, prefix, n, lo, hi): counts of one pass, added up."""
    shift, before = SHIFTS[level], SHIFTS[level - 1] if level else 0
    width = len(cols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            if group is None:
                split = [(0, slice(None))]
            else:
                codes = batch.column(width).dictionary_encode()
                ids = codes.indices.fill_null(-1).to_numpy()
                names = codes.dictionary.to_pylist()
                split = [(groups[names[i] if i >= 0 else None], np.flatnonzero(ids == i)) for i in np.unique(ids).tolist()]
            for c in range(width):
                column = batch.column(c)
                x, there = column.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
                key = order_key(np.where(there, x.astype(float), 0.0))
                for g, rows in split:
                    k = np.sort(key[rows][there[rows]])
                    col = g * width + c
                    if active is not None:
                        want = active.get(col)
                        if want is None:
                            continue
                        parent = k >> before
                        place = np.minimum(np.searchsorted(want, parent), len(want) - 1)
                        k = k[want[place] == parent]
                    if not len(k):
                        continue
                    prefix = k >> shift
                    at = np.flatnonzero(np.concatenate([[True], np.diff(prefix) != 0]))
                    ends = np.concatenate([at[1:], [len(k)]])
                    parts.append((np.full(len(at), col), prefix[at], ends - at, k[at], k[ends - 1]))
                    held += len(at)
            if held > HELD:
                parts = [_added_up(parts)]
                held = 0
        if parts:
            out = _added_up(parts)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["col", "prefix", "n", "lo", "hi"])

    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)],
                     *([F.col(group).alias("_g")] if group else []))
    found = rows.mapInArrow(count, "col long, prefix long, n long, lo long, hi long")
    return found.groupBy("col", "prefix").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@dataclass
class Selected:
    """Of one column (of one group): rows with a value, and the values at the wanted ranks."""
    n: int
    at: dict[int, float]

    def quantile(self, prob: float) -> float | None:
        """R type 7."""
        if not self.n:
            return None
        h = (self.n - 1) * prob
        lo = math.floor(h)
        a = self.at[lo + 1]
        return a if h == lo else a + (self.at[lo + 2] - a) * (h - lo)


def quantile_ranks(probs: Sequence[float]) -> Callable[[int], list[int]]:
    """Ranks that the type-7 quantiles of a column of n values need."""
    return lambda n: sorted({min(n, math.floor((n - 1) * p) + k) for p in probs for k in (1, 2)}) if n else []


def select_ranks(df: DataFrame, cols: Sequence[str], ranks: Callable[[int], Sequence[int]], group: str | None = None,
                 groups: Sequence = ()) -> dict[tuple, Selected]:
    """{(group or None, column): Selected} with the values at ``ranks(n)`` (1-based);
    NULLs are left out.  ``groups``: the values of the group column, a bounded list."""
    ship_package(df.sparkSession)
    names = {g: i for i, g in enumerate(groups)} if group else {}
    keys = list(groups) if group else [None]
    out = {g * len(cols) + i: Selected(0, {}) for g in range(len(keys)) for i in range(len(cols))}
    # wanted: (column, parent prefix) -> [(rank, rank among the rows of the parent)]
    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for level in range(len(SHIFTS)):
        active = None
        if level:
            active = {}
            for col, parent in sorted(wanted):
                active.setdefault(col, []).append(parent)
            active = {c: np.array(p, np.int64) for c, p in active.items()}
        cells = _cells(df, cols, level, active, group, names)
        if level == 0:
            by_col: dict[int, list] = {}
            for r in cells.collect():
                by_col.setdefault(r["col"], []).append(r)
            hits = []
            for col, rows in by_col.items():
                rows.sort(key=lambda r: r["prefix"])
                ends = np.cumsum([r["n"] for r in rows])
                out[col].n = int(ends[-1])
                for rank in ranks(out[col].n):
                    i = int(np.searchsorted(ends, rank))
                    hits.append((col, rank, rank - int(ends[i - 1] if i else 0), rows[i]))
        else:
            bits = SHIFTS[level - 1] - SHIFTS[level]
            asked = df.sparkSession.createDataFrame(
                [(c, p, rank, inner) for (c, p), rs in wanted.items() for rank, inner in rs],
                "col long, parent long, rank long, inner long")
            # a parent has 8,192 cells at most
            run = Window.partitionBy("col", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
            placed = cells.withColumn("parent", F.shiftright("prefix", bits)).withColumn("cum", F.sum("n").over(run))
            both = placed.join(F.broadcast(asked), ["col", "parent"]).where(
                (F.col("inner") <= F.col("cum")) & (F.col("inner") > F.col("cum") - F.col("n")))
            hits = [(r["col"], r["rank"], r["inner"] - (r["cum"] - r["n"]), r) for r in both.collect()]
        wanted = {}
        for col, rank, inner, r in hits:
            if r["lo"] == r["hi"]:
                out[col].at[rank] = value_of(r["lo"])
            else:
                wanted.setdefault((col, r["prefix"]), []).append((rank, inner))
        if not wanted:
            break
    return {(keys[col // len(cols)], cols[col % len(cols)]): s for col, s in out.items()}


def column_quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """{column: {prob: quantile}} (R type 7); None for a column without values."""
    found = select_ranks(df, list(cols), quantile_ranks(probs))
    return {c: {p: s.quantile(p) for p in probs} for (_, c), s in found.items()}
