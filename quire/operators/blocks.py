"""Numpy over blocks of time: a series of any length in pieces of bounded size.

Rows of (series, t, value) are dealt by (series, block of time); the rows that a
block looks back at are copied into it, so lags are data of one numpy call and
not columns of the plan.  Per-series numbers (mean, length, coefficients) travel
as one extra row per block.  What blocks return is added up by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Time steps of a series that one block holds.
BLOCK_STEPS = 4096

SERIES, TIME = "series_id", "t"


def _steps(carry: int) -> int:
    return max(BLOCK_STEPS, 4 * carry)


def _changes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Positions where any of the columns differs from the row before (NULL equals NULL)."""
    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        col = batch.column(name)
        a, b = col.slice(0, len(col) - 1), col.slice(1)
        differ = pc.not_equal(a, b).fill_null(False).to_numpy(zero_copy_only=False)
        out |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(out) + 1


def sorted_groups(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """Groups of equal ``names`` from batches sorted by them, put together across batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [0, *_changes(batch, names).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            now = tuple(part.column(n)[0].as_py() for n in names)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            key = now
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """One block: ``first`` is its first own time; ``dense(i)`` the i-th value column from
    ``start`` on, one element per time step, NaN where there is no row or no value."""

    def __init__(self, table: pa.Table, steps: int, n_values: int):
        self.series = table.column(SERIES)[0].as_py()
        self.first = table.column("_block")[0].as_py() * steps
        t = table.column(TIME).to_numpy()
        real = ~np.isnan(t) if t.dtype.kind == "f" else np.ones(len(t), bool)
        self.t = t[real].astype(np.int64)
        params = table.column("_params").drop_null()
        self.params = np.array(params[0].as_py(), float) if len(params) else np.zeros(0)
        self.start = int(self.t.min()) if len(self.t) else self.first
        self.size = int(self.t.max()) - self.start + 1 if len(self.t) else 0
        self._values = [table.column(f"_v{i}").to_numpy().astype(float)[real] for i in range(n_values)]

    def dense(self, i: int = 0) -> np.ndarray:
        out = np.full(self.size, np.nan)
        out[self.t - self.start] = self._values[i]
        return out

    @property
    def own(self) -> int:
        """Position in ``dense`` of the first row that is the block's own."""
        return min(max(self.first - self.start, 0), self.size)


def map_blocks(df: DataFrame, values: Sequence[str], carry: int, run: Callable[[Block], Iterable[tuple]],
               schema: str, params: DataFrame | None = None, series: str = SERIES, t: str = TIME) -> DataFrame:
    """Rows (series, *``run(block)``) of every block; ``schema`` names the columns behind
    the series.  ``params``: (series, array of doubles), handed to every block of the series."""
    steps = _steps(carry)
    kind = dict(df.dtypes)[series]
    block = lambda c: F.floor(c / F.lit(steps)).cast("long")
    rows = df.select(F.col(series).alias(SERIES), F.col(t).cast("long").alias(TIME),
                     *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    spread = rows.withColumn("_last", block(F.col(TIME)))
    # a row is copied into the blocks it is looked back at from, if the series reaches that far
    spread = spread.withColumn("_block", F.explode(F.sequence("_last", block(F.col(TIME) + carry)))) if carry else \
        spread.withColumn("_block", F.col("_last"))
    spread = spread.drop("_last").withColumn("_params", F.lit(None).cast("array<double>"))
    if params is not None:
        blocks = rows.select(SERIES, block(F.col(TIME)).alias("_block")).distinct()
        names = params.columns
        given = params.select(F.col(names[0]).alias("_s"), F.col(names[1]).cast("array<double>").alias("_params"))
        extra = blocks.join(given, F.col(SERIES).eqNullSafe(F.col("_s"))).select(
            SERIES, F.lit(None).cast("long").alias(TIME),
            *[F.lit(None).cast("double").alias(f"_v{i}") for i in range(len(values))], "_block", "_params")
        spread = spread.unionByName(extra)
    dealt = spread.repartition(SERIES, "_block").sortWithinPartitions(SERIES, "_block", TIME)
    n_values = len(values)
    names = [f.strip().split(" ")[0] for f in _fields(schema)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        target = None
        for table in sorted_groups(batches, [SERIES, "_block"]):
            b = Block(table, steps, n_values)
            if b.own == b.size:  # only carried rows: the series ends before
                continue
            target = table.schema.field(SERIES).type
            done += [(b.series, *row) for row in run(b)]
            if len(done) >= 5000:
                yield _batch(done, [series, *names], target)
                done = []
        if done:
            yield _batch(done, [series, *names], target)

    return dealt.mapInArrow(work, f"`{series}` {kind}, {schema}")


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def _batch(rows: list[tuple], names: Sequence[str], key_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [pa.array(cols[0], key_type)]
    for col in cols[1:]:
        if isinstance(col[0], np.ndarray):
            arrays.append(pa.array([x.tolist() for x in col], pa.list_(pa.float64())))
        elif isinstance(col[0], (int, np.integer)):
            arrays.append(pa.array([int(x) for x in col], pa.int64()))
        else:
            arrays.append(pa.array([None if x is None else float(x) for x in col], pa.float64()))
    return pa.RecordBatch.from_arrays(arrays, list(names))


def sum_arrays(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys..., column): element-wise sums of the arrays of each key."""
    each = df.select(*keys, F.posexplode(column).alias("_at", "_x"))
    sums = each.groupBy(*keys, "_at").agg(F.sum("_x").alias("_x"))
    rows = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_x"))).alias("_all"))
    return rows.select(*keys, F.transform("_all", lambda r: r["_x"]).alias(column))


def lags_of(x: np.ndarray, count: int) -> np.ndarray:
    """Columns x[t-1] .. x[t-count], NaN before the first element."""
    out = np.full((len(x), count), np.nan)
    for k in range(1, min(count, len(x)) + 1):
        out[k:, k - 1] = x[:len(x) - k] if k else x
    return out
