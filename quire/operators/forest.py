"""Random forests grown on all rows, many trees in one pass, with out-of-bag error.

Numbers are cut at their quantiles into at most 32 bins.  A tree's bootstrap is a
Poisson(1) weight from a hash of (row key, tree), so any task can tell at any time how
often a row is in a tree's sample, and 0 means out of bag.

Rows with equal bins differ in their weights and labels only.  While the table has at
most ``MOST_CELLS`` different rows of bins (cells; 32 bins and the levels of categories
bound them, whatever the number of rows), a task adds up a tree's weights per cell and
label, once for all levels; the sums of all parts of the rows meet in one task, which
grows the whole tree on them and votes for every cell.  The out-of-bag pass looks up the
votes of a row's cell.

With more cells, trees grow level by level: in one pass a task counts, for every open node of a batch of trees, weight and
positive weight per bin of the node's ``mtry`` random features, one tree after the
other.  Counts of a tree meet in one task, which adds them up as they stream in and
picks the tree's splits; only the splits reach the driver.  A batch is as many trees
as keep what a task sends within ``CELLS`` counts.

Rows are binned once and kept as blocks of bytes.  While they fill fewer parts than
there are cores, each part is kept once per group of trees: all cores work, and what
they send does not grow with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.radix import column_quantile_values
from quire.session import default_parallelism, ship_package, spread

BINS = 32
#: counts that a task sends in one pass: of all open nodes of the batch's trees
CELLS = 1 << 25
#: rows that a task reads in a pass at most, on average
ROWS_A_TASK = 1 << 20
#: rows of a kept block
BLOCK_ROWS = 1 << 12
ROWS_AT_ONCE = 1 << 15
#: different rows of bins up to which trees grow on them, not on rows
MOST_CELLS = 1 << 20
#: rows whose weights a task adds up per cell, on average, and bytes of such sums dealt at once
CELL_ROWS_A_TASK = 1 << 22
SUMS_AT_ONCE = 1 << 31
# Poisson(1) draws for 16 random bits
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)]),
                           (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.int8)


def _mixed(key: np.ndarray, tree: int, seed: int, x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Hash of (row key, tree), in ``x``; its first 16 bits draw the weight."""
    np.add(key, np.uint64(0x9E3779B97F4A7C15 * (1 + tree + (seed << 32)) % (1 << 64)), out=x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint64(factor), out=x)
    return x


def bootstrap_weights(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row in a tree's sample, from a hash of its key."""
    key = key.astype(np.int64).view(np.uint64)
    x = _mixed(key, tree, seed, np.empty_like(key), np.empty_like(key))
    return _POISSON.take((x >> np.uint64(48)).astype(np.int64))


@dataclass
class Forest:
    """Trees as heaps: node i has children 2i + 1 and 2i + 2; feature -1 marks a leaf."""
    features: list[str]
    edges: list[np.ndarray]
    feature: np.ndarray     # trees x nodes
    cut: np.ndarray         # last bin that goes left
    positive: np.ndarray    # share of positive weight in the node
    decrease: np.ndarray    # trees x features: Gini decrease, weighted by rows
    seed: int
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return binned(self.edges, x)

    def reached(self, flat: np.ndarray, width: int, rows: np.ndarray, tree: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, node): of the given rows those that lie on level ``levels``, and where."""
        feature, cut, at = self.feature[tree], self.cut[tree], np.zeros(len(rows), np.int64)
        first = rows * width
        for _ in range(levels):
            f = feature.take(at)
            if len(f) and f.min() < 0:
                on = np.flatnonzero(f >= 0)
                first, at, f = first.take(on), at.take(on), f.take(on)
            right = flat.take(first + f) > cut.take(at)
            at *= 2
            at += 1
            at += right
        return first // width, at

    def leaves(self, flat: np.ndarray, width: int, rows: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaf) of the given rows, in another order."""
        feature, cut, at = self.feature[tree], self.cut[tree], np.zeros(len(rows), np.int64)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            f = feature.take(at)
            on, off = np.flatnonzero(f >= 0), np.flatnonzero(f < 0)
            ended.append((rows.take(off), at.take(off)))
            rows, at, f = rows.take(on), at.take(on), f.take(on)
            at = 2 * at + 1 + (flat.take(rows * width + f) > cut.take(at))
        return tuple(np.concatenate(x) for x in zip(*ended)) if ended else (rows, at)

    def votes(self, binned: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(votes for 1, votes) of each row; with a key only by trees that left the row out."""
        ones, total = np.zeros(len(binned)), np.zeros(len(binned))
        flat, rows = binned.ravel(), np.arange(len(binned))
        for t in range(len(self.feature)):
            own = rows if key is None else np.flatnonzero(bootstrap_weights(key, t, self.seed) == 0)
            own, leaf = self.leaves(flat, binned.shape[1], own, t)
            ones[own] += self.positive[t].take(leaf) > 0.5
            total[own] += 1
        return ones, total

    def probability(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Adds the share of trees that vote for 1."""
        ship_package(df.sparkSession)
        shared, edges, width = df.sparkSession.sparkContext.broadcast(self), self.edges, len(self.features)

        @F.pandas_udf("binary")
        def bins(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, width))
            return pd.Series([r.tobytes() for r in binned(edges, rows)], dtype=object)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            ones, total = shared.value.votes(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), width))
            return pd.Series(ones / np.maximum(total, 1))

        # rows with equal bins have equal votes: each row of bins is judged once
        rows = df.drop(out).withColumn("_bins", bins(F.array(*[F.col(f"`{f}`").cast("double") for f in self.features])))
        judged = spread(rows.select("_bins").distinct()).withColumn(out, score("_bins"))
        return rows.join(judged, "_bins").drop("_bins")

    def importances(self, spark) -> DataFrame:
        """(feature, mean_decrease_gini, importance): per tree, and as a share of all."""
        mean = self.decrease.mean(0)
        share = mean / mean.sum() if mean.sum() > 0 else mean
        return spark.createDataFrame([(f, float(m), float(s)) for f, m, s in zip(self.features, mean, share)],
                                     "feature string, mean_decrease_gini double, importance double")


class ForestRows:
    """(key hash, label, bins) kept for the passes; rows with a NULL or NaN are left out.
    Every part of the rows is there ``groups`` times, for as many groups of trees."""

    def __init__(self, df: DataFrame, label: str, features: Sequence[str], key: str, edges: Sequence[np.ndarray]):
        ship_package(df.sparkSession)
        x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
        rows = df.select(F.xxhash64(key).alias("k"), F.col(label).cast("double").alias("y"), x.alias("x"))
        there = F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
        rows, self.width = rows.where(there), len(features)
        self.n = rows.count()
        parts = max(1, math.ceil(self.n / ROWS_A_TASK))
        self.groups = max(1, math.ceil(default_parallelism(df.sparkSession) / parts))
        blocks = rows.repartition(parts).mapInArrow(_packing(edges, self.width), _BLOCKS)
        own = F.explode(F.array(*[F.lit(g) for g in range(self.groups)])).alias("group")
        dealt = blocks.select("*", own).repartitionById(parts * self.groups, F.col("part") * self.groups + F.col("group"))
        self.rows = dealt.persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> ForestRows:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()

    def summed(self, run, size: int) -> np.ndarray:
        """Sum over the tasks of the vectors that ``run(total, key, y, bins)`` fills, each row once."""
        if not self.n or not size:
            return np.zeros(size)
        width, groups = self.width, self.groups

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            held, count = [], 0
            for group, at, block in _blocks(batches, width):
                if at % groups != group:    # another group's copy of the block is counted
                    continue
                held.append(block)
                count += len(block[0])
                if count >= ROWS_AT_ONCE:
                    run(total, *_joined(held))
                    held, count = [], 0
            if count:
                run(total, *_joined(held))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

        sums = self.rows.mapInArrow(work, "v array<double>").select(Summarizer.sum(array_to_vector("v")).alias("v"))
        return sums.first()["v"].toArray()


class CellRows:
    """Rows as (key hash, cell and label), kept for the passes if the different rows of bins
    are at most ``MOST_CELLS`` (``fit`` says so).  Rows with a NULL or NaN are left out.  Every
    part of the rows is there ``groups`` times, for as many groups of trees."""

    def __init__(self, df: DataFrame, label: str, features: Sequence[str], key: str, edges: Sequence[np.ndarray]):
        spark = df.sparkSession
        ship_package(spark)
        width = self.width = len(features)
        x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
        rows = df.select(F.xxhash64(key).alias("k"), F.col(label).cast("double").alias("y"), x.alias("x"))
        rows = rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
        self.kept = [spread(rows).mapInArrow(_packing(edges, width), _BLOCKS).persist(StorageLevel.MEMORY_AND_DISK)]

        def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, count = [], 0
            for batch in batches:
                for b in batch.column("b"):
                    held.append(_cells_of(b.as_buffer(), width))
                    count += len(held[-1])
                    if count > MOST_CELLS:
                        held = [np.unique(np.concatenate(held))]
                        count = len(held[0])
                        if count > MOST_CELLS // 2:
                            yield _cell_batch(held[0])
                            held, count = [], 0
            if held:
                yield _cell_batch(np.unique(np.concatenate(held)))

        cells = self.kept[0].mapInArrow(different, "cell binary").distinct()
        found = cells.limit(MOST_CELLS + 1).toArrow().column(0).combine_chunks()
        self.fit = len(found) <= MOST_CELLS
        if not self.fit:
            return
        cells = np.sort(_cells_of(b"".join(found.to_pylist()), width))
        self.cells, self.shared = len(cells), spark.sparkContext.broadcast(cells)
        self.n = self.kept[0].agg(F.sum("n").alias("n")).first()["n"] or 0
        self.parts = max(1, math.ceil(self.n / CELL_ROWS_A_TASK))
        self.groups = max(1, math.ceil(default_parallelism(spark) / self.parts))
        own = F.explode(F.array(*[F.lit(g) for g in range(self.groups)])).alias("group")
        shared, parts = self.shared, self.parts

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = TaskContext.get().partitionId()  # blocks are dealt to parts in turn
            for batch in batches:
                for n, k, y, b in zip(*(batch.column(c) for c in ("n", "k", "y", "b"))):
                    code = 2 * np.searchsorted(shared.value, _cells_of(b.as_buffer(), width))
                    code += np.frombuffer(y.as_buffer()).astype(np.int64)
                    cells = [k.as_py(), code.astype(np.int32).tobytes()]
                    yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (at % parts, at // parts)],
                                                      *[pa.array([c], pa.binary()) for c in cells]], ["part", "at", "k", "c"])
                    at += 1

        rows = self.kept[0].mapInArrow(coded, "part int, at int, k binary, c binary").select("*", own)
        dealt = rows.repartitionById(self.parts * self.groups, F.col("part") * self.groups + F.col("group"))
        self.kept.append(dealt.persist(StorageLevel.MEMORY_AND_DISK))

    def __enter__(self) -> CellRows:
        return self

    def __exit__(self, *_) -> None:
        for x in self.kept:
            x.unpersist()

    def grow(self, forest: Forest, mtry: int, least_rows: int) -> None:
        """Grows all trees, and keeps what they vote for each cell."""
        trees = len(forest.feature)
        self.votes = np.zeros((trees, -(-self.cells // 8)), np.uint8)
        if not self.n:
            return
        seed, depth, size, groups, width, shared = forest.seed, forest.depth, 2 * self.cells, self.groups, self.width, self.shared

        at_once = trees if self.parts == 1 else max(1, SUMS_AT_ONCE // (self.parts * size))
        for begin in range(0, trees, at_once):
            batch = range(begin, min(begin + at_once, trees))

            def count(batches: Iterator[pa.RecordBatch], batch=batch) -> Iterator[pa.RecordBatch]:
                rows = _sorted_rows(_cell_blocks(batches))
                if rows is None:
                    return
                group, key, code = rows
                for t in batch[group::groups]:
                    total = np.zeros(size, np.int32)
                    for codes, sums in _weights_of(key, code, t, seed):
                        total[codes] = sums
                    small = next(k for k in (np.uint8, np.uint16, np.int32) if total.max() <= np.iinfo(k).max)
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array(
                        [total.astype(small).tobytes()], pa.binary())], ["tree", "c"])

            def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                cells = shared.value.view(np.uint8).reshape(-1, width)
                for t, total in _added(batches, size):
                    yield _grown_tree(t, cells, total, seed, mtry, least_rows, depth)

            sums = self.kept[1].mapInArrow(count, "tree int, c binary")
            if self.parts > 1:
                sums = sums.repartition("tree").sortWithinPartitions("tree")
            found = sums.mapInArrow(grown, "tree int, feature binary, cut binary, positive binary, decrease binary, votes binary").toArrow()
            for t, *cells in zip(*(found.column(c).to_pylist() for c in found.column_names)):
                for row, cell in zip((forest.feature, forest.cut, forest.positive, forest.decrease, self.votes), cells):
                    row[t] = np.frombuffer(cell, row.dtype)

    def out_of_bag(self, seed: int) -> np.ndarray:
        """Rows by (label, vote of the trees that left the row out), each row counted once."""
        if not self.n:
            return np.zeros(4, np.int64)
        groups = self.groups
        votes = self.kept[1].sparkSession.sparkContext.broadcast(self.votes)
        most = np.uint64(int(np.searchsorted(_POISSON, 1)) << 48)  # hashes below it draw weight 0

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _sorted_rows((g, at, x) for g, at, x in _cell_blocks(batches) if at % groups == g)
            total = np.zeros(4, np.int64)
            for a in range(0, len(rows[1]) if rows else 0, ROWS_AT_ONCE):
                key, code = (c[a:a + ROWS_AT_ONCE] for c in rows[1:])
                cell = (code >> 1).astype(np.int64)
                low, high = cell[0] // 8, cell[-1] // 8 + 1
                cell -= 8 * low
                x, spare = np.empty_like(key), np.empty_like(key)
                ones, seen = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32)
                for t, bits in enumerate(votes.value):
                    out = _mixed(key, t, seed, x, spare) < most
                    seen += out
                    out &= np.unpackbits(bits[low:high]).view(bool).take(cell)
                    ones += out
                judged = seen > 0
                total += np.bincount(2 * (code[judged] & 1) + (2 * ones[judged] > seen[judged]), minlength=4)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()) for i in total], list("abcd"))

        sums = self.kept[1].mapInArrow(work, "a long, b long, c long, d long").agg(*[F.sum(c).alias(c) for c in "abcd"]).first()
        votes.unpersist()
        return np.array(sums, np.int64)


def _cells_of(data, width: int) -> np.ndarray:
    """Rows of ``width`` bins as one value each, which compares as the bins do."""
    return np.frombuffer(data, f"S{width}")


def _cell_batch(cells: np.ndarray) -> pa.RecordBatch:
    width, data = cells.dtype.itemsize, cells.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([data[i:i + width] for i in range(0, len(data), width)], pa.binary())], ["cell"])


def _cell_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(group, place in the part, (key, cell and label)) of the kept blocks."""
    for batch in batches:
        for group, at, k, c in zip(*(batch.column(c) for c in ("group", "at", "k", "c"))):
            yield group.as_py(), at.as_py(), (np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int32))


def _sorted_rows(blocks) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(group, keys, codes) of all blocks in the order of the codes."""
    held = [(g, x) for g, _, x in blocks]
    if not held:
        return None
    key, code = _joined([x for _, x in held])
    order = np.argsort(code)
    return held[0][0], key[order], code[order]


def _weights_of(key: np.ndarray, code: np.ndarray, tree: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, sums of the weights in the tree's sample) of sorted rows, in parts that stay in a
    processor's cache; no code is in two of them."""
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    ends = np.append(first, len(code))
    x, spare = np.empty(ROWS_AT_ONCE, np.uint64), np.empty(ROWS_AT_ONCE, np.uint64)
    a = 0
    while a < len(first):
        b = max(int(np.searchsorted(ends, ends[a] + ROWS_AT_ONCE, side="right")) - 1, a + 1)
        n = ends[b] - ends[a]
        if n > len(x):
            x, spare = np.empty(n, np.uint64), np.empty(n, np.uint64)
        drawn = _mixed(key[ends[a]:ends[b]], tree, seed, x[:n], spare[:n])
        drawn >>= np.uint64(48)
        weight = _POISSON.take(drawn.view(np.int64), mode="clip")
        yield code[first[a:b]], np.add.reduceat(weight, first[a:b] - ends[a], dtype=np.int32)
        a = b


def _added(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(tree, sums) of the parts of each tree, which come together."""
    tree, total = None, None
    for batch in batches:
        for t, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(data.as_buffer(), {1: np.uint8, 2: np.uint16, 4: np.int32}[len(data.as_buffer()) // size])
            if t == tree:
                total += part
            else:
                if tree is not None:
                    yield tree, total
                tree, total = t, part.astype(np.int64)
    if tree is not None:
        yield tree, total


def _grown_tree(tree: int, cells: np.ndarray, total: np.ndarray, seed: int, mtry: int, least_rows: int, depth: int) -> pa.RecordBatch:
    """A tree grown on the weights per (cell, label), with its vote for every cell."""
    width, flat, heap = cells.shape[1], cells.ravel(), 2 ** (depth + 1) - 1
    feature, cut = np.full(heap, -1, np.int16), np.zeros(heap, np.uint8)
    positive, decrease = np.zeros(heap), np.zeros(width)
    one = total[1::2].astype(float)
    weight = total[::2] + one
    own = np.flatnonzero(weight)
    weight, one, at, nodes = weight[own], one[own], np.zeros(len(own), np.int64), np.zeros(1, np.int64)
    for level in range(depth):
        allowed = node_features(seed, tree, nodes, width, mtry)
        slots = np.full(2 ** (level + 1), -1, np.int64)
        slots[nodes] = np.arange(len(nodes))
        slot = slots.take(at)
        on = np.flatnonzero(slot >= 0)
        own, weight, one, at, slot = (v.take(on) for v in (own, weight, one, at, slot))
        counts, first = np.zeros((2, len(nodes) * mtry * BINS)), own * width
        for j, f in enumerate(np.ascontiguousarray(allowed.T)):
            code = slot * (mtry * BINS) + j * BINS
            code += flat.take(first + f.take(slot))
            counts[0] += np.bincount(code, weight, counts.shape[1])
            counts[1] += np.bincount(code, one, counts.shape[1])
        nodes = _split(feature, cut, positive, decrease, nodes, *_chosen(tree, nodes, counts, allowed, least_rows), least_rows)
        if not len(nodes):
            break
        on = np.flatnonzero(feature.take(at) >= 0)
        own, weight, one, at = (v.take(on) for v in (own, weight, one, at))
        at = 2 * at + 1 + (flat.take(own * width + feature.take(at)) > cut.take(at))
    plain = Forest([], [], feature[None], cut[None], None, None, seed, depth)
    rows, leaf = plain.leaves(flat, width, np.arange(len(cells)), 0)
    votes = np.zeros(len(cells), bool)
    votes[rows] = positive.take(leaf) > 0.5
    return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (
        feature, cut, positive, decrease, np.packbits(votes))]], ["tree", "feature", "cut", "positive", "decrease", "votes"])


_BLOCKS = "part int, at int, n int, k binary, y binary, b binary"


def _packing(edges: Sequence[np.ndarray], width: int):
    """Rows (k, y, x) to blocks of their bytes, the numbers as bins."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                k, y, x = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0), batch.column(1), batch.column(2).flatten()))
                cells = [k.tobytes(), y.tobytes(), binned(edges, x.reshape(-1, width)).tobytes()]
                yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (part, at, batch.num_rows)],
                                                  *[pa.array([c], pa.binary()) for c in cells]], ["part", "at", "n", "k", "y", "b"])
                at += 1

    return pack


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(group, place in the part, (key, label, bins)) of the kept blocks."""
    for batch in batches:
        group, at, cells = batch.column("group"), batch.column("at"), [batch.column(c) for c in ("k", "y", "b")]
        for i in range(batch.num_rows):
            k, y, b = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(cells, (np.int64, np.float64, np.uint8)))
            yield group[i].as_py(), at[i].as_py(), (k, y, b.reshape(-1, width))


def _joined(blocks: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*blocks))


def binned(edges: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)


def node_features(seed: int, tree: int, nodes: np.ndarray, features: int, mtry: int) -> np.ndarray:
    """The ``mtry`` random features that each node may split on."""
    draws = np.random.default_rng([seed, tree, int(nodes[0])]).random((len(nodes), features))
    return np.argsort(draws, axis=1)[:, :mtry]


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, ...]:
    """(choice among the features, last bin left, Gini decrease, left counts) of each node,
    from counts (node, feature, bin, [weight, positive weight]); decrease 0 without a split."""
    left = hist.cumsum(axis=2)[:, :, :-1]
    whole = hist.sum(axis=2)[:, :, None]
    right = whole - left

    def impure(c):  # weight * Gini index
        n, one = c[..., 0], c[..., 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, 2 * one * (n - one) / n, 0.0)

    gain = impure(whole) - impure(left) - impure(right)
    gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), gain, 0.0)
    flat = gain.reshape(len(hist), -1).argmax(axis=1)
    choice, cut = np.divmod(flat, hist.shape[2] - 1)
    at = np.arange(len(hist))
    return choice, cut, gain[at, choice, cut], left[at, choice, cut]


def fit_forest(df: DataFrame, label: str, features: Sequence[str], key: str, num_trees: int = 1000, mtry: int = 5,
               max_depth: int = 10, least_rows: int = 2, seed: int = 100) -> tuple[Forest, dict]:
    """(forest, out-of-bag counts {(label, vote): rows}).  ``key`` identifies a row for
    the bootstrap; nodes of fewer than ``least_rows`` sampled rows are leaves."""
    features = list(features)
    mtry = min(mtry, len(features))
    probs = [i / BINS for i in range(1, BINS)]
    cuts = column_quantile_values(df, features, probs)
    edges = [np.unique([q for q in cuts[f].values() if q is not None]) for f in features]
    shape = (num_trees, 2 ** (max_depth + 1) - 1)
    forest = Forest(features, edges, np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape),
                    np.zeros((num_trees, len(features))), seed, max_depth)
    with CellRows(df, label, features, key, edges) as cells:
        if cells.fit:
            cells.grow(forest, mtry, least_rows)
            counts = cells.out_of_bag(seed).reshape(2, 2)
            return forest, {(a, b): int(counts[a, b]) for a in (0, 1) for b in (0, 1)}
    with ForestRows(df, label, features, key, edges) as rows:
        open_ = {t: np.zeros(1, np.int64) for t in range(num_trees)} if rows.n else {}
        for level in range(max_depth):
            grown: dict[int, np.ndarray] = {}
            for batch in _batches(open_, mtry, CELLS * rows.groups):
                grown |= _grow(rows, forest, batch, level, mtry, least_rows)
            open_ = grown
        counts = rows.summed(_oob(df, forest), 4).reshape(2, 2)
    return forest, {(a, b): int(counts[a, b]) for a in (0, 1) for b in (0, 1)}


def _batches(open_: dict[int, np.ndarray], mtry: int, most: int) -> Iterator[dict[int, np.ndarray]]:
    """Trees together as long as their counts fit."""
    part, cells = {}, 0
    for t, nodes in open_.items():
        size = len(nodes) * mtry * BINS * 2
        if part and cells + size > most:
            yield part
            part, cells = {}, 0
        part[t] = nodes
        cells += size
    if part:
        yield part


_SPLITS = "tree int, node array<int>, feature array<int>, cut array<int>, gain array<double>, " \
          "n array<double>, one array<double>, left_n array<double>, left_one array<double>"


def _grow(rows: ForestRows, forest: Forest, batch: dict[int, np.ndarray], level: int, mtry: int,
          least_rows: int) -> dict[int, np.ndarray]:
    """Splits the open nodes of the batch's trees; returns the nodes open on the next level."""
    seed, width, groups = forest.seed, len(forest.features), rows.groups
    trees = Forest(forest.features, forest.edges, {t: forest.feature[t] for t in batch}, {t: forest.cut[t] for t in batch},
                   None, None, seed, forest.depth)
    shared = rows.rows.sparkSession.sparkContext.broadcast((trees, batch))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, open_ = shared.value
        parts, group = [], 0
        for group, _, block in _blocks(batches, width):
            parts.append(block)
        if not parts:
            return
        key, y, bins = _joined(parts)
        flat, positive = bins.ravel(), y.astype(np.int64)
        for t, nodes in list(open_.items())[group::groups]:
            allowed = node_features(seed, t, nodes, width, mtry)
            weight = bootstrap_weights(key, t, seed)
            own, at = trees.reached(flat, width, np.flatnonzero(weight), t, level)
            slots = np.full(2 ** (level + 1), -1, np.int64)
            slots[nodes] = np.arange(len(nodes))
            slot = slots.take(at)
            on = np.flatnonzero(slot >= 0)
            own, slot = own.take(on), slot.take(on)
            # one count a feature, of the cells of both labels
            w, first, total = weight.take(own).astype(float), own * width, np.zeros((len(nodes) * mtry * BINS, 2))
            cells = slot * (2 * mtry * BINS) + positive.take(own)
            for j, f in enumerate(np.ascontiguousarray(allowed.T)):
                code = flat.take(first + f.take(slot)).astype(np.int64)
                code *= 2
                code += cells
                code += 2 * j * BINS
                total += np.bincount(code, w, total.size).reshape(total.shape)
            total[:, 0] += total[:, 1]
            total = np.ascontiguousarray(total.T, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["tree", "c"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, open_ = shared.value
        tree, total = None, None
        for batch in batches:
            for t, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(data.as_buffer(), np.int32)
                if t != tree:
                    if tree is not None:
                        yield _splits(tree, open_[tree], total, seed, width, mtry, least_rows)
                    tree, total = t, counts.astype(np.int64)
                else:
                    total += counts
        if tree is not None:
            yield _splits(tree, open_[tree], total, seed, width, mtry, least_rows)

    sums = rows.rows.mapInArrow(count, "tree int, c binary").repartition("tree").sortWithinPartitions("tree")
    out = {}
    found = sums.mapInArrow(choose, _SPLITS).toArrow().combine_chunks()
    for i, t in enumerate(found.column("tree").to_pylist()):
        at, feature, cut, *found_at = (found.column(c)[i].values.to_numpy() for c in found.column_names[1:])
        nodes = _split(forest.feature[t], forest.cut[t], forest.positive[t], forest.decrease[t], at.astype(np.int64),
                       feature.astype(np.int64), cut, *found_at, least_rows)
        if len(nodes):
            out[t] = nodes
    shared.unpersist()
    return out


def _split(features: np.ndarray, cuts: np.ndarray, positive: np.ndarray, decrease: np.ndarray, at: np.ndarray,
           feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, n: np.ndarray, one: np.ndarray, ln: np.ndarray,
           lone: np.ndarray, least_rows: int) -> np.ndarray:
    """Enters a level's splits in the arrays of a tree; returns the nodes open on the next level."""
    if len(at) and at[0] == 0:
        positive[at] = one / n
    split = feature >= 0
    at, n, one, ln, lone = at[split], n[split], one[split], ln[split], lone[split]
    features[at], cuts[at] = feature[split], cut[split]
    np.add.at(decrease, feature[split], gain[split])
    children = []
    for side, (cn, cone) in enumerate(((ln, lone), (n - ln, one - lone))):
        child = 2 * at + 1 + side
        positive[child] = cone / np.maximum(cn, 1)
        children.append(child[(cn >= least_rows) & (cone > 0) & (cone < cn)])
    return np.sort(np.concatenate(children))


def _chosen(tree: int, nodes: np.ndarray, total: np.ndarray, allowed: np.ndarray, least_rows: int) -> list[np.ndarray]:
    """(feature, cut, gain, n, one, left_n, left_one) of the open nodes of a tree (feature -1 without a split)."""
    hist = np.moveaxis(total.reshape(2, len(nodes), allowed.shape[1], BINS), 0, -1).astype(float)
    n, one = hist[:, 0, :, 0].sum(1), hist[:, 0, :, 1].sum(1)
    choice, cut, gain, left = best_splits(hist)
    split = (gain > 1e-9 * np.maximum(n, 1)) & (n >= least_rows)
    feature = np.where(split, allowed[np.arange(len(nodes)), choice], -1)
    return [feature, cut, gain, np.maximum(n, 1e-300), one, left[:, 0], left[:, 1]]


def _splits(tree: int, nodes: np.ndarray, total: np.ndarray, seed: int, width: int, mtry: int,
            least_rows: int) -> pa.RecordBatch:
    """The open nodes of a tree with their split."""
    cells = [nodes, *_chosen(tree, nodes, total, node_features(seed, tree, nodes, width, mtry), least_rows)]
    kinds = [pa.int32()] * 3 + [pa.float64()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array([tree], pa.int32()), *[pa.array([c.tolist()], pa.list_(k)) for c, k in zip(cells, kinds)]],
        ["tree", "node", "feature", "cut", "gain", "n", "one", "left_n", "left_one"])


def _oob(df: DataFrame, forest: Forest):
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(total, key, y, bins):
        ones, votes = shared.value.votes(bins, key)
        seen = votes > 0
        np.add.at(total, (2 * y[seen] + (2 * ones[seen] > votes[seen])).astype(int), 1)

    return run


def oob_table(counts: dict, spark) -> DataFrame:
    """(label, vote, n, error): the out-of-bag confusion and the share of wrong votes."""
    total = sum(counts.values())
    wrong = (counts[0, 1] + counts[1, 0]) / total if total else None
    return spark.createDataFrame([(a, b, n, wrong) for (a, b), n in sorted(counts.items())],
                                 "label int, vote int, n long, error double")
