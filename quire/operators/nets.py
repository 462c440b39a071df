"""Feed-forward nets with one hidden layer, trained on all rows at once.

As in the usual R package: logistic units, half the sum of squared errors, resilient
propagation with weight backtracking (steps by the sign of the slope), several
restarts from normal random weights, the one of least error kept, and an end when
every partial derivative is below a threshold.  One pass over the rows makes a step
of every restart still running: a task adds up their slopes as one vector.

Columns of few values (0/1 columns of categories) are constant in most blocks of rows
that are sorted by them.  There they are multiples of the constant input, so a block is
measured as a net of its other columns, whose slopes and second derivatives are carried
back to all weights once per combination of values and pass.  Columns are set apart as
long as their combinations have ``ROWS_A_PATTERN`` rows of a task, on average.

Sign steps alone take many thousand passes to such a threshold.  After
``sign_steps`` of them a restart goes on with damped Newton steps, downhill along
every eigenvector, whose second derivatives come from the same passes.  Each
restart reports its error, its largest slope and whether the threshold was reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import sigmoid
from quire.operators.logit import ROWS_AT_ONCE, LogitData, blocks

# Factors and limits of the sign steps.
GROW, SHRINK, FIRST_STEP, LEAST_STEP, MOST_STEP = 1.2, 0.5, 0.1, 1e-10, 0.1
#: rows that a combination of values has on average, if its columns are set apart
ROWS_A_PATTERN = 1 << 13


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def forward(x: np.ndarray, weights: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """(hidden units with a leading 1, output) for rows [1, features...]."""
    first = weights[:x.shape[1] * hidden].reshape(x.shape[1], hidden)
    h = np.hstack([np.ones((len(x), 1)), _logistic(x @ first)])
    return h, _logistic(h @ weights[x.shape[1] * hidden:])


def products(x: np.ndarray) -> np.ndarray:
    """Products of any two columns, one line each: they serve all restarts."""
    lines = np.ascontiguousarray(x.T)
    return np.vstack([lines[i] * lines[i:] for i in range(len(lines))])


def error_and_slopes(x: np.ndarray, y: np.ndarray, weights: np.ndarray, hidden: int, curve: bool,
                     pairs: np.ndarray | None = None) -> tuple:
    """Half the squared errors, their slope, and (``curve``) their second derivatives;
    ``pairs`` are the rows' ``products``."""
    h, out = forward(x, weights, hidden)
    width = x.shape[1]
    miss, bend = out - y, out * (1 - out)
    second, unit = weights[width * hidden + 1:], h[:, 1:]
    rise = unit * (1 - unit)
    pull = miss * bend
    slope = np.concatenate([(x.T @ (pull[:, None] * second * rise)).ravel(), h.T @ pull])
    if not curve:
        return float(miss @ miss) / 2, slope, None
    # the output is logistic in a; its slope in the weights and a's own second derivatives.
    # Weights of two inputs and two units meet in one sum over products of inputs.
    pairs = products(x) if pairs is None else pairs
    curved = bend * bend + pull * (1 - 2 * out)
    lines, rises = np.ascontiguousarray(h.T), np.ascontiguousarray(rise.T)
    steep, count = second[:, None] * rises, width * hidden
    j, k = np.triu_indices(hidden)
    both = steep[j] * (steep * curved)[k]
    both[j == k] += steep * pull * (1 - 2 * lines[1:])
    sums, (a, b) = pairs @ both.T, np.triu_indices(width)
    inputs = np.empty((width, hidden, width, hidden))
    for one, two in ((a[:, None], b[:, None]), (b[:, None], a[:, None])):
        inputs[one, j, two, k] = inputs[one, k, two, j] = sums
    mixed = steep[:, None, :] * (lines * curved)
    mixed[np.arange(hidden), np.arange(hidden) + 1] += rises * pull
    cross = (x.T @ mixed.reshape(-1, len(x)).T).reshape(count, hidden + 1)
    matrix = np.block([[inputs.reshape(count, count), cross], [cross.T, (lines * curved) @ h]])
    return float(miss @ miss) / 2, slope, matrix


def _products(lines: np.ndarray) -> np.ndarray:
    return np.vstack([lines[i] * lines[i:] for i in range(len(lines))])


@lru_cache(maxsize=64)
def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matrix's upper triangle."""
    return np.triu_indices(n)


def _logistic_of(x: np.ndarray) -> np.ndarray:
    """``_logistic``, in place."""
    np.negative(x, out=x)
    np.minimum(x, 700, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.divide(1.0, x, out=x)


def _measures(inputs: np.ndarray, y: np.ndarray, weights: np.ndarray, hidden: int, curve: bool,
              pairs: np.ndarray | None = None) -> tuple:
    """``error_and_slopes`` of inputs by line, with fewer passes over them."""
    width, n = inputs.shape
    count, second = width * hidden, weights[width * hidden + 1:]
    lines = np.ones((hidden + 1, n))  # the units with a leading 1
    unit = lines[1:]
    np.matmul(np.ascontiguousarray(weights[:count].reshape(width, hidden).T), inputs, out=unit)
    _logistic_of(unit)
    out = _logistic_of(weights[count:] @ lines)
    miss, bend = out - y, out * (1 - out)
    rise = unit * (1 - unit)
    pull = miss * bend
    steep = second[:, None] * rise
    pulled = steep * pull
    slope = np.concatenate([(inputs @ pulled.T).ravel(), lines @ pull])
    if not curve:
        return float(miss @ miss) / 2, slope, None
    pairs = _products(inputs) if pairs is None else pairs
    curved = bend * bend + pull * (1 - 2 * out)
    bent = steep * curved
    pulled *= 1 - 2 * unit
    j, k = _upper(hidden)
    both, at = np.empty((len(j), n)), 0
    for i in range(hidden):
        np.multiply(bent[i], steep[i:], out=both[at:at + hidden - i])
        both[at] += pulled[i]
        at += hidden - i
    sums, (a, b) = pairs @ both.T, _upper(width)
    matrix = np.empty((count + hidden + 1, count + hidden + 1))
    square = np.empty((width, hidden, width, hidden))
    for one, two in ((a[:, None], b[:, None]), (b[:, None], a[:, None])):
        square[one, j, two, k] = square[one, k, two, j] = sums
    if width <= hidden:  # the fewer products of the two
        mixed = np.ascontiguousarray(((inputs[:, None, :] * bent).reshape(-1, n) @ lines.T).reshape(width, hidden, hidden + 1))
    else:
        mixed = (inputs @ (bent[:, None, :] * lines).reshape(-1, n).T).reshape(width, hidden, hidden + 1)
    rise *= pull
    mixed[:, np.arange(hidden), np.arange(hidden) + 1] += inputs @ rise.T
    matrix[:count, :count] = square.reshape(count, count)
    matrix[:count, count:] = mixed.reshape(count, hidden + 1)
    matrix[count:, :count] = matrix[:count, count:].T
    matrix[count:, count:] = (lines * curved) @ lines.T
    return float(miss @ miss) / 2, slope, matrix


class _Restart:
    """One net on its way: sign steps, then damped Newton steps."""

    def __init__(self, weights: np.ndarray, sign_steps: int, threshold: float):
        self.w, self.threshold, self.signs_left = weights, threshold, sign_steps
        self.delta, self.before, self.moved = np.full(len(weights), FIRST_STEP), np.zeros(len(weights)), np.zeros(len(weights))
        self.damping, self.kept, self.steps = 1e-3, None, 0
        self.error, self.slope, self.done = math.inf, math.inf, False

    @property
    def curved(self) -> bool:
        return self.signs_left <= 0

    def take(self, error: float, slope: np.ndarray, matrix: np.ndarray | None) -> None:
        """The measures at ``w`` have come in: stop there, or move on."""
        self.steps += 1
        if matrix is None:
            self.error, self.slope = error, float(np.abs(slope).max())
            if self.slope < self.threshold:
                self.done = True
                return
            turn = slope * self.before
            self.delta = np.where(turn > 0, np.minimum(self.delta * GROW, MOST_STEP),
                                  np.where(turn < 0, np.maximum(self.delta * SHRINK, LEAST_STEP), self.delta))
            # a slope that changed its sign takes its last move back
            move = np.where(turn < 0, -self.moved, -np.sign(slope) * self.delta)
            self.before, self.moved = np.where(turn < 0, 0.0, slope), move
            self.w = self.w + move
            self.signs_left -= 1
            return
        if self.kept is None or error <= self.kept[1]:
            if self.kept is not None:
                self.damping = max(self.damping / 5, 1e-12)
            self.kept = (self.w, error, slope, matrix)
        else:
            self.damping = min(self.damping * 4, 1e12)
        at, self.error, slope, matrix = self.kept
        self.slope = float(np.abs(slope).max())
        if self.slope < self.threshold or self.damping >= 1e12:
            self.w, self.done = at, True
            return
        value, vector = np.linalg.eigh(matrix)
        value = np.abs(value)
        self.w = at - vector @ ((vector.T @ slope) / (value + self.damping * max(float(value.max()), 1e-12)))

    def result(self) -> np.ndarray:
        return self.kept[0] if self.kept is not None else self.w


@dataclass
class NetFit:
    features: list[str]
    hidden: int
    weights: np.ndarray
    error: float
    slope: float
    steps: int
    reached: bool
    restarts: list[tuple[int, float, float, int, bool]]

    def probability(self) -> Column:
        """The net's output as a codegen'd expression (no Python when scoring)."""
        width = 1 + len(self.features)
        first, second = self.weights[:width * self.hidden].reshape(width, self.hidden), self.weights[width * self.hidden:]
        z = F.lit(float(second[0]))
        for j in range(self.hidden):
            a = F.lit(float(first[0, j]))
            for i, f in enumerate(self.features):
                a = a + F.lit(float(first[1 + i, j])) * F.col(f"`{f}`")
            z = z + F.lit(float(second[1 + j])) * sigmoid(a)
        return sigmoid(z)

    def restart_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.restarts, "restart int, error double, slope double, steps int, reached boolean")


def start_weights(count: int, seed: int, restart: int) -> np.ndarray:
    return np.random.default_rng([seed, restart]).normal(size=count)


def resilient_net(df: DataFrame, label: str, features: Sequence[str], hidden: int, restarts: int = 5,
                  threshold: float = 0.01, sign_steps: int = 50, max_steps: int = 1000, seed: int = 1) -> NetFit:
    """Best of ``restarts`` nets; ``max_steps`` is a guard, and ``reached`` says whether
    the threshold ended the training.  Rows with a NULL or NaN are left out."""
    width = 1 + len(features)
    count = width * hidden + hidden + 1
    runs = [_Restart(start_weights(count, seed, r), sign_steps, threshold) for r in range(1, restarts + 1)]
    with NetRows(df, label, features) as data:
        for _ in range(max_steps if data.n else 0):
            open_ = [r for r in runs if not r.done]
            if not open_:
                break
            for r, found in zip(open_, _measured(data, [(r.w, r.curved) for r in open_], hidden)):
                r.take(*found)
    table = [(i, float(r.error), float(r.slope), r.steps, bool(r.slope < threshold)) for i, r in enumerate(runs, 1)]
    best = min(runs, key=lambda r: r.error)
    return NetFit(list(features), hidden, best.result(), float(best.error), float(best.slope), best.steps,
                  bool(best.slope < threshold), table)


class NetRows:
    """Rows in blocks whose set-apart columns are constant, kept for the passes: (n, pattern,
    block), the pattern having a value for every such column and NaN for the others, whose
    lines follow the labels in the block (the first column, of ones, is left out).  Where no
    column is set apart, the pattern is empty and the block is that of ``LogitData``."""

    def __init__(self, df: DataFrame, label: str, features: Sequence[str]):
        with LogitData(df, label, features) as data:
            self.rows = data.rows.mapInArrow(_by_pattern(ROWS_A_PATTERN), "n long, pattern binary, block binary").persist(StorageLevel.MEMORY_AND_DISK)
            self.n = self.rows.agg(F.sum("n").alias("n")).first()["n"] or 0

    def __enter__(self) -> NetRows:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()


def _set_apart(x: np.ndarray, most: int) -> tuple[list[int], np.ndarray]:
    """(columns, number of each row's combination of their values, ``most`` at most): columns
    of fewest values first."""
    code, apart, few = np.zeros(len(x), np.int64), [], []
    for c in range(1, x.shape[1]):
        if len(np.unique(x[:4 * most, c])) <= most:  # a first look, before all rows are sorted
            values, own = np.unique(x[:, c], return_inverse=True)
            few.append((len(values), c, own))
    for n, c, own in sorted(few, key=lambda f: f[:2]):
        if n > most:
            break
        found, both = np.unique(code * n + own, return_inverse=True)
        if len(found) <= most:
            code = both
            apart.append(c)
    return apart, code


def _by_pattern(rows_a_pattern: int):
    """Blocks of ``LogitData.rows`` to those of ``NetRows``."""
    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        held = [(y, x) for y, _, x in blocks(whole)]
        if not held:
            return
        y, x = (np.concatenate(c) for c in zip(*held))
        apart, code = _set_apart(x, len(x) // rows_a_pattern)
        if not apart:
            for batch in whole:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b""] * batch.num_rows, pa.binary()), batch.column(1)],
                                                 ["n", "pattern", "block"])
            return
        dense = [c for c in range(1, x.shape[1]) if c not in apart]
        order = np.argsort(code, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(order))
        for a, b in zip(ends[:-1], ends[1:]):
            for rows in np.array_split(order[a:b], -(-(b - a) // ROWS_AT_ONCE)):
                pattern = np.full(x.shape[1], np.nan)
                pattern[apart] = x[rows[0], apart]
                lines = np.vstack([y[rows], x[rows][:, dense].T])
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), *[
                    pa.array([v.tobytes()], pa.binary()) for v in (pattern, lines)]], ["n", "pattern", "block"])

    return regroup


def _carried(pattern: np.ndarray, hidden: int) -> np.ndarray:
    """The linear map from all weights to those of the net of a pattern's other columns."""
    dense = np.flatnonzero(np.isnan(pattern))
    inputs = np.zeros((len(dense), len(pattern)))
    inputs[np.arange(len(dense)), dense] = 1.0
    inputs[0] += np.nan_to_num(pattern)
    out = np.zeros((len(dense) * hidden + hidden + 1, len(pattern) * hidden + hidden + 1))
    out[:len(dense) * hidden, :len(pattern) * hidden] = np.kron(inputs, np.eye(hidden))
    out[len(dense) * hidden:, len(pattern) * hidden:] = np.eye(hidden + 1)
    return out


def _measured(data: NetRows, points: Sequence[tuple[np.ndarray, bool]], hidden: int) -> list[tuple]:
    """Error, slope and matrix of every restart at its weights: one pass."""
    count = len(points[0][0])
    sizes = [1 + count + (count * count if curve else 0) for _, curve in points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        found: dict[bytes, tuple] = {}  # per pattern: the map of its weights, those of the points, and their sums
        curves = any(curve for _, curve in points)
        for batch in batches:
            for n, pattern, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                cells = np.frombuffer(block.as_buffer())
                if not pattern:
                    y, x = cells[:n], cells[2 * n:].reshape(n, -1)
                    pairs = products(x) if curves else None
                    place = 0
                    for (w, curve), size in zip(points, sizes):
                        error, slope, matrix = error_and_slopes(x, y, w, hidden, curve, pairs)
                        total[place] += error
                        total[place + 1:place + 1 + count] += slope
                        if curve:
                            total[place + 1 + count:place + size] += matrix.ravel()
                        place += size
                    continue
                if pattern not in found:
                    to = _carried(np.frombuffer(pattern), hidden)
                    found[pattern] = to, [to @ w for w, _ in points], [[0.0, 0.0, 0.0] for _ in points]
                _, weights, sums = found[pattern]
                lines = cells.reshape(-1, n)
                inputs = np.vstack([np.ones(n), lines[1:]])
                pairs = _products(inputs) if curves else None
                for w, (_, curve), own in zip(weights, points, sums):
                    for i, v in enumerate(_measures(inputs, lines[0], w, hidden, curve, pairs)[:3 if curve else 2]):
                        own[i] = own[i] + v
        for to, _, sums in found.values():
            place = 0
            for (error, slope, matrix), (_, curve), size in zip(sums, points, sizes):
                total[place] += error
                total[place + 1:place + 1 + count] += slope @ to
                if curve:
                    total[place + 1 + count:place + size] += (to.T @ matrix @ to).ravel()
                place += size
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    sums = data.rows.mapInArrow(run, "v array<double>").select(Summarizer.sum(array_to_vector("v")).alias("v"))
    total, out, place = sums.first()["v"].toArray(), [], 0
    for (_, curve), size in zip(points, sizes):
        part = total[place:place + size]
        out.append((float(part[0]), part[1:1 + count], part[1 + count:].reshape(count, count) if curve else None))
        place += size
    return out
