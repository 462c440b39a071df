"""Support vector machines: many two-class machines fitted together, each to a certified gap.

A machine has the squared hinge loss, the ridge 1 / (C n) and a regularised
intercept.  One pass over the rows adds up, for every machine still open, the
gradient together with the sums of slacks and squared slacks; these give a dual
point for free, and with it a bound on how far the machine is from its optimum (the
duality gap).  A machine leaves the passes when its relative gap is below ``tol``.

Steps are accelerated and scaled by a curvature bound: the second moments of the
features, summed once, dominate the Hessian of every machine, so the number of passes
does not grow with the number of rows as that of plain gradient steps does.

The RBF kernel exp(-sigma |x - y|^2) is approximated by random Fourier features
(Rahimi & Recht, 2007).  Codings: one class against the rest, or every pair of classes
decided by votes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ship_package

#: rows that a task turns into matrices at once
ROWS_AT_ONCE = 2048


def fourier_weights(sigma: float, input_dim: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the random map z(x) = sqrt(2/D) cos(x W + b)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2.0 * sigma), size=(input_dim, dim)), rng.uniform(0.0, 2 * math.pi, size=dim)


@dataclass(frozen=True)
class FeatureMap:
    """[z(x), 1]: x itself, or random Fourier features of an RBF kernel."""
    input_dim: int
    sigma: float | None = None
    dim: int = 256
    seed: int = 7

    @property
    def width(self) -> int:
        return 1 + (self.input_dim if self.sigma is None else self.dim)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.sigma is not None:
            freq, phase = fourier_weights(self.sigma, self.input_dim, self.dim, self.seed)
            x = math.sqrt(2.0 / self.dim) * np.cos(x @ freq + phase)
        return np.hstack([x, np.ones((len(x), 1))])


def one_against_rest(k: int) -> np.ndarray:
    """(class, machine): 1 for the machine's own class, -1 for the others."""
    return 2.0 * np.eye(k) - 1.0


def one_against_one(k: int) -> np.ndarray:
    """(class, machine): 1 and -1 for the two classes of a pair, 0 for those it does not see."""
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    code = np.zeros((k, len(pairs)))
    for m, (a, b) in enumerate(pairs):
        code[a, m], code[b, m] = 1.0, -1.0
    return code


@dataclass
class Machines:
    """Machines over the same rows: feature map, code per class, fold left out, cost."""
    maps: list[FeatureMap]
    of_map: np.ndarray
    code: np.ndarray        # classes x machines
    left_out: np.ndarray    # fold, -1 for none
    cost: np.ndarray


@dataclass
class Fitted:
    weights: list[np.ndarray]   # per machine
    gap: np.ndarray             # relative duality gap at the weights
    steps: np.ndarray           # passes until the machine left


class Rows:
    """(x, class number, fold) kept in memory or on disk for the passes of a fit."""

    def __init__(self, df: DataFrame, label: str, x_col: str, fold=None):
        ship_package(df.sparkSession)
        named = df.select(F.transform(F.col(x_col), lambda v: v.cast("double")).alias("x"),
                          F.col(label).cast("double").alias("label"), (fold if fold is not None else F.lit(-1)).cast("int").alias("fold"))
        named = named.where("x IS NOT NULL AND label IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
        self.spark, self.rows = df.sparkSession, named
        # classes and folds are few; their counts are all that the driver needs
        counts = named.groupBy("label", "fold").count().collect()
        self.classes = np.array(sorted({r["label"] for r in counts}))
        self.folds = sorted({r["fold"] for r in counts})
        self.size = {(int(np.searchsorted(self.classes, r["label"])), r["fold"]): r["count"] for r in counts}
        first = named.select(F.size("x").alias("d")).first()
        self.input_dim = first["d"] if first else 0

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()

    def summed(self, run, size: int) -> np.ndarray:
        """Sum over the tasks of the vector that ``run`` makes of a task's (x, class, fold)."""
        if not self.size or not size:
            return np.zeros(size)
        dim, classes = self.input_dim, self.classes

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for part in _matrices(batches, dim, classes):
                run(total, *part)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

        sums = self.rows.mapInArrow(work, "v array<double>").select(Summarizer.sum(array_to_vector("v")).alias("v"))
        return sums.first()["v"].toArray()


def _matrices(batches, dim: int, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            yield (x, np.searchsorted(classes, batch.column(1).to_numpy(zero_copy_only=False)),
                   batch.column(2).to_numpy(zero_copy_only=False))


def _curvatures(rows: Rows, maps: list[FeatureMap], by_class: bool) -> list[np.ndarray]:
    """Per map: sums of z z' (of each class, or of all rows as one group), one pass."""
    groups = len(rows.classes) if by_class else 1
    shapes = [(groups, m.width, m.width) for m in maps]
    starts = np.concatenate([[0], np.cumsum([int(np.prod(s)) for s in shapes])])

    def run(total, x, y, fold):
        for m, lo, hi, shape in zip(maps, starts, starts[1:], shapes):
            z, part = m(x), total[lo:hi].reshape(shape)
            for g in range(groups):
                own = z[y == g] if by_class else z
                part[g] += own.T @ own

    total = rows.summed(run, int(starts[-1]))
    return [total[lo:hi].reshape(s) for lo, hi, s in zip(starts, starts[1:], shapes)]


def fit(rows: Rows, machines: Machines, tol: float = 1e-4, max_passes: int = 1000) -> Fitted:
    """Weights of every machine at a relative duality gap of at most ``tol``.
    ``max_passes`` is a guard: where it ends a fit, the gap returned says how far it got."""
    count, by_class = len(machines.of_map), bool((machines.code == 0).any())
    n = np.array([sum(c for (k, f), c in rows.size.items() if machines.code[k, m] and f != machines.left_out[m])
                  for m in range(count)], float)
    n = np.maximum(n, 1.0)
    ridge = 1.0 / (machines.cost * n)
    # eigenvectors and eigenvalues of each machine's curvature bound
    bases: list[tuple[np.ndarray, np.ndarray]] = [None] * count
    shared: dict[tuple, tuple] = {}
    moments = _curvatures(rows, machines.maps, by_class)
    for m in range(count):
        used = tuple(np.flatnonzero(machines.code[:, m])) if by_class else (0,)
        key = (int(machines.of_map[m]), used)
        if key not in shared:
            value, vector = np.linalg.eigh(moments[key[0]][list(used)].sum(0))
            shared[key] = np.maximum(value, 0.0), vector
        bases[m] = shared[key]
    w = [np.zeros(machines.maps[k].width) for k in machines.of_map]
    ahead, momentum = [x.copy() for x in w], np.ones(count)
    gap, steps, open_ = np.full(count, math.inf), np.zeros(count, int), list(range(count))
    for passes in range(1, max_passes + 1 if count else 1):
        sums = _slacks(rows, machines, open_, ahead)
        still = []
        for m, (v, s1, s2) in zip(open_, sums):
            at, lam = ahead[m], ridge[m]
            v = 2.0 * v / n[m]
            primal = lam / 2 * at @ at + s2 / n[m]
            dual = (2.0 * s1 - s2) / n[m] - v @ v / (2 * lam)
            gap[m], steps[m] = (primal - dual) / max(primal, 1e-300), passes
            if gap[m] <= tol or passes == max_passes:
                w[m] = at
                continue
            slope = lam * at - v
            value, vector = bases[m]
            new = at - vector @ ((vector.T @ slope) / (lam + 2.0 / n[m] * value))
            if slope @ (new - w[m]) > 0:  # the momentum points uphill
                momentum[m] = 1.0
            grown = (1 + math.sqrt(1 + 4 * momentum[m] ** 2)) / 2
            ahead[m] = new + (momentum[m] - 1) / grown * (new - w[m])
            w[m], momentum[m] = new, grown
            still.append(m)
        open_ = still
        if not open_:
            break
    return Fitted(w, gap, steps)


def _slacks(rows: Rows, machines: Machines, open_: Sequence[int], at: list[np.ndarray]) -> list[tuple]:
    """(sum of code * slack * z, sum of slacks, sum of squared slacks) of each open machine."""
    groups = []
    place = 0
    for k, fmap in enumerate(machines.maps):
        own = [m for m in open_ if machines.of_map[m] == k]
        if own:
            groups.append((fmap, np.column_stack([at[m] for m in own]), machines.code[:, own],
                           machines.left_out[own], place, own))
            place += (fmap.width + 2) * len(own)

    def run(total, x, y, fold):
        for fmap, weights, code, left_out, begin, own in groups:
            z, sign = fmap(x), code[y]
            sign = sign * (fold[:, None] != left_out[None, :])
            slack = np.maximum(0.0, 1.0 - sign * (z @ weights)) * (sign != 0)
            part = total[begin:begin + (fmap.width + 2) * len(own)].reshape(fmap.width + 2, len(own))
            part[:-2] += z.T @ (sign * slack)
            part[-2] += slack.sum(0)
            part[-1] += (slack * slack).sum(0)

    total = rows.summed(run, place)
    found = {}
    for fmap, _, _, _, begin, own in groups:
        part = total[begin:begin + (fmap.width + 2) * len(own)].reshape(fmap.width + 2, len(own))
        found |= {m: (part[:-2, j], part[-2, j], part[-1, j]) for j, m in enumerate(own)}
    return [found[m] for m in open_]


# ------------------------------------------------------------ one classifier
@dataclass
class PairwiseModel:
    """Machines of all class pairs; a row's class is the one with most votes, the least of equals."""
    fmap: FeatureMap
    classes: np.ndarray
    weights: np.ndarray     # features x pairs
    gap: float
    steps: int

    def votes(self, x: np.ndarray) -> np.ndarray:
        code = one_against_one(len(self.classes))
        score = self.fmap(x) @ self.weights
        return (score > 0) @ (code.T > 0).astype(float) + (score <= 0) @ (code.T < 0).astype(float)

    def predict(self, df: DataFrame, x_col: str, keep: Sequence[str], out: str = "prediction") -> DataFrame:
        """(keep..., out): the class of every row with a vector, one projection per Arrow batch."""
        ship_package(df.sparkSession)
        model = self

        @F.pandas_udf("double")
        def judge(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, model.fmap.input_dim))
            return pd.Series(model.classes[model.votes(rows).argmax(1)])

        rows = df.where(F.col(x_col).isNotNull())
        return rows.select(*keep, judge(F.transform(F.col(x_col), lambda v: v.cast("double"))).alias(out))


def fit_pairwise(df: DataFrame, label: str, x_col: str, cost: float = 1.0, sigma: float | None = None, dim: int = 256,
                 seed: int = 7, tol: float = 1e-4) -> PairwiseModel:
    """One machine for every pair of classes, all fitted together; linear, or RBF of width ``sigma``."""
    with Rows(df, label, x_col) as rows:
        fmap = FeatureMap(rows.input_dim, sigma, dim, seed)
        code = one_against_one(len(rows.classes))
        pairs = code.shape[1]
        done = fit(rows, Machines([fmap], np.zeros(pairs, int), code, np.full(pairs, -2), np.full(pairs, float(cost))), tol)
        weights = np.column_stack(done.weights) if pairs else np.zeros((fmap.width, 0))
        return PairwiseModel(fmap, rows.classes, weights, float(done.gap.max(initial=0.0)), int(done.steps.max(initial=0)))


def cv_grid(df: DataFrame, label: str, x_col: str, key: str, sigmas: Sequence[float], costs: Sequence[float],
            folds: int = 5, dim: int = 256, seed: int = 7, tol: float = 1e-3) -> DataFrame:
    """Grid search of the RBF machine: (sigma, cost, cv_accuracy, best, gap, steps) for
    every pair, by ``folds``-fold cross-validation with folds from a hash of ``key``.

    All machines -- every width, cost, fold and class against the rest -- are fitted
    together; ``gap`` is the largest relative duality gap among a pair's machines and
    ``steps`` the passes that the slowest took."""
    with Rows(df, label, x_col, F.pmod(F.xxhash64(key), F.lit(folds))) as rows:
        k = len(rows.classes)
        maps = [FeatureMap(rows.input_dim, float(s), dim, seed) for s in sigmas]
        shape = (len(maps), folds, len(costs), k)
        s, f, c, cls = (i.ravel() for i in np.indices(shape))
        machines = Machines(maps, s, one_against_rest(k)[:, cls] if k else np.zeros((0, 0)), f, np.array(costs, float)[c])
        done = fit(rows, machines, tol)
        weights = [np.array([done.weights[i] for i in np.flatnonzero(s == j)]).T for j in range(len(maps))]
        cells = (len(maps), folds, len(costs))

        def judge(total, x, y, fold):
            right = total.reshape(cells)
            for j, m in enumerate(maps):
                score = (m(x) @ weights[j]).reshape(len(x), *shape[1:])[np.arange(len(x)), fold]
                np.add.at(right[j], fold, score.argmax(axis=2) == y[:, None])

        hit = rows.summed(judge, int(np.prod(cells))).reshape(cells) if k else np.zeros(cells)
        size = {x: sum(n for (_, f_), n in rows.size.items() if f_ == x) for x in rows.folds}
    there = sorted(size)
    mean = np.mean([hit[:, x] / size[x] for x in there], axis=0) if there else hit[:, 0]
    gaps, steps = (a.reshape(shape).max(axis=(1, 3)) if k else np.zeros(mean.shape) for a in (done.gap, done.steps))
    best = mean.max(initial=0.0)
    out = [(float(sg), float(co), float(mean[i, j]), bool(mean[i, j] == best), float(gaps[i, j]), int(steps[i, j]))
           for i, sg in enumerate(sigmas) for j, co in enumerate(costs)]
    return df.sparkSession.createDataFrame(
        out, "sigma double, cost double, cv_accuracy double, best boolean, gap double, steps int")
