"""Logistic regressions: many candidate models fitted together.

A fit is iteratively reweighted least squares.  All candidates of a search step
share the passes over the rows: in one pass a task adds up, for every candidate
still moving, its information matrix, score and log-likelihood as one vector;
Spark sums the vectors and the driver takes k x k Newton steps.  A candidate that
has converged leaves the passes.  The information matrix of a fit gives its
standard errors and its VIFs without another pass.

Rows with a NULL or NaN in the label, the weight or any of the features are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import sigmoid
from quire.operators.ols import solve
from quire.session import ship_package, spread

#: rows that a task turns into matrices at once
ROWS_AT_ONCE = 4096


@dataclass
class LogitFit:
    features: list[str]
    coef: list[float]          # intercept first
    se: list[float]
    z: list[float]
    p: list[float]
    aic: float
    converged: bool = True
    iterations: int = 0
    information: np.ndarray = field(default=None, repr=False)

    def table(self, spark) -> DataFrame:
        names = ["(Intercept)"] + self.features
        rows = [(n, float(b), float(s), float(zv), float(pv)) for n, b, s, zv, pv in
                zip(names, self.coef, self.se, self.z, self.p)]
        return spark.createDataFrame(
            rows, "term string, estimate double, std_error double, z_value double, p_value double")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, w, x) as blocks: y of all rows, then w, then x row by row."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            cells = [c.to_numpy(zero_copy_only=False) for c in (batch.column(0), batch.column(1), batch.column(2).flatten())]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()),
                                              pa.array([np.concatenate(cells).tobytes()], pa.binary())], ["n", "block"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(y, w, x) of each block of ``LogitData.rows``."""
    for batch in batches:
        for n, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            cells = np.frombuffer(block.as_buffer())
            yield cells[:n], cells[n:2 * n], cells[2 * n:].reshape(n, -1)


class LogitData:
    """Rows (y, w, [1, features...]) kept in memory or on disk for the passes of a search,
    as blocks of doubles that a pass reads without converting them."""

    def __init__(self, df: DataFrame, label: str, features: Sequence[str], weight: str | None = None):
        ship_package(df.sparkSession)
        self.features = list(features)
        col = lambda c: F.col(f"`{c}`").cast("double")
        rows = df.select(col(label).alias("y"), (col(weight) if weight else F.lit(1.0)).alias("w"),
                         F.array(F.lit(1.0), *[col(f) for f in self.features]).alias("x"))
        there = F.col("y").isNotNull() & F.col("w").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
        self.rows = spread(rows.where(there)).mapInArrow(_packed, "n long, block binary") \
            .persist(StorageLevel.MEMORY_AND_DISK)
        self.n = self.rows.agg(F.sum("n").alias("n")).first()["n"] or 0

    def __enter__(self) -> LogitData:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()

    def columns_of(self, features: Sequence[str]) -> list[int]:
        return [0, *[1 + self.features.index(f) for f in features]]

    def moments(self, columns: Sequence[Sequence[int]], betas: Sequence[np.ndarray]) -> list[tuple]:
        """(information, score, log-likelihood) of each candidate at its coefficients: one pass."""
        sizes = [len(c) for c in columns]
        beta = np.zeros((1 + len(self.features), len(columns)))
        for j, (c, b) in enumerate(zip(columns, betas)):
            beta[c, j] = b

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(k * k + k + 1 for k in sizes))
            for y, w, x in blocks(batches):
                eta = x @ beta
                mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                like = w @ (y[:, None] * eta - np.logaddexp(0.0, eta))
                slope = w[:, None] * (y[:, None] - mu)
                curve = w[:, None] * mu * (1.0 - mu)
                place = 0
                for j, c in enumerate(columns):
                    own, k = x[:, c], len(c)
                    total[place:place + k * k] += ((own * curve[:, j:j + 1]).T @ own).ravel()
                    total[place + k * k:place + k * k + k] += own.T @ slope[:, j]
                    total[place + k * k + k] += like[j]
                    place += k * k + k + 1
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["m"])

        total, out, place = np.zeros(sum(k * k + k + 1 for k in sizes)), [], 0
        if self.n:
            sums = self.rows.mapInArrow(run, "m array<double>").select(Summarizer.sum(array_to_vector("m")).alias("m"))
            total = sums.first()["m"].toArray()
        for k in sizes:
            out.append((total[place:place + k * k].reshape(k, k), total[place + k * k:place + k * k + k],
                        float(total[place + k * k + k])))
            place += k * k + k + 1
        return out

    def fit(self, candidates: Sequence[Sequence[str]], starts: Sequence[np.ndarray] | None = None,
            max_iter: int = 25, tol: float = 1e-8) -> list[LogitFit]:
        """Binomial fits of all candidates (R ``glm(family = binomial)``): Newton steps,
        halved while the likelihood falls, until a step is below ``tol`` standard errors;
        ``max_iter`` passes at most, and ``converged`` says whether that was enough."""
        columns = [self.columns_of(c) for c in candidates]
        beta = [np.zeros(len(c)) if starts is None else np.array(starts[j], float) for j, c in enumerate(columns)]
        last: list[tuple | None] = [None] * len(columns)   # coefficients and likelihood of the last accepted point
        out: list[LogitFit | None] = [None] * len(columns)
        for iteration in range(1, max_iter + 1):
            open_ = [j for j in range(len(columns)) if out[j] is None]
            if not open_:
                break
            for j, (info, score, like) in zip(open_, self.moments([columns[j] for j in open_], [beta[j] for j in open_])):
                here = beta[j]
                if last[j] is not None and not like >= last[j][1] - 1e-9 * abs(last[j][1]) and iteration < max_iter:
                    beta[j] = (here + last[j][0]) / 2
                    continue
                step = solve(info, score)
                done = math.sqrt(max(float(score @ step), 0.0)) <= tol
                last[j], beta[j] = (here, like), here + step
                if done or iteration == max_iter:
                    out[j] = _described(list(candidates[j]), beta[j] if done else here, info, like, done, iteration)
        return out


def _described(features: list[str], beta: np.ndarray, info: np.ndarray, like: float, converged: bool,
               iterations: int) -> LogitFit:
    try:
        var = np.diag(np.linalg.inv(info))
    except np.linalg.LinAlgError:
        var = np.full(len(beta), math.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        se = np.sqrt(np.where(var > 0, var, math.nan))
        z = beta / se
    p = [math.erfc(abs(v) / math.sqrt(2)) if v == v else math.nan for v in z.tolist()]
    return LogitFit(features, beta.tolist(), se.tolist(), z.tolist(), p, -2 * like + 2 * len(beta), converged,
                    iterations, info)


def logit_fit(df: DataFrame, label: str, features: Sequence[str], weight: str | None = None,
              max_iter: int = 25) -> LogitFit:
    """One binomial fit with Wald statistics and AIC."""
    with LogitData(df, label, features, weight) as data:
        return data.fit([list(features)], max_iter=max_iter)[0]


def logit_predict_expr(intercept: float, coef: dict[str, float]) -> Column:
    """Probability from fixed coefficients as a codegen'd expression (no model object)."""
    z = F.lit(float(intercept))
    for c, b in coef.items():
        z = z + F.lit(float(b)) * F.col(c)
    return sigmoid(z)


def score_with(fit: LogitFit, df: DataFrame, out: str = "prob") -> DataFrame:
    return df.withColumn(out, logit_predict_expr(fit.coef[0], dict(zip(fit.features, fit.coef[1:]))))


def _moved(fit: LogitFit, features: Sequence[str]) -> np.ndarray:
    """Starting coefficients of a neighbouring model: those of ``fit``, 0 for a new term."""
    known = dict(zip(fit.features, fit.coef[1:]))
    return np.array([fit.coef[0], *[known.get(f, 0.0) for f in features]])


def stepwise_aic(df: DataFrame, label: str, features: Sequence[str], weight: str | None = None,
                 start: Sequence[str] | None = None) -> tuple[LogitFit, DataFrame]:
    """Both-direction stepwise selection by AIC (MASS ``stepAIC``), starting from the
    full model.  All candidates of a step are fitted together, from the coefficients
    of the step before."""
    with LogitData(df, label, features, weight) as data:
        current = list(start if start is not None else features)
        best = data.fit([current])[0]
        trace = [(0, "<start>", best.aic, ",".join(current))]
        while True:  # every step lowers the AIC, so no set of terms comes twice
            moves = [("-" + f, [x for x in current if x != f]) for f in current if len(current) > 1]
            moves += [("+" + f, current + [f]) for f in features if f not in current]
            if not moves:
                break
            fits = data.fit([m for _, m in moves], [_moved(best, m) for _, m in moves])
            (move, _), fit = min(zip(moves, fits), key=lambda x: x[1].aic)
            if not fit.aic < best.aic - 1e-9:
                break
            best, current = fit, fit.features
            trace.append((len(trace), move, best.aic, ",".join(current)))
    return best, df.sparkSession.createDataFrame(trace, "step int, move string, aic double, terms string")


def vifs(fit: LogitFit) -> dict[str, float]:
    """VIF of each term: diagonal of the inverse of the correlation matrix derived from
    the coefficient covariance (X'WX)^-1 with weights w * mu * (1 - mu)."""
    if len(fit.features) < 2:
        return dict.fromkeys(fit.features, 1.0)
    cov = np.linalg.inv(fit.information)[1:, 1:]
    d = np.sqrt(np.diag(cov))
    return dict(zip(fit.features, np.diag(np.linalg.inv(cov / np.outer(d, d))).tolist()))


def vif_table(df: DataFrame, fit: LogitFit) -> DataFrame:
    """(term, vif, p_value) of a fitted logit."""
    p = dict(zip(fit.features, fit.p[1:]))
    return df.sparkSession.createDataFrame([(f, float(v), float(p[f])) for f, v in vifs(fit).items()],
                                           "term string, vif double, p_value double")


def backward_eliminate(df: DataFrame, label: str, features: Sequence[str], weight: str | None = None,
                       vif_max: float = 2.0, p_max: float = 0.05) -> tuple[LogitFit, DataFrame]:
    """Drop terms one at a time: first the least significant among those with VIF above
    ``vif_max`` (when it is not significant), otherwise the term with the largest
    p-value above ``p_max``; stop when every term passes."""
    log = []
    with LogitData(df, label, features, weight) as data:
        fit = data.fit([list(features)])[0]
        while True:  # every round drops a term
            found, pvals = vifs(fit), dict(zip(fit.features, fit.p[1:]))
            high = [f for f in fit.features if found[f] > vif_max and pvals[f] > p_max]
            if high:
                drop, why = max(high, key=lambda f: (pvals[f], found[f])), "vif"
            else:
                weak = [f for f in fit.features if pvals[f] > p_max]
                if not weak or len(fit.features) == 1:
                    break
                drop, why = max(weak, key=lambda f: pvals[f]), "p_value"
            log.append((len(log) + 1, drop, why, float(found[drop]), float(pvals[drop])))
            left = [f for f in fit.features if f != drop]
            fit = data.fit([left], [_moved(fit, left)])[0]
    return fit, df.sparkSession.createDataFrame(
        log, "round int, dropped string, reason string, vif double, p_value double")
