"""Principal components by randomised block iteration, without a p x p aggregate.

One pass multiplies the centred second-moment matrix with a block of vectors: a task
returns X'(X V) for its rows.  Starting from a Gaussian sketch, each pass adds the
residuals of the current components to the basis, so components converge like those
of a block Lanczos iteration; they are done when every residual is small against the
largest variance.  The small factorisations run on the driver, on p x (basis) numbers.
"""

from __future__ import annotations

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

#: blocks that the basis may hold before it is cut back to the best two
MOST_BLOCKS = 8


@dataclass
class PcaModel:
    components: np.ndarray      # p x k, largest entry of each positive
    variance: np.ndarray        # of each component, divisor n - 1
    total: float                # sum of all variances
    residual: float             # largest residual against the largest variance
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.variance / self.total if self.total > 0 else np.zeros(len(self.variance))


def pca_fit(df: DataFrame, x_col: str, k: int, tol: float = 1e-9, oversample: int = 10, seed: int = 7,
            max_passes: int = 200) -> PcaModel:
    """The first ``k`` components of an array column; rows with a NULL in it are left out.
    ``max_passes`` is a guard; ``residual`` says how far it got."""
    ship_package(df.sparkSession)
    rows = df.select(F.transform(F.col(x_col), lambda v: v.cast("double")).alias("x"))
    rows = rows.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = rows.select(F.size("x").alias("p")).first()
        if first is None:
            return PcaModel(np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
        p = first["p"]
        k = min(k, p)
        head = _summed(rows, p, lambda x: np.concatenate([[len(x)], x.sum(0)]), 1 + p)
        n, mean = head[0], head[1:] / head[0]
        total = _summed(rows, p, lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0]

        def times(v: np.ndarray) -> np.ndarray:
            def product(x):
                x = x - mean
                return (x.T @ (x @ v)).ravel()
            return _summed(rows, p, product, v.size).reshape(v.shape)

        width = min(p, k + oversample)
        block = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))[0]
        basis, image = np.zeros((p, 0)), np.zeros((p, 0))
        for passes in range(1, max_passes + 1):
            basis, image = np.hstack([basis, block]), np.hstack([image, times(block)])
            value, vector = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
            value, vector = value[::-1], vector[:, ::-1]
            ritz, moved = basis @ vector[:, :width], image @ vector[:, :width]
            left = moved - ritz * value[:width]
            worst = float(np.linalg.norm(left[:, :k], axis=0).max())
            if worst <= tol * max(value[0], 1e-300) or basis.shape[1] >= p:
                break
            if basis.shape[1] + width > MOST_BLOCKS * width:
                keep = vector[:, :2 * width]
                basis, image = basis @ keep, image @ keep
            # new directions: residuals, freed of what the basis holds (twice, for rounding)
            for _ in range(2):
                left = left - basis @ (basis.T @ left)
            block, r = np.linalg.qr(left)
            block = block[:, np.abs(np.diag(r)) > 1e-14 * max(value[0], 1e-300)]
            block = block[:, :p - basis.shape[1]]
            if not block.shape[1]:
                break
    finally:
        rows.unpersist()
    components = ritz[:, :k]
    sign = np.sign(components[np.abs(components).argmax(0), np.arange(k)])
    return PcaModel(components * np.where(sign == 0, 1, sign), np.maximum(value[:k], 0) / max(n - 1, 1), total / max(n - 1, 1),
                    worst / max(value[0], 1e-300), passes)


def _summed(rows: DataFrame, p: int, run, size: int) -> np.ndarray:
    """Sum over all rows of ``run(x)``, x being a matrix of some of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += run(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    sums = rows.mapInArrow(work, "v array<double>").select(Summarizer.sum(array_to_vector("v")).alias("v"))
    return sums.first()["v"].toArray()


def pca_variance(model: PcaModel, spark) -> DataFrame:
    """(component, explained, cumulative): shares of the total variance."""
    rows = [(i + 1, float(e), float(c)) for i, (e, c) in enumerate(zip(model.explained, np.cumsum(model.explained)))]
    return spark.createDataFrame(rows, "component int, explained double, cumulative double")


def pca_project(model: PcaModel, df: DataFrame, x_col: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., pcs): each row's array times the components."""
    ship_package(df.sparkSession)
    components = model.components

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(x.to_numpy()).astype(float) @ components))

    return df.where(F.col(x_col).isNotNull()).select(
        *keep, project(F.transform(F.col(x_col), lambda v: v.cast("double"))).alias("pcs"))
