"""Least squares for many small groups at once.

The data are reduced to what least squares needs of each group: triangular factors of
[X, y] that tasks make and merge (``factors``), or the sums n, X'X, X'y, y'y of a plain
``groupBy().agg`` (``normal_equations``) where many sub-models share them.  A group with
billions of rows costs one small row per task, and only such rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import ship_package


#: groups whose factors a task holds before it sends them on
GROUPS_AT_ONCE = 20_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_equations(df: DataFrame, groups: Sequence[str], y: str, xcols: Sequence[str],
                     weight: str | None = None) -> DataFrame:
    """(groups..., n, xtx array (row-major k*k), xty array, yy) per group; rows with a NULL
    in y or any x are left out."""
    k = len(xcols)
    ok = F.col(y).isNotNull()
    for x in xcols:
        ok = ok & F.col(x).isNotNull()
    data = df.filter(ok)
    w = F.col(weight) if weight else F.lit(1.0)
    xx = [F.sum(w * F.col(xcols[i]) * F.col(xcols[j])) for i in range(k) for j in range(k)]
    xy = [F.sum(w * F.col(xcols[i]) * F.col(y)) for i in range(k)]
    return data.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.array(*xx).alias("xtx"), F.array(*xy).alias("xty"),
        F.sum(w * F.col(y) * F.col(y)).alias("yy"), F.sum(w).alias("sw"))


def solve(A: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(A, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(A, b, rcond=None)[0]


def ols_from_sums(n: float, xtx: np.ndarray, xty: np.ndarray, yy: float):
    """Coefficients, standard errors, RSS and sigma^2 from the normal equations."""
    k = len(xty)
    beta = solve(xtx, xty)
    rss = float(yy - 2 * beta @ xty + beta @ xtx @ beta)
    rss = max(rss, 0.0)
    dof = n - k
    sigma2 = rss / dof if dof > 0 else float("nan")
    try:
        inv = np.linalg.inv(xtx)
        se = np.sqrt(np.maximum(np.diag(inv) * sigma2, 0.0))
    except np.linalg.LinAlgError:
        se = np.full(k, np.nan)
    return beta, se, rss, sigma2


def _reduced(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of the rows: what least squares needs of them."""
    return rows if len(rows) <= 1 else np.linalg.qr(rows, mode="r")


def factors(df: DataFrame, groups: Sequence[str], y: str, xcols: Sequence[str], weight: str | None = None) -> DataFrame:
    """(groups..., n, r): the triangular factor of [X, y] of each group, row by row.

    A task factors the rows of a group as they come in and keeps one (k + 1) x (k + 1)
    factor for each; the factors of a group are stacked and factored again where they
    meet.  Unlike X'X, a factor does not square the condition of the design.  Rows with a
    NULL in y or any x are left out; a group of any size sends one factor per task."""
    ship_package(df.sparkSession)
    k, g = len(xcols) + 1, len(groups)
    ok = F.col(y).isNotNull()
    for x in xcols:
        ok = ok & F.col(x).isNotNull()
    root = F.sqrt(F.col(weight)) if weight else F.lit(1.0)
    # groups may carry any names: positions stand for them
    data = df.filter(ok).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)],
                                F.array(*[(root * F.col(c)).cast("double") for c in [*xcols, y]]).alias("_row"))
    names = [f"_g{i}" for i in range(g)]
    fields = [T.StructField(c, df.schema[o].dataType) for c, o in zip(names, groups)]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("r", T.ArrayType(T.DoubleType()))])

    def batch_of(held: dict, batch_schema: pa.Schema) -> pa.RecordBatch:
        keys = list(held)
        columns = [pa.array([key[i] for key in keys], batch_schema.field(i).type) for i in range(g)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([held[key][0] for key in keys], pa.int64()),
             pa.array([held[key][1].ravel().tolist() for key in keys], pa.list_(pa.float64()))], [*names, "n", "r"])

    def local(batches):
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(g).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            codes = np.zeros(batch.num_rows, np.int64)
            keys: list[tuple] = [()]
            for i in range(g):
                coded = batch.column(i).dictionary_encode()
                values = [*coded.dictionary.to_pylist(), None]
                part = coded.indices.fill_null(len(values) - 1).to_numpy().astype(np.int64)
                pair = codes * len(values) + part
                used, codes = np.unique(pair, return_inverse=True)
                keys = [(*keys[u // len(values)], values[u % len(values)]) for u in used.tolist()]
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(keys)))
            for key, lo, hi in zip(keys, [0, *ends.tolist()], ends.tolist()):
                own = rows[order[lo:hi]]
                n, before = held.get(key, (0, own[:0]))
                held[key] = (n + len(own), _reduced(np.vstack([before, own])))
            if len(held) > GROUPS_AT_ONCE:
                yield batch_of(held, batch.schema)
                held = {}
        if held:
            yield batch_of(held, batch.schema)

    def merged(batches):
        key, n, total, last = None, 0, None, None
        for batch in batches:
            last = batch.schema
            columns = [batch.column(i).to_pylist() for i in range(g + 2)]
            for *now, count, r in zip(*columns):
                r = np.array(r, float).reshape(-1, k)
                if total is not None and tuple(now) == key:
                    n, total = n + count, _reduced(np.vstack([total, r]))
                    continue
                if total is not None:
                    yield batch_of({key: (n, total)}, last)
                key, n, total = tuple(now), count, r
        if total is not None:
            yield batch_of({key: (n, total)}, last)

    parts = data.mapInArrow(local, schema)
    dealt = parts.repartition(*names).sortWithinPartitions(*names) if g else parts.repartition(1)  # one small row per task
    out = dealt.mapInArrow(merged, schema)
    return out.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(groups)], "n", "r")


def solve_factor(n: int, r: np.ndarray):
    """Coefficients, standard errors, RSS and sigma^2 from the factor of [X, y]."""
    k = r.shape[1] - 1
    r = np.vstack([r, np.zeros((max(0, k + 1 - len(r)), k + 1))])
    top, right = r[:k, :k], r[:k, k]
    size = np.abs(np.diag(top))
    if k and size.min() > 1e-13 * max(size.max(), 1e-300):
        beta, inverse = np.linalg.solve(top, right), np.linalg.inv(top)
        rss = float((r[k:, k] ** 2).sum())
        var = (inverse ** 2).sum(axis=1)
    else:  # a column is a combination of others: least norm, no standard errors
        beta = np.linalg.lstsq(top, right, rcond=None)[0]
        rss = float(((top @ beta - right) ** 2).sum() + (r[k:, k] ** 2).sum())
        var = np.full(k, np.nan)
    sigma2 = rss / (n - k) if n > k else float("nan")
    return beta, np.sqrt(np.maximum(var * sigma2, 0.0)) if n > k else np.full(k, np.nan), rss, sigma2


def grouped_ols(df: DataFrame, groups: Sequence[str], y: str, xcols: Sequence[str],
                weight: str | None = None) -> DataFrame:
    """(groups..., n, coef array, se array, rss, sigma2): one OLS per group, from triangular factors."""
    rows = factors(df, groups, y, xcols, weight)
    k = len(xcols) + 1
    gfields = [f for f in rows.schema.fields if f.name in groups]
    schema = T.StructType(gfields + [
        T.StructField("n", T.LongType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("se", T.ArrayType(T.DoubleType())), T.StructField("rss", T.DoubleType()),
        T.StructField("sigma2", T.DoubleType())])

    def fit(batches):
        for pdf in batches:
            out = {g: pdf[g].values for g in groups}
            coefs, ses, rsss, s2s = [], [], [], []
            for n, r in zip(pdf["n"], pdf["r"]):
                beta, se, rss, s2 = solve_factor(int(n), np.asarray(r, dtype=float).reshape(-1, k))
                coefs.append(beta.tolist()); ses.append(se.tolist()); rsss.append(rss); s2s.append(s2)
            out.update(n=pdf["n"].astype("int64").values, coef=coefs, se=ses, rss=rsss, sigma2=s2s)
            yield pd.DataFrame(out)

    return rows.mapInPandas(fit, schema)


def linear_predict(coef: Column, xs: Sequence[Column]) -> Column:
    """sum_i coef[i] * x_i as a column expression."""
    total = F.lit(0.0)
    for i, x in enumerate(xs):
        total = total + F.element_at(coef, i + 1) * x
    return total
