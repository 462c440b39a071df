"""Many time series at once, keyed by ``series_id`` in long form (series_id, t, value).

Per-series work is either (a) lags, leads and running sums over windows of
(series, block of time), so that a very long series is spread over many tasks,
or (b) a grouped sum of small design products (normal equations) followed by a
k x k solve on the aggregated rows.  Results that are model-sized (coefficients,
chosen orders, ACF lists) are the only things handled per series in Python.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.blocks import Block, lags_of, map_blocks, sum_arrays
from quire.operators.ols import grouped_ols, linear_predict, normal_equations, ols_from_sums
from quire.session import checkpoint_dir, ship_package


def monthly_index(df: DataFrame, keys: Sequence[str], period: str,
                  measures: Mapping[str, Column], sep: str = "_") -> DataFrame:
    """Aggregate each measure per (keys, period), stack the measures, and number
    the periods of each series 1..n (K1).  Output: series_id, <period>, t, value.
    The numbering window sees one row per (series, period): bounded by the calendar."""
    agg = df.groupBy(*keys, period).agg(*[c.cast("double").alias(m) for m, c in measures.items()])
    seg = F.concat_ws(sep, *keys) if len(keys) > 1 else F.col(keys[0])
    long = agg.select(seg.alias("_seg"), period, *measures.keys()).unpivot(
        ["_seg", period], list(measures.keys()), "measure", "value")
    long = long.select(F.concat_ws("|", "_seg", "measure").alias("series_id"), period, "value")
    w = Window.partitionBy("series_id").orderBy(period)
    return long.withColumn("t", F.row_number().over(w).cast("long")).select("series_id", period, "t", "value")


# ----------------------------------------------------------------- helpers
SERIES, TIME, VALUE = "series_id", "t", "value"

# Fixed values (public tables used by the usual R tests):
# KPSS level-stationarity critical values and their p-values.
KPSS_LEVEL_CRIT = [0.347, 0.463, 0.574, 0.739]
KPSS_LEVEL_P = [0.10, 0.05, 0.025, 0.01]
# Augmented Dickey-Fuller (constant + trend) critical values by sample size,
# one list per p-value column, rows for T = 25, 50, 100, 250, 500, 100000.
ADF_T = [25, 50, 100, 250, 500, 100000]
ADF_P = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
ADF_CRIT = [
    [-4.38, -4.15, -4.04, -3.99, -3.98, -3.96],
    [-3.95, -3.80, -3.73, -3.69, -3.68, -3.66],
    [-3.60, -3.50, -3.45, -3.43, -3.42, -3.41],
    [-3.24, -3.18, -3.15, -3.13, -3.13, -3.12],
    [-1.14, -1.19, -1.22, -1.23, -1.24, -1.25],
    [-0.80, -0.87, -0.90, -0.92, -0.93, -0.94],
    [-0.50, -0.58, -0.62, -0.64, -0.65, -0.66],
    [-0.15, -0.24, -0.28, -0.31, -0.32, -0.33],
]


def _wall(series: str = SERIES):
    return Window.partitionBy(series)


def per_series(df: DataFrame, series: str = SERIES, **aggs: Column) -> DataFrame:
    """Attach per-series aggregates (n, max t, mean, ...) by a grouped aggregate and a
    join on the series key -- no window holds a whole series."""
    stats = df.groupBy(series).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, series)


# Time steps of a series that one window holds.
BLOCK_STEPS = 4096


def lagged(df: DataFrame, value: str, lags: Sequence[int], series: str = SERIES, t: str = TIME,
           prefix: str = "_lag") -> DataFrame:
    """Add ``<prefix><k>`` = value at time t - k (k may be negative: a lead) for every k;
    NULL where the series has no such time.

    A series is cut into blocks of time; rows near an edge are copied into the
    blocks that look at them, and windows run over (series, block), so a very long
    series is spread over many tasks with one shuffle whatever the lags."""
    name = lambda k: f"{prefix}{k}" if k >= 0 else f"{prefix}m{-k}"
    if not lags:
        return df
    steps = max(BLOCK_STEPS, 4 * max(abs(k) for k in lags))
    block = lambda c: F.floor(c / F.lit(steps)).cast("long")
    reach = F.sequence(block(F.col(t) + min(0, *lags)), block(F.col(t) + max(0, *lags)))
    rows = df.withColumn("_own", block(F.col(t))).withColumn("_block", F.explode(reach))
    w = Window.partitionBy(series, "_block").orderBy(t)
    rows = rows.withColumns({name(k): F.max(value).over(w.rangeBetween(-k, -k)) for k in lags})
    return rows.where("_own = _block").drop("_own", "_block")


def running_sum(df: DataFrame, value: str, series: str = SERIES, t: str = TIME, out: str = "_cum") -> DataFrame:
    """Inclusive running sum of ``value`` inside each series ordered by t: a window
    over (series, block of time) plus the totals of the series' earlier blocks."""
    rows = df.withColumn("_block", F.floor(F.col(t) / F.lit(BLOCK_STEPS)).cast("long"))
    totals = rows.groupBy(series, "_block").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(series, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_before"))
    w = Window.partitionBy(series, "_block").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(out, F.sum(value).over(w)).join(totals, [series, "_block"])
    return rows.withColumn(out, F.col("_before") + F.col(out)).drop("_block", "_before")


def with_length(df: DataFrame, series: str = SERIES, out: str = "n") -> DataFrame:
    return per_series(df, series, **{out: F.count(F.lit(1))})


def holdout(df: DataFrame, h: int = 6, series: str = SERIES, t: str = TIME) -> DataFrame:
    """K2: the last ``h`` periods of every series are the test part."""
    out = per_series(df, series, _n=F.max(t))
    return out.withColumn("is_test", F.col(t) > F.col("_n") - h).drop("_n")


def smooth(df: DataFrame, width: int = 1, series: str = SERIES, t: str = TIME, value: str = VALUE,
           out: str = "smoothed") -> DataFrame:
    """K3: centred moving average of 2w+1 points; the first and last w points are
    extended linearly with the first/last inner difference.  ``t`` must run 1..n."""
    w = width
    d = per_series(df, series, _n=F.count(F.lit(1)))
    d = lagged(d, value, list(range(-w, w + 1)), series, t, prefix="_ma")
    cols = [F.col(f"_ma{k}" if k >= 0 else f"_mam{-k}") for k in range(-w, w + 1)]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    inner = F.when((F.col(t) > w) & (F.col(t) <= F.col("_n") - w), total / F.lit(2 * w + 1))
    d = d.withColumn("_in", inner).drop(*[c for c in d.columns if c.startswith("_ma")])
    pick = lambda cond: F.max(F.when(cond, F.col("_in")))
    ends = d.groupBy(series).agg(
        pick(F.col(t) == w + 1).alias("_a1"), pick(F.col(t) == w + 2).alias("_a2"),
        pick(F.col(t) == F.col("_n") - w).alias("_b1"), pick(F.col(t) == F.col("_n") - w - 1).alias("_b2"))
    d = d.join(ends, series)
    left = F.col("_a1") - (F.lit(w + 1) - F.col(t)) * (F.col("_a2") - F.col("_a1"))
    right = F.col("_b1") + (F.col(t) - (F.col("_n") - w)) * (F.col("_b1") - F.col("_b2"))
    res = F.when(F.col(t) <= w, left).when(F.col(t) > F.col("_n") - w, right).otherwise(F.col("_in"))
    return d.withColumn(out, res).drop("_n", "_in", "_a1", "_a2", "_b1", "_b2")


# ----------------------------------------------------------------- trend model
def trend_terms(t: Column, n: Column, spec: str = "sin_poly3") -> dict[str, Column]:
    """Design columns.  Polynomials use the centred/scaled time u = (t - (n+1)/2) / n
    (same fitted values as R's orthogonal ``poly``, well conditioned)."""
    u = (t - (n + 1) / 2.0) / n
    tt = t.cast("double")
    if spec == "sin_poly3":          # y ~ sin(0.5 t) + poly(t, 3)
        return {"x0": F.lit(1.0), "x1": F.sin(tt * 0.5), "x2": u, "x3": u * u, "x4": u * u * u}
    if spec == "cos_poly3_x_sin":    # y ~ cos(0.6 t) + poly(t, 3) * sin(0.19 t)
        s = F.sin(tt * 0.19)
        return {"x0": F.lit(1.0), "x1": F.cos(tt * 0.6), "x2": u, "x3": u * u, "x4": u * u * u, "x5": s,
                "x6": u * s, "x7": u * u * s, "x8": u * u * u * s}
    if spec == "linear":
        return {"x0": F.lit(1.0), "x1": tt}
    raise ValueError(spec)


def trend_fit(train: DataFrame, value: str = "smoothed", spec: str = "sin_poly3",
              series: str = SERIES, t: str = TIME) -> DataFrame:
    """K4: one regression per series on its training rows -> (series, n_train, coef, se, rss)."""
    d = per_series(train, series, n_train=F.max(t))
    terms = trend_terms(F.col(t), F.col("n_train"), spec)
    d = d.withColumns(terms)
    fit = grouped_ols(d, [series], value, list(terms))
    nt = d.groupBy(series).agg(F.max("n_train").alias("n_train"))
    # a fitted model: materialise once (reliable checkpoint) so later plans reuse it
    checkpoint_dir(train.sparkSession)
    return fit.join(nt, series).checkpoint(eager=True)


def trend_predict(df: DataFrame, fit: DataFrame, spec: str = "sin_poly3", series: str = SERIES,
                  t: str = TIME, out: str = "fitted") -> DataFrame:
    """K5: evaluate the fitted design at every t (train: in-sample fit; test: forecast).
    The per-series coefficient rows are joined on the series key."""
    j = df.join(fit.select(series, "coef", "n_train"), series)
    terms = trend_terms(F.col(t), F.col("n_train"), spec)
    return j.withColumn(out, linear_predict(F.col("coef"), list(terms.values()))).drop("coef", "n_train")


# ----------------------------------------------------------------- ACF / PACF
def default_max_lag(df: DataFrame, series: str = SERIES) -> int:
    m = df.groupBy(series).count().agg(F.max("count")).first()[0] or 1
    return max(1, int(math.floor(10 * math.log10(m))))


def _length_and_mean(df: DataFrame, value: str, series: str) -> DataFrame:
    """(series, [rows, mean]) for the blocks of each series."""
    return df.groupBy(series).agg(F.array(F.count(F.lit(1)).cast("double"), F.avg(value)).alias("params"))


def _centred(block: Block) -> np.ndarray:
    """The block's values less the series' mean; no row adds nothing to a product."""
    return np.nan_to_num(block.dense() - (block.params[1] if len(block.params) > 1 else math.nan))


def lag_products(x: np.ndarray, own: int, count: int) -> np.ndarray:
    """sum over the block's own t of x[t] * x[t - k], k = 0..count."""
    out = np.zeros(count + 1)
    for k in range(min(count, len(x) - 1) + 1):
        at = max(own, k)
        out[k] = x[at:] @ x[at - k:len(x) - k]
    return out


def _bartlett_lags(n: float) -> int:
    return int(3 * math.sqrt(n) / 13)


def acf(df: DataFrame, value: str = VALUE, max_lag: int | None = None, series: str = SERIES,
        t: str = TIME) -> DataFrame:
    """K7: (series, lag, acf) for lag 0..min(floor(10 log10 n), n-1); divisor n.
    Products are taken inside blocks of time, so the plan is the same at any lag."""
    ship_package(df.sparkSession)
    K = max_lag or default_max_lag(df, series)

    def run(block: Block):
        n = block.params[0]
        yield lag_products(_centred(block), block.own, int(min(K, math.floor(10 * math.log10(n)), n - 1))), n

    sums = map_blocks(df, [value], K, run, "g array<double>, n double", _length_and_mean(df, value, series), series, t)
    total = sum_arrays(sums, [series, "n"], "g")
    out = total.select(series, F.col("n").cast("long").alias("n"), F.posexplode("g").alias("lag", "_g"),
                       F.col("g")[0].alias("_g0"))
    return out.select(series, "n", "lag", F.try_divide(F.col("_g"), F.col("_g0")).alias("acf"))


def pacf(acf_df: DataFrame, series: str = SERIES) -> DataFrame:
    """K8: partial autocorrelations by Durbin-Levinson on each series' (bounded) ACF list."""
    ship_package(acf_df.sparkSession)
    lists = acf_df.groupBy(series).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("r"))
    gf = [f for f in lists.schema.fields if f.name == series]
    schema = T.StructType(gf + [T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for key, r in zip(pdf[series], pdf["r"]):
                rho = np.array([x["acf"] for x in r], dtype=float)
                K = len(rho) - 1
                phi_prev = np.zeros(0)
                for k in range(1, K + 1):
                    if k == 1:
                        phikk = rho[1]
                        phi = np.array([phikk])
                    else:
                        num = rho[k] - np.dot(phi_prev, rho[k - 1:0:-1])
                        den = 1.0 - np.dot(phi_prev, rho[1:k])
                        phikk = num / den if den != 0 else float("nan")
                        phi = np.append(phi_prev - phikk * phi_prev[::-1], phikk)
                    rows.append((key, k, float(phikk)))
                    phi_prev = phi
            yield pd.DataFrame(rows, columns=[series, "lag", "pacf"]).astype({"lag": "int32"})

    return lists.mapInPandas(run, schema)


def ljung_box(acf_df: DataFrame, series: str = SERIES) -> DataFrame:
    """K12: Q(h) = n(n+2) sum_{k<=h} r_k^2/(n-k) for h = 1..max lag (cumulative over the
    few lag rows of each series)."""
    terms = acf_df.filter(F.col("lag") >= 1).withColumn(
        "_term", F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))
    w = Window.partitionBy(series).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    return terms.select(series, "lag", (F.col("n") * (F.col("n") + 2) * F.sum("_term").over(w)).alias("q"))


def chi2_tails(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Upper tail of the chi-square distribution with integer degrees of freedom, for
    arrays: the finite sum of e^-h h^j / j! (j whole for even k, half-whole for odd),
    one step for all rows at once; NaN without a value or degrees of freedom."""
    h = np.where(x > 0, x, 0.0) / 2.0
    odd = k % 2 == 1
    with np.errstate(divide="ignore", invalid="ignore"):
        erfc = np.array([math.erfc(math.sqrt(v)) if v == v else math.nan for v in np.where(odd, h, 0.0)])
        total = np.where(odd, erfc, np.exp(-h))
        term = np.where(odd, np.exp(-h) * np.sqrt(h) / math.gamma(1.5), np.exp(-h) * h)
        for i in range(1, int(k.max(initial=0)) // 2 + 1):
            # even k adds j = 1 .. k/2 - 1, odd k adds j = 1/2 .. k/2 - 1
            total = total + np.where(np.where(odd, i <= (k - 1) // 2, i <= k // 2 - 1), term, 0.0)
            term = term * h / np.where(odd, i + 0.5, i + 1)
    return np.where(np.isnan(x) | (k <= 0), np.nan, np.where(x <= 0, 1.0, total))


def chi2_sf(x: float, k: int) -> float:
    """``chi2_tails`` of one value."""
    return float(chi2_tails(np.array([math.nan if x is None else x], float), np.array([k]))[0])


def ljung_box_pvalues(lb: DataFrame, fitdf: int = 0) -> DataFrame:
    """Adds the chi-square p-value (df = lag - fitdf) with a vectorised pandas UDF."""
    ship_package(lb.sparkSession)
    @F.pandas_udf(T.DoubleType())
    def sf(q: pd.Series, lag: pd.Series) -> pd.Series:
        return pd.Series(chi2_tails(q.to_numpy(dtype=float), lag.to_numpy(dtype=int) - fitdf))
    return lb.withColumn("p_value", sf(F.col("q"), F.col("lag")))


# ----------------------------------------------------------------- KPSS / ADF
def _interp_expr(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear interpolation with flat ends (R ``approx(rule = 2)``)."""
    expr = F.when(x <= xs[0], F.lit(ys[0]))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        expr = expr.when(x <= x1, F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0)))
    return expr.otherwise(F.lit(ys[-1]))


def kpss(df: DataFrame, value: str = VALUE, series: str = SERIES, t: str = TIME) -> DataFrame:
    """K11: KPSS level statistic with the Bartlett long-run variance,
    truncation l = trunc(3 sqrt(n) / 13), p-value interpolated in the published table.

    A block returns its weighted lag products and its own partial sums; the sums of
    the blocks before it shift them: sum (B + c)^2 = n B^2 + 2 B sum c + sum c^2."""
    ship_package(df.sparkSession)
    longest = df.groupBy(series).count().agg(F.max("count")).first()[0] or 1

    def run(block: Block):
        x, l = _centred(block), _bartlett_lags(block.params[0])
        g = lag_products(x, block.own, l)
        own = x[block.own:]
        have = ~np.isnan(block.dense()[block.own:])
        c = np.cumsum(own)[have]
        weights = 1 - np.arange(1, l + 1) / (l + 1)
        yield (block.first, block.params[0], have.sum(), own.sum(), c.sum(), c @ c, g[0], weights @ g[1:])

    blocks = map_blocks(df, [value], _bartlett_lags(longest), run,
                        "first long, n double, rows long, total double, c double, cc double, ee double, w double",
                        _length_and_mean(df, value, series), series, t)
    before = Window.partitionBy(series).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    shift = F.coalesce(F.sum("total").over(before), F.lit(0.0))
    agg = blocks.withColumn("_b", shift).groupBy(series, "n").agg(
        F.sum(F.col("rows") * F.col("_b") * F.col("_b") + 2 * F.col("_b") * F.col("c") + F.col("cc")).alias("_ss"),
        F.sum("ee").alias("_ee"), F.sum("w").alias("_w"))
    n = F.col("n")
    l = F.floor(F.lit(3.0) * F.sqrt(n) / 13)
    stat = F.try_divide(F.col("_ss") / (n * n), F.col("_ee") / n + 2.0 / n * F.col("_w"))
    out = agg.select(series, n.cast("long").alias("n"), l.cast("int").alias("lags"), stat.alias("stat"))
    return out.withColumn("p_value", _interp_expr(F.col("stat"), KPSS_LEVEL_CRIT, KPSS_LEVEL_P))


def _adf_pvalue(stat: float, n: int) -> float:
    row = [float(np.interp(n, ADF_T, col)) for col in ADF_CRIT]
    return float(np.interp(stat, row, ADF_P))


def _adf_lags(n: float, max_k: int | None = None) -> int:
    k = max(0, int(math.floor((n - 1) ** (1 / 3) + 1e-12)))
    return k if max_k is None else min(k, max_k)


def moments(columns: Sequence[np.ndarray], own: int) -> np.ndarray:
    """A'A, row by row, of the own rows in which every column has a value."""
    a = np.column_stack(columns)[own:]
    a = a[~np.isnan(a).any(axis=1)]
    return (a.T @ a).ravel()


def adf(df: DataFrame, value: str = VALUE, series: str = SERIES, t: str = TIME, max_k: int | None = None) -> DataFrame:
    """K11: augmented Dickey-Fuller test with constant and trend, k = trunc((N-1)^(1/3))
    lagged differences; moments of the regression are summed over blocks of time,
    the t-statistic of the lagged level solved per series."""
    ship_package(df.sparkSession)
    longest = df.groupBy(series).count().agg(F.max("count")).first()[0] or 2

    def run(block: Block):
        n = block.params[0]
        k, x = _adf_lags(n, max_k), block.dense()
        level = lags_of(x, 1)[:, 0]
        d = x - level
        time = block.start + np.arange(len(x), dtype=float)
        y = np.where(time >= k + 2, d, np.nan)
        yield moments([np.ones(len(x)), level, time - 1, *lags_of(d, k).T, y], block.own), n

    sums = sum_arrays(map_blocks(df, [value], _adf_lags(longest, max_k) + 2, run, "m array<double>, n double",
                                 _length_and_mean(df, value, series), series, t), [series, "n"], "m")
    gf = [f for f in sums.schema.fields if f.name == series]
    schema = T.StructType(gf + [T.StructField("n_series", T.LongType()), T.StructField("k", T.IntegerType()),
                                T.StructField("stat", T.DoubleType()), T.StructField("p_value", T.DoubleType())])

    def solve_all(batches):
        for pdf in batches:
            rows = []
            for key, n, m in zip(pdf[series], pdf["n"], pdf["m"]):
                k = _adf_lags(n, max_k)
                m = np.asarray(m, float).reshape(k + 4, k + 4)
                beta, se, _, _ = ols_from_sums(m[0, 0], m[:-1, :-1], m[:-1, -1], m[-1, -1])
                stat = float(beta[1] / se[1]) if se[1] > 0 else float("nan")
                rows.append((key, int(n), k, stat, _adf_pvalue(stat, int(n) - 1)))
            yield pd.DataFrame(rows, columns=[series, "n_series", "k", "stat", "p_value"]).astype(
                {"n_series": "int64", "k": "int32"})

    return sums.mapInPandas(solve_all, schema)


# ----------------------------------------------------------------- AR models
def ar_candidates(df: DataFrame, value: str = VALUE, max_p: int = 5, series: str = SERIES,
                  t: str = TIME) -> DataFrame:
    """K9: conditional least squares AR(p), p = 0..max_p, on levels (d=0) and first
    differences (d=1), over the common sample where all max_p lags exist.
    -> (series, d, p, n_obs, coef [c, phi1..phip], sigma2, aicc)."""
    ship_package(df.sparkSession)
    base = lagged(df.select(series, t, value), value, [1], series, t, prefix="_x")
    frames = []
    for dd in (0, 1):
        z = F.col(value) if dd == 0 else F.col(value) - F.col("_x1")
        f = base.select(series, t, z.alias("_z")).withColumn("d", F.lit(dd))
        f = lagged(f, "_z", list(range(1, max_p + 1)), series, t, prefix="_z")
        f = f.withColumn("_one", F.lit(1.0))
        frames.append(f.select(series, "d", "_z", "_one", *[f"_z{j}" for j in range(1, max_p + 1)]))
    data = frames[0].unionByName(frames[1])
    xcols = ["_one", *[f"_z{j}" for j in range(1, max_p + 1)]]
    ne = normal_equations(data, [series, "d"], "_z", xcols)
    gf = [f for f in ne.schema.fields if f.name in (series, "d")]
    schema = T.StructType(gf + [T.StructField("p", T.IntegerType()), T.StructField("n_obs", T.LongType()),
                                T.StructField("coef", T.ArrayType(T.DoubleType())),
                                T.StructField("sigma2", T.DoubleType()), T.StructField("aicc", T.DoubleType())])
    K = len(xcols)

    def run(batches):
        for pdf in batches:
            rows = []
            for key, dd, n, xtx, xty, yy in zip(pdf[series], pdf["d"], pdf["n"], pdf["xtx"], pdf["xty"], pdf["yy"]):
                A_all = np.asarray(xtx, dtype=float).reshape(K, K)
                b_all = np.asarray(xty, dtype=float)
                m = float(n)
                for p in range(0, max_p + 1):
                    A, b = A_all[:p + 1, :p + 1], b_all[:p + 1]
                    beta, _, rss, _ = ols_from_sums(m, A, b, float(yy))
                    s2 = rss / m if m > 0 else float("nan")
                    npar = p + 2
                    if rss > 0 and m - npar - 1 > 0:
                        aicc = m * math.log(rss / m) + 2 * npar + 2 * npar * (npar + 1) / (m - npar - 1)
                    else:
                        aicc = float("nan")
                    rows.append((key, int(dd), p, int(n), beta.tolist(), s2, aicc))
            yield pd.DataFrame(rows, columns=[series, "d", "p", "n_obs", "coef", "sigma2", "aicc"]).astype(
                {"d": "int32", "p": "int32", "n_obs": "int64"})

    return ne.mapInPandas(run, schema)


def ar_select(df: DataFrame, value: str = VALUE, max_p: int = 5, series: str = SERIES, t: str = TIME,
              kpss_crit: float = 0.463) -> DataFrame:
    """Differencing chosen by the KPSS level test (stat above the 5% point -> d = 1),
    then the order with the smallest AICc: one row per series."""
    cands = ar_candidates(df, value, max_p, series, t)
    # an undefined statistic (constant series) keeps the levels: d = 0
    dsel = kpss(df, value, series, t).select(
        series, F.coalesce(F.col("stat") > kpss_crit, F.lit(False)).cast("int").alias("d"))
    c = cands.join(dsel, [series, "d"])
    # at most 2 x (max_p + 1) candidate rows per series
    w = Window.partitionBy(series).orderBy(F.col("aicc").asc_nulls_last(), F.col("p"))
    checkpoint_dir(df.sparkSession)
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").checkpoint(eager=True)


def ar_forecast(df: DataFrame, model: DataFrame, h: int, value: str = VALUE, series: str = SERIES,
                t: str = TIME) -> DataFrame:
    """K10: h-step recursion from each series' last values -> (series, step, t, forecast)."""
    ship_package(df.sparkSession)
    maxp = model.agg(F.max("p")).first()[0] or 0
    last_n = maxp + 2
    tail = per_series(df.select(series, t, value), series, _n=F.max(t)).filter(F.col(t) > F.col("_n") - last_n)
    lists = tail.groupBy(series).agg(F.max("_n").alias("_n"),
                                     F.sort_array(F.collect_list(F.struct(t, value))).alias("hist"))
    j = lists.join(model.select(series, "d", "p", "coef"), series)
    gf = [f for f in j.schema.fields if f.name == series]
    schema = T.StructType(gf + [T.StructField("step", T.IntegerType()), T.StructField(t, T.LongType()),
                                T.StructField("forecast", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for key, n_last, hist, dd, p, coef in zip(pdf[series], pdf["_n"], pdf["hist"], pdf["d"], pdf["p"], pdf["coef"]):
                x = [float(r[value]) for r in hist]
                z = list(np.diff(x)) if dd == 1 else list(x)
                c = list(coef)
                level = x[-1]
                for s in range(1, h + 1):
                    nxt = c[0] + sum(c[i] * z[-i] for i in range(1, int(p) + 1))
                    z.append(nxt)
                    level = level + nxt if dd == 1 else nxt
                    rows.append((key, s, int(n_last) + s, float(level)))
            yield pd.DataFrame(rows, columns=[series, "step", t, "forecast"]).astype({"step": "int32", t: "int64"})

    return j.mapInPandas(run, schema)


# ----------------------------------------------------------------- ARIMA
def differencing_order(df: DataFrame, value: str = VALUE, max_d: int = 2, series: str = SERIES, t: str = TIME,
                       kpss_crit: float = 0.463) -> DataFrame:
    """(series, d): times the series is differenced until the KPSS level test no longer
    rejects, ``max_d`` at most; an undefined statistic (constant series) stops."""
    levels = df.select(series, t, F.col(value).alias("_z"))
    found = df.select(series).distinct().withColumn("d", F.lit(0))
    for step in range(max_d):
        over = kpss(levels, "_z", series, t).where(F.col("stat") > kpss_crit).select(
            F.col(series).alias("_s"), F.lit(1).alias("_more"))
        # a series that stopped earlier stays where it is
        found = found.join(over, F.col(series).eqNullSafe(F.col("_s")) & (F.col("d") == step), "left").select(
            series, (F.col("d") + F.coalesce("_more", F.lit(0))).alias("d"))
        if step + 1 < max_d:
            levels = lagged(levels, "_z", [1], series, t, prefix="_x")
            levels = levels.select(series, t, (F.col("_z") - F.col("_x1")).alias("_z")).where("_z is not null")
    checkpoint_dir(df.sparkSession)
    return found.checkpoint(eager=True)


def differenced(df: DataFrame, orders: DataFrame, value: str = VALUE, series: str = SERIES, t: str = TIME) -> DataFrame:
    """(series, t, z): every series differenced as often as ``orders`` says (0 to 2)."""
    rows = lagged(df.select(series, t, F.col(value).alias("_x")), "_x", [1, 2], series, t, prefix="_x")
    d = orders.select(F.col(series).alias("_s"), "d")
    rows = rows.join(d, F.col(series).eqNullSafe(F.col("_s")))
    x, x1, x2 = F.col("_x"), F.col("_x1"), F.col("_x2")
    z = F.when(F.col("d") == 0, x).when(F.col("d") == 1, x - x1).otherwise(x - 2 * x1 + x2)
    return rows.select(series, t, z.alias("z")).where("z is not null")


def long_order(n: float) -> int:
    """Order of the long autoregression that stands in for the shocks: (ln n)^1.5, a quarter of n at most."""
    return int(max(1, min(math.log(max(n, 2)) ** 1.5, n // 4)))


def _arima_choice(m: np.ndarray, max_p: int, max_q: int, least_root: float) -> dict:
    """The (p, q) of least AICc whose roots lie outside the circle of radius
    ``least_root``, solved from the moments of [1, z lags, shock lags, z]."""
    k = 2 + max_p + max_q
    m = m.reshape(k, k)
    n = m[0, 0]
    found = []
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            at = [0, *range(1, 1 + p), *range(1 + max_p, 1 + max_p + q)]
            beta, _, rss, _ = ols_from_sums(n, m[np.ix_(at, at)], m[at, -1], m[-1, -1])
            params = p + q + 2
            if rss > 0 and n - params - 1 > 0:
                aicc = n * math.log(rss / n) + 2 * params + 2 * params * (params + 1) / (n - params - 1)
                found.append((aicc, p + q, p, beta, rss / n))
    for aicc, order, p, beta, s2 in sorted(found, key=lambda r: r[:3]):
        ar, ma = beta[1:1 + p], beta[1 + p:]
        roots = np.concatenate([np.roots([*(-ar[::-1]), 1.0]), np.roots([*ma[::-1], 1.0])])
        if not len(roots) or np.abs(roots).min() > least_root:
            return {"p": p, "q": order - p, "n_obs": int(n), "intercept": beta[0], "ar": ar, "ma": ma, "sigma2": s2,
                    "aicc": aicc}
    return {"p": 0, "q": 0, "n_obs": int(n), "intercept": m[0, -1] / n if n else 0.0, "ar": np.zeros(0),
            "ma": np.zeros(0), "sigma2": 0.0, "aicc": math.nan}


def arima_select(df: DataFrame, value: str = VALUE, max_p: int = 5, max_q: int = 5, max_d: int = 2, series: str = SERIES,
                 t: str = TIME, kpss_crit: float = 0.463, least_root: float = 1.001) -> DataFrame:
    """K9: automatic ARIMA(p, d, q) of every series by Hannan and Rissanen's regressions.

    d comes from repeated KPSS tests.  The differenced series, less its mean, is
    regressed on ``long_order`` of its lags; the residuals stand in for the shocks, and
    one more regression on lags of both gives every (p, q) at once: the candidates
    are sub-blocks of one moment matrix, summed over blocks of time, over the rows
    where all lags exist.  Least AICc among those with stationary and invertible roots;
    ties to fewer parameters, then to fewer autoregressive ones.
    -> (series, d, p, q, n_obs, mean, intercept, ar, ma, sigma2, aicc, long_ar)."""
    ship_package(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    orders = differencing_order(df, value, max_d, series, t, kpss_crit)
    z = differenced(df, orders, value, series, t).checkpoint(eager=True)
    stats = z.groupBy(series).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("z").alias("mean"))
    most = long_order(stats.agg(F.max("n")).first()[0] or 1)

    def long_moments(block: Block):
        m, x = long_order(block.params[0]), block.dense() - block.params[1]
        yield (moments([np.ones(len(x)), *lags_of(x, m).T, x], block.own),)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve_long(all_m: pd.Series) -> pd.Series:
        out = []
        for m in all_m:
            k = math.isqrt(len(m))
            m = np.asarray(m, float).reshape(k, k)
            out.append(ols_from_sums(m[0, 0], m[:-1, :-1], m[:-1, -1], m[-1, -1])[0].tolist())
        return pd.Series(out)

    sums = sum_arrays(map_blocks(z, ["z"], most, long_moments, "m array<double>",
                                 stats.select(series, F.array("n", "mean")), series, t), [series], "m")
    long_fit = sums.select(series, solve_long("m").alias("long_ar"))
    known = stats.join(long_fit.withColumnRenamed(series, "_s"), F.col(series).eqNullSafe(F.col("_s"))).drop("_s")
    known = known.checkpoint(eager=True)

    def both_moments(block: Block):
        x, a = block.dense() - block.params[1], block.params[2:]
        shocks = x - a[0] - lags_of(x, len(a) - 1) @ a[1:]
        yield (moments([np.ones(len(x)), *lags_of(x, max_p).T, *lags_of(shocks, max_q).T, x], block.own),)

    sums = sum_arrays(map_blocks(z, ["z"], most + max(max_p, max_q), both_moments, "m array<double>",
                                 known.select(series, F.concat(F.array("n", "mean"), "long_ar")), series, t),
                      [series], "m")
    rows = known.join(sums.withColumnRenamed(series, "_s"), F.col(series).eqNullSafe(F.col("_s"))).drop("_s")
    d = orders.select(F.col(series).alias("_s"), "d")
    rows = rows.join(d, F.col(series).eqNullSafe(F.col("_s"))).select(series, "d", "mean", "long_ar", "m")
    gf = [f for f in rows.schema.fields if f.name == series]
    schema = T.StructType(gf + [T.StructField(c, k) for c, k in (
        ("d", T.IntegerType()), ("p", T.IntegerType()), ("q", T.IntegerType()), ("n_obs", T.LongType()),
        ("mean", T.DoubleType()), ("intercept", T.DoubleType()), ("ar", T.ArrayType(T.DoubleType())),
        ("ma", T.ArrayType(T.DoubleType())), ("sigma2", T.DoubleType()), ("aicc", T.DoubleType()),
        ("long_ar", T.ArrayType(T.DoubleType())))])

    def choose(batches):
        for pdf in batches:
            out = []
            for key, dd, mean, long_ar, m in zip(pdf[series], pdf["d"], pdf["mean"], pdf["long_ar"], pdf["m"]):
                x = _arima_choice(np.asarray(m, float), max_p, max_q, least_root)
                out.append((key, int(dd), x["p"], x["q"], x["n_obs"], mean, x["intercept"], x["ar"].tolist(),
                            x["ma"].tolist(), x["sigma2"], x["aicc"], list(long_ar)))
            yield pd.DataFrame(out, columns=[f.name for f in schema]).astype(
                {"d": "int32", "p": "int32", "q": "int32", "n_obs": "int64"})

    return rows.mapInPandas(choose, schema).checkpoint(eager=True)


def arima_forecast(df: DataFrame, model: DataFrame, h: int, value: str = VALUE, series: str = SERIES,
                   t: str = TIME) -> DataFrame:
    """K10: (series, step, t, forecast) of ``arima_select``'s models.  Shocks of the last
    steps are the long autoregression's residuals, later ones are zero; the tail that
    a forecast needs is a few lags, whatever the length of the series."""
    ship_package(df.sparkSession)
    reach = model.agg(F.max(F.size("long_ar") + F.size("ma") + F.size("ar"))).first()[0] or 1
    rows = per_series(df.select(series, t, F.col(value).alias("_x")), series, _n=F.max(t))
    tail = rows.where(F.col(t) > F.col("_n") - (reach + 3))
    lists = tail.groupBy(series).agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct(t, "_x"))).alias("tail"))
    j = lists.join(model, series)
    gf = [f for f in lists.schema.fields if f.name == series]
    schema = T.StructType(gf + [T.StructField("step", T.IntegerType()), T.StructField(t, T.LongType()),
                                T.StructField("forecast", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                x = np.array([v["_x"] for v in r["tail"]], float)
                z = np.diff(x, n=int(r["d"])) - r["mean"]
                a, ar, ma = (np.asarray(r[c], float) for c in ("long_ar", "ar", "ma"))
                shocks = np.nan_to_num(z - a[0] - lags_of(z, len(a) - 1) @ a[1:])
                z, shocks = z.tolist(), shocks.tolist()
                last = [np.diff(x, n=i)[-1] for i in range(int(r["d"]))]
                for s in range(1, h + 1):
                    z.append(r["intercept"] + sum(c * z[-i] for i, c in enumerate(ar, 1))
                             + sum(c * shocks[-i] for i, c in enumerate(ma, 1)))
                    shocks.append(0.0)
                    step = z[-1] + r["mean"]
                    for i in range(len(last) - 1, -1, -1):
                        step = last[i] = last[i] + step
                    out.append((r[series], s, int(r["_n"]) + s, float(step)))
            yield pd.DataFrame(out, columns=[series, "step", t, "forecast"]).astype({"step": "int32", t: "int64"})

    return j.mapInPandas(run, schema)


def mape(df: DataFrame, actual: str, forecast: str, groups: Sequence[str]) -> DataFrame:
    """K13: mean absolute percentage error per group (in percent)."""
    return df.groupBy(*groups).agg(
        (F.avg(F.abs(F.try_divide(F.col(actual) - F.col(forecast), F.col(actual)))) * 100).alias("mape"),
        F.count(F.lit(1)).cast("long").alias("n"))


def standardised_residuals(df: DataFrame, resid: str, series: str = SERIES, out: str = "std_resid") -> DataFrame:
    """K12: residuals divided by their per-series sample standard deviation."""
    d = per_series(df, series, _sd=F.stddev_samp(resid))
    return d.withColumn(out, F.try_divide(F.col(resid), F.col("_sd"))).drop("_sd")
