"""Queries for §2.11: every segment x measure series processed at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.operators import timeseries as ts
from quire.operators.ols import grouped_ols
from quire.plans.catalog import register
from quire.plans.standins import HOLDOUT_MONTHS, SERIES_SQL, segment_series

H = HOLDOUT_MONTHS
TRAIN_SQL = f"""{SERIES_SQL},
sl AS (SELECT *, max(t) OVER (PARTITION BY series_id) AS n_all FROM series),
train AS (SELECT series_id, t, value, count(*) OVER (PARTITION BY series_id) AS n FROM sl WHERE t <= n_all - {H}),
test AS (SELECT series_id, t, value FROM sl WHERE t > n_all - {H})"""


def series_frame(spark, d, materialise: bool = True):
    """The monthly series with the hold-out flag, materialised once per query: the
    statistics read it in several branches (per-series aggregates, lags, ends), and a
    written segments x months table guarantees a single pass over the order data
    instead of one per branch."""
    out = ts.holdout(segment_series(spark, d), H)
    return out.checkpoint(eager=True) if materialise else out


def train_frame(spark, d, materialise: bool = True):
    return series_frame(spark, d, materialise).filter(~F.col("is_test")).drop("is_test")


@register("ts_monthly_index", sql=f"""
WITH {SERIES_SQL} SELECT series_id, month, t, round(value, 2) AS value FROM series""")
def q_ts_monthly_index(spark, d):
    return segment_series(spark, d).select("series_id", "month", "t", r6("value", 2).alias("value"))


@register("ts_holdout", sql=f"""
WITH {SERIES_SQL} SELECT series_id, t, t > max(t) OVER (PARTITION BY series_id) - {H} AS is_test FROM series""")
def q_ts_holdout(spark, d):
    return series_frame(spark, d).select("series_id", "t", "is_test")


@register("ts_smooth", sql=f"""
WITH {TRAIN_SQL},
ma AS (SELECT series_id, t, n, value,
              CASE WHEN t > 1 AND t <= n - 1 THEN avg(value) OVER (PARTITION BY series_id ORDER BY t
                   ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS inner_ma FROM train),
ends AS (SELECT series_id, max(CASE WHEN t = 2 THEN inner_ma END) AS a1, max(CASE WHEN t = 3 THEN inner_ma END) AS a2,
                max(CASE WHEN t = n - 1 THEN inner_ma END) AS b1, max(CASE WHEN t = n - 2 THEN inner_ma END) AS b2
         FROM ma GROUP BY series_id)
SELECT m.series_id, m.t, round(m.value, 2) AS value,
       round(CASE WHEN m.t <= 1 THEN a1 - (2 - m.t) * (a2 - a1)
                  WHEN m.t > m.n - 1 THEN b1 + (m.t - (m.n - 1)) * (b1 - b2) ELSE inner_ma END, 4) AS smoothed
FROM ma m JOIN ends e ON m.series_id = e.series_id""")
def q_ts_smooth(spark, d):
    sm = ts.smooth(train_frame(spark, d), width=1)
    return sm.select("series_id", "t", r6("value", 2).alias("value"), r6("smoothed", 4).alias("smoothed"))


@register("ts_linear_trend", sql=f"""
WITH {TRAIN_SQL}
SELECT series_id, round(regr_intercept(value, t), 4) AS intercept, round(regr_slope(value, t), 6) AS slope,
       CAST(count(*) AS BIGINT) AS n FROM train GROUP BY series_id""")
def q_ts_linear_trend(spark, d):
    tr = train_frame(spark, d).withColumns({"_one": F.lit(1.0), "_t": F.col("t").cast("double")})
    fit = grouped_ols(tr, ["series_id"], "value", ["_one", "_t"])
    return fit.select("series_id", r6(F.col("coef")[0], 4).alias("intercept"), r6(F.col("coef")[1]).alias("slope"),
                      F.col("n").cast("long").alias("n"))


def _eliminated(k: int) -> str:
    """CTEs that solve (series_id, i, j, v): k equations, right side and identity behind
    them, one column after the other (Gauss-Jordan); the last is e<k>."""
    steps = []
    for p in range(k):
        steps.append(f"""e{p + 1} AS (SELECT a.series_id, a.i, a.j,
  CASE WHEN a.i = {p} THEN a.v / pv.v ELSE a.v - f.v * r.v / pv.v END AS v
  FROM e{p} a JOIN e{p} pv ON pv.series_id = a.series_id AND pv.i = {p} AND pv.j = {p}
  JOIN e{p} r ON r.series_id = a.series_id AND r.i = {p} AND r.j = a.j
  JOIN e{p} f ON f.series_id = a.series_id AND f.i = a.i AND f.j = {p})""")
    return ",\n".join(steps)


# The default trend on the smoothed training series: design rows, then their solved normal equations.
_TREND_SQL = f"""
WITH {TRAIN_SQL},
ma AS (SELECT series_id, t, n, value,
              CASE WHEN t > 1 AND t <= n - 1 THEN avg(value) OVER (PARTITION BY series_id ORDER BY t
                   ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS inner_ma FROM train),
ends AS (SELECT series_id, max(CASE WHEN t = 2 THEN inner_ma END) AS a1, max(CASE WHEN t = 3 THEN inner_ma END) AS a2,
                max(CASE WHEN t = n - 1 THEN inner_ma END) AS b1, max(CASE WHEN t = n - 2 THEN inner_ma END) AS b2
         FROM ma GROUP BY series_id),
sm AS (SELECT m.series_id, m.t, m.n, CASE WHEN m.t <= 1 THEN a1 - (2 - m.t) * (a2 - a1)
              WHEN m.t > m.n - 1 THEN b1 + (m.t - (m.n - 1)) * (b1 - b2) ELSE inner_ma END AS y
       FROM ma m JOIN ends e ON m.series_id = e.series_id),
dz AS (SELECT series_id, t, n, y, (t - (n + 1) / 2.0) / n AS u FROM sm WHERE y IS NOT NULL),
dm AS (SELECT series_id, n, y, [1.0, sin(t * 0.5), u, u * u, u * u * u, y]::DOUBLE[] AS x FROM dz),
mm AS (SELECT series_id, i, j, sum(x[i + 1] * x[j + 1]) AS v FROM dm, range(5) a(i), range(6) b(j) GROUP BY ALL),
e0 AS (SELECT * FROM mm UNION ALL
       SELECT series_id, i, 6 + j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM (SELECT DISTINCT series_id FROM mm), range(5) a(i), range(5) b(j)),
{_eliminated(5)},
co AS (SELECT series_id, list(v ORDER BY i) AS b FROM e5 WHERE j = 5 GROUP BY series_id),
rs AS (SELECT d.series_id, count(*) AS n_obs, max(d.n) AS n_train,
              sum(pow(y - (b[1] * x[1] + b[2] * x[2] + b[3] * x[3] + b[4] * x[4] + b[5] * x[5]), 2)) AS rss
       FROM dm d JOIN co USING (series_id) GROUP BY d.series_id)"""


def _trend(spark, d, spec="sin_poly3"):
    full = series_frame(spark, d, materialise=True)
    train = ts.smooth(full.filter(~F.col("is_test")), width=1)
    fit = ts.trend_fit(train, "smoothed", spec)
    return full, train, fit


@register("ts_trend_fit", sql=f"""{_TREND_SQL}
SELECT series_id, CAST(n_obs AS BIGINT) AS n, CAST(i AS INTEGER) AS term, round(b[i + 1], 2) AS estimate,
       round(sqrt(inv.v * rss / (n_obs - 5)), 2) AS std_error
FROM co JOIN rs USING (series_id) JOIN (SELECT series_id, i, v FROM e5 WHERE j = 6 + i) inv USING (series_id)""")
def q_ts_trend_fit(spark, d):
    _, _, fit = _trend(spark, d)
    return fit.select("series_id", "n", "n_train", F.posexplode(F.arrays_zip("coef", "se")).alias("term", "c")) \
              .select("series_id", "n", "term", r6("c.coef", 2).alias("estimate"), r6("c.se", 2).alias("std_error"))


@register("ts_trend_fit_seasonal_interaction")
def q_ts_trend_fit_interaction(spark, d):
    _, _, fit = _trend(spark, d, "cos_poly3_x_sin")
    return fit.select("series_id", "n", F.posexplode("coef").alias("term", "estimate"))


@register("ts_trend_forecast", sql=f"""{_TREND_SQL}
SELECT s.series_id, s.t, s.t > s.n_all - {H} AS is_test, round(s.value, 2) AS value,
       round(b[1] + b[2] * sin(s.t * 0.5) + b[3] * u + b[4] * u * u + b[5] * u * u * u, 2) AS fitted
FROM (SELECT sl.*, (t - (n_train + 1) / 2.0) / n_train AS u FROM sl JOIN rs USING (series_id)) s JOIN co USING (series_id)""")
def q_ts_trend_forecast(spark, d):
    full, _, fit = _trend(spark, d)
    return ts.trend_predict(full, fit).select("series_id", "t", "is_test", r6("value", 2).alias("value"),
                                              r6("fitted", 2).alias("fitted"))


def _local_series(spark, d):
    """Residual of the raw training values around the global (trend) fit."""
    full, train, fit = _trend(spark, d)
    pred = ts.trend_predict(train, fit)
    # reused by several statistics: cut the lineage once
    return pred.withColumn("local", F.col("value") - F.col("fitted")).checkpoint(eager=True)


@register("ts_acf", sql=f"""
WITH {TRAIN_SQL},
c AS (SELECT series_id, t, n, value - avg(value) OVER (PARTITION BY series_id) AS xc FROM train),
lags AS (SELECT a.series_id, a.n, b.t - a.t AS lag, sum(a.xc * b.xc) AS s
         FROM c a JOIN c b ON a.series_id = b.series_id AND b.t >= a.t AND b.t - a.t <= least(floor(10 * log10(a.n)), a.n - 1)
         GROUP BY 1, 2, 3)
SELECT l.series_id, CAST(l.n AS BIGINT) AS n, CAST(l.lag AS INTEGER) AS lag, round(l.s / z.s, 6) AS acf
FROM lags l JOIN lags z ON l.series_id = z.series_id AND z.lag = 0""")
def q_ts_acf(spark, d):
    a = ts.acf(train_frame(spark, d), "value")
    return a.select("series_id", F.col("n").cast("long").alias("n"), "lag", r6("acf").alias("acf"))


@register("ts_pacf")
def q_ts_pacf(spark, d):
    return ts.pacf(ts.acf(_local_series(spark, d), "local"))


@register("ts_ljung_box", sql=f"""
WITH {TRAIN_SQL},
c AS (SELECT series_id, t, n, value - avg(value) OVER (PARTITION BY series_id) AS xc FROM train),
lags AS (SELECT a.series_id, a.n, b.t - a.t AS lag, sum(a.xc * b.xc) AS s
         FROM c a JOIN c b ON a.series_id = b.series_id AND b.t >= a.t AND b.t - a.t <= least(floor(10 * log10(a.n)), a.n - 1)
         GROUP BY 1, 2, 3),
r AS (SELECT l.series_id, l.n, l.lag, l.s / z.s AS acf FROM lags l JOIN lags z ON l.series_id = z.series_id AND z.lag = 0)
SELECT series_id, CAST(lag AS INTEGER) AS lag,
       round(n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY series_id ORDER BY lag), 6) AS q
FROM r WHERE lag >= 1""")
def q_ts_ljung_box(spark, d):
    lb = ts.ljung_box(ts.acf(train_frame(spark, d), "value"))
    return lb.select("series_id", "lag", r6("q").alias("q"))


@register("ts_residual_diagnostics")
def q_ts_residual_diagnostics(spark, d):
    """Ljung-Box Q and p-values of the local (residual) series."""
    lb = ts.ljung_box(ts.acf(_local_series(spark, d), "local"))
    return ts.ljung_box_pvalues(lb)


def _kpss_sql() -> str:
    crit, pv = ts.KPSS_LEVEL_CRIT, ts.KPSS_LEVEL_P
    interp = f"CASE WHEN stat <= {crit[0]} THEN {pv[0]} "
    for (x0, y0), (x1, y1) in zip(zip(crit, pv), zip(crit[1:], pv[1:])):
        interp += f"WHEN stat <= {x1} THEN {y0} + (stat - {x0}) * {(y1 - y0) / (x1 - x0)!r} "
    interp += f"ELSE {pv[-1]} END"
    return f"""
WITH {TRAIN_SQL},
e AS (SELECT series_id, t, n, floor(3 * sqrt(n) / 13) AS l, value - avg(value) OVER (PARTITION BY series_id) AS e FROM train),
s AS (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cs FROM e),
g AS (SELECT x.series_id, sum(2.0 / x.n * (1 - (x.t - y.t) / (x.l + 1)) * x.e * y.e) AS w
      FROM e x JOIN e y ON x.series_id = y.series_id AND y.t < x.t AND x.t - y.t <= x.l GROUP BY 1),
a AS (SELECT series_id, n, l, sum(cs * cs) AS ss, sum(e * e) AS ee FROM s GROUP BY series_id, n, l),
k AS (SELECT series_id, n, l, (ss / (n * n)) / (ee / n + coalesce(w, 0)) AS stat FROM a LEFT JOIN g USING (series_id))
SELECT series_id, CAST(n AS BIGINT) AS n, CAST(l AS INTEGER) AS lags, round(stat, 6) AS stat,
       round({interp}, 6) AS p_value FROM k"""


@register("ts_kpss", sql=_kpss_sql())
def q_ts_kpss(spark, d):
    k = ts.kpss(train_frame(spark, d), "value")
    return k.select("series_id", "n", "lags", r6("stat").alias("stat"), r6("p_value").alias("p_value"))


@register("ts_adf")
def q_ts_adf(spark, d):
    return ts.adf(_local_series(spark, d), "local")


@register("ts_ar_select")
def q_ts_ar_select(spark, d):
    return ts.ar_select(train_frame(spark, d, materialise=True), "value")


def _ar_forecasts(spark, d):
    train = train_frame(spark, d, materialise=True)
    model = ts.ar_select(train, "value")
    return ts.ar_forecast(train, model, H)


@register("ts_ar_forecast")
def q_ts_ar_forecast(spark, d):
    return _ar_forecasts(spark, d)


@register("ts_mape", sql=f"""
WITH {TRAIN_SQL},
lt AS (SELECT series_id, regr_intercept(value, t) AS a, regr_slope(value, t) AS b,
              arg_max(value, t) AS last_value FROM train GROUP BY series_id),
f AS (SELECT s.series_id, s.value, lt.a + lt.b * s.t AS linear, lt.last_value AS naive FROM test s JOIN lt ON s.series_id = lt.series_id),
m AS (SELECT series_id, 'linear_trend' AS model, avg(abs((value - linear) / value)) * 100 AS mape, count(*) AS n FROM f GROUP BY 1
      UNION ALL SELECT series_id, 'naive', avg(abs((value - naive) / value)) * 100, count(*) FROM f GROUP BY 1)
SELECT series_id, model, round(mape, 4) AS mape, CAST(n AS BIGINT) AS n,
       row_number() OVER (PARTITION BY series_id ORDER BY mape, model) = 1 AS best FROM m""")
def q_ts_mape(spark, d):
    full = series_frame(spark, d)
    train = full.filter(~F.col("is_test")).withColumns({"_one": F.lit(1.0), "_t": F.col("t").cast("double")})
    fit = grouped_ols(train, ["series_id"], "value", ["_one", "_t"])
    last = train.groupBy("series_id").agg(F.max_by("value", "t").alias("last_value"))
    test = full.filter(F.col("is_test")).join(fit.select("series_id", "coef"), "series_id").join(last, "series_id")
    test = test.withColumns({"linear": F.col("coef")[0] + F.col("coef")[1] * F.col("t"), "naive": F.col("last_value")})
    long = test.unpivot(["series_id", "value"], ["linear", "naive"], "model", "forecast") \
        .withColumn("model", F.when(F.col("model") == "linear", "linear_trend").otherwise("naive"))
    m = ts.mape(long, "value", "forecast", ["series_id", "model"])
    w = Window.partitionBy("series_id").orderBy("mape", "model")   # two rows per series
    return m.select("series_id", "model", r6("mape", 4).alias("mape"), "n",
                    (F.row_number().over(w) == 1).alias("best"))


@register("ts_arima_select")
def q_ts_arima_select(spark, d):
    """Order and coefficients of the automatic ARIMA of every training series."""
    return ts.arima_select(train_frame(spark, d), "value").drop("long_ar")


def _arima_forecasts(spark, d):
    train = train_frame(spark, d)
    return ts.arima_forecast(train, ts.arima_select(train, "value"), H)


@register("ts_arima_forecast")
def q_ts_arima_forecast(spark, d):
    return _arima_forecasts(spark, d)


@register("ts_model_mape")
def q_ts_model_mape(spark, d):
    """Classical decomposition (trend on the smoothed series), AR and ARIMA forecasts on the hold-out."""
    full, _, fit = _trend(spark, d)
    test = full.filter(F.col("is_test"))
    classical = ts.trend_predict(test, fit).select("series_id", "t", "value", F.lit("classical").alias("model"),
                                                   F.col("fitted").alias("forecast"))
    ar = _ar_forecasts(spark, d).join(test.select("series_id", "t", "value"), ["series_id", "t"]) \
        .select("series_id", "t", "value", F.lit("ar").alias("model"), "forecast")
    arima = _arima_forecasts(spark, d).join(test.select("series_id", "t", "value"), ["series_id", "t"]) \
        .select("series_id", "t", "value", F.lit("arima").alias("model"), "forecast")
    return ts.mape(classical.unionByName(ar).unionByName(arima), "value", "forecast", ["series_id", "model"])


@register("ts_compare", sql=f"""
WITH {TRAIN_SQL},
ma AS (SELECT series_id, t, n, value,
              CASE WHEN t > 1 AND t <= n - 1 THEN avg(value) OVER (PARTITION BY series_id ORDER BY t
                   ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS inner_ma FROM train),
ends AS (SELECT series_id, max(CASE WHEN t = 2 THEN inner_ma END) AS a1, max(CASE WHEN t = 3 THEN inner_ma END) AS a2,
                max(CASE WHEN t = n - 1 THEN inner_ma END) AS b1, max(CASE WHEN t = n - 2 THEN inner_ma END) AS b2
         FROM ma GROUP BY series_id),
sm AS (SELECT m.series_id, m.t, CASE WHEN m.t <= 1 THEN a1 - (2 - m.t) * (a2 - a1)
                                     WHEN m.t > m.n - 1 THEN b1 + (m.t - (m.n - 1)) * (b1 - b2) ELSE inner_ma END AS smoothed
       FROM ma m JOIN ends e ON m.series_id = e.series_id),
lt AS (SELECT series_id, regr_intercept(value, t) AS a, regr_slope(value, t) AS b FROM train GROUP BY series_id)
SELECT s.series_id, s.t, s.t > s.n_all - {H} AS is_test, round(s.value, 2) AS value,
       round(sm.smoothed, 4) AS smoothed, round(lt.a + lt.b * s.t, 4) AS linear_fit
FROM sl s JOIN lt ON s.series_id = lt.series_id LEFT JOIN sm ON s.series_id = sm.series_id AND s.t = sm.t""")
def q_ts_compare(spark, d):
    """Raw, smoothed (training part) and linear-trend values side by side for every (series, t)."""
    full = series_frame(spark, d)
    train = full.filter(~F.col("is_test"))
    sm = ts.smooth(train, width=1).select("series_id", "t", "smoothed")
    fit = grouped_ols(train.withColumns({"_one": F.lit(1.0), "_t": F.col("t").cast("double")}),
                      ["series_id"], "value", ["_one", "_t"])
    out = full.join(fit.select("series_id", "coef"), "series_id").join(sm, ["series_id", "t"], "left")
    return out.select("series_id", "t", "is_test", r6("value", 2).alias("value"), r6("smoothed", 4).alias("smoothed"),
                      r6(F.col("coef")[0] + F.col("coef")[1] * F.col("t"), 4).alias("linear_fit"))


@register("ts_compare_models")
def q_ts_compare_models(spark, d):
    """Raw, smoothed, classical-decomposition and AR values side by side for every (series, t)."""
    full, train, fit = _trend(spark, d)
    fitted = ts.trend_predict(full, fit)
    sm = train.select("series_id", "t", "smoothed")
    ar = _ar_forecasts(spark, d).select("series_id", "t", F.col("forecast").alias("ar_forecast"))
    return fitted.join(sm, ["series_id", "t"], "left").join(ar, ["series_id", "t"], "left") \
        .select("series_id", "t", "is_test", "value", "smoothed", "fitted", "ar_forecast")


@register("ts_standardised_residuals", sql=f"""
WITH {TRAIN_SQL},
lt AS (SELECT series_id, regr_intercept(value, t) AS a, regr_slope(value, t) AS b FROM train GROUP BY series_id),
r AS (SELECT tr.series_id, tr.t, tr.value - (lt.a + lt.b * tr.t) AS resid FROM train tr JOIN lt ON tr.series_id = lt.series_id)
SELECT series_id, t, round(resid / stddev_samp(resid) OVER (PARTITION BY series_id), 6) AS std_resid FROM r""")
def q_ts_standardised_residuals(spark, d):
    """Standardised residuals of each series around its linear trend (training part)."""
    train = train_frame(spark, d).withColumns({"_one": F.lit(1.0), "_t": F.col("t").cast("double")})
    fit = grouped_ols(train, ["series_id"], "value", ["_one", "_t"])
    r = train.join(fit.select("series_id", "coef"), "series_id").withColumn(
        "resid", F.col("value") - (F.col("coef")[0] + F.col("coef")[1] * F.col("t")))
    out = ts.standardised_residuals(r, "resid")
    return out.select("series_id", "t", r6("std_resid").alias("std_resid"))
