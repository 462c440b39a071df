"""Queries for §2.7: scaling, dummy coding, WOE/IV, splits, sampling, balancing, PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.operators import features as fe
from quire.operators import pca
from quire.plans.catalog import register
from quire.plans.standins import APPLICANTS_SQL, applicants, materialised
from quire.sources.tables import load

NUMERIC = ["o_totalprice", "c_acctbal"]
CATEGORICAL = ["c_mktsegment", "o_orderpriority"]


@register("zscore", sql=f"""
WITH {APPLICANTS_SQL}
SELECT app_id,
       round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS o_totalprice,
       round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal
FROM applicants""")
def q_zscore(spark, d):
    a = materialised(applicants(spark, d).select("app_id", *NUMERIC))
    return fe.zscore(a, NUMERIC).select("app_id", *[r6(c).alias(c) for c in NUMERIC])


@register("minmax", sql=f"""
WITH {APPLICANTS_SQL}
SELECT app_id,
       round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS o_totalprice,
       round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal
FROM applicants""")
def q_minmax(spark, d):
    a = materialised(applicants(spark, d).select("app_id", *NUMERIC))
    return fe.minmax(a, NUMERIC).select("app_id", *[r6(c).alias(c) for c in NUMERIC])


@register("scale_constant", sql="""
SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / 255.0, 10)) AS pixels FROM embeddings""")
def q_scale_constant(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", F.transform(fe.scale_array("embedding", 255.0), lambda x: F.round(x, 10)).alias("pixels"))


def _dummy_sql() -> str:
    from quire.plans.q_aggregate import PRIORITIES
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cols = [f"""CAST(c_mktsegment = '{v}' AS INTEGER) AS "c_mktsegment.x{fe._clean_name(v)}\"""" for v in segs[1:]]
    cols += [f"""CAST(o_orderpriority = '{v}' AS INTEGER) AS "o_orderpriority.x{fe._clean_name(v)}\"""" for v in PRIORITIES[1:]]
    return f"WITH {APPLICANTS_SQL} SELECT app_id, " + ", ".join(cols) + " FROM applicants"


@register("dummy_code", sql=_dummy_sql())
def q_dummy_code(spark, d):
    a = materialised(applicants(spark, d).select("app_id", *CATEGORICAL))
    return fe.dummy_code(a, fe.fit_levels(a, CATEGORICAL))


_EDGES = ", ".join(str(i / 10) for i in range(11))
WOE_SQL = f"""{APPLICANTS_SQL},
edges AS (SELECT 'o_totalprice' AS feature, list_sort(list_distinct(quantile_cont(o_totalprice, [{_EDGES}]))) AS e FROM applicants
          UNION ALL
          SELECT 'c_acctbal', list_sort(list_distinct(quantile_cont(c_acctbal, [{_EDGES}]))) FROM applicants),
long AS (SELECT app_id, y, 'o_totalprice' AS feature, o_totalprice AS x FROM applicants
         UNION ALL SELECT app_id, y, 'c_acctbal', c_acctbal FROM applicants),
nb AS (SELECT l.app_id, l.y, l.feature,
              printf('%02d', greatest(1, len(list_filter(e.e, lambda v: v < l.x)))) AS bin,
              greatest(1, len(list_filter(e.e, lambda v: v < l.x))) AS bin_order
       FROM long l JOIN edges e ON l.feature = e.feature),
cb AS (SELECT app_id, y, 'c_mktsegment' AS feature, c_mktsegment AS bin, 0 AS bin_order FROM applicants
       UNION ALL SELECT app_id, y, 'o_orderpriority', o_orderpriority, 0 FROM applicants),
allb AS (SELECT * FROM nb UNION ALL SELECT * FROM cb),
cells AS (SELECT feature, bin, bin_order, count(*) AS n, sum(y) AS n_bad, count(*) - sum(y) AS n_good FROM allb GROUP BY 1, 2, 3),
w AS (SELECT *, n_bad * 1.0 / sum(n_bad) OVER (PARTITION BY feature) AS pct_bad,
             n_good * 1.0 / sum(n_good) OVER (PARTITION BY feature) AS pct_good FROM cells),
woe AS (SELECT *, CASE WHEN n_bad = 0 OR n_good = 0 THEN 0.0 ELSE ln(pct_bad / pct_good) END AS woe,
               CASE WHEN n_bad = 0 OR n_good = 0 THEN 0.0 ELSE (pct_bad - pct_good) * ln(pct_bad / pct_good) END AS iv
        FROM w)"""


@register("woe_table", sql=f"""
WITH {WOE_SQL}
SELECT feature, bin, CAST(bin_order AS INTEGER) AS bin_order, CAST(n AS BIGINT) AS n, CAST(n_bad AS BIGINT) AS n_bad,
       CAST(n_good AS BIGINT) AS n_good, round(pct_bad, 6) AS pct_bad, round(pct_good, 6) AS pct_good,
       round(woe, 6) AS woe, round(iv, 6) AS iv FROM woe""")
def q_woe_table(spark, d):
    a = materialised(applicants(spark, d).select("app_id", "y", *NUMERIC, *CATEGORICAL))
    t = fe.woe_table(a, "y", NUMERIC, CATEGORICAL)
    return t.select("feature", "bin", "bin_order", "n", "n_bad", "n_good",
                    *[r6(c).alias(c) for c in ["pct_bad", "pct_good", "woe", "iv"]])


@register("iv_rank", sql=f"""
WITH {WOE_SQL} SELECT feature, round(sum(iv), 6) AS iv FROM woe GROUP BY feature""")
def q_iv_rank(spark, d):
    a = materialised(applicants(spark, d).select("app_id", "y", *NUMERIC, *CATEGORICAL))
    t = fe.iv_rank(fe.woe_table(a, "y", NUMERIC, CATEGORICAL))
    return t.select("feature", r6("iv").alias("iv"))


@register("woe_transform", sql=f"""
WITH {WOE_SQL},
per AS (SELECT a.app_id, a.feature, round(w.woe, 6) AS woe FROM allb a JOIN woe w ON a.feature = w.feature AND a.bin = w.bin)
SELECT app_id,
       max(CASE WHEN feature = 'o_totalprice' THEN woe END) AS o_totalprice_woe,
       max(CASE WHEN feature = 'c_acctbal' THEN woe END) AS c_acctbal_woe,
       max(CASE WHEN feature = 'c_mktsegment' THEN woe END) AS c_mktsegment_woe,
       max(CASE WHEN feature = 'o_orderpriority' THEN woe END) AS o_orderpriority_woe
FROM per GROUP BY app_id""")
def q_woe_transform(spark, d):
    a = materialised(applicants(spark, d).select("app_id", "y", *NUMERIC, *CATEGORICAL))
    model = fe.fit_woe(a, "y", NUMERIC, CATEGORICAL)
    out = model.transform(a.select("app_id", *NUMERIC, *CATEGORICAL))
    return out.select("app_id", *[r6(f"{c}_woe").alias(f"{c}_woe") for c in NUMERIC + CATEGORICAL])


@register("stratified_split", sql=f"""
WITH {APPLICANTS_SQL}
SELECT app_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('1:' || CAST(app_id AS VARCHAR)), app_id)
                  <= round_even(0.7 * count(*) OVER (PARTITION BY y), 0) AS is_train
FROM applicants""")
def q_stratified_split(spark, d):
    a = applicants(spark, d).select("app_id", "y")
    return fe.stratified_split(a, "y", "app_id", 0.7, seed=1).select("app_id", "y", "is_train")


@register("shuffle_split", sql="""
SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey)
                   <= round_even(0.8 * count(*) OVER (), 0) AS is_train FROM orders""")
def q_shuffle_split(spark, d):
    o = load(spark, d, "orders").select("o_orderkey")
    return fe.shuffle_split(o, "o_orderkey", 0.8, seed=7)


@register("hash_sample", sql="""
SELECT vec_id, label FROM (
  SELECT vec_id, label, row_number() OVER (ORDER BY md5('3:' || CAST(vec_id AS VARCHAR)), vec_id) AS r,
         count(*) OVER () AS n FROM embeddings) WHERE r <= floor(0.3 * n)""")
def q_hash_sample(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label")
    return fe.hash_sample(e, "vec_id", 0.3, seed=3)


@register("balance_weights", sql=f"""
WITH {APPLICANTS_SQL},
neg AS (SELECT app_id, y, row_number() OVER (ORDER BY md5('1:' || CAST(app_id AS VARCHAR)), app_id) AS r,
               count(*) OVER () AS n FROM applicants WHERE y = 0)
SELECT app_id, y, CAST(1.0 AS DOUBLE) AS weights FROM applicants WHERE y = 1
UNION ALL
SELECT app_id, y, CAST(10.0 AS DOUBLE) FROM neg WHERE r <= floor(0.1 * n)""")
def q_balance_weights(spark, d):
    a = applicants(spark, d).select("app_id", "y")
    return fe.balance_weights(a, "y", "app_id", 0.1, 10.0, seed=1)


@register("pca_variance")
def q_pca_variance(spark, d):
    model = pca.pca_fit(load(spark, d, "embeddings"), "embedding", k=64)     # the whole spectrum
    return pca.pca_variance(model, spark)


@register("pca_project")
def q_pca_project(spark, d):
    e = load(spark, d, "embeddings")
    model = pca.pca_fit(e, "embedding", k=35)
    return pca.pca_project(model, e, "embedding", ["vec_id", "label"])
