"""Queries for §2.5: grouped aggregates, top-k, shares, correlation, CoV."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.operators import aggregate as agg
from quire.operators.rank import global_ntile
from quire.plans.catalog import register
from quire.plans.standins import (
    APPLICANTS_SQL, ATTENDANCE_SQL, INVESTMENTS_SQL, SEGMENT_ORDERS_SQL, applicants, attendance, investments,
    segment_orders)
from quire.sources.tables import load


@register("segment_cov", sql=f"""
WITH {SEGMENT_ORDERS_SQL},
m AS (SELECT segment, month, sum(o_totalprice) AS v FROM seg_orders GROUP BY segment, month)
SELECT segment, CAST(count(*) AS BIGINT) AS n_periods,
       round(avg(v), 4) AS mean_value, round(stddev_samp(v), 4) AS sd_value,
       round(stddev_samp(v) / avg(v), 6) AS cov
FROM m GROUP BY segment""")
def q_segment_cov(spark, d):
    out = agg.segment_cov(segment_orders(spark, d), ["segment"], "month", "o_totalprice")
    return out.select("segment", "n_periods", r6("mean_value", 4).alias("mean_value"),
                      r6("sd_value", 4).alias("sd_value"), r6("cov").alias("cov"))


@register("segment_cov_best", sql=f"""
WITH {SEGMENT_ORDERS_SQL},
m AS (SELECT segment, month, sum(o_totalprice) AS v FROM seg_orders GROUP BY segment, month)
SELECT segment, round(stddev_samp(v) / avg(v), 6) AS cov
FROM m GROUP BY segment ORDER BY stddev_samp(v) / avg(v), segment LIMIT 2""")
def q_segment_cov_best(spark, d):
    out = agg.segment_cov(segment_orders(spark, d), ["segment"], "month", "o_totalprice")
    return agg.top_k(out, [F.col("cov").asc(), F.col("segment").asc()], 2) \
        .select("segment", r6("cov").alias("cov"))


# ---------------------------------------------------------------- investments
# The investment-size window of the reference's analysis, scaled
# to the stand-in amounts, and the chosen round type.
AMOUNT_LO, AMOUNT_HI = 5000, 50000
CHOSEN_ROUND = "R"


@register("group_agg", sql=f"""
WITH {INVESTMENTS_SQL}
SELECT round_type, CAST(count(*) AS BIGINT) AS n, round(sum(amount), 2) AS total, round(avg(amount), 6) AS mean_amount
FROM investments GROUP BY round_type""")
def q_group_agg(spark, d):
    inv = investments(spark, d)
    out = agg.group_agg(inv, ["round_type"], {"n": F.count(F.lit(1)).cast("long"), "total": F.sum("amount"),
                                              "mean_amount": F.avg("amount")})
    return out.select("round_type", "n", r6("total", 2).alias("total"), r6("mean_amount").alias("mean_amount"))


@register("group_multi_sum", sql="""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net
FROM lineitem GROUP BY 1, 2""")
def q_group_multi_sum(spark, d):
    li = load(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.sum("l_quantity"), 2).alias("sum_qty"), r6(F.sum("l_extendedprice"), 2).alias("sum_price"),
        r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_net"))


@register("count_distinct", sql=f"""
WITH {INVESTMENTS_SQL}
SELECT CAST(count(DISTINCT company) AS BIGINT) AS n_distinct_company,
       CAST(count(DISTINCT country) AS BIGINT) AS n_distinct_country,
       CAST(count(DISTINCT sector) AS BIGINT) AS n_distinct_sector,
       CAST(count(DISTINCT category) AS BIGINT) AS n_distinct_category,
       CAST(count(DISTINCT CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE country END)
            + max(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct_country_na
FROM investments""")
def q_count_distinct(spark, d):
    inv = investments(spark, d).withColumn(
        "country_na", F.when(F.col("l_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("country")))
    return inv.agg(*[agg.distinct_count_expr(c).alias(f"n_distinct_{c}") for c in
                     ["company", "country", "sector", "category"]],
                   agg.distinct_count_expr("country_na", include_null=True).alias("n_distinct_country_na"))


@register("global_agg", sql="""
SELECT 'l_extendedprice' AS column, CAST(count(l_extendedprice) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS sum,
       round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd,
       round(min(l_extendedprice), 6) AS min, round(max(l_extendedprice), 6) AS max FROM lineitem
UNION ALL
SELECT 'l_quantity', count(l_quantity), round(sum(l_quantity), 2), round(avg(l_quantity), 6),
       round(stddev_samp(l_quantity), 6), round(min(l_quantity), 6), round(max(l_quantity), 6) FROM lineitem""")
def q_global_agg(spark, d):
    out = agg.global_agg(load(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    return out.select("column", "n", r6("sum", 2).alias("sum"),
                      *[r6(c).alias(c) for c in ["mean", "sd", "min", "max"]])


@register("attendance_rollup", sql=f"""
WITH {ATTENDANCE_SQL}
SELECT user_id, CAST(count(hours) AS BIGINT) AS days_present,
       CAST((SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) - count(hours) AS BIGINT) AS days_absent,
       round(avg(hours), 6) AS mean_hours
FROM attendance GROUP BY user_id""")
def q_attendance_rollup(spark, d):
    att = attendance(spark, d)
    n_days = load(spark, d, "events").agg(F.count_distinct(F.col("ts").cast("date")).alias("n")).first()["n"]
    return att.groupBy("user_id").agg(
        F.count("hours").cast("long").alias("days_present"),
        (F.lit(n_days) - F.count("hours")).cast("long").alias("days_absent"),
        r6(F.avg("hours")).alias("mean_hours"))


@register("arg_max", sql=f"""
WITH {INVESTMENTS_SQL},
m AS (SELECT round_type, avg(amount) AS mean_amount FROM investments GROUP BY round_type)
SELECT round_type, round(mean_amount, 6) AS mean_amount FROM m
WHERE mean_amount BETWEEN 40000 AND 60000 ORDER BY mean_amount DESC, round_type LIMIT 1""")
def q_arg_max(spark, d):
    means = investments(spark, d).groupBy("round_type").agg(F.avg("amount").alias("mean_amount"))
    best = agg.arg_max(means.filter(F.col("mean_amount").between(40000, 60000)), "round_type", "mean_amount")
    return best.select("round_type", r6("mean_amount").alias("mean_amount"))


@register("top_k", sql=f"""
WITH {INVESTMENTS_SQL}
SELECT country, round(sum(amount), 2) AS total FROM investments WHERE round_type = '{CHOSEN_ROUND}'
GROUP BY country ORDER BY sum(amount) DESC, country LIMIT 9""")
def q_top_k(spark, d):
    inv = investments(spark, d).filter(F.col("round_type") == CHOSEN_ROUND)
    per_country = inv.groupBy("country").agg(F.sum("amount").alias("total"))
    return agg.top_k(per_country, [F.col("total").desc(), F.col("country")], 9) \
        .select("country", r6("total", 2).alias("total"))


_SECTOR_COUNTS_SQL = f"""{INVESTMENTS_SQL},
sc AS (SELECT country, sector, count(*) AS n, sum(amount) AS total FROM investments
       WHERE round_type = '{CHOSEN_ROUND}' AND amount BETWEEN {AMOUNT_LO} AND {AMOUNT_HI} GROUP BY country, sector),
ranked AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, sector) AS rank FROM sc)"""


def _sector_counts(spark, d):
    inv = investments(spark, d).filter((F.col("round_type") == CHOSEN_ROUND)
                                       & F.col("amount").between(AMOUNT_LO, AMOUNT_HI))
    return inv, inv.groupBy("country", "sector").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                                     F.sum("amount").alias("total"))


@register("top_k_per_group", sql=f"""
WITH {_SECTOR_COUNTS_SQL}
SELECT country, sector, CAST(n AS BIGINT) AS n, round(total, 2) AS total, CAST(rank AS BIGINT) AS rank
FROM ranked WHERE rank <= 3""")
def q_top_k_per_group(spark, d):
    _, sc = _sector_counts(spark, d)
    top = agg.top_k_per_group(sc, ["country"], [F.col("n").desc(), F.col("sector")], 3)
    return top.select("country", "sector", "n", r6("total", 2).alias("total"), "rank")


@register("top_company_in_top_sector", sql=f"""
WITH {_SECTOR_COUNTS_SQL},
cc AS (SELECT i.country, r.rank AS sector_rank, i.sector, i.company, sum(i.amount) AS company_total
       FROM investments i JOIN ranked r ON i.country = r.country AND i.sector = r.sector AND r.rank <= 2
       WHERE i.round_type = '{CHOSEN_ROUND}' AND i.amount BETWEEN {AMOUNT_LO} AND {AMOUNT_HI}
       GROUP BY 1, 2, 3, 4),
best AS (SELECT *, row_number() OVER (PARTITION BY country, sector_rank ORDER BY company_total DESC, company) AS rn FROM cc)
SELECT country, CAST(sector_rank AS BIGINT) AS sector_rank, sector, company, round(company_total, 2) AS company_total
FROM best WHERE rn = 1""")
def q_top_company(spark, d):
    # one pass over the line items: aggregate at (country, sector, company) and roll the
    # sector counts up from that small table, so both branches read the same aggregate
    inv = investments(spark, d).filter((F.col("round_type") == CHOSEN_ROUND)
                                       & F.col("amount").between(AMOUNT_LO, AMOUNT_HI))
    per_company = inv.groupBy("country", "sector", "company").agg(
        F.count(F.lit(1)).alias("n_c"), F.sum("amount").alias("company_total"))
    sc = per_company.groupBy("country", "sector").agg(F.sum("n_c").cast("long").alias("n"))
    top2 = agg.top_k_per_group(sc, ["country"], [F.col("n").desc(), F.col("sector")], 2, rank_col="sector_rank")
    cc = per_company.join(top2.select("country", "sector", "sector_rank"), ["country", "sector"])
    best = agg.top_k_per_group(cc, ["country", "sector_rank"], [F.col("company_total").desc(), F.col("company")], 1)
    return best.select("country", "sector_rank", "sector", "company", r6("company_total", 2).alias("company_total"))


@register("prop_table", sql=f"""
WITH {APPLICANTS_SQL}
SELECT y, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS prop
FROM applicants GROUP BY y""")
def q_prop_table(spark, d):
    out = agg.prop_table(applicants(spark, d), "y").withColumn("n", F.col("n").cast("long"))
    return out.select("y", "n", r6("prop").alias("prop"))


@register("response_rate", sql=f"""
WITH {APPLICANTS_SQL} SELECT round(avg(y), 6) AS response_rate, CAST(count(*) AS BIGINT) AS n FROM applicants""")
def q_response_rate(spark, d):
    return applicants(spark, d).agg(r6(F.avg("y")).alias("response_rate"), F.count(F.lit(1)).cast("long").alias("n"))


# The five order priorities of the test tables (columns of the oracle).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("crosstab", sql=f"""
WITH {APPLICANTS_SQL}
SELECT c_mktsegment, """ + ", ".join(
    f"""CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS BIGINT) AS "{p}\"""" for p in PRIORITIES) + """
FROM applicants GROUP BY c_mktsegment""")
def q_crosstab(spark, d):
    return agg.crosstab(applicants(spark, d), "c_mktsegment", "o_orderpriority")


@register("crosstab_long", sql=f"""
WITH {APPLICANTS_SQL}
SELECT c_mktsegment, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM applicants GROUP BY 1, 2""")
def q_crosstab_long(spark, d):
    return agg.crosstab_long(applicants(spark, d), "c_mktsegment", "o_orderpriority")


@register("corr_pair", sql=f"""
WITH {APPLICANTS_SQL} SELECT round(corr(o_totalprice, c_acctbal), 6) AS corr,
round(corr(o_totalprice, p), 6) AS corr_price_score FROM applicants""")
def q_corr_pair(spark, d):
    a = applicants(spark, d)
    return a.agg(r6(F.corr("o_totalprice", "c_acctbal")).alias("corr"),
                 r6(F.corr("o_totalprice", "p")).alias("corr_price_score"))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_matrix", sql="\nUNION ALL\n".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i:]))
def q_corr_matrix(spark, d):
    out = agg.corr_matrix(load(spark, d, "lineitem"), _CORR_COLS)
    return out.select("var_a", "var_b", r6("corr").alias("corr"))


_EMB_DIMS = 64


@register("cov_matrix", sql="""
WITH u AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(0, 64) t(i))
SELECT 'e' || a.i AS var_a, 'e' || b.i AS var_b, round(covar_samp(a.x, b.x), 8) AS cov
FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""")
def q_cov_matrix(spark, d):
    out = agg.array_covariance(load(spark, d, "embeddings"), "embedding", _EMB_DIMS)
    name = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    return out.select(name("i").alias("var_a"), name("j").alias("var_b"), r6("cov", 8).alias("cov"))


@register("ntile_score", sql=f"""
WITH {APPLICANTS_SQL}
SELECT app_id, CAST(ntile(10) OVER (ORDER BY p DESC, app_id) AS BIGINT) AS tile FROM applicants""")
def q_ntile_score(spark, d):
    a = applicants(spark, d).select("app_id", "p")
    return global_ntile(a, [F.col("p").desc(), F.col("app_id")], 10).select("app_id", "tile")


