"""Queries for §2.6: the tables behind bar, stacked-bar, histogram and box charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.operators import charts
from quire.plans.catalog import register
from quire.plans.standins import APPLICANTS_SQL, SEGMENT_ORDERS_SQL, applicants, attrition, segment_orders
from quire.sources.tables import load


@register("bar_counts", sql=f"""
WITH {APPLICANTS_SQL} SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM applicants GROUP BY 1""")
def q_bar_counts(spark, d):
    return charts.bar_counts(applicants(spark, d), "o_orderpriority")


@register("share_within", sql=f"""
WITH {APPLICANTS_SQL}
SELECT c_mktsegment, y, CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share
FROM applicants GROUP BY 1, 2""")
def q_share_within(spark, d):
    out = charts.share_within(applicants(spark, d), "c_mktsegment", "y")
    return out.select("c_mktsegment", "y", "n", r6("share").alias("share"))


@register("share_faceted", sql=f"""
WITH {APPLICANTS_SQL}
SELECT n_name, o_orderpriority, y, CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY n_name, o_orderpriority), 6) AS share
FROM applicants GROUP BY 1, 2, 3""")
def q_share_faceted(spark, d):
    out = charts.share_within(applicants(spark, d), "o_orderpriority", "y", facets=["n_name"])
    return out.select("n_name", "o_orderpriority", "y", "n", r6("share").alias("share"))


@register("histogram", sql="""
SELECT event_type, CAST(ceil(value / 25.0 - 0.5) AS BIGINT) AS bin, ceil(value / 25.0 - 0.5) * 25.0 AS center,
       (ceil(value / 25.0 - 0.5) - 0.5) * 25.0 AS lo, (ceil(value / 25.0 - 0.5) + 0.5) * 25.0 AS hi,
       CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2, 3, 4, 5""")
def q_histogram(spark, d):
    return charts.histogram(load(spark, d, "events"), "value", 25.0, groups=["event_type"])


@register("histogram_share", sql=f"""
WITH {APPLICANTS_SQL}
SELECT CAST(ceil(c_acctbal / 1000.0 - 0.5) AS BIGINT) AS bin, y, CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY CAST(ceil(c_acctbal / 1000.0 - 0.5) AS BIGINT)), 6) AS share
FROM applicants GROUP BY 1, 2""")
def q_histogram_share(spark, d):
    out = charts.histogram_share(applicants(spark, d), "c_acctbal", 1000.0, "y")
    return out.select("bin", "y", "n", r6("share").alias("share"))


@register("box_stats", sql="""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       CAST(count(*) AS BIGINT) AS n,
       round(min(CASE WHEN value BETWEEN lo AND hi THEN value END), 6) AS whisker_low,
       round(max(CASE WHEN value BETWEEN lo AND hi THEN value END), 6) AS whisker_high,
       CAST(sum(CASE WHEN value BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM events e JOIN f ON e.event_type = f.event_type GROUP BY f.event_type, q1, median, q3""")
def q_box_stats(spark, d):
    out = charts.box_stats(load(spark, d, "events"), "event_type", "value")
    return out.select("event_type", *[r6(c).alias(c) for c in ["q1", "median", "q3"]], "n",
                      r6("whisker_low").alias("whisker_low"), r6("whisker_high").alias("whisker_high"), "n_outliers")


@register("segment_month_series", sql=f"""
WITH {SEGMENT_ORDERS_SQL}
SELECT segment, month, round(sum(o_totalprice), 2) AS sales, CAST(count(*) AS BIGINT) AS quantity
FROM seg_orders GROUP BY 1, 2""")
def q_segment_month_series(spark, d):
    out = charts.segment_month_series(segment_orders(spark, d), ["segment"], "month",
                                      {"sales": F.sum("o_totalprice"), "quantity": F.count(F.lit(1)).cast("long")})
    return out.select("segment", "month", r6("sales", 2).alias("sales"), "quantity")


_ATTRITION_SQL = """
att AS (SELECT d.doc_id, CAST(l.toxic AS INTEGER) AS y, CAST(d.n_chars AS DOUBLE) AS n_chars,
               CAST(len(regexp_split_to_array(trim(d.text), '\\s+')) AS DOUBLE) AS n_words, d.lang
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@register("attrition_word_histogram", sql=f"""
WITH {_ATTRITION_SQL}
SELECT CAST(ceil(n_words / 500.0 - 0.5) AS BIGINT) AS bin, y, CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY CAST(ceil(n_words / 500.0 - 0.5) AS BIGINT)), 6) AS share
FROM att GROUP BY 1, 2""")
def q_attrition_word_histogram(spark, d):
    """Class shares per word-count bin of the whole texts (the attrition histograms)."""
    out = charts.histogram_share(attrition(spark, d), "n_words", 500.0, "y")
    return out.select("bin", "y", "n", r6("share").alias("share"))
