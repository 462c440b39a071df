"""Queries for §2.1: readers (round trips through delimited files), shape,
schema profile, summary and describe."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.scalars import r6
from quire.operators import profile
from quire.plans.catalog import register
from quire.plans.sqlgen import long_stats_sql
from quire.sources.readers import read_headerless, read_table, scratch_path, write_delimited
from quire.sources.tables import load

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType())])
SUPPLIER_SCHEMA = "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"

# The missing-value spellings of the reference inputs.
NULL_TOKENS = ("", " ", "NA", "n/a")
TOKEN_CASE_SQL = ("CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'NA' "
                  "WHEN 3 THEN 'n/a' ELSE c_mktsegment END")


@register("scan_csv_roundtrip", sql="SELECT * FROM customer")
def q_scan_csv(spark, d):
    path = write_delimited(load(spark, d, "customer"), scratch_path(spark, "csv"))
    return read_table(spark, path, schema=CUSTOMER_SCHEMA)


@register("scan_tsv_roundtrip", sql="SELECT * FROM supplier")
def q_scan_tsv(spark, d):
    path = write_delimited(load(spark, d, "supplier"), scratch_path(spark, "tsv"), sep="\t")
    return read_table(spark, path, schema=SUPPLIER_SCHEMA, sep="\t")


@register("scan_headerless", sql="""
SELECT p_partkey, p_name AS V2, p_brand AS V3, p_type AS V4, p_size AS V5, p_retailprice AS V6 FROM part""")
def q_scan_headerless(spark, d):
    path = write_delimited(load(spark, d, "part"), scratch_path(spark, "nohdr"), header=False)
    types = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.IntegerType(), T.DoubleType()]
    return read_headerless(spark, path, types, first_name="p_partkey")


@register("null_tokens", sql=f"""
SELECT c_custkey, CASE WHEN note IN ('', ' ', 'NA', 'n/a') THEN NULL ELSE note END AS note
FROM (SELECT c_custkey, {TOKEN_CASE_SQL} AS note FROM customer)""")
def q_null_tokens(spark, d):
    raw = load(spark, d, "customer").select("c_custkey", F.expr(TOKEN_CASE_SQL).alias("note"))
    path = write_delimited(raw, scratch_path(spark, "tokens"))
    return read_table(spark, path, schema="c_custkey BIGINT, note STRING", null_tokens=NULL_TOKENS)


@register("table_shape", sql="SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def q_table_shape(spark, d):
    return profile.table_shape(load(spark, d, "lineitem"))


# The columns of orders and their types as Spark names them.
_ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
           ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def _profile_sql(order: str) -> str:
    parts = [f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type, "
             f"string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY o_orderkey {order}) AS \"values\" FROM h"
             for i, (c, t) in enumerate(_ORDERS, 1)]
    return f"WITH h AS (SELECT * FROM orders ORDER BY o_orderkey {order} LIMIT 3) " + " UNION ALL ".join(parts)


@register("schema_profile", sql=_profile_sql("ASC"))
def q_schema_profile(spark, d):
    return profile.schema_profile(load(spark, d, "orders"), ["o_orderkey"], n=3)


@register("schema_profile_tail", sql=_profile_sql("DESC"))
def q_schema_profile_tail(spark, d):
    return profile.schema_profile(load(spark, d, "orders"), ["o_orderkey"], n=3, tail=True)


EVENTS_NULLED_SQL = ("(SELECT event_id, user_id, event_type, ts, props, value, "
                     "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value_n FROM events)")


def events_nulled(spark, d):
    ev = load(spark, d, "events")
    return ev.withColumn("value_n", F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value")))


_SUMMARY = {"min": "min({c})", "q1": "quantile_cont({c}, 0.25)", "median": "quantile_cont({c}, 0.5)",
            "mean": "avg({c})", "q3": "quantile_cont({c}, 0.75)", "max": "max({c})",
            "n_null": "count(*) - count({c})"}


@register("numeric_summary", sql=long_stats_sql(EVENTS_NULLED_SQL, ["value", "value_n", "user_id"], _SUMMARY))
def q_numeric_summary(spark, d):
    out = profile.numeric_summary(events_nulled(spark, d), ["value", "value_n", "user_id"])
    return out.select("column", "stat", r6("value").alias("value"))


@register("level_counts", sql="""
SELECT 'o_orderstatus' AS column, o_orderstatus AS level, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2
UNION ALL
SELECT 'o_orderpriority', o_orderpriority, CAST(count(*) AS BIGINT) FROM orders GROUP BY 2""")
def q_level_counts(spark, d):
    return profile.level_counts(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def _describe_sql(source: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS column, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd,
       round(quantile_cont(x, 0.5), 6) AS median,
       round(avg(CASE WHEN r > floor(cnt * 0.1) AND r <= cnt - floor(cnt * 0.1) THEN x END), 6) AS trimmed,
       round(1.4826 * quantile_cont(abs(x - med), 0.5), 6) AS mad,
       round(min(x), 6) AS min, round(max(x), 6) AS max, round(max(x) - min(x), 6) AS range,
       round(avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) * power((count(*) - 1.0) / count(*), 1.5), 6) AS skew,
       round((avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2)) * power((count(*) - 1.0) / count(*), 2) - 3, 6) AS kurtosis,
       round(stddev_samp(x) / sqrt(count(*)), 6) AS se
FROM (SELECT CAST({c} AS DOUBLE) AS x,
             row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS cnt,
             avg(CAST({c} AS DOUBLE)) OVER () AS mu,
             quantile_cont(CAST({c} AS DOUBLE), 0.5) OVER () AS med
      FROM {source} WHERE {c} IS NOT NULL)""")
    return "\nUNION ALL\n".join(parts)


@register("describe_table", sql=_describe_sql("events", ["value", "user_id"]))
def q_describe_table(spark, d):
    out = profile.describe_table(load(spark, d, "events"), ["value", "user_id"])
    return out.select("column", "n", *[r6(c).alias(c) for c in
                                       ["mean", "sd", "median", "trimmed", "mad", "min", "max", "range",
                                        "skew", "kurtosis", "se"]])
