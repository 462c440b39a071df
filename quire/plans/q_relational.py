"""Queries for §2.4: joins, reshaping and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.operators import relational as R
from quire.plans.catalog import register
from quire.plans.standins import APPLICANTS_SQL, INVESTMENTS_SQL, applicants, investments
from quire.sources.tables import load



@register("join_inner", sql="""
SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_join_inner(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return R.join_on(o, c, ["o_custkey"], ["c_custkey"]).drop("o_custkey")


@register("join_chain", sql=f"""
WITH {INVESTMENTS_SQL}
SELECT l_orderkey, l_linenumber, round_type, amount, company, country, category, sector FROM investments""")
def q_join_chain(spark, d):
    return investments(spark, d)


@register("join_left", sql="""
SELECT c.c_custkey, n.n_name FROM customer c
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON c.c_nationkey = n.n_nationkey""")
def q_join_left(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(load(spark, d, "nation").filter(F.col("n_regionkey") != 2))
    return R.join_on(c, n, ["c_nationkey"], ["n_nationkey"], how="left").select("c_custkey", "n_name")


@register("join_anti", sql="""
SELECT 'customer_without_orders' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL
SELECT 'part_never_sold', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL
SELECT 'customer_without_2001_orders', c_custkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')""")
def q_join_anti(spark, d):
    a = R.anti_keys(load(spark, d, "customer"), load(spark, d, "orders"), "c_custkey", "o_custkey")
    b = R.anti_keys(load(spark, d, "part"), load(spark, d, "lineitem"), "p_partkey", "l_partkey")
    recent = load(spark, d, "orders").filter(F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00'"))
    c = R.anti_keys(load(spark, d, "customer"), recent, "c_custkey", "o_custkey")
    return R.union_all([
        a.select(F.lit("customer_without_orders").alias("kind"), F.col("c_custkey").alias("id")),
        b.select(F.lit("part_never_sold").alias("kind"), F.col("p_partkey").alias("id")),
        c.select(F.lit("customer_without_2001_orders").alias("kind"), F.col("c_custkey").alias("id"))])


@register("unpivot_nonzero", sql="""
SELECT n.n_name, r.r_name AS region, CAST(count(*) AS BIGINT) AS member
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""")
def q_unpivot_nonzero(spark, d):
    """Wide 0/1 membership table (one column per region, like the sector mapping) back to long,
    dropping the zero cells."""
    n = load(spark, d, "nation")
    r = F.broadcast(load(spark, d, "region"))
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name")
    wide = R.wide_presence(j, "n_name", "r_name")
    return R.unpivot_long(wide, ["n_name"], wide.columns[1:], "region", "member", drop_zero=True)


@register("unpivot_ids", sql="""
SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def q_unpivot_ids(spark, d):
    li = load(spark, d, "lineitem")
    return R.unpivot_long(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@register("union_all", sql="""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 400000""")
def q_union_all(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.union_all([o.filter(F.col("o_orderstatus") == "F"), o.filter(F.col("o_orderstatus") == "O"),
                        o.filter(F.col("o_totalprice") > 400000).select("o_totalprice", "o_orderkey", "o_orderstatus")])


@register("bind_by_key", sql=f"""
WITH {APPLICANTS_SQL}
SELECT o.o_orderkey AS app_id, o.o_orderdate, round(a.p, 6) AS p
FROM orders o JOIN applicants a ON o.o_orderkey = a.app_id""")
def q_bind_by_key(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("app_id"), "o_orderdate")
    scores = applicants(spark, d).select("app_id", r6("p").alias("p"))
    return R.bind_by_key(o, scores, "app_id")


@register("distinct_values", sql="""
SELECT DISTINCT c_mktsegment, c_nationkey FROM customer""")
def q_distinct_values(spark, d):
    return load(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()
