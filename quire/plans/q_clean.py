"""Queries for §2.2: projection, renaming, derived columns and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import r6, round_even
from quire.operators import clean
from quire.plans.catalog import register
from quire.plans.q_sources import EVENTS_NULLED_SQL, events_nulled
from quire.sources.tables import load


@register("project_columns", sql="""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders""")
def q_project(spark, d):
    o = load(spark, d, "orders")
    # by name, then by negation: drop what is not wanted
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate") \
            .drop("o_orderstatus")


@register("rename_columns", sql="""
SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation_id,
       c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def q_rename(spark, d):
    return load(spark, d, "customer").withColumnsRenamed({
        "c_custkey": "customer_id", "c_name": "name", "c_nationkey": "nation_id",
        "c_acctbal": "balance", "c_mktsegment": "segment"})


@register("derive_columns", sql="""
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net_price,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross_price,
       round_even(l_quantity / 12.0, 1) AS qty_years
FROM lineitem""")
def q_derive(spark, d):
    li = load(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", r6(net).alias("net_price"),
                     r6(net * (1 + F.col("l_tax"))).alias("gross_price"),
                     round_even(F.col("l_quantity") / 12.0, 1).alias("qty_years"))


# orders with one constant and one all-null column, as the loan file has
_ORDERS_PLUS_SQL = ("(SELECT *, 'x' AS const_col, CAST(NULL AS VARCHAR) AS null_col, "
                    "CASE WHEN o_orderkey % 2 = 0 THEN CAST(NULL AS VARCHAR) ELSE 'a' END AS half_null FROM orders)")


def _orders_plus(spark, d):
    return load(spark, d, "orders").withColumns({
        "const_col": F.lit("x"), "null_col": F.lit(None).cast("string"),
        "half_null": F.when(F.col("o_orderkey") % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("a"))})


_PLUS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
              "const_col", "null_col", "half_null"]


@register("drop_constant_columns", sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct, "
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 AS dropped FROM {_ORDERS_PLUS_SQL}"
    for c in _PLUS_COLS))
def q_drop_constant(spark, d):
    return clean.constant_columns_report(_orders_plus(spark, d))


@register("drop_all_null", sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS n_present, count({c}) = 0 AS dropped FROM {_ORDERS_PLUS_SQL}"
    for c in _PLUS_COLS))
def q_drop_all_null(spark, d):
    return clean.all_null_report(_orders_plus(spark, d))


_KEPT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "half_null"]


@register("drop_constant_columns_applied", sql=f"SELECT {', '.join(_KEPT)} FROM {_ORDERS_PLUS_SQL}")
def q_drop_constant_applied(spark, d):
    return clean.drop_constant_columns(_orders_plus(spark, d))


@register("drop_all_null_applied", sql=f"SELECT {', '.join([*_KEPT, 'const_col'])} FROM {_ORDERS_PLUS_SQL}")
def q_drop_all_null_applied(spark, d):
    return clean.drop_all_null(_orders_plus(spark, d))


_NZV_SRC = ("(SELECT l_quantity, l_discount, l_tax, l_linenumber, "
            "CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS rare_flag, 7 AS const_feature FROM lineitem)")


def _nzv_frame(spark, d):
    li = load(spark, d, "lineitem")
    return li.select("l_quantity", "l_discount", "l_tax", "l_linenumber",
                     F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0).alias("rare_flag"),
                     F.lit(7).alias("const_feature"))


_NZV_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "rare_flag", "const_feature"]


@register("near_zero_variance", sql="WITH " + ",\n".join(
    [f"""c_{c} AS (SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, count(*) AS cnt FROM {_NZV_SRC} GROUP BY 2),
s_{c} AS (SELECT feature, sum(cnt) AS n_rows, count(v) AS n_unique,
          max(cnt) AS top,
          (SELECT cnt FROM c_{c} WHERE v IS NOT NULL ORDER BY cnt DESC LIMIT 1 OFFSET 1) AS second
          FROM c_{c} WHERE v IS NOT NULL GROUP BY feature)""" for c in _NZV_COLS]) + """,
allf AS (""" + " UNION ALL ".join(f"SELECT * FROM s_{c}" for c in _NZV_COLS) + """)
SELECT feature,
       round(CASE WHEN n_unique <= 1 THEN 0.0 ELSE top * 1.0 / second END, 6) AS freq_ratio,
       round(n_unique * 100.0 / n_rows, 6) AS pct_unique,
       n_unique <= 1 AS zero_var,
       ((CASE WHEN n_unique <= 1 THEN 0.0 ELSE top * 1.0 / second END) > 19.0 AND n_unique * 100.0 / n_rows <= 10)
         OR n_unique <= 1 AS nzv
FROM allf""")
def q_nzv(spark, d):
    out = clean.near_zero_variance(_nzv_frame(spark, d), _NZV_COLS)
    return out.select("feature", r6("freq_ratio").alias("freq_ratio"), r6("pct_unique").alias("pct_unique"),
                      "zero_var", "nzv")


@register("near_zero_variance_applied", sql=f"SELECT l_quantity, l_discount, l_tax, l_linenumber FROM {_NZV_SRC}")
def q_nzv_applied(spark, d):
    """The frame without the features that the screen flags."""
    frame = _nzv_frame(spark, d)
    return clean.drop_near_zero_variance(clean.near_zero_variance(frame, _NZV_COLS), frame)[0]


@register("duplicate_whole_rows", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS n_distinct_rows,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS n_duplicate_rows FROM lineitem""")
def q_duplicate_whole_rows(spark, d):
    return clean.duplicate_rows(load(spark, d, "lineitem"))


@register("duplicate_rows", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST((SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS BIGINT) AS n_distinct_rows,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS BIGINT) AS n_duplicate_rows
FROM lineitem""")
def q_duplicate_rows(spark, d):
    return clean.duplicate_rows(load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@register("dedupe_first", sql="""
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice
FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice,
             row_number() OVER (PARTITION BY l_partkey
                                ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS rn
      FROM lineitem) WHERE rn = 1""")
def q_dedupe_first(spark, d):
    li = load(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey",
                                           "l_quantity", "l_extendedprice")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return clean.dedupe_first(li.withColumn("_ord", order), ["l_partkey"], "_ord").drop("_ord")


@register("key_uniqueness", sql="""
SELECT 'orders' AS tbl, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_keys,
       count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders
UNION ALL
SELECT 'lineitem', CAST(count(*) AS BIGINT), CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT),
       count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def q_key_uniqueness(spark, d):
    a = clean.key_uniqueness(load(spark, d, "orders"), ["o_orderkey"]).withColumn("tbl", F.lit("orders"))
    b = clean.key_uniqueness(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("tbl", F.lit("lineitem"))
    return a.unionByName(b)


_NULLS_SRC = ("(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value_n, "
              "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS type_n, "
              "CASE WHEN user_id % 13 = 0 THEN NULL ELSE props END AS props_n FROM events)")


def _nulls_frame(spark, d):
    ev = load(spark, d, "events")
    return ev.select("event_id",
                     F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value")).alias("value_n"),
                     F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_type")).alias("type_n"),
                     F.when(F.col("user_id") % 13 == 0, None).otherwise(F.col("props")).alias("props_n"))


@register("null_profile", sql=f"""
WITH t AS {_NULLS_SRC},
c AS (SELECT count(*) AS n,
             sum(CASE WHEN event_id IS NULL THEN 1 ELSE 0 END) AS event_id,
             sum(CASE WHEN value_n IS NULL THEN 1 ELSE 0 END) AS value_n,
             sum(CASE WHEN type_n IS NULL THEN 1 ELSE 0 END) AS type_n,
             sum(CASE WHEN props_n IS NULL THEN 1 ELSE 0 END) AS props_n,
             sum(CASE WHEN event_id IS NULL OR value_n IS NULL OR type_n IS NULL OR props_n IS NULL THEN 1 ELSE 0 END) AS anyn
      FROM t)
SELECT "column", CAST(n_null AS BIGINT) AS n_null, round(n_null * 100.0 / n, 6) AS pct_null FROM (
  SELECT 'event_id' AS column, event_id AS n_null, n FROM c UNION ALL
  SELECT 'value_n', value_n, n FROM c UNION ALL
  SELECT 'type_n', type_n, n FROM c UNION ALL
  SELECT 'props_n', props_n, n FROM c UNION ALL
  SELECT '__rows_with_null__', anyn, n FROM c UNION ALL
  SELECT '__total__', event_id + value_n + type_n + props_n, n FROM c)""")
def q_null_profile(spark, d):
    from quire.operators.profile import null_profile
    out = null_profile(_nulls_frame(spark, d))
    return out.select("column", "n_null", r6("pct_null").alias("pct_null"))


@register("invalid_profile", sql="""
WITH t AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE c_mktsegment END AS seg FROM customer)
SELECT 'c_custkey' AS column, CAST(0 AS BIGINT) AS n_blank, CAST(sum(CASE WHEN c_custkey < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative FROM t
UNION ALL SELECT 'c_acctbal', 0, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM t
UNION ALL SELECT 'seg', CAST(sum(CASE WHEN trim(seg) = '' THEN 1 ELSE 0 END) AS BIGINT), 0 FROM t""")
def q_invalid_profile(spark, d):
    from quire.operators.profile import invalid_profile
    c = load(spark, d, "customer").select(
        "c_custkey", "c_acctbal",
        F.when(F.col("c_custkey") % 9 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("seg"))
    return invalid_profile(c)


@register("drop_incomplete", sql=f"SELECT * FROM {_NULLS_SRC} WHERE value_n IS NOT NULL AND type_n IS NOT NULL AND props_n IS NOT NULL")
def q_drop_incomplete(spark, d):
    return _nulls_frame(spark, d).dropna(how="any")


@register("impute_median", sql=f"""
SELECT event_id, round(coalesce(value_n, (SELECT quantile_cont(value_n, 0.5) FROM {EVENTS_NULLED_SQL})), 6) AS value_n
FROM {EVENTS_NULLED_SQL}""")
def q_impute_median(spark, d):
    out = clean.impute_median(events_nulled(spark, d).select("event_id", "value_n"), ["value_n"])
    return out.select("event_id", r6("value_n").alias("value_n"))


@register("impute_constant", sql=f"""
SELECT event_id, coalesce(value_n, 0.0) AS value_n, coalesce(type_n, 'unknown') AS type_n FROM {_NULLS_SRC}""")
def q_impute_constant(spark, d):
    return clean.impute_constant(_nulls_frame(spark, d).select("event_id", "value_n", "type_n"),
                                 {"value_n": 0.0, "type_n": "unknown"})


@register("drop_invalid", sql="""
SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey >= 1""")
def q_drop_invalid(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return clean.drop_invalid(c, (F.col("c_acctbal") >= 0) & (F.col("c_nationkey") >= 1))


@register("cap_constant", sql="""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_quantity > 30 THEN 30.0 ELSE l_quantity END AS l_quantity FROM lineitem""")
def q_cap_constant(spark, d):
    """A NULL quantity (every seventh order) stays NULL."""
    li = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"))
    return clean.cap_constant(li, {"l_quantity": 30.0})


def _fence_sql(src: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS column, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
       CAST((SELECT count(*) FROM {src} WHERE {c} < q1 - 1.5 * (q3 - q1)) AS BIGINT) AS n_below,
       CAST((SELECT count(*) FROM {src} WHERE {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_above
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src})""")
    return "\nUNION ALL\n".join(parts)


@register("iqr_fences", sql=_fence_sql("lineitem", ["l_extendedprice", "l_quantity"])
          + "\nUNION ALL\n" + _fence_sql("events", ["value"]))
def q_iqr_fences(spark, d):
    li = clean.iqr_fences(load(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    ev = clean.iqr_fences(load(spark, d, "events"), ["value"])
    out = li.unionByName(ev)
    return out.select("column", *[r6(c).alias(c) for c in ["q1", "q3", "iqr", "lower", "upper"]],
                      "n_below", "n_above")


@register("iqr_cap", sql="""
SELECT event_id, round(least(value, (SELECT quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events)), 6) AS value
FROM events""")
def q_iqr_cap(spark, d):
    out = clean.iqr_cap(load(spark, d, "events").select("event_id", "value"), ["value"])
    return out.select("event_id", r6("value").alias("value"))


@register("percentile_table", sql="""
SELECT 'value' AS column, CAST(unnest(range(0, 101)) AS INTEGER) AS pct,
       round(unnest(quantile_cont(value, [""" + ", ".join(repr(round(i / 100, 2)) for i in range(101)) + """])), 6) AS value
FROM events""")
def q_percentile_table(spark, d):
    out = clean.percentile_table(load(spark, d, "events"), ["value"])
    return out.select("column", "pct", r6("value").alias("value"))


@register("semi_join_ids", sql="""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def q_semi_join(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    o = load(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi")


@register("columns_identical", sql="""
WITH l AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders),
r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS status2 FROM orders),
j AS (SELECT l.o_custkey AS a1, r.o_custkey AS b1, l.o_orderstatus AS a2, r.status2 AS b2
      FROM l FULL OUTER JOIN r ON l.o_orderkey = r.o_orderkey)
SELECT 'o_custkey' AS left_column, 'o_custkey' AS right_column,
       CAST(sum(CASE WHEN a1 IS NOT DISTINCT FROM b1 THEN 0 ELSE 1 END) AS BIGINT) AS n_mismatch FROM j
UNION ALL
SELECT 'o_orderstatus', 'status2', CAST(sum(CASE WHEN a2 IS NOT DISTINCT FROM b2 THEN 0 ELSE 1 END) AS BIGINT) FROM j""")
def q_columns_identical(spark, d):
    o = load(spark, d, "orders")
    r = o.select("o_orderkey", "o_custkey",
                 F.when(F.col("o_orderkey") % 97 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status2"))
    return clean.columns_identical(o, r, "o_orderkey", {"o_custkey": "o_custkey", "o_orderstatus": "status2"})
