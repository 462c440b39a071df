"""Queries for §2.3: filters, conditional columns and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.plans.catalog import register
from quire.plans.standins import ATTENDANCE_SQL, attendance
from quire.sources.tables import load

# The reference's income bucket bounds and labels, and its
# account-count bucket bounds and labels.
INCOME_BOUNDS = [25000, 75000, 150000, 300000]
INCOME_LABELS = ["< 25000", "25000-75000", "75000-150000", "150000 - 300000", ">300000"]
ACC_BOUNDS = [12, 24]
ACC_LABELS = ["< 12", "12 to 24", "> 24"]

# Order-priority recoding (ordered level map).
PRIORITY_LABELS = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium",
                   "4-NOT SPECIFIED": "Unspecified", "5-LOW": "Low"}


@register("filter_predicates", sql="""
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity FROM lineitem
WHERE (l_returnflag = 'R' OR l_linestatus = 'O') AND l_discount IS NOT NULL AND l_quantity > 10""")
def q_filter_predicates(spark, d):
    li = load(spark, d, "lineitem")
    return li.filter(((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O"))
                     & F.col("l_discount").isNotNull() & (F.col("l_quantity") > 10)) \
             .select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")


@register("filter_range", sql="""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000""")
def q_filter_range(spark, d):
    return load(spark, d, "orders").filter(F.col("o_totalprice").between(50000, 150000)) \
        .select("o_orderkey", "o_totalprice")


@register("case_when", sql="""
SELECT o_orderkey,
       CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS price_band,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS is_final
FROM orders""")
def q_case_when(spark, d):
    o = load(spark, d, "orders")
    band = F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low")
    return o.select("o_orderkey", band.alias("price_band"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("is_final"))


def _bucket_sql(x: str, bounds, labels) -> str:
    conds = [f"{x} < {bounds[0]}", f"{x} >= {bounds[0]} AND {x} <= {bounds[1]}"]
    conds += [f"{x} > {bounds[i - 1]} AND {x} <= {bounds[i]}" for i in range(2, len(bounds))]
    conds.append(f"{x} > {bounds[-1]}")
    whens = " ".join(f"WHEN {c} THEN '{lab}'" for c, lab in reversed(list(zip(conds, labels))))
    return f"CASE {whens} END"


@register("bucket_labels", sql=f"""
SELECT o.o_orderkey, {_bucket_sql('o.o_totalprice', INCOME_BOUNDS, INCOME_LABELS)} AS income_bucket,
       {_bucket_sql('n_lines', ACC_BOUNDS, ACC_LABELS).replace("n_lines", "l.n_lines")} AS lines_bucket
FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_quantity) / 4 AS n_lines FROM lineitem GROUP BY l_orderkey) l
  ON o.o_orderkey = l.l_orderkey""")
def q_bucket_labels(spark, d):
    o = load(spark, d, "orders")
    li = load(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") / 4).alias("n_lines"))
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    return j.select("o_orderkey", S.bucketize("o_totalprice", INCOME_BOUNDS, INCOME_LABELS).alias("income_bucket"),
                    S.bucketize("n_lines", ACC_BOUNDS, ACC_LABELS).alias("lines_bucket"))


@register("cut_bins", sql="""
SELECT p_partkey,
       CASE WHEN p_retailprice > 900 AND p_retailprice <= 1000
            THEN '(' || CAST(900 + (ceil((p_retailprice - 900) / 20.0) - 1) * 20 AS BIGINT) || ','
                     || CAST(900 + ceil((p_retailprice - 900) / 20.0) * 20 AS BIGINT) || ']' END AS price_bin
FROM part""")
def q_cut_bins(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", S.cut_bins("p_retailprice", 900, 1000, 20).alias("price_bin"))


@register("recode_levels", sql="""
SELECT o_orderkey, CASE o_orderpriority """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_LABELS.items()) + """ END AS priority FROM orders""")
def q_recode_levels(spark, d):
    m = F.create_map(*[F.lit(x) for kv in PRIORITY_LABELS.items() for x in kv])
    o = load(spark, d, "orders")
    return o.select("o_orderkey", m[F.col("o_orderpriority")].alias("priority"))


@register("string_case", sql="""
SELECT p_partkey, lower(p_brand) AS brand_lower, upper(p_name) AS name_upper,
       upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name_firstup FROM part""")
def q_string_case(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", F.lower("p_brand").alias("brand_lower"), F.upper("p_name").alias("name_upper"),
                    S.firstup("p_name").alias("name_firstup"))


@register("string_replace", sql="""
SELECT p_partkey, regexp_replace(p_brand, 'Brand#', '', 'g') AS brand_no,
       replace(p_name, ' ', '_') AS name_key FROM part""")
def q_string_replace(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").alias("brand_no"),
                    F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name_key"))


@register("split_first", sql="""
SELECT p_partkey, split_part(p_name, ' ', 1) AS category FROM part""")
def q_split_first(spark, d):
    return load(spark, d, "part").select("p_partkey", S.first_token("p_name", " ").alias("category"))


@register("concat_trim", sql="""
SELECT c_custkey, trim('  ' || c_mktsegment || '_' || c_name || ' ') AS label FROM customer""")
def q_concat_trim(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", F.trim(F.concat(F.lit("  "), F.concat_ws("_", "c_mktsegment", "c_name"),
                                                 F.lit(" "))).alias("label"))


@register("try_numeric", sql="""
SELECT p_partkey, TRY_CAST(txt AS DOUBLE) AS brand_num,
       TRY_CAST(regexp_replace(txt, '[^0-9.+-]', '', 'g') AS DOUBLE) AS brand_num_stripped
FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN replace(p_brand, 'Brand#', '') || ' years'
                             ELSE replace(p_brand, 'Brand#', '') END AS txt FROM part)""")
def q_try_numeric(spark, d):
    p = load(spark, d, "part")
    txt = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit(" years"))) \
           .otherwise(F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    return p.select("p_partkey", txt.alias("txt")).select(
        "p_partkey", S.try_numeric("txt").alias("brand_num"),
        S.try_numeric(S.strip_non_numeric("txt")).alias("brand_num_stripped"))


@register("month_key", sql="""
SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y') AS DATE) AS order_day,
       strftime(o_orderdate, '%y-%m') AS month_key FROM orders""")
def q_month_key(spark, d):
    o = load(spark, d, "orders")
    text = F.date_format("o_orderdate", "dd-MM-yyyy")
    day = S.parse_date(text, "dd-MM-yyyy")
    return o.select("o_orderkey", day.alias("order_day"), S.month_key(day).alias("month_key"))


@register("elapsed_hours", sql=f"""
WITH {ATTENDANCE_SQL} SELECT user_id, day, round(hours, 6) AS hours FROM attendance""")
def q_elapsed_hours(spark, d):
    return attendance(spark, d).select("user_id", "day", S.r6("hours").alias("hours"))


@register("round_even", sql="""
SELECT l_orderkey, l_linenumber, round_even(CAST(l_linenumber AS DOUBLE) + 0.5, 0) AS half_even,
       round_even(l_quantity / 4.0, 0) AS qty_quarters, round_even(l_quantity / 8.0, 2) AS qty_eighths FROM lineitem""")
def q_round_even(spark, d):
    li = load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.round_even(F.col("l_linenumber") + 0.5, 0).alias("half_even"),
                     S.round_even(F.col("l_quantity") / 4.0, 0).alias("qty_quarters"),
                     S.round_even(F.col("l_quantity") / 8.0, 2).alias("qty_eighths"))


@register("math_scalars", sql="""
SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS ln_qty, round(exp(l_discount), 6) AS exp_disc,
       round(sin(0.5 * l_quantity), 6) AS sin_q, round(cos(0.6 * l_quantity), 6) AS cos_q,
       round(power(l_quantity, 3), 6) AS qty_cubed FROM lineitem""")
def q_math_scalars(spark, d):
    li = load(spark, d, "lineitem")
    q = F.col("l_quantity")
    return li.select("l_orderkey", "l_linenumber", S.r6(F.log(q)).alias("ln_qty"),
                     S.r6(F.exp("l_discount")).alias("exp_disc"), S.r6(F.sin(q * 0.5)).alias("sin_q"),
                     S.r6(F.cos(q * 0.6)).alias("cos_q"), S.r6(F.pow(q, 3)).alias("qty_cubed"))


@register("month_token_date", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%b-%y') AS token,
       CAST(strptime(strftime(o_orderdate, '%b-%y'), '%b-%y') AS DATE) AS month_start FROM orders""")
def q_month_token_date(spark, d):
    """Month tokens such as 'Dec-11' parsed as month-year (not as a day of the month)."""
    o = load(spark, d, "orders")
    token = F.date_format("o_orderdate", "MMM-yy")
    return o.select("o_orderkey", token.alias("token"),
                    S.parse_two_digit_year_date(token, "MMM-yy").alias("month_start"))
