"""Stand-in frames built from the test tables (see SURVEY §7.1), each with the
same frame written as a DuckDB common table expression for the oracles."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.scalars import sigmoid
from quire.sources.tables import load

# Fixed value: the reference's forecasting hold-out length.
HOLDOUT_MONTHS = 6

# Segments.
SEGMENT_ORDERS_SQL = f"""
seg_orders AS (
  SELECT o.o_orderkey, r.r_name || '_' || c.c_mktsegment AS segment,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
         o.o_totalprice
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE o.o_orderdate < (SELECT CASE WHEN CAST(max(o_orderdate) AS DATE) = last_day(max(o_orderdate))
                                     THEN last_day(max(o_orderdate)) + INTERVAL 1 DAY
                                     ELSE date_trunc('month', max(o_orderdate)) END FROM orders))"""


def segment_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders labelled with the region_segment key and their calendar month.  The last
    month is left out unless the data reach its last day.

    nation (25 rows) and region (5 rows) have fixed sizes, so they are
    broadcast; orders x customer is a shuffle join that AQE may re-plan."""
    orders = load(spark, d, "orders")
    last = orders.agg(F.max(F.col("o_orderdate").cast("date")).alias("m")).first()["m"]
    if last is not None:
        complete = (last + timedelta(days=1)).day == 1
        end = last + timedelta(days=1) if complete else last.replace(day=1)
        orders = orders.filter(F.col("o_orderdate") < F.expr(f"TIMESTAMP_NTZ '{end} 00:00:00'"))
    geo = F.broadcast(load(spark, d, "nation")).join(
        F.broadcast(load(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    cust = load(spark, d, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.concat_ws("_", "r_name", "c_mktsegment").alias("segment"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"),
        "o_totalprice",
    )


# Applicants.
# Coefficients of the deterministic score used wherever an
# evaluation needs a probability that DuckDB can recompute exactly.
# The linear term is summed in integers and divided once, so equal scores are
# bit-identical in every engine (ties then order by the key everywhere).
SCORE_Z_SQL = ("(CAST(-90 - 15 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
               " + 5 * CAST(floor(o_totalprice / 25000.0) AS INTEGER)"
               " + CASE WHEN c_acctbal < 0 THEN 40 ELSE 0 END"
               " - 10 * (CAST(year(o_orderdate) AS INTEGER) - 1998) AS DOUBLE) / 100.0)")

APPLICANTS_SQL = f"""
applicants AS (
  SELECT o.o_orderkey AS app_id,
         CAST(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS y,
         o.o_totalprice, c.c_acctbal, c.c_mktsegment, o.o_orderpriority, n.n_name,
         CAST(year(o.o_orderdate) AS INTEGER) AS order_year,
         1.0 / (1.0 + exp(-{SCORE_Z_SQL})) AS p
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def applicants(spark: SparkSession, d: str) -> DataFrame:
    """Application-level frame: key, 0/1 outcome, numbers, categories, score p."""
    o = load(spark, d, "orders")
    c = load(spark, d, "customer")
    n = F.broadcast(load(spark, d, "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    z = F.expr(SCORE_Z_SQL)
    return j.select(
        F.col("o_orderkey").alias("app_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("y"),
        "o_totalprice", "c_acctbal", "c_mktsegment", "o_orderpriority", "n_name",
        F.year("o_orderdate").cast("int").alias("order_year"),
        sigmoid(z).alias("p"),
    )


# Series.
SERIES_SQL = f"""{SEGMENT_ORDERS_SQL},
series_raw AS (
  SELECT segment || '|sales' AS series_id, month, sum(o_totalprice) AS value
  FROM seg_orders GROUP BY segment, month
  UNION ALL
  SELECT segment || '|quantity' AS series_id, month, CAST(count(*) AS DOUBLE) AS value
  FROM seg_orders GROUP BY segment, month),
series AS (
  SELECT series_id, month,
         CAST(row_number() OVER (PARTITION BY series_id ORDER BY month) AS BIGINT) AS t,
         value
  FROM series_raw)"""


def segment_series(spark: SparkSession, d: str) -> DataFrame:
    """Long monthly series (series_id, month, t, value): both measures of every
    segment, t = 1..n over the months present."""
    from quire.operators.timeseries import monthly_index
    so = segment_orders(spark, d)
    return monthly_index(so, keys=["segment"], period="month",
                         measures={"sales": F.sum("o_totalprice"),
                                   "quantity": F.count(F.lit(1)).cast("double")})


# Attendance.
ATTENDANCE_SQL = """
attendance AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3600.0 AS hours
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""


def attendance(spark: SparkSession, d: str) -> DataFrame:
    """Per (user, day): hours between first and last event (the in/out times)."""
    from quire.functions.scalars import elapsed_hours
    ev = load(spark, d, "events").select("user_id", "ts")
    per_day = ev.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.min("ts").alias("t_in"), F.max("ts").alias("t_out"))
    return per_day.select("user_id", "day", elapsed_hours("t_in", "t_out").alias("hours"))


# Investments.
INVESTMENTS_SQL = """
investments AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag AS round_type, l.l_extendedprice AS amount,
         s.s_name AS company, n.n_name AS country, split_part(p.p_name, ' ', 1) AS category,
         p.p_type AS sector
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


def investments(spark: SparkSession, d: str) -> DataFrame:
    """Funding-round stand-in: one row per line item with its round type, amount,
    funded company (supplier), country, category and sector."""
    from quire.functions.scalars import first_token
    li = load(spark, d, "lineitem")
    part = load(spark, d, "part")
    sup = load(spark, d, "supplier")
    nat = F.broadcast(load(spark, d, "nation"))
    j = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
           .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
           .join(nat, F.col("s_nationkey") == F.col("n_nationkey")))
    return j.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("round_type"),
                    F.col("l_extendedprice").alias("amount"), F.col("s_name").alias("company"),
                    F.col("n_name").alias("country"), first_token("p_name", " ").alias("category"),
                    F.col("p_type").alias("sector"))


# Attrition.
def attrition(spark: SparkSession, d: str) -> DataFrame:
    """Employee-file stand-in: labelled documents.  Outcome = ``toxic``; numbers are
    measured on the whole text (characters, words, lines); categories = lang, source."""
    docs = load(spark, d, "documents")
    lab = load(spark, d, "labels")
    j = docs.join(lab, "doc_id")
    return j.select(
        "doc_id", F.col("toxic").cast("int").alias("y"), F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(F.col("text"), "\n")).cast("double").alias("n_lines"),
        "lang", "source", F.col("quality").cast("int").alias("quality"))


def materialised(df: DataFrame) -> DataFrame:
    """Write a derived frame once (reliable checkpoint in the shared folder) before an
    operator that reads it in several passes, so the joins that built it run once."""
    from quire.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
