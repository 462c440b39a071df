"""Plan properties the scale design relies on (checked on the physical plans)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from quire.operators.evaluate import cutoff_sweep
from quire.operators.features import balance_weights, hash_sample, shuffle_split, stratified_split
from quire.operators.rank import global_rank
from quire.operators.scorecard import scorecard_cutoffs


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_per_group_limits_before_the_shuffle(spark, sf_dir):
    plan = _plan(E.queries()["top_k_per_group"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") >= 2          # partial (map side) and final


def test_flagship_pushes_filter_and_prunes_columns(spark, sf_dir):
    df = E.queries()["segment_cov"](spark, sf_dir)
    formatted = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    explain = df._jdf.queryExecution().explainString(formatted)
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in explain
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in explain


def test_woe_scoring_is_a_projection(spark, sf_dir):
    plan = _plan(E.queries()["woe_transform"](spark, sf_dir))
    assert "Join" not in plan and "Exchange" not in plan


def test_global_rank_range_partitions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    ranked = global_rank(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    plan = _plan(ranked)
    # the data itself is read from the checkpoint written after a range partitioning;
    # only the per-partition counts meet in one partition
    assert "Scan ExistingRDD" in plan or "ExistingRDD" in plan
    assert ranked.count() == o.count()


def _joins_at_scale(spark, build) -> str:
    """Physical plan with size-based broadcast off, as for tables too large for it."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _plan(build())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_splits_shuffle_no_row(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("y"), F.lit("x").alias("rest"))
    for build in (lambda: stratified_split(df, "y", "id", 0.7), lambda: shuffle_split(df, "id", 0.7),
                  lambda: hash_sample(df, "id", 0.3), lambda: balance_weights(df, "y", "id")):
        plan = _joins_at_scale(spark, build)
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "Exchange hash" not in plan
    assert stratified_split(df, "y", "id", 0.7).where("is_train").groupBy("y").count().orderBy("y").collect() == \
        [(0, 1050), (1, 1050)]


def test_sweep_keeps_expressions_small(spark):
    """Neither the score nor the guess is copied into each other or into a pushed filter."""
    df = spark.range(500).select((F.col("id") % 2).alias("y"), (F.exp(-F.col("id") / 99.0) + 0.123456).alias("p"))
    plan = cutoff_sweep(df, "y", "p", 0.01, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("0.123456") <= 3
    table = scorecard_cutoffs(df.withColumn("e", F.lit(1.0)), "y", "p", "e", 0.2, 1.0, 0.1)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("0.123456") <= 3
