"""Radix selection against numpy: every rank, hot values, odd numbers, groups, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import radix
from quire.operators.charts import box_stats
from quire.operators.clean import iqr_fences, percentile_table
from quire.operators.profile import describe_table, numeric_summary
from quire.operators.quantile import grouped_quantiles, quantiles_by

ODD = [0.0, -0.0, 1.5, -1.5, 1e-300, -1e-300, 1e300, float("inf"), float("-inf"), 5e-324, 3.0, 3.0, 3.0000000000000004, 2.0**53]


def test_keys_keep_the_order_of_doubles():
    x = np.array(sorted(ODD))
    k = radix.order_key(x)
    assert (np.diff(k) >= 0).all() and ((np.diff(k) == 0) == (np.diff(x) == 0)).all()
    assert [radix.value_of(int(v)) for v in k] == [v + 0.0 for v in x.tolist()]
    assert radix.order_key(np.array([np.nan, -np.nan]))[0] == radix.order_key(np.array([-np.nan]))[0] > k[-1]


def test_every_rank_of_odd_columns(spark):
    rng = np.random.default_rng(0)
    cols = {"odd": ODD * 3, "hot": [7.25] * 30 + [float(i) for i in range(12)], "same": [2.5] * 42, "tiny": (rng.normal(size=42) * 1e-9).tolist(),
            "nulls": [None] * 40 + [4.0, -4.0], "none": [None] * 42, "near": (1e9 + np.arange(42) * 1e-7).tolist()}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = radix.select_ranks(df, list(cols), lambda n: range(1, n + 1))
    for c, values in cols.items():
        want = sorted(v + 0.0 for v in values if v is not None)
        s = got[(None, c)]
        assert s.n == len(want) and [s.at[r] for r in range(1, s.n + 1)] == want, c


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_quantiles_equal_numpy(spark, n):
    x = np.random.default_rng(n).lognormal(3, 4, n)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    got = radix.column_quantile_values(df, ["x"], probs)["x"]
    assert np.allclose([got[p] for p in probs], np.quantile(x, probs), rtol=1e-12)


def test_a_value_held_by_most_rows_is_one_cell(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, F.lit(42.0)).otherwise(F.col("id") * 0.37).alias("x"))
    x = np.where(np.arange(200_000) % 3 > 0, 42.0, np.arange(200_000) * 0.37)
    got = {r["pct"]: r["value"] for r in percentile_table(df, ["x"]).collect()}
    assert np.allclose([got[i] for i in range(101)], np.quantile(x, np.arange(101) / 100))


def test_groups_null_group_and_many_groups(spark, monkeypatch):
    rows = [(g, float(v)) for g, n in (("a", 50), ("b", 1), (None, 20)) for v in np.random.default_rng(n).normal(size=n)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {(g, p): np.quantile([v for k, v in rows if k == g], p) for g in ("a", "b", None) for p in (0.25, 0.5)}
    found, few = quantiles_by(df, "g", "v", [0.25, 0.5])
    assert few and {(r["g"], r["prob"]): r["q"] for r in found.collect()} == pytest.approx(want)
    box = {r["g"]: r for r in box_stats(df, "g", "v").collect()}
    assert set(box) == {"a", "b", None} and box["a"]["n"] == 50 and box["b"]["whisker_low"] == box["b"]["median"]
    import quire.operators.quantile as Q
    monkeypatch.setattr(Q, "MAX_RADIX_GROUPS", 2)
    found, few = quantiles_by(df, "g", "v", [0.25, 0.5])
    assert not few and {(r["g"], r["prob"]): r["q"] for r in found.collect()} == pytest.approx(want)


def test_frames_without_groups_rows_or_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert grouped_quantiles(df, [], "x", [0.5]).first()["q"] == 2.0
    empty = df.limit(0)
    assert percentile_table(empty, ["x"]).count() == 0 and iqr_fences(empty, ["x"]).count() == 0
    assert describe_table(empty, ["x"]).count() == 0
    stats = {r["stat"]: r["value"] for r in numeric_summary(empty, ["x"]).collect()}
    assert stats["median"] is None and stats["n_null"] == 0
    one = describe_table(df.limit(1), ["x"]).first()
    assert one["n"] == 1 and one["sd"] is None and one["mad"] == 0


def test_no_key_join_and_no_sort_of_the_data(spark):
    """With size-based broadcast off, as at scale, no join stands on the column's name."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5000).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 7).cast("double").alias("y"),
                                      (F.col("id") % 3).alias("g"))
        for out in (percentile_table(df, ["x", "y"]), iqr_fences(df, ["x", "y"]), numeric_summary(df, ["x", "y"]),
                    describe_table(df, ["x", "y"])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "CartesianProduct" not in plan
        keyless = grouped_quantiles(df, [], "x", [0.5])._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in keyless
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
