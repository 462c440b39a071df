"""One key holding a third of the rows: the balanced operators stay balanced and exact."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.operators import clean
from quire.operators.quantile import grouped_quantiles
from quire.operators.rank import global_rank, rank_within


def _hot_frame(spark, n=30000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.uniform(size=n) < 1 / 3, "hot", rng.choice(["a", "b", "c", "d", "e", "f"], n))
    x = np.where(g == "hot", 5.0, rng.normal(size=n).round(3))          # hot rows also share one value
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "g": g, "x": x})), pd.DataFrame(
        {"id": np.arange(n), "g": g, "x": x})


def test_range_partitions_split_a_hot_value(spark):
    df, _ = _hot_frame(spark)
    parts = (df.repartitionByRange(8, F.col("x"), F.col("id"))
               .groupBy(F.spark_partition_id().alias("pid")).count().toPandas()["count"])
    assert parts.max() < 2.0 * parts.mean()            # the hot value is spread over several tasks


def test_rank_within_hot_group_is_exact(spark):
    df, pdf = _hot_frame(spark)
    got = rank_within(df, ["g"], [F.col("x"), F.col("id")]).toPandas()
    pdf = pdf.sort_values(["g", "x", "id"])
    pdf["r"] = pdf.groupby("g").cumcount() + 1
    assert (got.merge(pdf, on="id").eval("rank == r")).all()


def test_rank_quantiles_with_hot_group(spark):
    df, pdf = _hot_frame(spark)
    got = grouped_quantiles(df, ["g"], "x", [0.1, 0.5, 0.9]).toPandas()
    for (g, p), q in got.set_index(["g", "prob"])["q"].items():
        assert np.isclose(q, np.quantile(pdf.loc[pdf.g == g, "x"], p))


def test_dedupe_first_hot_key(spark):
    df, pdf = _hot_frame(spark)
    got = clean.dedupe_first(df, ["g"], "id").toPandas().set_index("g")["id"]
    exp = pdf.groupby("g")["id"].min()
    assert (got.sort_index() == exp.sort_index()).all()


def test_hot_value_collapses_before_the_running_count(spark):
    from quire.operators.quantile import running_counts, value_counts
    df, pdf = _hot_frame(spark)
    run = running_counts(value_counts(df, [], "x"), [])
    assert run.count() == pdf["x"].nunique()
    assert run.where("x = 5.0").first()["c"] == (pdf["x"] == 5.0).sum()
    assert run.agg(F.max("cum")).first()[0] == len(pdf)
