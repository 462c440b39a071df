"""The composed case studies and the streaming scorer run end to end on sf0.001."""

import tempfile

from pyspark.sql import functions as F

from quire.plans import case_studies as cs
from quire.plans.standins import applicants
from quire.streaming.scoring import score_stream

SMALL = "/root/testdata/sf0.001"


def test_investment_study(spark):
    out = cs.investment_study(spark, SMALL)
    assert out["top_countries"].count() <= 9
    assert out["top_sectors"].groupBy("country").count().agg(F.max("count")).first()[0] <= 3


def test_forecasting_study(spark):
    out = cs.forecasting_study(spark, SMALL)
    assert out["best_segments"].count() == 2
    m = out["mape"].toPandas()
    assert set(m["model"]) == {"classical", "ar"} and (m["mape"] >= 0).all()


def test_forecasting_study_with_residual_ar(spark):
    out = cs.forecasting_study(spark, SMALL, add_back_residual_ar=True)
    assert out["mape"].filter("model = 'classical'").count() > 0


def test_credit_scoring_study(spark):
    out = cs.credit_scoring_study(spark, SMALL)
    assert out["evaluation"].count() == 1
    assert out["cutoffs"].count() == 8
    assert out["benefit"].count() == 1


def test_credit_scoring_study_joins_applicants_once(spark):
    out = cs.credit_scoring_study(spark, SMALL)
    assert all("c_custkey" not in df._jdf.queryExecution().toString() for df in out.values())


def test_digits_study(spark):
    out = cs.digits_study(spark, SMALL, k=4)
    assert out["pca_variance"].count() == 4


def test_streaming_scores_equal_batch(spark):
    src = tempfile.mkdtemp(prefix="quire-stream-src-")
    sink = tempfile.mkdtemp(prefix="quire-stream-sink-")
    ckpt = tempfile.mkdtemp(prefix="quire-stream-ckpt-")
    a = applicants(spark, SMALL).select("app_id", "o_totalprice", "c_acctbal")
    a.repartition(3).write.mode("overwrite").parquet(src + "/in")
    coef = {"o_totalprice": 2e-6, "c_acctbal": -4e-5}
    q = score_stream(spark, src + "/in", sink + "/out", "app_id BIGINT, o_totalprice DOUBLE, c_acctbal DOUBLE",
                     -1.2, coef, "app_id", checkpoint=ckpt)
    q.awaitTermination(120)
    got = spark.read.parquet(sink + "/out")
    assert got.count() == a.count()
    assert got.filter((F.col("score") < 0) | F.col("p_bad").isNull()).count() == 0
