"""Score new applications from a file stream with fixed logit coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.models import logit_predict_expr
from quire.operators.scorecard import score_points


def scored_stream(spark: SparkSession, source: str, schema: str, intercept: float, coef: dict[str, float],
                  key: str) -> DataFrame:
    """Streaming frame (key, p_bad, score): stateless, so no watermark or state store is needed."""
    stream = spark.readStream.schema(schema).parquet(source)
    p = logit_predict_expr(intercept, coef)
    return stream.select(key, p.alias("p_bad")).withColumn("score", score_points(F.col("p_bad")))


def score_stream(spark: SparkSession, source: str, sink: str, schema: str, intercept: float,
                 coef: dict[str, float], key: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scores to a Parquet sink.  Progress is kept in ``checkpoint``, a shared
    folder of this stream's own, so a restarted job (or a lost executor) resumes
    without duplicates."""
    df = scored_stream(spark, source, schema, intercept, coef, key)
    writer = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
