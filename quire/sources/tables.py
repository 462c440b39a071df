"""The named Parquet tables of a scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one table; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all(spark: SparkSession, sf_dir: str, views: bool = False) -> dict[str, DataFrame]:
    frames = {t: load(spark, sf_dir, t) for t in TABLES}
    if views:
        for t, df in frames.items():
            df.createOrReplaceTempView(t)
    return frames
