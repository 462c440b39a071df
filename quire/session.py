"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quire", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and a UTC clock.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, wiring it up if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is.  A scratch folder is created only where driver and tasks are one
    process (a ``local[...]`` master); elsewhere a missing setting is an error,
    because each executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.sparkContext.defaultParallelism), 1)


#: rows that ``spread`` puts into one part at most, on average
ROWS_A_PART = 1 << 18


def spread(df: DataFrame) -> DataFrame:
    """The rows in even parts, one per core at least: a frame kept for many passes
    otherwise has the parts of its files, which for a few megabytes is a single one."""
    return df.repartition(max(default_parallelism(df.sparkSession), math.ceil(df.count() / ROWS_A_PART)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


__all__ = ["get_session", "checkpoint_dir", "default_parallelism", "shuffle_partitions", "ship_package", "spread"]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable by the Python workers (what ``--py-files`` does):
    the package is zipped once per application and added with ``addPyFile``,
    which Spark distributes to every executor."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import quire
    pkg = os.path.dirname(os.path.abspath(quire.__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="quire-pyfiles-"), "quire.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
