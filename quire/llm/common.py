"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

#: a word: a run of anything but the six ASCII white-space characters
WORD_RE = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: rows that a task works on at once, in bytes
SLICE_BYTES = 1 << 22


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut at a
    table that outlives any executor, and later steps run the work once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_column(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(col) -> "F.Column":
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def release() -> None:
    """Give what Arrow and numpy have freed back to the system.  A Python worker
    stays between tasks and stages, beside an executor that needs the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, in order, in parts of about ``size`` bytes, so that
    what a task makes of them stays small; after the last, free memory is released."""
    try:
        for batch in batches:
            rows = max(batch.num_rows * size // max(batch.nbytes, 1), 1)
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        release()


def word_blocks(data: bytes, carry: int, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of ``data`` in lists of about ``size`` bytes, each list beginning
    with the ``carry`` words before it, so that a text of any length is worked
    through in bounded memory and every n-gram (n = carry + 1) lies in one list."""
    if len(data) <= size:
        yield data.split()
        return
    at, tail, any_yet = 0, [], False
    while at < len(data):
        end = at + size
        if end < len(data):
            gap = _SPACE.search(data, end)
            end = gap.start() if gap else len(data)
        words = tail + data[at:end].split()
        at = end
        if len(words) > carry or (at >= len(data) and not any_yet):
            any_yet = True
            yield words
            tail = words[len(words) - carry:] if carry else []
        else:
            tail = words


def star_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an edge list: (node, component), component being
    the smallest node reachable.  Nodes without an edge are not listed.

    Alternating large-star and small-star rounds: every round is two
    pre-aggregated minima and two joins back, so a node with very many
    neighbours is a skewed join that adaptive execution splits, never one
    group in memory.  Each round is checkpointed in the shared folder; the
    driver sees one row of totals per round.
    """
    checkpoint_dir(edges.sparkSession)
    cur = (edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
           .checkpoint())
    seen = None
    while True:
        totals = cur.agg(F.count("*").alias("n"),
                         F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if totals["n"] == 0 or (totals["n"], totals["h"]) == seen:
            break
        seen = (totals["n"], totals["h"])
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))))
        cur = small.where("u <> v").distinct().checkpoint()
    stars = cur.groupBy("u").agg(F.min("v").alias("component"))
    heads = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.select(F.col("u").alias("node"), "component").union(heads)
