"""Delimited readers (header, tab, headerless) and null-token normalisation.

Schemas are always declared: inference costs a full extra pass over the input
and is unstable across files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import checkpoint_dir

# The tokens the reference reads as missing.
R_NULL_TOKENS = ("", " ", "NA")
NA_WORD = "n/a"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "csv", header: bool = True, sep: str = ",",
               null_tokens: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Read a CSV/TSV/Parquet input; string cells equal to a null token become NULL."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", header).option("sep", sep)
        # keep blank cells as strings so that the token list decides what is missing
        reader = reader.option("nullValue", "\u0000").option("emptyValue", "")
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.csv(path)
    if null_tokens:
        df = normalise_nulls(df, null_tokens)
    return df


def read_headerless(spark: SparkSession, path: str, types: list[T.DataType],
                    first_name: str | None = None, sep: str = ",") -> DataFrame:
    """Headerless file: columns get generated names V1..Vn, the first may be renamed."""
    names = [f"V{i + 1}" for i in range(len(types))]
    schema = T.StructType([T.StructField(n, t, True) for n, t in zip(names, types)])
    df = read_table(spark, path, schema=schema, header=False, sep=sep)
    if first_name:
        df = df.withColumnRenamed("V1", first_name)
    return df


def null_token_expr(c: Column, tokens) -> Column:
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def normalise_nulls(df: DataFrame, tokens=R_NULL_TOKENS, columns: list[str] | None = None) -> DataFrame:
    """One projection turning exact token matches in string columns into NULL."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = [c for c in (columns or df.columns) if c in strings]
    if not targets:
        return df
    return df.withColumns({c: null_token_expr(F.col(c), tokens) for c in targets})


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quire-{tag}-{uuid.uuid4().hex}"


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> str:
    (df.write.mode("overwrite").option("header", header).option("sep", sep)
       .option("nullValue", "").option("emptyValue", "\"\"").csv(path))
    return path
