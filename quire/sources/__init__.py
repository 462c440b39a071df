"""Readers: named Parquet tables and delimited files with R-style null tokens."""

from quire.sources.tables import TABLES, load, load_all
from quire.sources.readers import (
    normalise_nulls,
    read_headerless,
    read_table,
    scratch_path,
    write_delimited,
)

__all__ = [
    "TABLES", "load", "load_all", "normalise_nulls", "read_headerless",
    "read_table", "scratch_path", "write_delimited",
]
