"""quire: business-analytics operators written as Spark DataFrame plans.

Sub-packages
------------
sources     readers for the delimited/Parquet inputs and the named test tables
functions   column-expression builders (buckets, cut, parsing, rounding, scores)
operators   DataFrame -> DataFrame operators (profiling, cleaning, relational,
            aggregation, chart tables, features, models, evaluation,
            scorecards, time series)
plans       the stand-in frames, the registered queries with their SQL
            oracles, and the composed case-study flows
streaming   applying fitted, stateless scorers to a Structured Streaming source
"""

from quire.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
