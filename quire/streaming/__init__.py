"""Structured Streaming entry points.

The reference reads batch files only; the one streaming use that follows from
it is applying an already fitted, stateless scorer (logit coefficients and the
scorecard scaling) to applications as they arrive.
"""

from quire.streaming.scoring import score_stream

__all__ = ["score_stream"]
