"""Column-expression builders; everything here stays inside whole-stage codegen."""

from quire.functions.scalars import (
    bucketize,
    cut_bins,
    elapsed_hours,
    first_token,
    firstup,
    month_key,
    parse_date,
    parse_two_digit_year_date,
    r6,
    round_even,
    sigmoid,
    strip_non_numeric,
    try_numeric,
)

__all__ = [
    "bucketize", "cut_bins", "elapsed_hours", "first_token", "firstup", "month_key",
    "parse_date", "parse_two_digit_year_date", "r6", "round_even", "sigmoid", "strip_non_numeric", "try_numeric",
]
