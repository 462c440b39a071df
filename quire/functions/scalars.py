"""Scalar column expressions used across the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c, digits: int = 6) -> Column:
    """Round a double for cross-engine comparison (last-digit noise of float sums)."""
    return F.round(_c(c), digits)


def round_even(c, digits: int = 0) -> Column:
    """R ``round``: half to even (Spark ``round`` is half-up)."""
    return F.bround(_c(c), digits)


def bucketize(c, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Manual labelled buckets with the reference's interval shape.

    With bounds b0 < b1 < ... < bk and k+2 labels:
    label0: x < b0; label1: b0 <= x <= b1; label_i: b_{i-1} < x <= b_i; last: x > bk.
    Masks are applied in order, so when intervals overlap the later one wins;
    a NULL input (or no match) stays NULL.
    """
    if len(labels) != len(bounds) + 1:
        raise ValueError("need len(bounds) + 1 labels")
    x = _c(c)
    conds = [x < bounds[0]]
    for i in range(1, len(bounds)):
        lo = (x >= bounds[i - 1]) if i == 1 else (x > bounds[i - 1])
        conds.append(lo & (x <= bounds[i]))
    conds.append(x > bounds[-1])
    if len(bounds) == 1:
        conds = [x < bounds[0], x >= bounds[0]]
    expr = None
    # last matching mask wins -> test masks from the last to the first
    for cond, label in reversed(list(zip(conds, labels))):
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def cut_bins(c, start: float, stop: float, width: float, labels: bool = True) -> Column:
    """R ``cut(x, seq(start, stop, width))``: left-open, right-closed; outside -> NULL.

    Returns the 1-based bin index, or the ``(lo,hi]`` label when ``labels``.
    """
    x = _c(c)
    n = int(round((stop - start) / width))
    k = F.ceil((x - F.lit(start)) / F.lit(width))
    inside = (x > F.lit(start)) & (x <= F.lit(start + n * width))
    idx = F.when(inside, F.greatest(F.lit(1), F.least(F.lit(n), k)))
    if not labels:
        return idx.cast("int")
    lo = F.lit(start) + (idx - 1) * F.lit(width)
    hi = F.lit(start) + idx * F.lit(width)
    return F.when(inside, F.format_string("(%s,%s]", _num_text(lo), _num_text(hi)))


def _num_text(c: Column) -> Column:
    """Render a whole number without a decimal part, like R's labels."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def firstup(c) -> Column:
    """First character upper-cased, rest unchanged."""
    x = _c(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def first_token(c, sep_regex: str = r"\|") -> Column:
    """Keep the text before the first separator (tidyr ``separate`` with extra='drop')."""
    return F.split(_c(c), sep_regex).getItem(0)


def strip_non_numeric(c) -> Column:
    """Remove everything except digits, sign and decimal point."""
    return F.regexp_replace(_c(c), r"[^0-9.+-]", "")


def try_numeric(c) -> Column:
    """String to double; malformed text becomes NULL (R's NA-with-warning)."""
    return _c(c).try_cast("double")


def parse_date(c, fmt: str) -> Column:
    """Parse text to a date; unparsable text is NULL."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("date")


def parse_two_digit_year_date(c, fmt: str) -> Column:
    """Parse a date whose pattern has a two-digit year with R's/POSIX pivot:
    00-68 -> 20xx, 69-99 -> 19xx (Spark alone would read every 'yy' as 20xx)."""
    d = parse_date(c, fmt)
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def month_key(c) -> Column:
    """Display key ``yy-MM`` of a date (sorting must use the date itself)."""
    return F.date_format(_c(c), "yy-MM")


def elapsed_hours(start, end) -> Column:
    """Elapsed time between two timestamps in hours, as double."""
    # microsecond difference, independent of the session time zone
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1e6) / F.lit(3600.0)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
