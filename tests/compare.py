"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def _norm(v, digits):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, round(v, digits) + 0.0)
    if isinstance(v, decimal.Decimal):
        return (1, round(float(v), digits) + 0.0)
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, (int,)):
        return (1, float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return (1, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (1, tuple(_norm(x, digits) for x in v))
    return (1, str(v))


def rows_of(columns, records, digits):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i], digits) for i in order) for r in records)


def spark_rows(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def assert_same(scols, srows, dcols, drows, digits=4, rel=1e-7):
    assert sorted(scols) == sorted(dcols), f"columns differ: {sorted(scols)} vs {sorted(dcols)}"
    assert len(srows) == len(drows), f"row counts differ: spark {len(srows)} vs duckdb {len(drows)}"
    a = rows_of(scols, srows, digits)
    b = rows_of(dcols, drows, digits)
    for ra, rb in zip(a, b):
        for (na, va), (nb, vb) in zip(ra, rb):
            assert na == nb, f"null mismatch {ra} vs {rb}"
            if isinstance(va, float) and isinstance(vb, float):
                assert math.isclose(va, vb, rel_tol=rel, abs_tol=10 ** -digits), f"{ra} vs {rb}"
            else:
                assert va == vb, f"{ra} vs {rb}"
