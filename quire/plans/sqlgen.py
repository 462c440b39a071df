"""Small helpers that write the long-form oracle SQL for per-column statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def long_stats_sql(source: str, cols: Sequence[str], stats: Mapping[str, str],
                   name_col: str = "column", stat_col: str = "stat", value_col: str = "value",
                   digits: int = 6) -> str:
    """UNION ALL over columns of one aggregate row each, unnested into (column, stat, value).

    ``stats`` maps a stat name to a SQL template using ``{c}`` for the column."""
    parts = []
    names = list(stats)
    for c in cols:
        aggs = ", ".join(f"CAST({tpl.format(c=c)} AS DOUBLE) AS {n}" for n, tpl in stats.items())
        parts.append(
            f"SELECT '{c}' AS {name_col}, unnest([{', '.join(repr(n) for n in names)}]) AS {stat_col}, "
            f"round(unnest([{', '.join(names)}]), {digits}) AS {value_col} FROM (SELECT {aggs} FROM {source})")
    return "\nUNION ALL\n".join(parts)


def wide_per_column_sql(source: str, cols: Sequence[str], exprs: Mapping[str, str],
                        name_col: str = "column") -> str:
    """One row per column: SELECT 'c' AS column, <expr1> AS n1, ... FROM source."""
    parts = []
    for c in cols:
        sel = ", ".join(f"{tpl.format(c=c)} AS {n}" for n, tpl in exprs.items())
        parts.append(f"SELECT '{c}' AS {name_col}, {sel} FROM {source}")
    return "\nUNION ALL\n".join(parts)
