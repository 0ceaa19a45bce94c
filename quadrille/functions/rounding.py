"""Rounding that two engines agree on.

Decimal data often lie exactly half way between two roundings, where the last bit of a sum
decides. Rounding up from slightly below one half makes that bit irrelevant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEARLY_HALF = 0.5001


def tidy(value: Column | str, digits: int = 6) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    unit = float(10**digits)
    return F.when(F.abs(c) < 1e12 / unit * 1e6, F.floor(c * unit + NEARLY_HALF) / unit).otherwise(c)


def tidy_sql(sql: str) -> str:
    """Replaces round(x, 5) and round(x, 6) of an SQL text by the same rule."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, start + 6, -1
        while depth:
            c = sql[end]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = sql[start + 6 : comma], sql[comma + 1 : end - 1].strip()
        inner = tidy_sql(inner)
        out += sql[at:start] + (f"(floor(({inner}) * 1e{digits} + {NEARLY_HALF}) / 1e{digits})" if digits in ("5", "6") else f"round({inner}, {digits})")
        at = end
    return out + sql[at:]
