"""Presentation of results for comparison: six decimals, ISO dates as text, 64-bit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The rounding boundary sits slightly off the decimal tie, so values that differ in the last bit still print alike.
SCALE, OFFSET = 1000000.0, 0.501
_INTS = {"tinyint", "smallint", "int", "bigint"}


def report(df: DataFrame) -> DataFrame:
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.floor(c * SCALE + OFFSET) / SCALE
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in _INTS:
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)
