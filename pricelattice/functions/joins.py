"""Join on named columns with NULL equal to NULL, keeping the left side's key columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in cols})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols])
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])
