"""Daily log returns and the ranking of markets by how much they report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .normalize import ensure_market_id


def market_returns(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Log return against the previous report when that report is exactly one day older; other rows drop out.

    ``by`` are the grouping keys (commodity, optionally year); a series is one market within them and holds at most
    one row per day, so its window is bounded.
    """
    by = by or ["commodity"]
    x = ensure_market_id(df).where(F.col("date").isNotNull() & F.col("market_id").isNotNull() & F.col("modal_price").isNotNull())
    series = Window.partitionBy(*by, "market_id").orderBy("date")
    x = x.withColumn("__lp", F.ln("modal_price"))
    x = x.withColumn("ret", F.when(F.datediff("date", F.lag("date").over(series)) == 1,
                                   F.col("__lp") - F.lag("__lp").over(series)))
    keep = [c for c in ("state", "district") if c in x.columns]
    return x.where(F.col("ret").isNotNull()).select(*by, "date", "market_id", "market", *keep, "modal_price", "ret")


def top_markets(returns: DataFrame, by: list[str], k: int | None) -> DataFrame:
    """The k markets with most returns per group (all, ranked, without k), ties by id; Spark prunes to k per task before the shuffle."""
    counts = returns.groupBy(*by, "market_id").agg(F.count(F.lit(1)).alias("n_returns"), F.min("market").alias("market"))
    order = Window.partitionBy(*by).orderBy(F.desc("n_returns"), "market_id")
    ranked = counts.withColumn("market_rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("market_rank") <= k)


def with_position(returns: DataFrame, by: list[str], lag_mode: str = "report") -> DataFrame:
    """Row position of a date among the group's reporting dates ('report'), or its day number ('calendar')."""
    if lag_mode == "calendar":
        return returns.withColumn("pos", F.datediff("date", F.lit("1970-01-01").cast("date")))
    if lag_mode != "report":
        raise ValueError("lag_mode must be 'report' or 'calendar'")
    # dates are ranked once per group, from the group's distinct dates, and joined back: no window holds a group's returns
    dates = returns.select(*by, "date").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("date")))
    return returns.join(dates, [*by, "date"])
