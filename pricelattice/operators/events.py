"""Supply crunches, price shocks and ripples along lead-lag edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import pct_from_log, with_robust_z
from ..functions.ranks import exact_quantiles
from .normalize import ensure_market_id
from .returns import market_returns

SERIES = ["commodity", "market_id"]


def market_crunches(df: DataFrame, arrival_threshold: float = -1.5, price_threshold: float = 1.5) -> DataFrame:
    """Days of unusually low quantity and unusually high price within one market's own history."""
    x = ensure_market_id(df)
    part = Window.partitionBy(*SERIES)
    x = with_robust_z(with_robust_z(x, "arrivals", "arrival_z", part), "modal_price", "price_z", part)
    x = x.where((F.col("arrival_z") <= arrival_threshold) & (F.col("price_z") >= price_threshold))
    severity = F.sqrt(F.pow(F.greatest("price_z", F.lit(0.0)), 2) + F.pow(F.least("arrival_z", F.lit(0.0)), 2))
    return x.select("date", "market_id", *[c for c in ("state", "district", "market") if c in x.columns], "commodity",
                    "modal_price", "arrivals", "arrival_z", "price_z", severity.alias("crunch_severity"))


def price_shocks(df: DataFrame, z_threshold: float = 2.0) -> DataFrame:
    """Daily returns far from their market's median return."""
    r = with_robust_z(market_returns(df), "ret", "return_z", Window.partitionBy(*SERIES))
    return r.withColumn("return_pct", pct_from_log(F.col("ret"))).where(F.abs("return_z") >= z_threshold)


def ripple(df: DataFrame, edges: DataFrame, events: DataFrame, max_horizon: int) -> DataFrame:
    """Follower returns at event date + lag for each (commodity, leader_id, event_date).

    Two equi-joins: the leader's own return is optional, a follower without a return that day drops out.
    """
    r = market_returns(df).select("commodity", "market_id", "date", pct_from_log(F.col("ret")).alias("pct"))
    e = events.join(edges.where(F.col("lag_days") <= max_horizon), ["commodity", "leader_id"])
    e = e.withColumn("response_date", F.date_add("event_date", F.col("lag_days")))
    own = r.withColumnsRenamed({"market_id": "leader_id", "date": "event_date", "pct": "leader_shock_pct"})
    other = r.withColumnsRenamed({"market_id": "follower_id", "date": "response_date", "pct": "follower_response_pct"})
    x = e.join(own, ["commodity", "leader_id", "event_date"], "left").join(other, ["commodity", "follower_id", "response_date"])
    return x.select("commodity", "leader_id", "leader", "follower_id", "follower", "event_date", "response_date", "lag_days",
                    F.col("corr").alias("edge_corr"), F.col("q_value").alias("edge_q_value"), "leader_shock_pct", "follower_response_pct")


def default_ripple_event(df: DataFrame, scores: DataFrame, z_threshold: float = 2.0) -> DataFrame:
    """Per commodity: the top-scored leader and the date of its strongest shock, or the last date without one."""
    lead = scores.groupBy("commodity").agg(
        F.min_by("market_id", F.struct(-F.col("influence_score"), F.col("market_id"))).alias("leader_id"))
    shocks = price_shocks(df, z_threshold).select("commodity", F.col("market_id").alias("leader_id"), "date", "return_z")
    best = shocks.join(lead, ["commodity", "leader_id"], "left_semi").groupBy("commodity").agg(
        F.max_by("date", F.struct(F.abs("return_z"), F.col("date"))).alias("shock_date"))
    last = df.groupBy("commodity").agg(F.max("date").alias("last_date"))
    return lead.join(last, "commodity").join(best, "commodity", "left").select(
        "commodity", "leader_id", F.coalesce("shock_date", "last_date").alias("event_date"))


def _located(markets: DataFrame) -> DataFrame:
    m = ensure_market_id(markets).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return m.groupBy("market_id").agg(F.min(F.struct("state", "lat", "lon")).alias("m")).select("market_id", "m.*")


def located_edges(edges: DataFrame, markets: DataFrame) -> DataFrame:
    """Edges or ripples with the coordinates of both ends; rows without them drop out."""
    m = _located(markets)
    for end in ("leader", "follower"):
        side = m.select(F.col("market_id").alias(f"{end}_id"), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
        edges = edges.join(side, f"{end}_id")
    return edges


def located_scores(scores: DataFrame, markets: DataFrame) -> DataFrame:
    return scores.join(_located(markets), "market_id")


def response_scale(ripples: DataFrame, by: list[str]) -> DataFrame:
    """95th percentile of the absolute response, at least 1."""
    x = ripples.select(*by, F.abs("follower_response_pct").alias("a"))
    q = exact_quantiles(x, by, "a", {"p95": 0.95})
    return q.select(*by, F.greatest(F.lit(1.0), F.col("p95")).alias("max_abs"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows of a total order; Spark keeps n rows per task instead of sorting everything."""
    return df.orderBy(*order).limit(n)
