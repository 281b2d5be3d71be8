"""Lead-lag edges between markets, for every commodity (and year) in one job.

The K kept markets of a group form a date by market matrix of at most days x K cells. Correlations of all
(direction, lag) candidates are products of that matrix with its shifted self, so a task multiplies matrices instead
of joining every day of every market with every other. Groups wider than ``BLOCK`` markets split into block pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import median, t_two_sided
from ..functions.ranks import benjamini_hochberg
from ..session import cut_lineage
from ..spec import LeadLagPolicy
from .returns import market_returns, top_markets, with_position

BLOCK = 64
EDGE_COLUMNS = ["leader_id", "follower_id", "leader", "follower", "lag_days", "corr", "p_value", "q_value", "overlap"]


def dense(pos, col, values, n_pos, n_col):
    """Zero-filled matrix, its 0/1 mask, each column centred on its own mean (correlation does not change)."""
    x, m = np.zeros((n_pos, n_col)), np.zeros((n_pos, n_col))
    x[pos, col] = values
    m[pos, col] = 1.0
    mean = x.sum(axis=0) / np.maximum(m.sum(axis=0), 1.0)
    return (x - mean) * m, m


def masked_corr(x, mx, y, my):
    """Pairwise overlap count and correlation of the columns of x with those of y; NaN where a side is constant."""
    n = mx.T @ my
    sx, sy = x.T @ my, mx.T @ y
    sxx, syy, sxy = (x * x).T @ my, mx.T @ (y * y), x.T @ y
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        vx = np.where(vx > 1e-12 * sxx, vx, np.nan)
        vy = np.where(vy > 1e-12 * syy, vy, np.nan)
        r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
    return n, np.clip(r, -1.0, 1.0)


def _best_candidates(pdf: pd.DataFrame, first: int, second: int, max_lag: int, min_overlap: int) -> pd.DataFrame:
    """Best (direction, lag) per unordered pair: largest |r|, first in the order a->b lags, then b->a lags."""
    ranks, col = np.unique(pdf["market_rank"].to_numpy(), return_inverse=True)
    pos = pdf["pos"].to_numpy()
    pos = pos - pos.min()
    x, m = dense(pos, col, pdf["ret"].to_numpy(), int(pos.max()) + 1, len(ranks))
    named = pdf.drop_duplicates("market_rank").sort_values("market_rank")
    ids, names = named["market_id"].to_numpy(), named["market"].to_numpy()
    block = (ranks - 1) // BLOCK
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    score, corr, count = [], [], []
    for flip in (False, True):
        for lag in range(1, max_lag + 1):
            lead, follow = (b, a) if flip else (a, b)
            n, r = masked_corr(x[:-lag][:, lead], m[:-lag][:, lead], x[lag:][:, follow], m[lag:][:, follow])
            n, r = (n.T, r.T) if flip else (n, r)
            ok = (n >= max(min_overlap, 2)) & np.isfinite(r)
            score.append(np.where(ok, np.abs(r), -1.0))
            corr.append(r)
            count.append(n)
    score, corr, count = np.array(score), np.array(corr), np.array(count)
    best = score.argmax(axis=0)
    usable = score.max(axis=0) >= 0
    if first == second:
        usable &= np.triu(np.ones_like(usable), 1).astype(bool)
    i, j = np.nonzero(usable)
    k = best[i, j]
    r, n = corr[k, i, j], count[k, i, j]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = r * np.sqrt((n - 2) / (1 - r * r))
    p = np.where(n > 2, t_two_sided(t, n - 2), 1.0)
    ahead, behind = np.where(k < max_lag, a[i], b[j]), np.where(k < max_lag, b[j], a[i])
    return pd.DataFrame({
        "leader_id": ids[ahead], "follower_id": ids[behind], "leader": names[ahead], "follower": names[behind],
        "lag_days": k % max_lag + 1, "corr": r, "p_value": p, "overlap": n.astype("int64")})


def lead_lag_candidates(df: DataFrame, policy: LeadLagPolicy = LeadLagPolicy(), by: list[str] | None = None) -> DataFrame:
    """One row per unordered market pair that has a usable candidate, before any significance filter."""
    by = by or ["commodity"]
    returns = market_returns(df, by).select(*by, "market_id", "market", "date", "ret")
    kept = top_markets(returns, by, policy.max_markets).select(*by, "market_id", F.col("market").alias("__name"), "market_rank")
    # a row is copied once per block of markets that its own group has
    blocks = kept.groupBy(*by).agg(F.floor((F.max("market_rank") - 1) / BLOCK).cast("int").alias("__last"))
    x = returns.drop("market").join(kept.withColumnRenamed("__name", "market"), [*by, "market_id"]).join(blocks, by)
    x = with_position(x, by, policy.lag_mode)
    own = F.floor((F.col("market_rank") - 1) / BLOCK).cast("int")
    x = x.withColumn("__o", own).withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    x = x.withColumn("__i", F.least("__o", "__p")).withColumn("__j", F.greatest("__o", "__p")).drop("__o", "__p", "__last")
    x = x.select(*by, "market_id", "ret", "market", "market_rank", "pos", "__i", "__j")
    kinds = dict(x.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + (
        ", leader_id string, follower_id string, leader string, follower string, lag_days int, corr double, "
        "p_value double, overlap bigint")
    max_lag, min_overlap = policy.max_lag, policy.min_overlap

    def kernel(key, pdf):
        out = _best_candidates(pdf, int(key[-2]), int(key[-1]), max_lag, min_overlap)
        for c, v in zip(by, key):
            out[c] = v
        return out

    return x.groupBy(*by, "__i", "__j").applyInPandas(kernel, schema)


def lead_lag_edges(df: DataFrame, policy: LeadLagPolicy = LeadLagPolicy(), by: list[str] | None = None) -> DataFrame:
    """Directed edges that pass the |r| threshold and the false-discovery gate of their group."""
    by = by or ["commodity"]
    # the candidates are read by the correction's counts and by the join of its result: work them out once
    cand = benjamini_hochberg(cut_lineage(lead_lag_candidates(df, policy, by)), by, "p_value")
    ok = (F.abs("corr") >= policy.min_abs_corr) & (F.col("q_value") <= policy.fdr_alpha)
    return cand.where(ok).select(*by, *EDGE_COLUMNS)


def evaluable_years(df: DataFrame, min_overlap: int) -> DataFrame:
    """(commodity, year) in which at least two markets report often enough to reach the overlap."""
    per = df.groupBy("commodity", F.year("date").alias("year"), "market_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("commodity", "year").agg(F.count_if(F.col("n") >= min_overlap + 1).alias("k")).where("k >= 2").select("commodity", "year")


def yearly_edges(df: DataFrame, policy: LeadLagPolicy = LeadLagPolicy()) -> DataFrame:
    """Edges re-estimated per calendar year; the year is a grouping key, so no loop and no cross-year return."""
    x = df.withColumn("year", F.year("date"))
    x = x.join(evaluable_years(df, policy.min_overlap), ["commodity", "year"], "left_semi")
    return lead_lag_edges(x, policy, ["commodity", "year"])


def edge_stability(yearly: DataFrame, years: DataFrame) -> DataFrame:
    """How often a directed edge recurs among a commodity's evaluable years."""
    total = years.groupBy("commodity").agg(F.count(F.lit(1)).alias("years_evaluated"))
    agg = yearly.groupBy("commodity", "leader_id", "follower_id", "leader", "follower").agg(
        F.countDistinct("year").alias("years_supported"), median(F.col("corr")).alias("median_corr"),
        median(F.abs("corr")).alias("median_abs_corr"), median(F.col("lag_days")).alias("median_lag_days"),
        median(F.col("overlap")).alias("median_overlap"))
    return agg.join(total, "commodity").withColumn(
        "persistence_ratio", F.col("years_supported") / F.greatest("years_evaluated", F.lit(1)))


def leader_ranks(scores: DataFrame, by: list[str]) -> DataFrame:
    """Position of each market by influence within its graph, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.desc("influence_score"), "market_id")
    return scores.withColumn("rank", F.row_number().over(order))


def leader_stability(annual: DataFrame) -> DataFrame:
    """Summary of yearly ranks (at most one row per market and year)."""
    return annual.groupBy("commodity", "market_id", "market").agg(
        F.countDistinct("year").alias("years_present"), F.avg("rank").alias("mean_rank"), median(F.col("rank")).alias("median_rank"),
        F.avg("influence_score").alias("mean_influence"), median(F.col("influence_score")).alias("median_influence"),
        F.count_if(F.col("rank") <= 3).alias("top3_years"))
