"""Pairwise market comparison: integration, distance decay, permutation test, quantity-price association.

A market pair needs the two full series. Markets are hashed into blocks and one task compares two blocks (at most
2 x ``block`` series of one row per day), so a row is copied once per block and not once per partner market.
Markets with too few rows to reach the overlap are dropped before the copies are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import join_on
from ..functions.numeric import corr_safe, corr_t, distance_bin, haversine_km, t_pvalue
from ..functions.ranks import spearman
from ..session import cut_lineage
from .leadlag import dense, masked_corr
from .normalize import ensure_market_id
from .returns import market_returns

BLOCK = 96


def _median_gap(level_a, has_a, level_b, has_b):
    """Median |difference| of the shared dates for every column of a against every column of b."""
    out = np.full((level_a.shape[1], level_b.shape[1]), np.nan)
    for i in range(level_a.shape[1]):
        rows = has_a[:, i] > 0
        both = has_b[rows] > 0
        gap = np.where(both, np.abs(level_b[rows] - level_a[rows, i][:, None]), np.inf)
        gap.sort(axis=0)
        n = both.sum(axis=0)
        lo, hi = np.maximum((n - 1) // 2, 0), np.maximum(n // 2, 0)
        cols = np.flatnonzero(n > 0)
        out[i, cols] = (gap[lo[cols], cols] + gap[hi[cols], cols]) / 2.0
    return out


def _compare_blocks(pdf: pd.DataFrame, first: int, second: int, min_overlap: int, prices: bool) -> pd.DataFrame:
    ids, col = np.unique(pdf["market_id"].to_numpy(str), return_inverse=True)
    pos = pdf["day"].to_numpy()
    pos = pos - pos.min()
    n_pos = int(pos.max()) + 1
    home = np.zeros(len(ids), dtype=int)
    home[col] = pdf["own"].to_numpy()
    a, b = np.flatnonzero(home == first), np.flatnonzero(home == second)
    known = pdf["ret"].notna().to_numpy()
    x, m = dense(pos[known], col[known], pdf["ret"].to_numpy()[known], n_pos, len(ids))
    n, r = masked_corr(x[:, a], m[:, a], x[:, b], m[:, b])
    ok = n >= min_overlap
    if first == second:
        ok &= np.triu(np.ones_like(ok), 1).astype(bool)
    cols = {"overlap": n, "return_corr": r}
    if prices:
        lp, has = np.zeros((n_pos, len(ids))), np.zeros((n_pos, len(ids)))
        lp[pos, col], has[pos, col] = pdf["log_price"].to_numpy(), 1.0
        shared, days = has[:, a].T @ has[:, b], has.sum(axis=0)
        ok &= shared >= min_overlap
        cols["median_abs_log_price_gap"] = _median_gap(lp[:, a], has[:, a], lp[:, b], has[:, b])
        cols["shared_date_fraction"] = np.minimum(1.0, shared / np.maximum(1.0, np.minimum(days[a][:, None], days[b][None, :])))
    i, j = np.nonzero(ok)
    left, right = ids[a[i]], ids[b[j]]
    swap = left > right
    out = pd.DataFrame({"market_a_id": np.where(swap, right, left), "market_b_id": np.where(swap, left, right)})
    for name, v in cols.items():
        out[name] = v[i, j]
    return out.astype({"overlap": "int64"})


def compare_pairs(series: DataFrame, by: list[str], min_overlap: int, prices: bool, block: int = BLOCK) -> DataFrame:
    """Pair statistics from (by, market_id, date, ret [, log_price]) rows."""
    enough = series.groupBy(*by, "market_id").agg(F.count("ret").alias("n")).where(F.col("n") >= min_overlap)
    blocks = enough.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__nb"))
    homes = enough.join(blocks, by).select(*by, "market_id", "__nb", F.pmod(F.xxhash64("market_id"), F.col("__nb")).cast("int").alias("own"))
    x = series.join(homes, [*by, "market_id"])
    x = x.withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    x = x.withColumn("__i", F.least("own", "__p")).withColumn("__j", F.greatest("own", "__p"))
    x = x.withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date"))).drop("__p", "__nb", "date")
    kinds = dict(x.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in by) + "market_a_id string, market_b_id string, overlap bigint, return_corr double"
    if prices:
        schema += ", median_abs_log_price_gap double, shared_date_fraction double"

    def kernel(key, pdf):
        out = _compare_blocks(pdf, int(key[-2]), int(key[-1]), min_overlap, prices)
        for c, v in zip(by, key):
            out[c] = v
        return out

    pairs = x.groupBy(*by, "__i", "__j").applyInPandas(kernel, schema)
    return pairs.withColumn("return_corr", F.nanvl("return_corr", F.lit(None).cast("double")))


def _both_ends(pairs: DataFrame, dim: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Attach market attributes to both ends of a pair."""
    for end in ("a", "b"):
        side = dim.select(*on, F.col("market_id").alias(f"market_{end}_id"), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(side, [*on, f"market_{end}_id"])
    return pairs


def integration_pairs(df: DataFrame, edges: DataFrame | None = None, min_overlap: int = 35) -> DataFrame:
    """Integration score of every market pair with enough shared dates and returns, for all commodities."""
    by = ["commodity"]
    x = ensure_market_id(df)
    r = market_returns(x, by).select(*by, "market_id", "date", "ret")
    series = x.select(*by, "market_id", "date", F.ln("modal_price").alias("log_price")).join(r, [*by, "market_id", "date"], "left")
    pairs = compare_pairs(series, by, min_overlap, prices=True)
    if edges is not None:
        strength = edges.groupBy(*by, F.least("leader_id", "follower_id").alias("market_a_id"),
                                 F.greatest("leader_id", "follower_id").alias("market_b_id")).agg(F.max(F.abs("corr")).alias("s"))
        pairs = pairs.join(strength, [*by, "market_a_id", "market_b_id"], "left")
    else:
        pairs = pairs.withColumn("s", F.lit(None).cast("double"))
    pairs = pairs.withColumn("transmission_strength", F.coalesce("s", F.lit(0.0)))
    meta = x.groupBy(*by, "market_id").agg(F.min(F.struct("state", "market")).alias("m")).select(*by, "market_id", "m.*")
    pairs = _both_ends(pairs, meta, by, ["market", "state"])
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("return_corr") + 1) / 2))
    score = (0.40 * F.when(F.col("return_corr").isNotNull(), similarity) + 0.30 * F.exp(-F.col("median_abs_log_price_gap") / 0.25)
             + 0.20 * F.col("shared_date_fraction") + 0.10 * F.col("transmission_strength"))
    return pairs.select(*by, "market_a_id", "market_b_id", "market_a", "market_b", "state_a", "state_b", "return_corr",
                        "median_abs_log_price_gap", "shared_date_fraction", "transmission_strength", score.alias("integration_score"))


def usable_coordinates(df: DataFrame, markets: DataFrame, match: str = "auto") -> DataFrame:
    """Coordinates keyed by market id.

    ``match='id'`` uses ids, ``'name'`` display names that are unique among the coordinates. ``'auto'`` asks one
    small job whether any id matches and falls back to names only if none does.
    """
    cols = [c for c in ("market", "state", "lat", "lon") if c in markets.columns]
    m = ensure_market_id(markets).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    m = m.groupBy("market_id").agg(F.min(F.struct(*cols)).alias("m")).select("market_id", "m.*")
    if match == "auto":
        hit = not m.join(df.select("market_id").distinct(), "market_id", "left_semi").isEmpty()
        match = "id" if hit or "market" not in cols else "name"
    if match == "id":
        return m
    named = m.groupBy("market").agg(F.min(F.struct(*cols)).alias("m"), F.count(F.lit(1)).alias("k"))
    repeated = named.agg(F.coalesce(F.max("k"), F.lit(0))).scalar()
    ids = df.groupBy("market_id").agg(F.min("market").alias("name"))
    return ids.join(named, ids["name"] == named["market"]).where(repeated <= 1).select("market_id", "m.*")


def distance_pairs(df: DataFrame, markets: DataFrame, min_overlap: int = 35, match: str = "auto") -> DataFrame:
    """Great-circle distance and return correlation of every pair of located markets."""
    by = ["commodity"]
    df = ensure_market_id(df)
    r = market_returns(df, by)
    coords = usable_coordinates(df, markets, match)
    series = r.select(*by, "market_id", "date", "ret").join(coords.select("market_id"), "market_id", "left_semi")
    pairs = _both_ends(compare_pairs(series, by, min_overlap, prices=False), coords, [], [c for c in coords.columns if c != "market_id"])
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    pairs = pairs.withColumn("distance_km", km).withColumn("distance_bin", distance_bin(F.col("distance_km")))
    return pairs.select(*by, "market_a_id", "market_b_id", *[c for c in ("market_a", "market_b", "state_a", "state_b") if c in pairs.columns],
                        "distance_km", "return_corr", "overlap", "distance_bin")


def permutation_rhos(pairs: DataFrame, by: list[str], permutations: int, seed: int) -> DataFrame:
    """Rank correlation of distance with relabelled return correlation, one row per (by, permutation).

    The shuffle order is a seeded hash of the market, so it does not depend on partitioning. Pairs whose relabelled
    partner was never observed drop out of that permutation, hence ranks are taken anew in each.
    """
    ends = pairs.select(*by, F.explode(F.array("market_a_id", "market_b_id")).alias("id")).distinct()
    ids = ends.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("id")))
    perm = ids.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    shuffled = Window.partitionBy(*by, "perm").orderBy(F.xxhash64(F.lit(seed), "perm", "id"), "id")
    mapping = perm.select(*by, "perm", F.col("id").alias("to"), F.row_number().over(shuffled).alias("slot"))
    mapping = cut_lineage(mapping.join(ids, [*by, "slot"]).select(*by, "perm", "id", "to"))
    x = pairs.select(*by, "market_a_id", "market_b_id", "distance_km")
    for end in ("a", "b"):
        m = mapping.select(*by, "perm", F.col("id").alias(f"market_{end}_id"), F.col("to").alias(f"to_{end}"))
        x = x.join(m, [*by, f"market_{end}_id"] + (["perm"] if end == "b" else []))
    x = x.select(*by, "perm", "distance_km", F.least("to_a", "to_b").alias("market_a_id"), F.greatest("to_a", "to_b").alias("market_b_id"))
    x = x.join(pairs.select(*by, "market_a_id", "market_b_id", "return_corr"), [*by, "market_a_id", "market_b_id"])
    x = x.where(F.col("return_corr").isNotNull())
    grp = Window.partitionBy(*by, "perm")

    def rank(c: str):
        return F.rank().over(grp.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "perm", c)) - 1) / 2.0

    x = x.select(*by, "perm", rank("distance_km").alias("rx"), rank("return_corr").alias("ry"))
    return x.groupBy(*by, "perm").agg(F.count(F.lit(1)).alias("n"), corr_safe(F.col("rx"), F.col("ry")).alias("rho")).where("n >= 3")


def distance_effect(pairs: DataFrame, by: list[str] | None = None, permutations: int = 499, seed: int = 240124) -> DataFrame:
    """Pairs, Spearman rho of distance and co-movement, its t-test p and the permutation p, per commodity."""
    by = by or ["commodity"]
    pairs = cut_lineage(pairs)  # a result table that the ranks and permutations below read several times
    counts = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"))
    rho = spearman(pairs, by, "distance_km", "return_corr").withColumnsRenamed({"n": "used"})
    out = join_on(counts, rho, by, "left")
    enough = F.col("pairs") >= 3
    out = out.withColumn("spearman_rho", F.when(enough, F.col("rho")))
    out = out.withColumn("p_value", t_pvalue(corr_t(F.col("spearman_rho"), F.col("used")), F.col("used") - 2))
    if permutations <= 0:
        return out.select(*by, "pairs", "spearman_rho", "p_value", F.lit(None).cast("double").alias("qap_p_value"))
    sims = join_on(permutation_rhos(pairs, by, permutations, seed).withColumnsRenamed({"rho": "sim"}), out.select(*by, "spearman_rho"), by)
    tail = sims.groupBy(*by).agg(
        F.count_if(F.abs("sim") >= F.abs("spearman_rho") - 1e-12).alias("extreme"), F.count("sim").alias("valid"))
    out = join_on(out, tail, by, "left")
    qap = F.when((F.col("valid") > 0) & F.col("spearman_rho").isNotNull(), (F.col("extreme") + 1) / (F.col("valid") + 1))
    return out.select(*by, "pairs", "spearman_rho", "p_value", qap.alias("qap_p_value"))


def supply_price_stats(df: DataFrame, by: list[str], min_n: int = 20) -> DataFrame:
    """Spearman and log-log association of quantity and price per group; groups may be of any size."""
    x = df.where((F.col("arrivals") >= 0) & (F.col("modal_price") > 0))
    lx, ly = F.log1p("arrivals"), F.ln("modal_price")
    base = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(ly, lx).alias("beta"), F.regr_r2(ly, lx).alias("r2"),
                              (F.min("arrivals") < F.max("arrivals")).alias("vx"), (F.min("modal_price") < F.max("modal_price")).alias("vy"))
    rho = spearman(x, by, "arrivals", "modal_price").drop("n")
    out = join_on(base, rho, by, "left")
    ok = (F.col("n") >= min_n) & F.col("vx") & F.col("vy")
    out = out.select(*by, "n", *[F.when(ok, F.col(c)).alias(a) for c, a in (("rho", "spearman_rho"), ("beta", "loglog_beta"), ("r2", "r_squared"))])
    r = F.signum("loglog_beta") * F.sqrt("r_squared")
    return out.select(
        *by, "n", "spearman_rho", t_pvalue(corr_t(F.col("spearman_rho"), F.col("n")), F.col("n") - 2).alias("spearman_p"),
        "loglog_beta", t_pvalue(corr_t(r, F.col("n")), F.col("n") - 2).alias("beta_p"), "r_squared")


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation with its two-sided p-value per group."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr_safe(F.col(x), F.col(y)).alias("r"))
    t = corr_t(F.col("r"), F.col("n"))
    return out.select(*by, "n", "r", t.alias("t"), t_pvalue(t, F.col("n") - 2).alias("p_value"))
