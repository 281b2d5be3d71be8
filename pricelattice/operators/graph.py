"""Centrality of lead-lag graphs. Every graph (one per grouping key) is scored in the same job.

Graphs of any size iterate as joins between checkpoints: PageRank on reversed weighted edges, betweenness on unweighted
directed paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import median
from ..session import cut_lineage

DAMPING, TOLERANCE, MAX_ROUNDS = 0.85, 1e-6, 200  # fixed defaults of the score definition
WEIGHTS = {"source_pagerank": 0.35, "out_strength": 0.35, "betweenness": 0.20, "lead_consistency": 0.10}


def graph_tables(edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (one per endpoint, with label) and weighted links."""
    ends = edges.select(*by, F.explode(F.array(
        F.struct(F.col("leader_id").alias("id"), F.col("leader").alias("label")),
        F.struct(F.col("follower_id").alias("id"), F.col("follower").alias("label")))).alias("e"))
    nodes = ends.groupBy(*by, F.col("e.id").alias("market_id")).agg(F.min("e.label").alias("market"))
    links = edges.select(*by, F.col("leader_id").alias("src"), F.col("follower_id").alias("dst"), F.abs("corr").alias("weight"))
    return nodes, links


def pagerank(nodes: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Iterated joins; a graph stops changing once its own L1 step is below n * tolerance. Fails if one doesn't settle."""
    size = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    back = links.select(*by, F.col("dst").alias("market_id"), F.col("src").alias("to"), "weight")
    out = back.groupBy(*by, "market_id").agg(F.sum("weight").alias("out"))
    back = cut_lineage(back.join(out, [*by, "market_id"]).select(*by, "market_id", "to", (F.col("weight") / F.col("out")).alias("w")))
    state = nodes.select(*by, "market_id").join(size, by).join(out, [*by, "market_id"], "left").select(
        *by, "market_id", "n", F.col("out").isNull().alias("dangling"), (1.0 / F.col("n")).alias("r"), F.lit(None).cast("double").alias("prev"),
        F.lit(False).alias("done"))
    state = cut_lineage(state)
    for _ in range(MAX_ROUNDS):
        stats = state.groupBy(*by).agg(
            F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0)).alias("mass"),
            (F.bool_or("done") | F.coalesce(F.sum(F.abs(F.col("r") - F.col("prev"))) < F.max("n") * TOLERANCE, F.lit(False))).alias("stop"))
        inflow = back.join(state.select(*by, "market_id", "r"), [*by, "market_id"]).groupBy(
            *by, F.col("to").alias("market_id")).agg(F.sum(F.col("w") * F.col("r")).alias("inflow"))
        step = state.drop("done").join(inflow, [*by, "market_id"], "left").join(stats, by)
        new = DAMPING * (F.coalesce("inflow", F.lit(0.0)) + F.col("mass") / F.col("n")) + (1 - DAMPING) / F.col("n")
        state = cut_lineage(step.select(
            *by, "market_id", "n", "dangling", F.when(F.col("stop"), F.col("r")).otherwise(new).alias("r"),
            F.col("r").alias("prev"), F.col("stop").alias("done")))
        if state.where(~F.col("done")).isEmpty():
            return state.select(*by, "market_id", F.col("r").alias("source_pagerank"))
    raise RuntimeError(f"PageRank not settled after {MAX_ROUNDS} rounds")


def betweenness(nodes: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Breadth-first frontiers of all sources as joins, then path dependencies back level by level."""
    step = cut_lineage(links.select(*by, F.col("src").alias("v"), F.col("dst").alias("w")).distinct())
    first = nodes.select(*by, F.col("market_id").alias("s"), F.col("market_id").alias("v"), F.lit(1.0).alias("sigma"))
    levels = [cut_lineage(first)]
    seen = levels[0].select(*by, "s", "v")
    while True:
        nxt = levels[-1].join(step, [*by, "v"]).groupBy(*by, "s", F.col("w").alias("v")).agg(F.sum("sigma").alias("sigma"))
        nxt = cut_lineage(nxt.join(seen, [*by, "s", "v"], "left_anti").select(*by, "s", "v", "sigma"))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select(*by, "s", "v"))
    zero = F.lit(0.0)
    below, parts = None, []
    for level in reversed(levels[1:]):
        if below is None:
            cur = level.withColumn("delta", zero)
        else:
            cur = level.join(below, [*by, "s", "v"], "left").withColumn("delta", F.coalesce("delta", zero))
        cur = cut_lineage(cur)
        parts.append(cur.groupBy(*by, F.col("v").alias("market_id")).agg(F.sum("delta").alias("d")))
        up = cur.select(*by, "s", F.col("v").alias("w"), ((1.0 + F.col("delta")) / F.col("sigma")).alias("share"))
        before = levels[levels.index(level) - 1]
        below = up.join(step, [*by, "w"]).join(before.select(*by, "s", "v", "sigma"), [*by, "s", "v"]).groupBy(*by, "s", "v").agg(
            F.sum(F.col("sigma") * F.col("share")).alias("delta"))
    total = nodes.select(*by, "market_id", F.lit(0.0).alias("d"))
    for p in parts:
        total = total.unionByName(p)
    size = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    scale = (F.col("n") - 1) * (F.col("n") - 2)
    return total.groupBy(*by, "market_id").agg(F.sum("d").alias("d")).join(size, by).select(
        *by, "market_id", F.coalesce(F.try_divide(F.col("d"), scale.cast("double")), zero).alias("betweenness"))


def centrality(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, market_id, source_pagerank, betweenness) of all graphs in the same rounds."""
    nodes, links = graph_tables(edges, by)
    return pagerank(nodes, links, by).join(betweenness(nodes, links, by), [*by, "market_id"])


def influence_scores(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Composite score of upstream price leaders per graph, with every component."""
    by = by or ["commodity"]
    # the edge table is small and is read four times below, by actions among them: compute it once
    edges = cut_lineage(edges)
    nodes, _ = graph_tables(edges, by)
    outward = edges.groupBy(*by, F.col("leader_id").alias("market_id")).agg(
        F.sum(F.abs("corr")).alias("out_strength"), F.avg(1.0 / F.greatest(F.lit(1), F.col("lag_days"))).alias("lead_consistency"),
        F.count(F.lit(1)).alias("outbound_edges"), median(F.nullif(F.col("overlap"), F.lit(0))).alias("median_overlap"))
    x = nodes.join(centrality(edges, by), [*by, "market_id"]).join(outward, [*by, "market_id"], "left")
    x = x.na.fill(0, ["out_strength", "lead_consistency", "outbound_edges", "median_overlap"])
    top = x.groupBy(*by).agg(*[F.max(c).alias(f"__top_{c}") for c in WEIGHTS])
    x = x.join(top, by)
    score = sum(w * F.coalesce(F.try_divide(F.col(c), F.col(f"__top_{c}")), F.lit(0.0)) for c, w in WEIGHTS.items())
    return x.select(*by, "market_id", "market", "source_pagerank", F.col("source_pagerank").alias("pagerank"), "out_strength",
                    "betweenness", "lead_consistency", "outbound_edges", "median_overlap", score.alias("influence_score"))
