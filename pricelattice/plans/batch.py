"""Whole runs: the exploratory analysis of a panel and the analysis of a verified snapshot.

The commodity is a grouping key of every operator, so a run has no commodity loop. Each table is written once and
later steps read the written table, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import coverage as cov, events as ev, graph as gr, leadlag as ll, pairs as pr, weather as we
from ..sources import sinks
from ..sources.readers import load_markets, load_weather
from ..spec import EventPolicy, LeadLagPolicy, SelectionPolicy


class _Store:
    """Write a result table and hand back the stored version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, name: str, df: DataFrame) -> DataFrame:
        sinks.write_result(df, self.folder, name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def run_summary(panel: DataFrame, edges: DataFrame, scores: DataFrame, stability: DataFrame | None = None, leaders: DataFrame | None = None,
                effect: DataFrame | None = None, events: DataFrame | None = None, supply: DataFrame | None = None) -> DataFrame:
    """One row per commodity with the headline numbers of a run."""
    out = panel.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("state").alias("states"), F.countDistinct("market_id").alias("markets"))
    parts = [edges.groupBy("commodity").agg(F.count(F.lit(1)).alias("lead_lag_edges")),
             scores.groupBy("commodity").agg(F.min_by("market_id", F.struct(-F.col("influence_score"), F.col("market_id"))).alias("top_leader"))]
    if stability is not None:
        parts.append(stability.groupBy("commodity").agg(
            F.max("years_evaluated").alias("evaluable_years"), F.count_if(F.col("persistence_ratio") >= 0.5).alias("persistent_edges_ge_50pct")))
    if leaders is not None:
        best = F.struct(-F.col("top3_years"), F.col("mean_rank"), -F.col("mean_influence"), F.col("market_id"))
        parts.append(leaders.groupBy("commodity").agg(F.min_by("market_id", best).alias("top_stable_leader")))
    if effect is not None:
        parts.append(effect.withColumnsRenamed({"pairs": "distance_pairs", "spearman_rho": "distance_rho", "p_value": "distance_p",
                                                "qap_p_value": "distance_qap_p"}))
    if events is not None:
        parts.append(events.groupBy("commodity").agg(F.count(F.lit(1)).alias("weather_event_rows"),
                                                     F.countDistinct("event_sign", "horizon_days").alias("weather_summary_rows")))
    if supply is not None:
        parts.append(supply.withColumnsRenamed({c: f"supply_{c}" for c in supply.columns if c != "commodity"}))
    for p in parts:
        out = out.join(p, "commodity", "left")
    counts = [c for c in ("lead_lag_edges", "evaluable_years", "persistent_edges_ge_50pct", "weather_event_rows", "weather_summary_rows") if c in out.columns]
    return out.na.fill(0, counts)


def _network(store: _Store, panel: DataFrame, policy: LeadLagPolicy) -> tuple[DataFrame, DataFrame]:
    edges = store.put("lead_lag", ll.lead_lag_edges(panel, policy))
    return edges, store.put("influence", gr.influence_scores(edges))


def _space(store: _Store, panel: DataFrame, markets: DataFrame, min_overlap: int) -> DataFrame:
    pairs = store.put("distance_pairs", pr.distance_pairs(panel, markets, min_overlap))
    return store.put("distance_summary", pr.distance_effect(pairs))


def _weather(store: _Store, panel: DataFrame, weather: DataFrame, policy: EventPolicy) -> DataFrame:
    events = store.put("weather_events", we.event_study(we.join_market_weather(panel, weather), policy=policy))
    store.put("weather_event_summary", we.event_study_summary(events))
    return events


def analyze_panel(spark: SparkSession, panel: DataFrame, markets: DataFrame, weather: DataFrame, folder: str,
                  policy: LeadLagPolicy = LeadLagPolicy(), selection: SelectionPolicy = SelectionPolicy(),
                  study: EventPolicy = EventPolicy()) -> None:
    """Every table of the exploratory run, all commodities at once, plus a manifest of its settings."""
    store = _Store(spark, folder)
    panel = store.put("panel", panel)
    settings = json.dumps({"lead_lag": asdict(policy), "selection": asdict(selection), "events": asdict(study)}, sort_keys=True)
    store.put("run_manifest", cov.panel_status(panel, markets, weather).withColumn("analysis_settings", F.lit(settings)))
    store.put("quality_summary", cov.quality_summary(panel))
    audit = store.put("coverage_audit", cov.coverage_audit(panel))
    store.put("commodity_coverage_ranking", cov.commodity_coverage_score(audit))
    store.put("commodity_scope_selection", cov.commodity_scope_table(panel, selection))
    store.put("market_crunch_candidates", ev.market_crunches(panel))
    edges, _ = _network(store, panel, policy)
    store.put("integration", pr.integration_pairs(panel, edges, policy.min_overlap))
    _space(store, panel, markets, policy.min_overlap)
    _weather(store, panel, weather, study)


def analyze_snapshot(spark: SparkSession, target: str, policy: LeadLagPolicy = LeadLagPolicy(), study: EventPolicy = EventPolicy()) -> DataFrame:
    """Analysis of a snapshot whose checksums hold; returns the per-commodity summary."""
    check = sinks.verify_snapshot(spark, target)
    if not sinks.snapshot_ok(check):
        bad = check.where(~F.col("status").isin("ok", "unlisted"))
        bad.write.mode("overwrite").parquet(f"{target}/verification_failures")
        told = bad.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first")).orderBy("status").collect()
        raise ValueError("snapshot verification failed (all files in verification_failures): " + "; ".join(
            f"{r['status']}: {r['files']}, first {r['first']}" for r in told))
    data = f"{target}/{sinks.DATA}"
    panel = spark.read.parquet(f"{data}/market_daily").drop("year")
    markets, weather = load_markets(spark, f"{data}/markets"), load_weather(spark, f"{data}/weather_daily")
    store = _Store(spark, f"{target}/results")
    store.put("coverage_audit", cov.coverage_audit(panel))
    store.put("market_crunch_candidates", ev.market_crunches(panel))
    edges, scores = _network(store, panel, policy)
    store.put("integration", pr.integration_pairs(panel, edges, policy.min_overlap))
    yearly = store.put("lead_lag_yearly", ll.yearly_edges(panel, policy))
    stability = store.put("edge_stability", ll.edge_stability(yearly, ll.evaluable_years(panel, policy.min_overlap)))
    by = ["commodity", "year"]
    annual = store.put("leader_yearly", ll.leader_ranks(gr.influence_scores(yearly, by), by))
    leaders = store.put("leader_stability", ll.leader_stability(annual))
    effect = _space(store, panel, markets, policy.min_overlap)
    events = _weather(store, panel, weather, study)
    supply = store.put("supply_price", pr.supply_price_stats(panel, ["commodity"]))
    summary = store.put("run_summary", run_summary(panel, edges, scores, stability, leaders, effect, events, supply))
    sinks.write_result_manifest(spark, f"{target}/results")
    return summary
