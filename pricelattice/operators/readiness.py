"""Readiness audit of an empirical scope and its gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import infer_source_tier, tiers_acceptable
from ..spec import ReadinessPolicy
from .coverage import tier_set
from .normalize import ensure_market_id


# what a reader of the gate table needs to know about each gate
GATE_NOTES = {
    "real_data_only": "every observation must be real",
    "nonempty_selected_scope": "the scope must hold observations",
    "source_provenance_present": "at least one source must be named",
    "paper_acceptable_source_tier": "only official or curated official sources count as evidence",
    "temporal_span": "a short span says little about seasons",
    "state_breadth": "few states do not support national statements",
    "market_breadth": "a network needs several well observed markets",
    "observation_volume": "small panels give unstable estimates",
    "arrival_availability": "crunch and supply analyses need quantities",
    "coordinate_coverage": "maps and distance analyses need coordinates",
    "weather_market_coverage": "weather studies should cover most markets",
}


def in_scope(df: DataFrame, commodities: list[str], start: str, end: str) -> DataFrame:
    wanted = [c.strip() for c in commodities if c.strip()]
    return ensure_market_id(df).where(
        F.col("commodity").isin(wanted) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def used_markets(x: DataFrame) -> DataFrame:
    return x.select("market_id").distinct()


def readiness_summary(prices: DataFrame, markets: DataFrame | None, weather: DataFrame | None,
                      commodities: list[str], start: str, end: str) -> DataFrame:
    """One row describing the scope; an empty scope gives zeros and empty lists."""
    x = in_scope(prices, commodities, start, end)
    if "source_tier" not in x.columns:
        x = x.withColumn("source_tier", infer_source_tier(F.col("source"), F.col("data_mode")))
    ids = used_markets(x)
    n = F.count(F.lit(1))
    out = x.agg(
        n.alias("observations"), F.countDistinct("state").alias("states"), F.countDistinct("market_id").alias("markets"),
        F.coalesce(F.datediff(F.max("date"), F.min("date")) + 1, F.lit(0)).alias("span_days"),
        F.coalesce(F.try_divide(F.count("arrivals").cast("double"), n), F.lit(0.0)).alias("arrival_availability"),
        F.array_sort(F.collect_set(F.upper(F.coalesce("data_mode", F.lit(""))))).alias("data_modes"))
    sources = x.groupBy("source").agg(F.lit(1)).agg(F.array_sort(F.collect_set(F.nullif("source", F.lit("")))))
    extra: dict[str, Column] = {"sources": sources.scalar(), "source_tiers": tier_set(x).scalar()}
    if markets is not None:
        m = ensure_market_id(markets).join(ids, "market_id", "left_semi")
        m = m.groupBy("market_id").agg(F.min(F.struct("lat", "lon", "coordinate_quality")).alias("m")).select("m.*")
        has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        extra["coordinate_coverage"] = m.agg(F.coalesce(F.avg(has.cast("int")), F.lit(0.0))).scalar()
        per = m.groupBy(F.coalesce("coordinate_quality", F.lit("unknown")).alias("q")).agg(F.count(F.lit(1)).alias("k"))
        extra["coordinate_quality_counts"] = per.agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("q", "k"))))).scalar()
    else:
        extra["coordinate_coverage"] = F.lit(0.0)
        extra["coordinate_quality_counts"] = F.create_map().cast("map<string,bigint>")
    if weather is not None:
        w = ensure_market_id(weather).where(F.to_date("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        covered = w.join(ids, "market_id", "left_semi").agg(F.countDistinct("market_id")).scalar()
        extra["weather_market_coverage"] = F.coalesce(F.try_divide(covered.cast("double"), F.col("markets")), F.lit(0.0))
    else:
        extra["weather_market_coverage"] = F.lit(0.0)
    return out.withColumns(extra)


def readiness_gates(summary: DataFrame, policy: ReadinessPolicy = ReadinessPolicy()) -> DataFrame:
    """The gates as rows (gate, status, value, threshold, detail); hard gates fail, soft ones warn."""
    tiers = F.col("source_tiers")

    def listed(c: str) -> Column:
        return F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))

    def gate(name: str, ok: Column, value: Column, threshold: str, hard: bool) -> Column:
        return F.struct(F.lit(name).alias("gate"), F.when(ok, "PASS").otherwise("FAIL" if hard else "WARN").alias("status"),
                        value.cast("string").alias("value"), F.lit(threshold).alias("threshold"),
                        F.lit(GATE_NOTES[name]).alias("detail"))

    def at_least(name: str, column: str, limit, places: int | None = None) -> Column:
        v = F.col(column)
        return gate(name, v >= limit, v if places is None else F.round(v, places), str(limit), False)

    rows = [
        gate("real_data_only", F.col("data_modes") == F.array(F.lit("REAL")), listed("data_modes"), "[REAL]", True),
        gate("nonempty_selected_scope", F.col("observations") > 0, F.col("observations"), "> 0", True),
        gate("source_provenance_present", F.size("sources") > 0, F.size("sources"), ">= 1 source", True),
        gate("paper_acceptable_source_tier", F.coalesce(tiers_acceptable(tiers), F.lit(False)), listed("source_tiers"),
             "PRIMARY_OFFICIAL or CURATED_OFFICIAL_DERIVED only", True),
        at_least("temporal_span", "span_days", policy.min_span_days),
        at_least("state_breadth", "states", policy.min_states),
        at_least("market_breadth", "markets", policy.min_markets),
        at_least("observation_volume", "observations", policy.min_observations),
        at_least("arrival_availability", "arrival_availability", policy.min_arrival_availability, 4),
        at_least("coordinate_coverage", "coordinate_coverage", policy.min_coordinate_coverage, 4),
        at_least("weather_market_coverage", "weather_market_coverage", policy.min_weather_market_coverage, 4),
    ]
    return summary.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def readiness_status(gates: DataFrame) -> DataFrame:
    """One row: BLOCKED, READY_WITH_WARNINGS or READY, with the failed gate names."""
    fails, warns = F.count_if(F.col("status") == "FAIL"), F.count_if(F.col("status") == "WARN")
    return gates.agg(
        F.when(fails > 0, "BLOCKED").when(warns > 0, "READY_WITH_WARNINGS").otherwise("READY").alias("readiness"),
        fails.alias("failed"), warns.alias("warned"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "FAIL", F.col("gate")))), ",").alias("failed_gates"))
