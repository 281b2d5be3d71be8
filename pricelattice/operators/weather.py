"""Weather anomalies, the market-weather join, grid-cell weather and the event study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import grid_centre, grid_index, median, with_robust_z
from ..spec import EventPolicy
from .normalize import ensure_market_id, keep_last

LAT_STEP, LON_STEP = 0.5, 0.625
WEATHER_VALUES = ["rainfall_mm", "temperature_c", "temperature_max_c", "temperature_min_c"]


def weather_anomalies(weather: DataFrame) -> DataFrame:
    """Robust z within place and calendar month, with the number of days behind it."""
    w = ensure_market_id(weather)
    place = next(c for c in ("market_id", "market", "state") if c in w.columns)
    part = Window.partitionBy(place, F.month("date"))
    for value, out in (("rainfall_mm", "rainfall_anomaly_z"), ("temperature_c", "temperature_anomaly_z")):
        if value in w.columns:
            w = with_robust_z(w, value, out, part)
    return w.withColumn("climatology_n", F.count(F.lit(1)).over(part))


def id_overlap(prices: DataFrame, weather: DataFrame) -> DataFrame:
    """One row: shared ids, distinct ids per side, and whether display names are unique on both sides."""
    p = prices.groupBy("market_id").agg(F.min("market").alias("pm"))
    w = weather.groupBy("market_id").agg(F.min("market").alias("wm"))
    shared = p.join(w.select("market_id"), "market_id", "left_semi").agg(F.count(F.lit(1))).scalar()

    def repeats(df: DataFrame):
        per = df.groupBy("market").agg(F.countDistinct("market_id").alias("k"))
        return per.agg(F.coalesce(F.max("k"), F.lit(0)) <= 1).scalar()

    out = p.agg(F.count(F.lit(1)).alias("price_ids"))
    out = out.withColumns({"weather_ids": w.agg(F.count(F.lit(1))).scalar(), "shared_ids": shared,
                           "names_unique": repeats(prices) & repeats(weather)})
    return out.withColumn("overlap_ratio", F.col("shared_ids") / F.greatest(F.lit(1), F.least("price_ids", "weather_ids")))


def join_market_weather(prices: DataFrame, weather: DataFrame, key: str | None = None) -> DataFrame:
    """Left join on (date, market id), or on (date, name) when ids barely overlap and names are unique.

    That choice depends on the data, so a one-row statistics job runs first unless the caller names the key.
    """
    p, w = ensure_market_id(prices), weather_anomalies(weather)
    if key:
        pass
    elif not {"market", "market_id"} <= set(w.columns):
        key = "market_id" if "market_id" in w.columns else "market"
    else:
        s = id_overlap(p, w).first()
        key = "market" if s["overlap_ratio"] < 0.5 and s["names_unique"] else "market_id"
    keys = ["date", key]
    cols = [c for c in [*WEATHER_VALUES, "rainfall_anomaly_z", "temperature_anomaly_z", "climatology_n"] if c in w.columns]
    right = w.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("w")).select(*keys, "w.*")
    return p.join(right, keys, "left")


def market_cells(markets: DataFrame) -> DataFrame:
    """Located markets with their grid cell as integer indices and as centre coordinates."""
    m = ensure_market_id(markets).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    m = m.withColumns({"cell_i": grid_index(F.col("lat"), LAT_STEP), "cell_j": grid_index(F.col("lon"), LON_STEP)})
    return m.withColumns({"power_cell_lat": grid_centre(F.col("cell_i"), LAT_STEP), "power_cell_lon": grid_centre(F.col("cell_j"), LON_STEP)})


def rebuild_weather(markets: DataFrame, chunks: DataFrame, order: list[str]) -> DataFrame:
    """Daily weather per market from cell chunks; the last chunk row of a cell and day wins. Joins on cell indices."""
    cell = {"cell_i": grid_index(F.col("power_cell_lat"), LAT_STEP), "cell_j": grid_index(F.col("power_cell_lon"), LON_STEP)}
    values = [c for c in WEATHER_VALUES if c in chunks.columns]
    w = chunks.withColumns(cell).withColumn("date", F.to_date("date")).select("cell_i", "cell_j", "date", *order, *values)
    w = keep_last(w, ["cell_i", "cell_j", "date"], order).drop(*order)
    m = market_cells(markets)
    place = [c for c in ("market_id", "state", "district", "market", "lat", "lon", "power_cell_lat", "power_cell_lon") if c in m.columns]
    out = m.select(*place, "cell_i", "cell_j").join(w, ["cell_i", "cell_j"])
    return out.select("date", *place, *values, F.lit("NASA_POWER").alias("source"), F.lit("REAL").alias("data_mode"))


def decluster(events: DataFrame, series: list[str], z: str, separation_days: int) -> DataFrame:
    """Chains of events with gaps of at most ``separation_days`` keep their strongest day, earliest on ties."""
    order = Window.partitionBy(*series).orderBy("date")
    gap = F.datediff("date", F.lag("date").over(order))
    x = events.withColumn("__new", F.when(gap <= separation_days, 0).otherwise(1))
    x = x.withColumn("__chain", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(*series, "__chain").orderBy(F.abs(z).desc(), "date")
    return x.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__new", "__chain", "__k")


def event_study(joined: DataFrame, z: str = "rainfall_anomaly_z", policy: EventPolicy = EventPolicy()) -> DataFrame:
    """Price and quantity change after declustered extreme days.

    Baseline is the previous report (``lag``); a response is the first report within [horizon, horizon + tolerance]
    days, a range frame over day numbers. All frames share one sort of the (commodity, market) series, so the study
    has no join at all.
    """
    series = ["commodity", "market_id"]
    x = ensure_market_id(joined).withColumn("__day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    rows = Window.partitionBy(*series).orderBy("__day")
    seen = F.struct("date", "modal_price", "arrivals")
    x = x.withColumn("__base", F.lag(seen).over(rows))
    hits = []
    for h in policy.horizons:
        frame = rows.rangeBetween(h, h + policy.tolerance_days)
        x = x.withColumn(f"__h{h}", F.first(seen).over(frame))
        hits.append(F.struct(F.lit(h).alias("h"), F.col(f"__h{h}").alias("f")))
    events = decluster(x.where(F.abs(z) >= policy.threshold), series, z, policy.separation_days)
    e = events.where(F.col("__base").isNotNull()).withColumn("__r", F.explode(F.array(*hits))).where(F.col("__r.f").isNotNull())
    price, q = F.col("__base.modal_price"), F.col("__base.arrivals")
    return e.select(
        "market_id", "market", "state", "commodity", F.col("date").alias("event_date"), F.col("__base.date").alias("baseline_date"),
        F.col("__r.f.date").alias("response_date"), F.col("__r.h").alias("horizon_days"), F.col(z).alias("weather_z"),
        F.when(F.col(z) > 0, "positive").otherwise("negative").alias("event_sign"),
        ((F.try_divide(F.col("__r.f.modal_price"), price) - 1) * 100).alias("price_change_pct"),
        ((F.try_divide(F.col("__r.f.arrivals"), q) - 1) * 100).alias("arrival_change_pct"))


def event_study_summary(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count and median response by sign and horizon; the number of declustered events bounds a group."""
    by = by or ["commodity"]
    return events.groupBy(*by, "event_sign", "horizon_days").agg(
        F.count("price_change_pct").alias("n"), median(F.col("price_change_pct")).alias("median_price_change_pct"),
        median(F.col("arrival_change_pct")).alias("median_arrival_change_pct"))
