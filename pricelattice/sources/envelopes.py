"""Landed JSON payloads to rows. Text goes through ``from_json`` with a fixed schema; bad payloads go to a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical_state

JOIN_KEY = ["date", "commodity_id", "census_state_id", "census_district_id", "market_id"]
MISSING_WEATHER = -999.0
# fixed parameter names of the weather payload -> canonical columns
WEATHER_PARAMETERS = {"PRECTOTCORR": "rainfall_mm", "T2M": "temperature_c", "T2M_MAX": "temperature_max_c", "T2M_MIN": "temperature_min_c"}


def unwrap(df: DataFrame, payload: str, row: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of payloads shaped {output: {type, message, data}} or {data}; ``row`` is a DDL row schema."""
    schema = f"output struct<type: string, message: string, data: array<struct<{row}>>>, data array<struct<{row}>>"
    x = df.select(*keep, F.col(payload).alias("__t"), F.from_json(payload, schema).alias("__j"))
    wrapped = F.col("__j.output").isNotNull()
    status = F.lower(F.coalesce(F.col("__j.output.type"), F.lit("success")))
    malformed = F.col("__j").isNull() | ~F.trim("__t").startswith("{")
    reason = F.when(malformed, "payload is not a JSON object").when(
        wrapped & (status != "success"), F.concat(F.lit("source error: "), F.coalesce(F.col("__j.output.message"), F.lit("unknown error"))))
    x = x.withColumn("reason", reason)
    data = F.when(wrapped, F.col("__j.output.data")).otherwise(F.col("__j.data"))
    rows = x.where(F.col("reason").isNull()).select(*keep, F.posexplode(data).alias("position", "__r")).where(F.col("__r").isNotNull())
    return rows.select(*keep, "position", "__r.*"), x.where(F.col("reason").isNotNull()).select(*keep, "reason")


def records(df: DataFrame, payload: str, row: str, order: list[str], max_records: int | None = None,
            filters: dict[str, str] | None = None) -> DataFrame:
    """Paged {records: [...]} payloads to rows in page order, with equality filters and an optional record cap."""
    parsed = F.from_json(payload, f"records array<struct<{row}>>")
    x = df.select(*order, F.posexplode(parsed["records"]).alias("position", "__r")).select(*order, "position", "__r.*")
    for c, v in (filters or {}).items():
        if v:
            x = x.where(F.col(c) == v)
    return x if max_records is None else x.orderBy(*order, "position").limit(max_records)


def rainfall_rows(df: DataFrame, payload: str, row: str, keep: list[str]) -> DataFrame:
    """Rainfall payloads: the list sits under data, records or result, or the payload is the list itself."""
    arr = f"array<struct<{row}>>"
    obj = F.from_json(payload, f"data {arr}, records {arr}, result {arr}")
    bare = F.when(F.ltrim(F.col(payload)).startswith("["), F.from_json(payload, arr))
    found = F.coalesce(bare, obj["data"], obj["records"], obj["result"])
    return df.select(*keep, F.posexplode(found).alias("position", "__r")).select(*keep, "position", "__r.*")


def daily_weather(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Map-of-maps weather payloads to one row per day over the union of all date keys; -999 means missing."""
    j = F.from_json(payload, "properties struct<parameter: map<string, map<string, double>>>")
    x = df.select(*keep, j["properties"]["parameter"].alias("__p")).where(F.col("__p").isNotNull())
    days = F.array_distinct(F.flatten(F.transform(F.map_values("__p"), lambda m: F.map_keys(m))))
    x = x.withColumn("__k", F.explode(days))

    def value(name: str) -> Column:
        return F.nullif(F.try_element_at(F.try_element_at("__p", F.lit(name)), F.col("__k")), F.lit(MISSING_WEATHER))

    return x.select(*keep, F.to_date("__k", "yyyyMMdd").alias("date"), *[value(p).alias(c) for p, c in WEATHER_PARAMETERS.items()],
                    F.lit("NASA_POWER").alias("source"), F.lit("REAL").alias("data_mode"))


def canonical_rows(prices: DataFrame, quantities: DataFrame | None, markets: DataFrame, commodities: DataFrame,
                   geographies: DataFrame) -> DataFrame:
    """Price rows joined with quantities on date and four ids, ids resolved to names.

    Ids that are no numbers drop out; a market without a catalog name is called ``Market #id``.
    """
    def with_id(df: DataFrame) -> DataFrame:
        return df.withColumn("market_id", F.col("market_id").cast("string").try_cast("double").cast("bigint")).where(F.col("market_id").isNotNull())

    p = with_id(prices)
    qty = unit = None
    if quantities is not None and set(JOIN_KEY) <= set(quantities.columns):
        qty = next((c for c in ("quantity", "arrivals") if c in quantities.columns), None)
        unit = next((c for c in ("arrival_unit", "quantity_unit", "unit") if c in quantities.columns), None)
    if qty:
        cols = [F.col(qty).alias("arrivals"), (F.col(unit) if unit else F.lit("UNKNOWN")).alias("arrival_unit")]
        p = p.drop("arrivals", "arrival_unit").join(with_id(quantities).select(*JOIN_KEY, *cols), JOIN_KEY, "left")
    else:
        p = p.withColumn("arrivals", F.lit(None).cast("double")).withColumn("arrival_unit", F.lit("UNKNOWN"))
    names = with_id(markets).groupBy("market_id").agg(F.min("market_name").alias("market_name"))
    geo = geographies.groupBy("census_state_id", "census_district_id").agg(
        F.min("census_state_name").alias("census_state_name"), F.min("census_district_name").alias("census_district_name"))
    x = (p.join(names, "market_id", "left").join(commodities.select("commodity_id", "commodity_name"), "commodity_id", "left")
         .join(geo, ["census_state_id", "census_district_id"], "left"))
    return x.select(
        "date", canonical_state(F.col("census_state_name")).alias("state"), F.trim("census_district_name").alias("district"),
        F.coalesce(F.trim("market_name"), F.concat(F.lit("Market #"), F.col("market_id").cast("string"))).alias("market"),
        F.trim("commodity_name").alias("commodity"), F.lit("").alias("variety"), F.lit("").alias("grade"), "min_price", "max_price",
        "modal_price", "arrivals", "arrival_unit", F.lit("CEDA_AGMARKNET").alias("source"),
        F.lit("CURATED_OFFICIAL_DERIVED").alias("source_tier"), F.lit("REAL").alias("data_mode"),
        F.col("commodity_id").alias("source_commodity_id"), F.col("census_state_id").alias("source_state_id"),
        F.col("census_district_id").alias("source_district_id"), F.col("market_id").alias("source_market_id"))
