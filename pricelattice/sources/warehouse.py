"""A star schema (line items, suppliers, nations, regions, parts, orders, customers) read as market panels.

Suppliers or their nations play the market, part types the commodity, the ship date the reporting date. Joins carry
no broadcast hint: Spark broadcasts the small dimensions by their size statistics and shuffles them once they grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.joins import join_on
from ..functions.numeric import median
from ..functions.text import make_market_id
from ..operators.normalize import keep_last
from ..operators.panel import aggregate_market_daily
from ..session import cut_lineage, shared_folder
from ..spec import ROW_KEY

INGEST_ORDER = ["l_orderkey", "l_linenumber"]


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; its schema is read from the footer once per path and then passed on, which saves a job per scan."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def geography(spark: SparkSession, folder: str) -> DataFrame:
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def price_rows(spark: SparkSession, folder: str, typed: bool = False, fine: bool = False) -> DataFrame:
    """Typed price rows at variety/grade grain. ``typed``: commodity = part type; ``fine``: market = supplier."""
    li, s, p = table(spark, folder, "lineitem"), table(spark, folder, "supplier"), table(spark, folder, "part")
    x = (li.join(s.select("s_suppkey", "s_nationkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
         .join(geography(spark, folder), F.col("s_nationkey") == F.col("n_nationkey"))
         .join(p.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")))
    modal = F.col("l_extendedprice") / F.col("l_quantity")
    return x.select(
        F.to_date("l_shipdate").alias("date"), F.col("r_name").alias("state"), F.col("n_name").alias("district"),
        F.col("s_name" if fine else "n_name").alias("market"),
        (F.col("p_type") if typed else F.lit("ALL")).alias("commodity"),
        F.col("p_brand").alias("variety"), F.col("l_returnflag").alias("grade"),
        (modal * (1 - F.col("l_discount"))).alias("min_price"), (modal * (1 + F.col("l_tax"))).alias("max_price"),
        modal.alias("modal_price"), F.col("l_quantity").alias("arrivals"),
        (F.col("l_linestatus") if typed else F.lit("unit")).alias("arrival_unit"),
        F.when(F.col("l_returnflag") == "A", "CEDA_AGMARKNET").when(F.col("l_returnflag") == "N", "DATA_GOV_FEED")
        .otherwise("STATE_ARCHIVE").alias("source"),
        F.when(F.col("l_returnflag") == "A", "CURATED_OFFICIAL_DERIVED").when(F.col("l_returnflag") == "N", "PRIMARY_OFFICIAL")
        .otherwise("SECONDARY_MIRROR").alias("source_tier"),
        F.lit("REAL").alias("data_mode"), *INGEST_ORDER)


def panel(spark: SparkSession, folder: str, typed: bool = False, fine: bool = False) -> DataFrame:
    """Market-day panel: last row per variety and grade, then one record per market, commodity and day."""
    rows = keep_last(price_rows(spark, folder, typed, fine), ROW_KEY, INGEST_ORDER)
    return aggregate_market_daily(rows.drop(*INGEST_ORDER))


def stored_panel(spark: SparkSession, folder: str, typed: bool = False, fine: bool = False) -> DataFrame:
    """The panel written once to the checkpoint folder, for work that reads it several times."""
    return cut_lineage(panel(spark, folder, typed, fine))


def daily_prices(spark: SparkSession, folder: str, typed: bool = False, fine: bool = False) -> tuple[DataFrame, DataFrame]:
    """``date, commodity, market_id, modal_price`` of ``panel`` with numbers for names, and the commodities' names (``number, name``).

    Names are numbered in the small tables, so that a row takes only numbers to where rows meet. Written once, compressed, to the shared folder."""
    def numbered(names: DataFrame, number: str) -> DataFrame:
        return cut_lineage(names.distinct().withColumn(number, F.monotonically_increasing_id()))

    place, kind = ["state", "district", "market"], ["p_type", "p_brand"]
    s = table(spark, folder, "supplier").join(geography(spark, folder), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("s_suppkey", F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("s_name" if fine else "n_name").alias("market"))
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_type") if typed else F.lit("ALL")).alias("p_type"), "p_brand")
    places = numbered(s.select(*place), "place")
    ids = places.withColumn("id", make_market_id(*map(F.col, place)))
    places = join_on(ids, numbered(ids.select("id"), "market_id"), ["id"]).drop("id")
    types = numbered(p.select("p_type"), "commodity")
    kinds = join_on(numbered(p.select(*kind), "kind"), types, ["p_type"])
    rows = (table(spark, folder, "lineitem")
            .join(join_on(s, places, place).drop(*place), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(join_on(p, kinds, kind).drop(*kind), F.col("l_partkey") == F.col("p_partkey")))
    modal = F.col("l_extendedprice") / F.col("l_quantity")
    # as in keep_last, what follows the order decides between rows of one place in it
    last = F.max(F.struct(*INGEST_ORDER, (modal * (1 - F.col("l_discount"))).alias("min_price"), (modal * (1 + F.col("l_tax"))).alias("max_price"),
                          modal.alias("modal_price"))).alias("last")
    found = rows.groupBy(F.to_date("l_shipdate").alias("date"), "commodity", "market_id", "place", "kind", "l_returnflag").agg(last)
    days = found.groupBy("date", "commodity", "market_id", "place").agg(median(F.col("last.modal_price")).alias("modal_price")).drop("place")
    path = shared_folder(spark, "daily-prices")
    days.write.parquet(path)
    return spark.read.schema(days.schema).parquet(path), types.select(F.col("commodity").alias("number"), F.col("p_type").alias("name"))


def text_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as untyped, untidy text: padded names, two date styles, non-numbers, negative amounts."""
    x = price_rows(spark, folder, typed=True)
    line = F.col("l_linenumber")
    slashed = F.date_format("date", "dd/MM/yyyy")
    state = (F.when(F.col("district") == "NATION_0", "NCT of Delhi").when(F.col("district") == "NATION_1", " Orissa ")
             .when(F.col("district") == "NATION_2", "Mahārāshtra").otherwise(F.concat(F.lit("  "), F.col("state"))))
    return x.select(
        F.when(line == 7, "no date").when(line % 2 == 0, slashed).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("arrival_date"),
        state.alias("state"), F.col("district"), F.concat(F.col("market"), F.lit(" ")).alias("market"), "commodity", "variety", "grade",
        F.when(line == 4, F.col("modal_price") * 2).otherwise(F.col("min_price")).cast("string").alias("min_price"),
        F.col("max_price").cast("string").alias("max_price"), F.col("modal_price").cast("string").alias("modal_price"),
        F.when(line == 3, "n/a").when(line == 5, "-1").otherwise(F.col("arrivals").cast("bigint").cast("string")).alias("arrival_quantity"),
        F.when(line == 6, "").otherwise("tonne").alias("arrival_unit"), "source",
        F.when(line == 2, "USER_SUPPLIED").otherwise("").alias("source_tier"), "data_mode", *INGEST_ORDER)


def coordinates(spark: SparkSession, folder: str, fine: bool = False) -> DataFrame:
    """Synthetic coordinates per nation, or per supplier when ``fine``."""
    g = geography(spark, folder)
    if fine:
        s = table(spark, folder, "supplier")
        x = s.join(g, F.col("s_nationkey") == F.col("n_nationkey"))
        key, market = F.col("s_suppkey"), F.col("s_name")
        lat, lon = 6 + (key * 7) % 32 + (key % 10) / 20.0, 67 + (key * 11) % 31 + (key % 7) / 10.0
    else:
        x, key, market = g, F.col("n_nationkey"), F.col("n_name")
        lat, lon = 6 + (key * 7) % 32, 67 + (key * 11) % 31
    return x.select(
        make_market_id(F.col("r_name"), F.col("n_name"), market).alias("market_id"), F.col("r_name").alias("state"),
        F.col("n_name").alias("district"), market.alias("market"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"),
        F.when(key % 3 == 0, "reviewed").when(key % 3 == 1, "geocoded").alias("coordinate_quality"),
        F.lit("survey").alias("coordinate_source"), key.cast("bigint").alias("position"))


def daily_signal(spark: SparkSession, folder: str) -> DataFrame:
    """A second daily series per nation from orders, standing in for weather."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    x = (o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .join(geography(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")))
    day = x.groupBy(F.to_date("o_orderdate").alias("date"), "r_name", "n_name").agg(
        (F.avg("o_totalprice") / 1000).alias("rainfall_mm"), F.count(F.lit(1)).cast("double").alias("temperature_c"))
    return day.select(
        "date", make_market_id(F.col("r_name"), F.col("n_name"), F.col("n_name")).alias("market_id"),
        F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("n_name").alias("market"),
        "rainfall_mm", "temperature_c")
