"""Scans of panels, side tables, landed chunks and catalogs. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.coverage import data_mode
from ..operators.normalize import RENAMES, ensure_market_id, normalize_prices
from ..operators.panel import aggregate_market_daily
from ..spec import MARKETS_SCHEMA, PANEL_SCHEMA, RAW_SCHEMA, WEATHER_SCHEMA
from . import versions

CATALOG_COLUMNS = {
    "commodities": ["commodity_id", "commodity_name"],
    "geographies": ["census_state_id", "census_state_name", "census_district_id", "census_district_name"],
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_text_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with headings; every column stays text unless a schema is given. Blank cells stay NULL."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """A processed panel (Parquet or CSV) normalised and aggregated again, so foreign rows meet the same rules."""
    raw = landed(read_text_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path))
    return aggregate_market_daily(normalize_prices(raw, INGEST_ORDER, with_id=False))


def load_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side table, or an empty one of the same schema when the path is absent."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return ensure_market_id(spark.read.schema(schema).parquet(path))


def load_markets(spark: SparkSession, path: str) -> DataFrame:
    return load_optional(spark, path, MARKETS_SCHEMA)


def load_weather(spark: SparkSession, path: str) -> DataFrame:
    return load_optional(spark, path, WEATHER_SCHEMA)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel: of versions where it has manifests, else plain Parquet; an absent one is empty."""
    merged = versions.read(spark, path) if versions.is_versioned(spark, path) else None
    return load_optional(spark, path, PANEL_SCHEMA) if merged is None else merged


def side_tables(spark: SparkSession, panel: DataFrame, real: dict[str, str], demo: dict[str, str]) -> dict[str, DataFrame]:
    """Markets and weather for a panel. A REAL panel never falls back to demo side tables; absent ones are empty."""
    is_demo = data_mode(panel).first()[0] == "DEMO"
    out = {}
    for name, schema in (("markets", MARKETS_SCHEMA), ("weather", WEATHER_SCHEMA)):
        path = real[name]
        if is_demo and not path_exists(spark, path):
            path = demo[name]
        out[name] = load_optional(spark, path, schema)
    return out


def read_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All CSV chunks below a folder (or in a list), columns matched by heading whatever their order; absent ones are NULL.

    One scan reads all lines. A small table holds each file's heading and where it has each known column; lines join it by file and
    are parsed once, into an array from which columns are taken by place. Only the widest heading's number of columns and one
    unknown heading, if any, reach the driver. A file's heading is its first line that isn't blank; lines equal to it are headings, too.
    ``INGEST_ORDER`` columns tell which of two rows landed later. Headings without any known column are refused; values
    must not hold line ends.
    """
    lines = landed(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(paths)).where(F.trim("value") != "")
    heads = lines.where("chunk_start = 0").groupBy("chunk_path").agg(F.min_by("value", "chunk_row").alias("heading"))
    width = F.size(F.split("heading", ","))
    names = F.transform(F.split(F.regexp_replace("heading", "^\ufeff", ""), ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    known = [*(c.split()[0] for c in RAW_SCHEMA.split(", ")), "market_id"]
    strange = ~F.arrays_overlap(names, F.array(*map(F.lit, [*known, *RENAMES])))
    told = heads.agg(F.max(width).alias("width"), F.min(F.when(strange, F.col("heading"))).alias("strange")).first()
    if told["strange"] is not None:
        raise ValueError(f"no known column in: {told['strange']}")
    if told["width"] is None:
        return landed(spark.createDataFrame([], RAW_SCHEMA), of_files=False)
    olds = {new: old for old, new in RENAMES.items()}

    def place(column: str) -> Column:
        at = F.array_position("names", column)
        # an old heading counts where its canonical name is absent
        return F.when(at == 0, F.array_position("names", olds[column])).otherwise(at) if column in olds else at

    places = heads.withColumn("names", names).select(F.col("chunk_path").alias("__file"), "heading", F.struct(*(place(c).cast("int").alias(c) for c in known)).alias("at"))
    cells = ", ".join(f"c{k} string" for k in range(told["width"]))
    rows = lines.join(places, lines["chunk_path"] == places["__file"]).where(F.col("value") != F.col("heading"))
    rows = rows.withColumn("row", F.from_csv("value", cells, {"escape": '"'})).withColumn("row", F.array(*(F.col(f"row.c{k}") for k in range(told["width"]))))
    return rows.select(*(F.when(F.col(f"at.{c}") > 0, F.element_at("row", F.col(f"at.{c}"))).alias(c) for c in known), *INGEST_ORDER)


#: A row's place among all landed rows: file time, file, block, row within it.
INGEST_ORDER = ["chunk_time", "chunk_path", "chunk_start", "chunk_row"]


def landed(df: DataFrame, of_files: bool = True) -> DataFrame:
    """``df`` of a file scan with the columns of ``INGEST_ORDER``."""
    if not of_files:
        return df.select("*", F.lit(None).cast("timestamp").alias("chunk_time"), F.lit(None).cast("string").alias("chunk_path"),
                         F.lit(None).cast("bigint").alias("chunk_start"), F.lit(None).cast("bigint").alias("chunk_row"))
    return df.select("*", F.col("_metadata.file_modification_time").alias("chunk_time"), F.col("_metadata.file_path").alias("chunk_path"),
                     F.col("_metadata.file_block_start").alias("chunk_start"), F.monotonically_increasing_id().alias("chunk_row"))


def load_catalog(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A cached catalog; refuses one without its required columns."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    missing = set(CATALOG_COLUMNS[kind]) - set(df.columns)
    if missing:
        raise ValueError(f"{kind} catalog lacks {sorted(missing)}")
    ids = [c for c in CATALOG_COLUMNS[kind] if c.endswith("_id")]
    return df.withColumns({c: F.col(c).cast("string").try_cast("int") for c in ids})
