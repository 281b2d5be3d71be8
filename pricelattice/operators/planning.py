"""Ingestion planning as tables: windows, jobs, keys, resume, name resolution, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import canonical_state, job_slug
from .weather import market_cells

JOB_COLUMNS = ["commodity_id", "commodity_name", "state_id", "state_name", "district_id", "district_name", "start_date", "end_date"]


def year_window_array(start: Column, end: Column) -> Column:
    """Array of (start_date, end_date), one per calendar year of the inclusive range; an inverted range is an error."""
    years = F.sequence(F.year(start), F.year(end))
    wins = F.transform(years, lambda y: F.struct(
        F.greatest(start, F.make_date(y, F.lit(1), F.lit(1))).alias("start_date"),
        F.least(end, F.make_date(y, F.lit(12), F.lit(31))).alias("end_date")))
    return F.when(end < start, F.raise_error(F.lit("end_date must be on or after start_date"))).otherwise(wins)


def year_windows(df: DataFrame, start: str, end: str) -> DataFrame:
    keep = [c for c in df.columns if c not in (start, end)]
    x = df.withColumn("__w", F.explode(year_window_array(F.to_date(start), F.to_date(end))))
    return x.select(*keep, "__w.start_date", "__w.end_date")


def resolve_names(requests: DataFrame, catalog: DataFrame, name: str, key: str, states: bool = False) -> DataFrame:
    """Match requested names: case-folded equality first, else a unique substring match.

    ``requests`` has one row per name a user typed. Every request gets a status: matched, ambiguous or unknown. The
    substring test covers only requests without an exact match. It is an equi-join on the substrings of the distinct
    catalog names, which are short, so no request is compared with every name.
    """
    def fold(c: Column) -> Column:
        return F.lower(F.trim(canonical_state(c) if states else c))

    cat = catalog.groupBy(key).agg(F.min(name).alias(name)).withColumn("__f", fold(F.col(name)))
    req = requests.select(F.col("name"), fold(F.col("name")).alias("__t")).distinct()
    one = cat.groupBy("__f").agg(F.min(F.struct(F.col(key), F.col(name))).alias("m"))
    exact = req.join(one, req["__t"] == one["__f"]).select("name", "m", F.lit("matched").alias("status"))
    rest = req.join(exact.select("name"), "name", "left_anti")
    size = F.length("__f")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
        F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col("__f"), i, n))))
    inside = cat.where(size > 0).select(F.col(key), F.col(name), F.explode(F.array_distinct(F.array_append(pieces, F.lit("")))).alias("__t"))
    found = rest.join(inside, "__t", "left").groupBy("name").agg(
        F.count(F.col(key)).alias("k"), F.min(F.struct(F.col(key), F.col(name))).alias("m"))
    status = F.when(F.col("k") == 1, "matched").when(F.col("k") > 1, "ambiguous").otherwise("unknown")
    part = found.select("name", F.when(F.col("k") == 1, F.col("m")).alias("m"), status.alias("status"))
    return exact.unionByName(part).select("name", F.col(f"m.{key}").alias(key), F.col(f"m.{name}").alias(name), "status")


def job_plan(commodities: DataFrame, districts: DataFrame, start: str, end: str, states: list[int] | None = None,
             district_limit: int | None = None) -> DataFrame:
    """Commodity x district x year jobs.

    The selected commodities are a user's short list: they travel as one array value and are exploded beside the
    year windows, so the product needs no join.
    """
    d = districts
    if states is not None:
        d = d.where(F.col("state_id").isin(states))
    if district_limit:
        order = Window.partitionBy("state_id").orderBy("district_name", "district_id")
        d = d.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= district_limit).drop("__k")
    picked = commodities.select("commodity_id", "commodity_name").distinct().agg(
        F.array_sort(F.collect_list(F.struct("commodity_id", "commodity_name")))).scalar()
    wins = year_window_array(F.lit(start).cast("date"), F.lit(end).cast("date"))
    x = d.withColumn("__c", F.explode(picked)).withColumn("__w", F.explode(wins))
    return x.select("__c.commodity_id", "__c.commodity_name", "state_id", "state_name", "district_id", "district_name",
                    "__w.start_date", "__w.end_date")


def job_key() -> Column:
    return F.concat_ws("/", job_slug(F.col("commodity_name")), job_slug(F.col("state_name")), F.concat_ws(
        "_", F.col("district_id").cast("string"), job_slug(F.col("district_name")),
        F.date_format("start_date", "yyyy-MM-dd"), F.date_format("end_date", "yyyy-MM-dd")))


def weather_plan(markets: DataFrame, start: str, end: str) -> DataFrame:
    """One job per distinct grid cell and year: nearby markets share their request."""
    cells = market_cells(markets).select("power_cell_lat", "power_cell_lon").distinct()
    x = cells.withColumn("__w", F.explode(year_window_array(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return x.select(F.col("power_cell_lat").alias("cell_lat"), F.col("power_cell_lon").alias("cell_lon"), "__w.start_date", "__w.end_date")


def weather_job_key() -> Column:
    def signed(c: str, width: int) -> Column:
        sign = F.when(F.col(c) < 0, "-").otherwise("+")
        return F.concat(sign, F.lpad(F.format_string("%.3f", F.abs(c)), width - 1, "0"))

    return F.concat_ws("_", signed("cell_lat", 7), signed("cell_lon", 8),
                       F.date_format("start_date", "yyyy-MM-dd"), F.date_format("end_date", "yyyy-MM-dd"))


def pending_jobs(jobs: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Jobs without a completed ledger entry; ``force`` plans all of them again."""
    if force:
        return jobs
    return jobs.join(ledger.where(F.col("status").isin("fetched", "empty")).select("job_key"), "job_key", "left_anti")


def run_counters(jobs: DataFrame, ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: planned, fetched, cached, empty, failed, rows. An empty job counts as fetched too."""
    done = ledger.where(F.col("status").isin("fetched", "empty"))
    cached = jobs.join(done.select("job_key"), "job_key", "left_semi").agg(F.count(F.lit(1))).scalar()
    out = outcomes.agg(
        F.count_if(F.col("status").isin("fetched", "empty")).alias("fetched"), F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"))
    return out.withColumns({"planned": jobs.agg(F.count(F.lit(1))).scalar(), "cached": cached})
