"""Market-day aggregation, authority merge and market coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import join_on
from ..functions.numeric import in_coordinate_range, median
from ..functions.ranks import exact_medians
from ..functions.text import authority_rank
from ..session import shared_folder
from ..spec import MARKET_DAY_KEY, PANEL_KEY
from .normalize import ensure_market_id, keep_last

COORDINATE_COLUMNS = ["lat", "lon", "coordinate_quality", "coordinate_source"]


def _label_set(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",")


def quantity_rule(q: str = "arrivals", unit: str = "arrival_unit") -> tuple[Column, Column]:
    """A total repeated on every row counts once; distinct amounts add up; mixed units give no amount."""
    units = F.collect_set(unit)
    one_value = F.min(q) == F.max(q)
    amount = F.when(F.size(units) > 1, None).when(one_value, F.min(q)).otherwise(F.sum(q))
    label = F.when(F.size(units) > 1, F.concat(F.lit("MIXED:"), F.array_join(F.array_sort(units), "|"))).otherwise(F.min(unit))
    return amount, label


#: Rows of a group that one ``percentile`` may hold.
LARGE_GROUP = 100_000


def _large_groups(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of the groups of more than ``LARGE_GROUP`` rows, counted map-side; ``None`` without any."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > LARGE_GROUP).select(*keys)
    path = shared_folder(df.sparkSession, "large-groups")
    large.write.parquet(path)
    stored = df.sparkSession.read.schema(large.schema).parquet(path)
    return None if stored.isEmpty() else stored


def aggregate_market_daily(df: DataFrame, unbounded_groups: bool = False) -> DataFrame:
    """One record per market, commodity and day.

    After row normalisation a market-day holds one row per variety and grade, so ``percentile`` keeps a small state
    per group. ``unbounded_groups=True`` is for raw input in which one market-day may hold a large share of all rows: market-days
    are counted first, and those of more than ``LARGE_GROUP`` rows take their medians by bucketed selection instead.
    """
    if "market_id" in df.columns:
        df = ensure_market_id(df)
    # an id that follows from state, district and market is derived once per market-day instead of once per row
    keys = [k for k in MARKET_DAY_KEY if k in df.columns]
    if "arrival_unit" not in df.columns:
        df = df.withColumn("arrival_unit", F.lit("UNKNOWN"))
    unit = F.trim(F.coalesce(F.col("arrival_unit"), F.lit("")))
    df = df.withColumn("arrival_unit", F.coalesce(F.nullif(unit, F.lit("")), F.lit("UNKNOWN")))
    amount, label = quantity_rule()
    other = [
        F.countDistinct("variety").alias("varieties"),
        _label_set("source").alias("source"), _label_set("source_tier").alias("source_tier"),
        amount.alias("arrivals"), label.alias("arrival_unit"),
    ]
    prices = ["modal_price", "min_price", "max_price"]

    def small(rows: DataFrame) -> DataFrame:
        # the distinct-variety count as a set keeps this a single shuffle; the set is as small as the group
        varieties = F.size(F.collect_set("variety")).cast("bigint").alias("varieties")
        return rows.groupBy(*keys).agg(*[median(F.col(p)).alias(p) for p in prices], varieties, *other[1:])

    # the list of large market-days is stored, so that Spark knows its size and broadcasts it
    large = _large_groups(df, keys) if unbounded_groups else None
    if large is None:
        out = small(df)
    else:
        rows = join_on(df, large, keys, "left_semi")
        meds = exact_medians(rows, keys, {p: p for p in prices})
        out = small(join_on(df, large, keys, "left_anti")).unionByName(join_on(rows.groupBy(*keys).agg(*other), meds, keys, "left"), allowMissingColumns=True)
    return ensure_market_id(out).select(*MARKET_DAY_KEY, *prices, "varieties", "source", "source_tier", "arrivals", "arrival_unit")


def merge_market_daily(existing: DataFrame | None, incoming: DataFrame | None, look: bool = True) -> DataFrame:
    """Union two panels; per date, market and commodity the most authoritative row stays, incoming first on ties.

    An absent (``None``) or empty side returns the other one untouched. Looking for a first row runs a side's plan as far as that
    takes; ``look=False`` leaves it out where neither side is a stored table and an empty one is known not to matter.
    """
    if existing is None and incoming is None:
        raise ValueError("nothing to merge")
    if existing is None or (look and incoming is not None and existing.isEmpty()):
        return existing if incoming is None else incoming
    if incoming is None or (look and incoming.isEmpty()):
        return existing
    both = existing.withColumn("__incoming", F.lit(0)).unionByName(
        incoming.withColumn("__incoming", F.lit(1)), allowMissingColumns=True)
    both = ensure_market_id(both).withColumn("date", F.to_date("date"))
    if "source_tier" not in both.columns:
        both = both.withColumn("source_tier", F.lit(""))
    both = both.withColumn("__authority", authority_rank(F.col("source_tier")))
    return keep_last(both, PANEL_KEY, ["__authority", "__incoming"]).drop("__authority", "__incoming")


def update_market_index(daily: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct markets of a panel with any coordinates already known for them."""
    x = ensure_market_id(daily)
    base = x.groupBy("market_id").agg(F.min(F.struct("state", "district", "market")).alias("m")).select("market_id", "m.*")
    if known is None:
        return base.withColumns({
            "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"),
            "coordinate_quality": F.lit("unresolved"), "coordinate_source": F.lit("")})
    k = ensure_market_id(known)
    k = k.groupBy("market_id").agg(F.min(F.struct(*COORDINATE_COLUMNS)).alias("c")).select("market_id", "c.*")
    return base.join(k, "market_id", "left")


def import_coordinates(markets: DataFrame, coords: DataFrame, order: list[str],
                       quality: str = "user", source: str = "user_import") -> DataFrame:
    """Upsert coordinates: valid new values win, old values stay where the new ones are missing.

    ``order`` gives the file position of a coordinate row; the last row of a market wins.
    """
    c = ensure_market_id(coords)
    if not {"lat", "lon"} <= set(c.columns):
        raise ValueError("coordinates need lat and lon, and a market_id or state, district and market")
    c = c.withColumns({"lat": F.col("lat").cast("string").try_cast("double"), "lon": F.col("lon").cast("string").try_cast("double")})
    c = c.where(in_coordinate_range(F.col("lat"), F.col("lon")))
    for name, default in (("coordinate_quality", quality), ("coordinate_source", source)):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(default))
    c = keep_last(c.select("market_id", *order, *COORDINATE_COLUMNS), ["market_id"], order)
    c = c.select("market_id", *[F.col(x).alias(f"__new_{x}") for x in COORDINATE_COLUMNS])
    m = ensure_market_id(markets)
    out = m.join(c, "market_id", "left")
    fill = {x: F.coalesce(F.col(f"__new_{x}"), F.col(x)) if x in m.columns else F.col(f"__new_{x}") for x in COORDINATE_COLUMNS}
    return out.withColumns(fill).drop(*[f"__new_{x}" for x in COORDINATE_COLUMNS])


def coordinate_audit(markets: DataFrame, valid_rows: DataFrame | None = None) -> DataFrame:
    """(metric, value): totals, resolved and unresolved markets, and valid import rows when given."""
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    one = markets.agg(
        F.count(F.lit(1)).alias("markets_total"), F.count_if(has).alias("coordinates_resolved"),
        F.count_if(~has).alias("coordinates_unresolved"))
    if valid_rows is not None:
        one = one.withColumn("import_rows_valid", valid_rows.agg(F.count(F.lit(1))).scalar())
    return one.unpivot([], one.columns, "metric", "value")


def unresolved_markets(markets: DataFrame, limit: int | None = None) -> DataFrame:
    """Work list of markets without coordinates, in id order."""
    out = markets.where(F.col("lat").isNull() | F.col("lon").isNull()).orderBy("market_id")
    return out.limit(limit) if limit is not None else out
