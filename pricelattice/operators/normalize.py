"""Row normalisation: text rows of any provenance to typed, bounded, de-duplicated price rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical_state, infer_source_tier, make_market_id, slug
from ..spec import PRICE_COLUMNS, ROW_KEY

# Canonical column names and the old headings that stand for them.
RENAMES = {"arrival_date": "date", "arrival_quantity": "arrivals"}
TEXT_COLUMNS = ["state", "district", "market", "commodity", "variety", "grade", "source", "source_tier", "data_mode"]
NUMERIC_COLUMNS = ["min_price", "max_price", "modal_price", "arrivals"]
MAX_PRICE = 1_000_000


def rename_and_default(df: DataFrame) -> DataFrame:
    """Old headings to canonical ones; absent text columns become '', absent numbers NULL, blank units UNKNOWN."""
    df = df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})
    have = set(df.columns)
    cols = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("") for c in TEXT_COLUMNS}
    unit = F.trim(F.coalesce(F.col("arrival_unit").cast("string"), F.lit(""))) if "arrival_unit" in have else F.lit("")
    cols["arrival_unit"] = F.coalesce(F.nullif(unit, F.lit("")), F.lit("UNKNOWN"))
    for c in NUMERIC_COLUMNS:
        if c not in have:
            cols[c] = F.lit(None).cast("double")
    return df.withColumns(cols)


#: Day-first forms of portals besides ISO, each with the shape of its text; a text is parsed once, by the form that it has the shape of.
DATE_FORMS = (
    ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("d/M/yy", r"\d{1,2}/\d{1,2}/\d{2}"), ("d/M/yyyy H:mm", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}"),
    ("d/M/yyyy H:mm:ss", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}"), ("yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}"), ("d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"),
    ("d MMM yyyy", r"\d{1,2} \p{Alpha}{3} \d{4}"), ("d-MMM-yyyy", r"\d{1,2}-\p{Alpha}{3}-\d{4}"), ("d MMMM yyyy", r"\d{1,2} \p{Alpha}{4,} \d{4}"),
    ("d-MMM-yy", r"\d{1,2}-\p{Alpha}{3}-\d{2}"), ("d.M.yyyy", r"\d{1,2}\.\d{1,2}\.\d{4}"))
ISO = r"[+-]?\d{4,7}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?"


def parse_date(c: Column, is_text: bool = True) -> Column:
    """Text is ISO (offsets honoured, UTC day kept) or one of ``DATE_FORMS``, day first; other text is NULL."""
    if not is_text:
        return F.to_date(c)
    text = F.trim(c.cast("string"))
    out = F.when(text.rlike(f"^(?:{ISO})$"), F.to_date(F.try_to_timestamp(text)))
    for form, shape in DATE_FORMS:
        out = out.when(text.rlike(f"^(?:{shape})$"), F.to_date(F.try_to_timestamp(text, F.lit(form))))
    return out


def to_number(c: Column) -> Column:
    """Coerce to double; text that is no number, and NaN, become NULL."""
    return F.nullif(F.trim(c.cast("string")).try_cast("double"), F.lit(float("nan")))


def coerce_types(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    out = df.withColumn("date", parse_date(F.col("date"), kinds["date"] == "string"))
    return out.withColumns({
        c: to_number(F.col(c)) if kinds[c] == "string" else F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        for c in NUMERIC_COLUMNS})


def row_rules(df: DataFrame) -> DataFrame:
    """Required fields, price bounds, price order and quantity sign. Blank text counts as present.

    The row number keeps the filter above the projection that parses dates and prices. Pushed below it, every condition would parse
    them again, in one generated method that is too long for the JVM to compile.
    """
    df = df.withColumn("__row", F.monotonically_increasing_id())
    ok = F.col("__row") >= 0
    for c in ("date", "state", "market", "commodity", "modal_price"):
        ok = ok & F.col(c).isNotNull()
    df = df.where(ok & (F.col("modal_price") > 0) & (F.col("modal_price") < MAX_PRICE)).drop("__row")
    bad_order = F.coalesce((F.col("min_price") > F.col("modal_price")) | (F.col("modal_price") > F.col("max_price")), F.lit(False)) \
        & F.col("min_price").isNotNull() & F.col("max_price").isNotNull()
    return df.withColumns({
        "min_price": F.when(~bad_order, F.col("min_price")),
        "max_price": F.when(~bad_order, F.col("max_price")),
        "arrivals": F.when(F.col("arrivals") >= 0, F.col("arrivals")),
    })


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the row with the greatest ``order`` per key.

    One aggregate of the maximal struct: it combines map-side, so a key repeated over a third of the input costs one
    row per task. Remaining columns follow ``order`` inside the struct, which makes the choice total.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.max(F.struct(*order, *rest)).alias("__last")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in df.columns if c not in keys])


def ensure_market_id(df: DataFrame) -> DataFrame:
    """Fill missing or blank ids from state, district and market; frames without geography use the market name."""
    have = set(df.columns)
    if "market" not in have and "market_id" not in have:
        return df
    if {"state", "market"} <= have:
        made = make_market_id(F.col("state"), F.col("district") if "district" in have else F.lit(""), F.col("market"))
    elif "market_id" in have:
        return df
    else:
        made = slug(F.col("market"))
    if "market_id" not in have:
        return df.withColumn("market_id", made)
    kept = F.col("market_id").cast("string")
    return df.withColumn("market_id", F.when(F.trim(F.coalesce(kept, F.lit(""))) != "", kept).otherwise(made))


def normalize_prices(df: DataFrame, order: list[str] | None = None, with_id: bool = True) -> DataFrame:
    """Full row normaliser. ``order`` names the ingest-order columns that decide which duplicate is last.

    ``with_id=False`` leaves deriving absent market ids to the market-day aggregation that follows.
    """
    out = rename_and_default(df)
    out = out.withColumn("state", canonical_state(F.col("state")))
    out = out.withColumn("source_tier", F.when(F.col("source_tier") == "", infer_source_tier(F.col("source"), F.col("data_mode")))
                         .otherwise(F.col("source_tier")))
    out = row_rules(coerce_types(out))
    extra = [c for c in ("market_id",) if c in out.columns]
    out = out.select(*PRICE_COLUMNS, *extra, *[c for c in (order or []) if c not in PRICE_COLUMNS])
    out = keep_last(out, ROW_KEY, order or [])
    if not with_id and not extra:
        return out.select(*PRICE_COLUMNS)
    return ensure_market_id(out).select(*PRICE_COLUMNS, "market_id")


def market_metadata(df: DataFrame, order: list[str]) -> DataFrame:
    """First row per market id by ``order``."""
    x = ensure_market_id(df)
    cols = [c for c in ("state", "district", "market") if c in x.columns]
    first = F.min_by(F.struct(*cols), F.struct(*order, *cols)).alias("m")
    return x.groupBy("market_id").agg(first).select("market_id", *[F.col(f"m.{c}").alias(c) for c in cols])


def scope_filter(df: DataFrame, commodity: str | None = None, state: str | None = None,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """Commodity, state ('All India' means every state) and inclusive date bounds; all reach the scan."""
    if commodity:
        df = df.where(F.col("commodity") == commodity)
    if state and state != "All India":
        df = df.where(F.col("state") == state)
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def national_frame(df: DataFrame, commodity: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return scope_filter(df, commodity, "All India", start, end)
