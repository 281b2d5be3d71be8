"""Schema-tolerant imports of portal exports and the routes that stamp provenance on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..operators.normalize import normalize_prices
from ..operators.panel import aggregate_market_daily, merge_market_daily
from ..spec import GENERIC_IMPORT_TIERS

# ---- fixed heading vocabulary ----
# canonical column -> headings that mean exactly that column
EXACT_HEADINGS = {
    "date": ["date", "reported_date", "arrival_date", "period"],
    "state": ["state", "state_name"],
    "district": ["district", "district_name"],
    "market": ["market", "market_name", "mandi", "mandi_name"],
    "commodity": ["commodity", "commodity_name", "crop", "crop_name"],
    "variety": ["variety", "variety_name"],
    "grade": ["grade", "grade_name"],
}
# canonical column -> fragments of which one must occur, fragment that must occur, fragments that must not
FRAGMENT_HEADINGS = {
    "date": (["date"], "", []),
    "min_price": (["min"], "price", []),
    "max_price": (["max"], "price", []),
    "modal_price": (["modal", "mode"], "price", []),
    "arrivals": (["arrival", "quantity", "qty"], "", ["date", "unit"]),
    "arrival_unit": (["arrival", "quantity", "qty"], "unit", []),
}
# ---- end of fixed values ----
REQUIRED = ("date", "state", "market", "commodity", "modal_price")
# fixed provenance per dedicated route: (source label, tier)
ROUTES = {
    "curated_portal": ("CEDA_PORTAL_EXPORT", "CURATED_OFFICIAL_DERIVED"),
    "official_manual": ("DATA_GOV_IN_AGMARKNET_MANUAL", "PRIMARY_OFFICIAL"),
    "official_current": ("DATA_GOV_IN_AGMARKNET", "PRIMARY_OFFICIAL"),
}


def heading_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def map_headings(columns: list[str]) -> dict[str, str]:
    """Incoming heading -> canonical column, from column names alone; exact headings come before fragments."""
    keys = {c: heading_key(c) for c in columns}
    found: dict[str, str] = {}
    for target, names in EXACT_HEADINGS.items():
        found |= {target: c for c in reversed(columns) if keys[c] in names}
    for target, (some, must, never) in FRAGMENT_HEADINGS.items():
        if target in found:
            continue
        hits = [c for c in columns if any(f in keys[c] for f in some) and must in keys[c] and not any(f in keys[c] for f in never)]
        if hits:
            found[target] = hits[0]
    return {c: target for target, c in found.items()}


def canonicalize_export(df: DataFrame, *, state: str | None = None, district: str | None = None, market: str | None = None,
                        commodity: str | None = None) -> DataFrame:
    """Canonical columns, metadata for missing or blank identity; refuses frames without the required fields."""
    mapping = map_headings(df.columns)
    out = df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])
    for field, value in (("state", state), ("district", district), ("market", market), ("commodity", commodity)):
        if value is None:
            continue
        current = F.nullif(F.col(field), F.lit("")) if field in out.columns else F.lit(None).cast("string")
        out = out.withColumn(field, F.coalesce(current, F.lit(value)))
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError("columns missing from the import: " + ", ".join(missing))
    blanks = {"district": "", "variety": "", "grade": "", "min_price": None, "max_price": None, "arrivals": None, "arrival_unit": "UNKNOWN"}
    return out.withColumns({c: F.lit(v).cast("string") for c, v in blanks.items() if c not in out.columns})


def import_panel(raw: DataFrame, existing: DataFrame | None, source: str, tier: str, order: list[str] | None = None) -> DataFrame:
    """Stamp provenance, normalise, aggregate to market days and merge into the panel."""
    x = raw.withColumns({"source": F.lit(source), "source_tier": F.lit(tier), "data_mode": F.lit("REAL")})
    return merge_market_daily(existing, aggregate_market_daily(normalize_prices(x, order, with_id=False)))


def import_generic(raw: DataFrame, existing: DataFrame | None, tier: str, source: str | None = None, order: list[str] | None = None) -> DataFrame:
    """User files may only claim the two lowest real tiers; checked before any job starts."""
    if tier not in GENERIC_IMPORT_TIERS:
        raise ValueError("generic imports may only be " + " or ".join(GENERIC_IMPORT_TIERS))
    if source is None and "source" in raw.columns:
        x = raw.withColumns({"source_tier": F.lit(tier), "data_mode": F.lit("REAL")})
        return merge_market_daily(existing, aggregate_market_daily(normalize_prices(x, order, with_id=False)))
    return import_panel(raw, existing, source or "USER_IMPORT", tier, order)


def import_export(raw: DataFrame, existing: DataFrame | None, route: str, order: list[str] | None = None, **identity) -> DataFrame:
    """Portal export through a dedicated route, with identity fields for filtered downloads."""
    source, tier = ROUTES[route]
    return import_panel(canonicalize_export(raw, **identity), existing, source, tier, order)
