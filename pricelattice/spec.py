"""Column roles, table schemas, default thresholds and policies."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: column order, tier vocabulary and ranks ----
PRICE_COLUMNS = [
    "date", "state", "district", "market", "commodity", "variety", "grade",
    "min_price", "max_price", "modal_price", "arrivals", "arrival_unit",
    "source", "source_tier", "data_mode",
]
ROW_KEY = ["date", "state", "district", "market", "commodity", "variety", "grade"]
MARKET_DAY_KEY = ["date", "state", "district", "market", "market_id", "commodity", "data_mode"]
PANEL_KEY = ["date", "market_id", "commodity"]

TIER_RANK = {
    "DEMO": 0,
    "UNKNOWN": 1,
    "USER_SUPPLIED": 2,
    "SECONDARY_MIRROR": 3,
    "CURATED_OFFICIAL_DERIVED": 4,
    "PRIMARY_OFFICIAL": 5,
}
ACCEPTABLE_TIERS = ["PRIMARY_OFFICIAL", "CURATED_OFFICIAL_DERIVED"]
GENERIC_IMPORT_TIERS = ["USER_SUPPLIED", "SECONDARY_MIRROR"]

# alias -> canonical state name, keys already lower-cased with single spaces
STATE_ALIASES = {
    "nct of delhi": "Delhi",
    "delhi (nct)": "Delhi",
    "orissa": "Odisha",
    "odisha": "Odisha",
    "andaman & nicobar island": "Andaman and Nicobar Islands",
    "andaman & nicobar islands": "Andaman and Nicobar Islands",
    "andaman and nicobar island": "Andaman and Nicobar Islands",
    "andaman and nicobar islands": "Andaman and Nicobar Islands",
    "dadra & nagar haveli": "Dadra and Nagar Haveli and Daman and Diu",
    "dadra and nagar haveli": "Dadra and Nagar Haveli and Daman and Diu",
    "daman & diu": "Dadra and Nagar Haveli and Daman and Diu",
    "daman and diu": "Dadra and Nagar Haveli and Daman and Diu",
    "pondicherry": "Puducherry",
    "jammu & kashmir": "Jammu and Kashmir",
    "jammu and kashmir": "Jammu and Kashmir",
    "uttaranchal": "Uttarakhand",
}
# ---- end of fixed values ----

RAW_SCHEMA = ", ".join(f"{c} STRING" for c in PRICE_COLUMNS)
PANEL_SCHEMA = (
    "date DATE, state STRING, district STRING, market STRING, market_id STRING, commodity STRING, "
    "data_mode STRING, modal_price DOUBLE, min_price DOUBLE, max_price DOUBLE, varieties BIGINT, "
    "source STRING, source_tier STRING, arrivals DOUBLE, arrival_unit STRING"
)
MARKETS_SCHEMA = (
    "market_id STRING, state STRING, district STRING, market STRING, lat DOUBLE, lon DOUBLE, "
    "coordinate_quality STRING, coordinate_source STRING"
)
WEATHER_SCHEMA = (
    "date DATE, market_id STRING, state STRING, district STRING, market STRING, lat DOUBLE, lon DOUBLE, "
    "power_cell_lat DOUBLE, power_cell_lon DOUBLE, rainfall_mm DOUBLE, temperature_c DOUBLE, "
    "temperature_max_c DOUBLE, temperature_min_c DOUBLE, source STRING, data_mode STRING"
)


@dataclass(frozen=True)
class LeadLagPolicy:
    max_lag: int = 7
    min_overlap: int = 35
    min_abs_corr: float = 0.30
    fdr_alpha: float = 0.05
    max_markets: int | None = None  # a number keeps only that many markets of each group, those with most returns
    lag_mode: str = "report"  # 'report' = row offset over reporting dates, 'calendar' = true days


@dataclass(frozen=True)
class SelectionPolicy:
    target_count: int = 10
    min_states: int = 8
    min_markets: int = 40
    min_observations: int = 2000
    min_median_state_density: float = 0.08
    min_arrival_availability: float = 0.20
    min_span_days: int = 365


@dataclass(frozen=True)
class ReadinessPolicy:
    min_span_days: int = 365
    min_states: int = 3
    min_markets: int = 8
    min_observations: int = 500
    min_arrival_availability: float = 0.20
    min_coordinate_coverage: float = 0.70
    min_weather_market_coverage: float = 0.60


@dataclass(frozen=True)
class EventPolicy:
    threshold: float = 2.0
    horizons: tuple[int, ...] = (1, 3, 7, 14)
    separation_days: int = 2
    tolerance_days: int = 2
