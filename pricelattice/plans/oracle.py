"""Building blocks of the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

GEO = "geo AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def slug(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g')"


MID = f"{slug('state')} || '__' || {slug('district')} || '__' || {slug('market')}"
NATION_ID = f"{slug('r_name')} || '__' || {slug('n_name')} || '__' || {slug('n_name')}"
TITLE = "array_to_string(list_transform(string_split(lower(state), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
KEYS = "date, state, district, market, commodity, variety, grade"


def rows(typed: bool = False, fine: bool = False) -> str:
    modal = "(l_extendedprice / l_quantity)"
    return f"""{GEO}, price_rows AS (
  SELECT CAST(l_shipdate AS DATE) AS date, r_name AS state, n_name AS district, {'s_name' if fine else 'n_name'} AS market,
    {"p_type" if typed else "'ALL'"} AS commodity, p_brand AS variety, l_returnflag AS grade,
    {modal} * (1 - l_discount) AS min_price, {modal} * (1 + l_tax) AS max_price, {modal} AS modal_price,
    l_quantity AS arrivals, {"l_linestatus" if typed else "'unit'"} AS arrival_unit,
    CASE l_returnflag WHEN 'A' THEN 'CEDA_AGMARKNET' WHEN 'N' THEN 'DATA_GOV_FEED' ELSE 'STATE_ARCHIVE' END AS source,
    CASE l_returnflag WHEN 'A' THEN 'CURATED_OFFICIAL_DERIVED' WHEN 'N' THEN 'PRIMARY_OFFICIAL' ELSE 'SECONDARY_MIRROR' END AS source_tier,
    'REAL' AS data_mode, l_orderkey, l_linenumber
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN geo ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def last_rows(typed: bool = False, fine: bool = False) -> str:
    return rows(typed, fine) + f""", last_rows AS (
  SELECT * FROM price_rows QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY l_orderkey DESC, l_linenumber DESC,
    min_price DESC, max_price DESC, modal_price DESC, arrivals DESC, arrival_unit DESC) = 1)"""


AGGREGATE = """SELECT date, state, district, market, {mid} AS market_id, commodity, data_mode,
    quantile_cont(modal_price, 0.5) AS modal_price, quantile_cont(min_price, 0.5) AS min_price,
    quantile_cont(max_price, 0.5) AS max_price, count(DISTINCT variety) AS varieties,
    coalesce(string_agg(DISTINCT nullif(source, ''), ',' ORDER BY nullif(source, '')), '') AS source,
    coalesce(string_agg(DISTINCT nullif(source_tier, ''), ',' ORDER BY nullif(source_tier, '')), '') AS source_tier,
    CASE WHEN count(DISTINCT arrival_unit) > 1 THEN NULL WHEN min(arrivals) = max(arrivals) THEN min(arrivals)
      ELSE sum(arrivals) END AS arrivals,
    CASE WHEN count(DISTINCT arrival_unit) > 1 THEN 'MIXED:' || string_agg(DISTINCT arrival_unit, '|' ORDER BY arrival_unit)
      ELSE min(arrival_unit) END AS arrival_unit
  FROM {src} GROUP BY ALL"""


def panel(typed: bool = False, fine: bool = False) -> str:
    return last_rows(typed, fine) + ", panel AS (" + AGGREGATE.format(mid=MID, src="last_rows") + ")"


RETURNS = """, ret AS (SELECT * FROM (
  SELECT *, CASE WHEN date - lag(date) OVER w = 1 THEN ln(modal_price) - lag(ln(modal_price)) OVER w END AS ret
  FROM panel WINDOW w AS (PARTITION BY commodity, market_id ORDER BY date)) WHERE ret IS NOT NULL)"""

COORDS = f""", coords AS (SELECT {NATION_ID} AS market_id, r_name AS state,
    n_name AS district, n_name AS market, CAST(6 + (n_nationkey * 7) % 32 AS DOUBLE) AS lat,
    CAST(67 + (n_nationkey * 11) % 31 AS DOUBLE) AS lon,
    CASE n_nationkey % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'geocoded' END AS coordinate_quality,
    'survey' AS coordinate_source, n_nationkey AS position FROM geo)"""

FINE_COORDS = GEO + f""", coords AS (SELECT {slug('r_name')} || '__' || {slug('n_name')} || '__' || {slug('s_name')} AS market_id,
    r_name AS state, n_name AS district, s_name AS market,
    CAST(6 + (s_suppkey * 7) % 32 + (s_suppkey % 10) / 20.0 AS DOUBLE) AS lat,
    CAST(67 + (s_suppkey * 11) % 31 + (s_suppkey % 7) / 10.0 AS DOUBLE) AS lon,
    CASE s_suppkey % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'geocoded' END AS coordinate_quality,
    'survey' AS coordinate_source, s_suppkey AS position FROM supplier JOIN geo ON s_nationkey = n_nationkey)"""

SIGNAL_BODY = f""" signal AS (SELECT CAST(o_orderdate AS DATE) AS date, {NATION_ID} AS market_id, r_name AS state, n_name AS district, n_name AS market,
    avg(o_totalprice) / 1000 AS rainfall_mm, CAST(count(*) AS DOUBLE) AS temperature_c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey GROUP BY ALL)"""

_WRAP = {
    "s": "{c}", "b": "{c}", "i": "CAST({c} AS BIGINT)", "d": "strftime({c}, '%Y-%m-%d')",
    "f": "floor(CAST({c} AS DOUBLE) * 1000000.0 + 0.501) / 1000000.0",
}


def select(ctes: str, columns: str, source: str) -> str:
    """``columns`` lists name:type with s text, b boolean, i integer, f six-decimal number, d ISO date."""
    items = []
    for item in columns.split():
        name, kind = item.split(":")
        items.append(f"{_WRAP[kind].format(c=name)} AS {name}")
    return f"WITH {ctes}\nSELECT {', '.join(items)} FROM {source}"


def z_score(x: str, part: str, out: str, source: str, name: str) -> str:
    """CTEs adding the robust z of x within part to source; ends in a relation called ``name``."""
    return f""", {name}_m AS (SELECT *, quantile_cont({x}, 0.5) OVER (PARTITION BY {part}) AS med_,
    stddev_pop({x}) OVER (PARTITION BY {part}) AS sd_ FROM {source}),
  {name}_d AS (SELECT *, quantile_cont(abs({x} - med_), 0.5) OVER (PARTITION BY {part}) AS mad_ FROM {name}_m),
  {name} AS (SELECT * EXCLUDE (med_, sd_, mad_), CASE WHEN med_ IS NULL THEN NULL
    WHEN coalesce(mad_, 0) = 0 THEN CASE WHEN coalesce(sd_, 0) = 0 THEN 0.0 ELSE ({x} - med_) / sd_ END
    ELSE 0.67448975 * ({x} - med_) / mad_ END AS {out} FROM {name}_d)"""


def t_tail(t: str, nu: str) -> str:
    """Two-sided Student-t tail for integer degrees of freedom as its finite trigonometric series."""
    c = f"ln(1.0 / sqrt(1.0 + ({t}) * ({t}) / ({nu})))"
    theta = f"atan(abs({t}) / sqrt({nu}))"
    even = (f"sin({theta}) * list_sum(list_transform(range(0, CAST(({nu}) / 2 AS BIGINT)), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(k + 1.0) + 2 * k * {c}) / sqrt(pi())))")
    odd = (f"(2 / pi()) * ({theta} + sin({theta}) * coalesce(list_sum(list_transform(range(0, CAST((({nu}) - 1) / 2 AS BIGINT)), lambda k: "
           f"exp(lgamma(k + 1.0) - lgamma(k + 1.5) + (2 * k + 1) * {c}) * sqrt(pi()) / 2)), 0))")
    return f"(CASE WHEN ({nu}) % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END)"
