"""Queries over rows and panels: normalisation, aggregation, coverage, quality, merge, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import coverage as cov, normalize as nrm, panel as pan
from ..session import shared_folder
from ..sources import readers, sinks, warehouse as wh
from ..spec import PANEL_KEY, ROW_KEY, SelectionPolicy
from . import oracle as o
from .queries import query

PANEL_COLS = ("date:d state:s district:s market:s market_id:s commodity:s data_mode:s modal_price:f min_price:f max_price:f "
              "varieties:i source:s source_tier:s arrivals:f arrival_unit:s")
SCOPE_POLICY = SelectionPolicy(target_count=3, min_states=5, min_markets=20, min_observations=50,
                               min_median_state_density=0.0, min_arrival_availability=0.0, min_span_days=300)

# ---------- text rows -> normalised rows ----------
TEXT = o.rows(typed=True) + f""", txt AS (SELECT
    CASE WHEN l_linenumber = 7 THEN NULL ELSE date END AS date,
    CASE district WHEN 'NATION_0' THEN 'Delhi' WHEN 'NATION_1' THEN 'Odisha' WHEN 'NATION_2' THEN 'Maharashtra'
      ELSE {o.TITLE} END AS state,
    district, market, commodity, variety, grade,
    CASE WHEN l_linenumber = 4 THEN modal_price * 2 ELSE min_price END AS min_price, max_price, modal_price,
    CASE WHEN l_linenumber IN (3, 5) THEN NULL ELSE CAST(CAST(arrivals AS BIGINT) AS DOUBLE) END AS arrivals,
    CASE WHEN l_linenumber = 6 THEN 'UNKNOWN' ELSE 'tonne' END AS arrival_unit, source,
    CASE WHEN l_linenumber = 2 THEN 'USER_SUPPLIED' ELSE source_tier END AS source_tier, data_mode, l_orderkey, l_linenumber
  FROM price_rows),
  ruled AS (SELECT * REPLACE (CASE WHEN bad THEN NULL ELSE min_price END AS min_price, CASE WHEN bad THEN NULL ELSE max_price END AS max_price)
    FROM (SELECT *, min_price > modal_price OR modal_price > max_price AS bad FROM txt
      WHERE date IS NOT NULL AND modal_price > 0 AND modal_price < 1000000)),
  norm AS (SELECT * EXCLUDE (bad), {o.MID} AS market_id
    FROM ruled QUALIFY row_number() OVER (PARTITION BY date, state, district, market, commodity, variety, grade
      ORDER BY l_orderkey DESC, l_linenumber DESC, min_price DESC NULLS LAST, max_price DESC NULLS LAST, modal_price DESC,
        arrivals DESC NULLS LAST, arrival_unit DESC) = 1)"""
NORM_COLS = ("date:d state:s district:s market:s commodity:s variety:s grade:s min_price:f max_price:f modal_price:f "
             "arrivals:f arrival_unit:s source:s source_tier:s data_mode:s market_id:s")


@query("nrm01_normalize_prices", o.select(TEXT, NORM_COLS, "norm"))
def _(spark, d):
    return nrm.normalize_prices(wh.text_rows(spark, d), wh.INGEST_ORDER)


@query("src01_panel_scan", o.select(TEXT + ", again AS (" + o.AGGREGATE.format(mid="market_id", src="norm") + ")", PANEL_COLS, "again"))
def _(spark, d):
    return pan.aggregate_market_daily(nrm.normalize_prices(wh.text_rows(spark, d), wh.INGEST_ORDER, with_id=False))


@query("src04_data_mode_probe", "WITH " + o.rows() + " SELECT CASE WHEN bool_and(upper(data_mode) = 'DEMO') THEN 'DEMO' ELSE 'REAL' END AS data_mode FROM price_rows")
def _(spark, d):
    return cov.data_mode(wh.price_rows(spark, d))


@query("nrm02_defaults_and_trim", "WITH " + o.rows(True) + """
SELECT trim(market) AS market, CASE WHEN l_linenumber = 6 THEN 'UNKNOWN' ELSE 'tonne' END AS arrival_unit,
  CAST(count(*) AS BIGINT) AS n FROM price_rows GROUP BY ALL""")
def _(spark, d):
    return nrm.rename_and_default(wh.text_rows(spark, d)).groupBy("market", "arrival_unit").agg(F.count(F.lit(1)).alias("n"))


@query("nrm03_parse_dates", "WITH " + o.rows(True) + """
SELECT strftime(CASE WHEN l_linenumber = 7 THEN NULL ELSE date END, '%Y-%m-%d') AS date, CAST(count(*) AS BIGINT) AS n FROM price_rows GROUP BY ALL""")
def _(spark, d):
    return wh.text_rows(spark, d).groupBy(nrm.parse_date(F.col("arrival_date")).alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("nrm04_coerce_numbers", "WITH " + o.rows(True) + """
SELECT CASE l_linenumber WHEN 3 THEN NULL WHEN 5 THEN -1.0 ELSE arrivals END AS arrivals, CAST(count(*) AS BIGINT) AS n
FROM price_rows GROUP BY ALL""")
def _(spark, d):
    return wh.text_rows(spark, d).groupBy(nrm.to_number(F.col("arrival_quantity")).alias("arrivals")).agg(F.count(F.lit(1)).alias("n"))


@query("nrm05_nrm07_row_rules", o.select(TEXT.rsplit(",\n  norm AS", 1)[0] + """, s AS (SELECT state, count(*) AS n, count(min_price) AS with_min,
  count(max_price) AS with_max, count(arrivals) AS with_q FROM ruled GROUP BY ALL)""", "state:s n:i with_min:i with_max:i with_q:i", "s"))
def _(spark, d):
    x = nrm.rename_and_default(wh.text_rows(spark, d))
    x = nrm.row_rules(nrm.coerce_types(x.withColumn("state", text.canonical_state(F.col("state")))))
    return x.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("min_price").alias("with_min"),
                                  F.count("max_price").alias("with_max"), F.count("arrivals").alias("with_q"))


# the untidy rows land as files of two headings, in other column orders, and are read back
LANDED = ["commodity", "state", "arrival_date", "market", "modal_price", "min_price",
          "max_price", "arrival_quantity", "arrival_unit", "district", "variety", "grade", "source", "source_tier", "data_mode"]


@query("src03_landed_chunks", o.select(TEXT.rsplit(",\n  norm AS", 1)[0] + """, s AS (SELECT state, commodity, count(*) AS n, count(min_price) AS with_min,
  count(max_price) AS with_max, count(arrivals) AS with_q, sum(modal_price) AS prices, min(date) AS first_date, max(date) AS last_date FROM ruled GROUP BY ALL)""",
  "state:s commodity:s n:i with_min:i with_max:i with_q:i prices:f first_date:d last_date:d", "s"))
def _(spark, d):
    x, folder = wh.text_rows(spark, d), shared_folder(spark, "chunks")
    for k, part in enumerate((x.where("l_linenumber % 3 = 0").select(*LANDED), x.where("l_linenumber % 3 <> 0").select(*reversed(LANDED)).withColumnsRenamed(nrm.RENAMES))):
        part.write.option("header", True).option("quoteAll", k == 0).csv(f"{folder}/{k}")
    rows = nrm.rename_and_default(readers.read_chunks(spark, folder))
    ruled = nrm.row_rules(nrm.coerce_types(rows.withColumn("state", text.canonical_state(F.col("state")))))
    return ruled.groupBy("state", "commodity").agg(
        F.count(F.lit(1)).alias("n"), F.count("min_price").alias("with_min"), F.count("max_price").alias("with_max"), F.count("arrivals").alias("with_q"),
        F.sum("modal_price").alias("prices"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("nrm08_keep_last", o.select(o.last_rows(True), "date:d state:s district:s market:s commodity:s variety:s grade:s modal_price:f arrivals:f l_orderkey:i l_linenumber:i", "last_rows"))
def _(spark, d):
    x = nrm.keep_last(wh.price_rows(spark, d, typed=True), ROW_KEY, wh.INGEST_ORDER)
    return x.select(*ROW_KEY, "modal_price", "arrivals", *wh.INGEST_ORDER)


@query("nrm09_canonical_state", "WITH " + o.rows(True) + f"""
SELECT CASE district WHEN 'NATION_0' THEN 'Delhi' WHEN 'NATION_1' THEN 'Odisha' WHEN 'NATION_2' THEN 'Maharashtra'
  ELSE {o.TITLE} END AS state,
  CAST(count(*) AS BIGINT) AS n FROM price_rows GROUP BY ALL""")
def _(spark, d):
    x = wh.text_rows(spark, d).groupBy(text.canonical_state(F.col("state")).alias("state"))
    return x.agg(F.count(F.lit(1)).alias("n"))


@query("nrm10_market_ids", "WITH " + o.rows(fine=True) + f"""
SELECT {o.MID} AS market_id, CAST(count(*) AS BIGINT) AS n FROM price_rows GROUP BY ALL""")
def _(spark, d):
    return nrm.ensure_market_id(wh.price_rows(spark, d, fine=True)).groupBy("market_id").agg(F.count(F.lit(1)).alias("n"))


@query("nrm11_market_metadata", "WITH " + o.rows(fine=True) + f"""
SELECT {o.MID} AS market_id, min(state) AS state, min(district) AS district, min(market) AS market FROM price_rows GROUP BY ALL""")
def _(spark, d):
    return nrm.market_metadata(wh.price_rows(spark, d, fine=True), ["date"])


@query("nrm12_source_tier", "WITH " + o.rows(True) + """
SELECT source, CASE WHEN source LIKE 'DEMO%' THEN 'DEMO' WHEN source LIKE '%DATA_GOV%' THEN 'PRIMARY_OFFICIAL'
  WHEN source LIKE '%CEDA%' THEN 'CURATED_OFFICIAL_DERIVED' WHEN source LIKE '%ARCHIVE%' THEN 'SECONDARY_MIRROR'
  ELSE 'USER_SUPPLIED' END AS source_tier, CAST(count(*) AS BIGINT) AS n FROM price_rows GROUP BY ALL""")
def _(spark, d):
    x = wh.text_rows(spark, d)
    return x.groupBy("source", text.infer_source_tier(F.col("source"), F.col("data_mode")).alias("source_tier")).agg(F.count(F.lit(1)).alias("n"))


@query("nrm13_tier_acceptability", "WITH " + o.panel(True) + """
SELECT source_tier, bool_and(source_tier <> '' AND NOT contains(source_tier, 'SECONDARY_MIRROR')) AS acceptable, CAST(count(*) AS BIGINT) AS n
FROM panel GROUP BY ALL""")
def _(spark, d):
    x = wh.panel(spark, d, typed=True)
    return x.groupBy("source_tier", text.tiers_acceptable(text.split_tiers(F.col("source_tier"))).alias("acceptable")).agg(F.count(F.lit(1)).alias("n"))


@query("nrm14_scope_filter", o.select(o.panel(True), "date:d market_id:s commodity:s modal_price:f",
       "panel WHERE commodity = 'ECONOMY' AND state = 'ASIA' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"))
def _(spark, d):
    x = nrm.scope_filter(wh.panel(spark, d, typed=True), "ECONOMY", "ASIA", "1996-01-01", "1999-12-31")
    return x.select("date", "market_id", "commodity", "modal_price")


@query("nrm14_national_frame", o.select(o.panel(True), "date:d state:s market_id:s modal_price:f",
       "panel WHERE commodity = 'ECONOMY' AND date >= DATE '1996-01-01'"))
def _(spark, d):
    return nrm.national_frame(wh.panel(spark, d, typed=True), "ECONOMY", "1996-01-01").select("date", "state", "market_id", "modal_price")


# ---------- aggregation and merge ----------
@query("agg01_market_day_dense", o.select(o.panel(), PANEL_COLS, "panel"))
def _(spark, d):
    return wh.panel(spark, d)


@query("agg01_market_day_typed", o.select(o.panel(True), PANEL_COLS, "panel"))
def _(spark, d):
    return wh.panel(spark, d, typed=True)


@query("agg01_market_day_unbounded", o.select(o.rows(True) + ", panel AS (" + o.AGGREGATE.format(mid=o.MID, src="price_rows") + ")", PANEL_COLS, "panel"))
def _(spark, d):
    return pan.aggregate_market_daily(wh.price_rows(spark, d, typed=True).drop(*wh.INGEST_ORDER), unbounded_groups=True)


MERGE = o.rows(True) + f""", a AS (SELECT * FROM price_rows QUALIFY row_number() OVER (PARTITION BY {o.KEYS} ORDER BY l_orderkey DESC, l_linenumber DESC,
    min_price DESC, max_price DESC, modal_price DESC, arrivals DESC, arrival_unit DESC) = 1),
  old_ AS ({o.AGGREGATE.format(mid=o.MID, src="(SELECT * FROM a WHERE grade <> 'N')")}),
  new_ AS ({o.AGGREGATE.format(mid=o.MID, src="(SELECT * FROM a WHERE grade <> 'R')")}),
  both_ AS (SELECT *, 0 AS inc FROM old_ UNION ALL SELECT *, 1 AS inc FROM new_),
  ranked AS (SELECT *, CASE WHEN contains(source_tier, 'PRIMARY_OFFICIAL') THEN 5 WHEN contains(source_tier, 'CURATED_OFFICIAL_DERIVED') THEN 4
    WHEN contains(source_tier, 'SECONDARY_MIRROR') THEN 3 WHEN contains(source_tier, 'USER_SUPPLIED') THEN 2
    WHEN source_tier = 'DEMO' THEN 0 ELSE 1 END AS authority FROM both_),
  merged AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY date, market_id, commodity ORDER BY authority DESC, inc DESC) = 1)"""


def _old_and_new(spark, d):
    x = nrm.keep_last(wh.price_rows(spark, d, typed=True), ROW_KEY, wh.INGEST_ORDER).drop(*wh.INGEST_ORDER)
    return (pan.aggregate_market_daily(x.where(F.col("grade") != "N")), pan.aggregate_market_daily(x.where(F.col("grade") != "R")))


@query("mrg01_authority_merge", o.select(MERGE, PANEL_COLS, "merged"))
def _(spark, d):
    return pan.merge_market_daily(*_old_and_new(spark, d), look=False).select(*[c.split(":")[0] for c in PANEL_COLS.split()])


@query("snk02_versioned_upsert", o.select(MERGE, PANEL_COLS, "merged"))
def _(spark, d):
    old, new = _old_and_new(spark, d)
    folder = shared_folder(spark, "panel")
    sinks.upsert_panel(spark, old, folder)
    return sinks.upsert_panel(spark, new, folder).select(*[c.split(":")[0] for c in PANEL_COLS.split()])


@query("set01_union_all", o.select(MERGE.rsplit(",\n  ranked", 1)[0], "date:d market_id:s commodity:s modal_price:f", "both_"))
def _(spark, d):
    a, b = _old_and_new(spark, d)
    return a.unionByName(b, allowMissingColumns=True).select("date", "market_id", "commodity", "modal_price")


# ---------- coverage and quality ----------
AUDIT = o.panel(True) + """, audit AS (SELECT state, commodity, count(*) AS observations, count(DISTINCT market_id) AS markets,
    count(DISTINCT date) AS active_days, min(date) AS first_date, max(date) AS last_date,
    least(1.0, count(*) / (greatest(max(date) - min(date) + 1, 1) * greatest(count(DISTINCT market_id), 1))) AS reporting_density,
    count(arrivals) / count(*) AS arrival_availability FROM panel GROUP BY ALL)"""


@query("agg02_coverage_audit", o.select(AUDIT, "state:s commodity:s observations:i markets:i active_days:i first_date:d last_date:d reporting_density:f arrival_availability:f", "audit"))
def _(spark, d):
    return cov.coverage_audit(wh.panel(spark, d, typed=True))


@query("agg03_commodity_score", o.select(AUDIT + """, c AS (SELECT commodity, count(DISTINCT state) AS states, sum(markets) AS markets,
    sum(observations) AS observations, avg(reporting_density) AS density, avg(arrival_availability) AS arrival_availability FROM audit GROUP BY ALL),
  s AS (SELECT *, 0.35 * states / max(states) OVER () + 0.20 * markets / max(markets) OVER () + 0.20 * observations / max(observations) OVER ()
    + 0.15 * density + 0.10 * arrival_availability AS coverage_score FROM c)""",
    "commodity:s states:i markets:i observations:i density:f arrival_availability:f coverage_score:f", "s"))
def _(spark, d):
    return cov.commodity_coverage_score(cov.coverage_audit(wh.stored_panel(spark, d, typed=True)))


@query("agg04_price_dispersion", o.select(o.panel(True, True) + """, g AS (SELECT date, commodity, count(*) AS markets, quantile_cont(modal_price, 0.5) AS med,
    quantile_cont(modal_price, 0.75) - quantile_cont(modal_price, 0.25) AS iqr_, stddev_samp(modal_price) / avg(modal_price) AS cv_,
    (quantile_cont(modal_price, 0.9) - quantile_cont(modal_price, 0.1)) / quantile_cont(modal_price, 0.5) AS gap_ FROM panel GROUP BY ALL),
  dv AS (SELECT p.date, p.commodity, quantile_cont(abs(modal_price - med), 0.5) AS mad_ FROM panel p JOIN g ON p.date = g.date AND p.commodity = g.commodity GROUP BY ALL),
  r AS (SELECT g.date, g.commodity, markets, med AS median_price, CASE WHEN markets >= 2 THEN iqr_ END AS iqr, CASE WHEN markets >= 2 THEN mad_ END AS mad,
    CASE WHEN markets >= 2 THEN cv_ END AS cv, CASE WHEN markets >= 2 THEN gap_ END AS relative_gap FROM g JOIN dv ON g.date = dv.date AND g.commodity = dv.commodity)""",
    "date:d commodity:s markets:i median_price:f iqr:f mad:f cv:f relative_gap:f", "r"))
def _(spark, d):
    days, names = wh.daily_prices(spark, d, typed=True, fine=True)
    found = cov.price_dispersion(days)
    return found.join(names, found["commodity"] == names["number"]).select(*[F.col("name").alias(c) if c == "commodity" else found[c] for c in found.columns])


QUALITY = """SELECT count(*) AS rows, count(DISTINCT state) AS states, count(DISTINCT market_id) AS markets, count(DISTINCT commodity) AS commodities,
    round((count(*) - count(arrivals)) * 100.0 / count(*), 2) AS missing_arrivals_pct,
    count(*) FILTER (min_price > modal_price OR modal_price > max_price) AS invalid_price_order_rows"""


@query("agg05_quality_summary", o.select(o.panel(True) + ", q AS (" + QUALITY + """,
    count(*) - count(DISTINCT (date, market, commodity)) AS duplicate_key_rows,
    (SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM (SELECT unnest(string_split(source_tier, ',')) AS t FROM panel)) AS source_tiers FROM panel)""",
    "rows:i states:i markets:i commodities:i missing_arrivals_pct:f invalid_price_order_rows:i duplicate_key_rows:i source_tiers:s", "q"))
def _(spark, d):
    return cov.quality_summary(wh.stored_panel(spark, d, typed=True))


@query("agg05_quality_of_raw_rows", o.select(o.rows(True) + ", m AS (SELECT *, " + o.MID + " AS market_id FROM price_rows), q AS (" + QUALITY + """,
    count(*) - count(DISTINCT (date, market, commodity, variety, grade)) AS duplicate_key_rows,
    (SELECT string_agg(DISTINCT source_tier, ',' ORDER BY source_tier) FROM m) AS source_tiers FROM m)""",
    "rows:i states:i markets:i commodities:i missing_arrivals_pct:f invalid_price_order_rows:i duplicate_key_rows:i source_tiers:s", "q"))
def _(spark, d):
    return cov.quality_summary(nrm.ensure_market_id(wh.price_rows(spark, d, typed=True)))


@query("agg06_state_coverage", o.select(o.panel(True, True) + """, r AS (SELECT state, commodity, count(*) AS observations, count(DISTINCT market_id) AS markets,
    count(DISTINCT district) AS districts, count(DISTINCT date) AS active_days, min(date) AS first_date, max(date) AS last_date,
    count(arrivals) / count(*) AS arrival_coverage, count(*) / ((max(date) - min(date) + 1) * count(DISTINCT market_id)) AS reporting_density FROM panel GROUP BY ALL)""",
    "state:s commodity:s observations:i markets:i districts:i active_days:i first_date:d last_date:d arrival_coverage:f reporting_density:f", "r"))
def _(spark, d):
    return cov.state_coverage_report(wh.panel(spark, d, typed=True, fine=True))


@query("agg07_market_coverage", o.select(o.panel(True, True) + """, r AS (SELECT state, district, market, market_id, count(*) AS observations,
    min(date) AS first_date, max(date) AS last_date, count(arrivals) / count(*) AS arrival_coverage FROM panel GROUP BY ALL)""",
    "state:s district:s market:s market_id:s observations:i first_date:d last_date:d arrival_coverage:f", "r"))
def _(spark, d):
    return cov.market_coverage_report(wh.panel(spark, d, typed=True, fine=True))


@query("agg08_fn08_monthly_activity", o.select(o.panel(True) + """, r AS (SELECT strftime(date, '%Y-%m') AS month, commodity, count(*) AS observations,
    count(DISTINCT market_id) AS markets FROM panel GROUP BY ALL)""", "month:s commodity:s observations:i markets:i", "r"))
def _(spark, d):
    return cov.monthly_activity(wh.panel(spark, d, typed=True))


@query("agg09_missingness", o.select(o.panel(True) + """, r AS (SELECT f AS field, count(*) FILTER (v) AS missing_rows, round(count(*) FILTER (v) * 100.0 / count(*), 4) AS missing_pct
  FROM (SELECT unnest(['min_price', 'modal_price', 'max_price', 'arrivals', 'arrival_unit']) AS f,
    unnest([min_price IS NULL, modal_price IS NULL, max_price IS NULL, arrivals IS NULL, arrival_unit IS NULL]) AS v FROM panel) GROUP BY f)""",
    "field:s missing_rows:i missing_pct:f", "r"))
def _(spark, d):
    return cov.missingness(wh.panel(spark, d, typed=True))


def _metric_rows(src, keys):
    return f"""SELECT unnest(['rows', 'missing_modal_price', 'missing_arrivals', 'invalid_price_order', 'duplicate_keys']) AS metric,
    unnest([count(*), count(*) - count(modal_price), count(*) - count(arrivals), count(*) FILTER (min_price > modal_price OR modal_price > max_price),
    count(*) - count(DISTINCT ({keys}))]) AS v FROM {src}"""


@query("agg10_quality_before_after", o.select(o.panel(True) + f""", a AS ({_metric_rows('price_rows', o.KEYS)}), b AS ({_metric_rows('panel', 'date, market_id, commodity')}),
  r AS (SELECT a.metric, a.v AS raw, b.v AS processed FROM a JOIN b ON a.metric = b.metric)""", "metric:s raw:i processed:i", "r"))
def _(spark, d):
    return cov.quality_before_after(wh.price_rows(spark, d, typed=True), wh.stored_panel(spark, d, typed=True), ROW_KEY, PANEL_KEY)


@query("agg11_dataset_statistics_whole", "WITH " + o.panel(True) + o.COORDS + """, a AS (SELECT count(*) AS n, count(DISTINCT state) AS st, count(DISTINCT district) AS di,
    count(DISTINCT market_id) AS mk, count(DISTINCT commodity) AS co, strftime(min(date), '%Y-%m-%d') AS d0, strftime(max(date), '%Y-%m-%d') AS d1,
    round(count(arrivals) / count(*), 6) AS ac FROM panel)
  SELECT unnest(['processed_market_day_rows', 'states', 'districts', 'markets', 'commodities', 'date_min', 'date_max', 'arrival_coverage', 'raw_rows', 'coordinate_coverage']) AS metric,
    unnest([CAST(n AS VARCHAR), CAST(st AS VARCHAR), CAST(di AS VARCHAR), CAST(mk AS VARCHAR), CAST(co AS VARCHAR), d0, d1, CAST(ac AS VARCHAR),
      (SELECT CAST(count(*) AS VARCHAR) FROM price_rows),
      (SELECT CAST(round(avg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS VARCHAR) FROM coords)]) AS value FROM a""")
def _(spark, d):
    return cov.dataset_statistics(wh.price_rows(spark, d, typed=True), wh.stored_panel(spark, d, typed=True), wh.coordinates(spark, d))


@query("agg13_price_trend", o.select(o.panel(True) + ", r AS (SELECT commodity, date, quantile_cont(modal_price, 0.5) AS modal_price FROM panel GROUP BY ALL)",
       "commodity:s date:d modal_price:f", "r"))
def _(spark, d):
    return cov.price_trend(wh.panel(spark, d, typed=True))


@query("agg14_state_map", o.select(o.panel(True) + o.COORDS + f""", t AS (SELECT {o.TITLE} AS st, * FROM panel),
  xy AS (SELECT {o.TITLE} AS st, avg(lat) AS lat, avg(lon) AS lon FROM coords GROUP BY ALL),
  r AS (SELECT commodity, t.st AS state, count(DISTINCT market_id) AS markets, count(*) AS observations, quantile_cont(modal_price, 0.5) AS modal_price,
    any_value(lat) AS lat, any_value(lon) AS lon FROM t JOIN xy ON t.st = xy.st GROUP BY ALL)""",
    "commodity:s state:s markets:i observations:i modal_price:f lat:f lon:f", "r"))
def _(spark, d):
    return cov.state_map_frame(wh.stored_panel(spark, d, typed=True), wh.coordinates(spark, d))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("agg15_density_pivot_whole", o.select(AUDIT + ", r AS (SELECT state, " + ", ".join(
    f"avg(reporting_density) FILTER (commodity = '{c}') AS {c}" for c in TYPES) + " FROM audit GROUP BY ALL)", "state:s " + " ".join(f"{c}:f" for c in TYPES), "r"))
def _(spark, d):
    return cov.density_pivot(cov.coverage_audit(wh.stored_panel(spark, d, typed=True)))


@query("agg16_kpis", o.select(o.panel(True) + """, r AS (SELECT count(*) AS observations, count(DISTINCT market_id) AS markets, min(date) AS date_min, max(date) AS date_max,
    quantile_cont(modal_price, 0.5) AS median_price FROM panel WHERE commodity = 'ECONOMY')""",
    "observations:i markets:i date_min:d date_max:d median_price:f", "r"))
def _(spark, d):
    return cov.kpis(nrm.scope_filter(wh.stored_panel(spark, d, typed=True), "ECONOMY"))


@query("agg18_panel_status", o.select(o.panel(True) + o.COORDS + "," + o.SIGNAL_BODY + """, r AS (SELECT count(*) AS observations, count(DISTINCT state) AS states,
    count(DISTINCT market_id) AS markets, count(DISTINCT commodity) AS commodities, min(date) AS date_min, max(date) AS date_max, 'REAL' AS data_mode,
    (SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM (SELECT unnest(string_split(source_tier, ',')) AS t FROM panel)) AS source_tiers,
    (SELECT avg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 1.0 ELSE 0 END) FROM coords) AS coordinate_coverage,
    (SELECT count(*) FROM signal) AS weather_rows, (SELECT count(DISTINCT market_id) FROM signal) AS weather_markets FROM panel)""",
    "observations:i states:i markets:i commodities:i date_min:d date_max:d data_mode:s source_tiers:s coordinate_coverage:f weather_rows:i weather_markets:i", "r"))
def _(spark, d):
    return cov.panel_status(wh.stored_panel(spark, d, typed=True), wh.coordinates(spark, d), wh.daily_signal(spark, d))


# ---------- selection, top-k, sets ----------
SCOPE = AUDIT + """, c AS (SELECT commodity, count(DISTINCT state) AS states, count(DISTINCT state) / (SELECT count(DISTINCT state) FROM panel) AS state_coverage_ratio,
    sum(markets) AS markets, sum(observations) AS observations, max(last_date) - min(first_date) + 1 AS span_days,
    quantile_cont(reporting_density, 0.5) AS median_state_density,
    (SELECT count(arrivals) / count(*) FROM panel p WHERE p.commodity = audit.commodity) AS arrival_availability FROM audit GROUP BY ALL),
  s AS (SELECT *, 0.30 * state_coverage_ratio + 0.18 * ln(1 + markets) / max(greatest(ln(1 + markets), 1)) OVER ()
    + 0.16 * ln(1 + observations) / max(greatest(ln(1 + observations), 1)) OVER () + 0.12 * least(1, span_days / 900.0)
    + 0.14 * median_state_density + 0.10 * arrival_availability AS coverage_score,
    states >= 5 AND markets >= 20 AND observations >= 50 AND span_days >= 300 AS eligible FROM c),
  t AS (SELECT *, eligible AND row_number() OVER (ORDER BY eligible DESC, coverage_score DESC, states DESC, observations DESC, commodity) <= 3 AS recommended FROM s)"""
SCOPE_COLS = ("commodity:s states:i state_coverage_ratio:f markets:i observations:i span_days:i median_state_density:f "
              "arrival_availability:f coverage_score:f eligible:b recommended:b")


@query("sel01_commodity_scope", o.select(SCOPE, SCOPE_COLS, "t"))
def _(spark, d):
    return cov.commodity_scope_table(wh.stored_panel(spark, d, typed=True), SCOPE_POLICY)


@query("sel02_recommended", o.select(SCOPE, "commodity:s coverage_score:f", "t WHERE recommended"))
def _(spark, d):
    return cov.recommended_commodities(cov.commodity_scope_table(wh.stored_panel(spark, d, typed=True), SCOPE_POLICY)).select("commodity", "coverage_score")


@query("pln08_jn14_scope_choice", "WITH " + o.panel(True) + """
SELECT c AS commodity, CASE WHEN c IN (SELECT commodity FROM panel) THEN 'found' ELSE 'missing' END AS status FROM (SELECT unnest(['ECONOMY', 'NOT_A_TYPE']) AS c)""")
def _(spark, d):
    return cov.scope_choice(wh.panel(spark, d, typed=True), ["ECONOMY", "NOT_A_TYPE"])


@query("top04_busiest_market", "WITH " + o.panel() + """
SELECT market_id, CAST(count(*) AS BIGINT) AS observations FROM panel GROUP BY ALL ORDER BY observations DESC, market_id LIMIT 1""")
def _(spark, d):
    return cov.busiest_market(wh.panel(spark, d))


@query("top05_market_options", "WITH " + o.panel(True, True) + " SELECT DISTINCT market_id, state, district, market FROM panel")
def _(spark, d):
    return cov.market_options(wh.panel(spark, d, typed=True, fine=True))


@query("smp01_seeded_sample")
def _(spark, d):
    x = wh.panel(spark, d, typed=True).where(F.col("arrivals").isNotNull())
    return cov.seeded_sample(x.select("date", "market_id", "commodity", "arrivals", "modal_price"), ["commodity", "market_id", "date"])


# ---------- coordinates ----------
UPSERT = o.FINE_COORDS + """, old_ AS (SELECT * REPLACE (CASE WHEN position % 4 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN position % 4 = 0 THEN NULL ELSE lon END AS lon,
    CASE WHEN position % 4 = 0 THEN NULL ELSE coordinate_quality END AS coordinate_quality) FROM coords),
  new_ AS (SELECT market_id, lat + 1 AS lat, lon + 1 AS lon, 'field' AS q, 'import' AS s FROM coords WHERE lat + 1 BETWEEN 6 AND 38 AND lon + 1 BETWEEN 67 AND 98 AND position % 3 = 0),
  up AS (SELECT o.market_id, o.state, coalesce(n.lat, o.lat) AS lat, coalesce(n.lon, o.lon) AS lon,
    coalesce(n.q, o.coordinate_quality) AS coordinate_quality, coalesce(n.s, o.coordinate_source) AS coordinate_source FROM old_ o LEFT JOIN new_ n ON o.market_id = n.market_id)"""


def _upserted(spark, d):
    m = wh.coordinates(spark, d, fine=True)
    gone = F.col("position") % 4 == 0
    old = m.withColumns({c: F.when(~gone, F.col(c)) for c in ("lat", "lon", "coordinate_quality")})
    new = m.where(F.col("position") % 3 == 0).select(
        "market_id", (F.col("lat") + 1).alias("lat"), (F.col("lon") + 1).alias("lon"), "position")
    return pan.import_coordinates(old.drop("position"), new, ["position"], "field", "import")


@query("jn05_fn07_coordinate_upsert", o.select(UPSERT, "market_id:s state:s lat:f lon:f coordinate_quality:s coordinate_source:s", "up"))
def _(spark, d):
    return _upserted(spark, d).select("market_id", "state", "lat", "lon", "coordinate_quality", "coordinate_source")


@query("agg17_coordinate_audit", "WITH " + UPSERT + """, a AS (SELECT count(*) AS n, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS k FROM up)
SELECT unnest(['markets_total', 'coordinates_resolved', 'coordinates_unresolved']) AS metric, CAST(unnest([n, k, n - k]) AS BIGINT) AS value FROM a""")
def _(spark, d):
    return pan.coordinate_audit(_upserted(spark, d))


@query("fix01_unresolved_markets", "WITH " + UPSERT + " SELECT market_id FROM up WHERE lat IS NULL OR lon IS NULL ORDER BY market_id LIMIT 20")
def _(spark, d):
    return pan.unresolved_markets(_upserted(spark, d), 20).select("market_id")
