"""Queries over landed payloads, planning tables and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as pl, readiness as rd
from ..sources import envelopes as en, imports as im, sinks, warehouse as wh
from . import oracle as o
from .queries import query

# ---------- JSON payloads made from the event table ----------
ROW = "id bigint, user bigint, k int"


def _body():
    return F.concat(F.lit('[{"id":'), F.col("event_id").cast("string"), F.lit(',"user":'), F.col("user_id").cast("string"), F.lit(',"k":'),
                    F.get_json_object("props", "$.k"), F.lit('},{"id":'), F.col("event_id").cast("string"), F.lit(',"user":0,"k":1}]'))


def _envelopes(spark, d):
    body = _body()
    text = (F.when(F.col("event_id") % 7 == 0, F.lit('{"output":{"type":"error","message":"quota"}}'))
            .when(F.col("event_id") % 7 == 1, F.concat(F.lit('{"data":'), body, F.lit("}"))).when(F.col("event_id") % 7 == 2, F.lit("[1]"))
            .otherwise(F.concat(F.lit('{"output":{"type":"success","data":'), body, F.lit("}}"))))
    return wh.table(spark, d, "events").select("event_id", text.alias("payload"))


EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query("src05_envelope_rows", o.select(EV + """, r AS (SELECT event_id, 0 AS position, event_id AS id, user_id AS \"user\", k FROM ev WHERE event_id % 7 NOT IN (0, 2)
    UNION ALL SELECT event_id, 1, event_id, 0, 1 FROM ev WHERE event_id % 7 NOT IN (0, 2))""", 'event_id:i position:i id:i "user":i k:i', "r"))
def _(spark, d):
    return en.unwrap(_envelopes(spark, d), "payload", ROW, ["event_id"])[0]


@query("src05_envelope_rejects", "WITH " + EV + """ SELECT CAST(event_id AS BIGINT) AS event_id,
  CASE event_id % 7 WHEN 0 THEN 'source error: quota' ELSE 'payload is not a JSON object' END AS reason FROM ev WHERE event_id % 7 IN (0, 2)""")
def _(spark, d):
    return en.unwrap(_envelopes(spark, d), "payload", ROW, ["event_id"])[1]


@query("src07_paged_records", "WITH " + EV + """ SELECT CAST(event_id AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS position, event_type AS state, CAST(k AS BIGINT) AS k
  FROM ev WHERE event_type = 'click' ORDER BY event_id LIMIT 500""")
def _(spark, d):
    text = F.concat(F.lit('{"records":[{"state":"'), F.col("event_type"), F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}]}"))
    pages = wh.table(spark, d, "events").select("event_id", text.alias("payload"))
    return en.records(pages, "payload", "state string, k int", ["event_id"], 500, {"state": "click"})


@query("src08_daily_weather", "WITH " + EV + """, r AS (SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS rainfall_mm,
    CAST(user_id AS DOUBLE) AS temperature_c FROM ev
  UNION ALL SELECT event_id, strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d'), NULL, 1.5 FROM ev)
  SELECT CAST(event_id AS BIGINT) AS event_id, date, rainfall_mm, temperature_c FROM r""")
def _(spark, d):
    day, nxt = F.date_format("ts", "yyyyMMdd"), F.date_format(F.date_add(F.to_date("ts"), 1), "yyyyMMdd")
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"properties":{"parameter":{"PRECTOTCORR":{"'), day, F.lit('":'), F.when(k.cast("int") % 5 == 0, "-999").otherwise(k),
                    F.lit('},"T2M":{"'), day, F.lit('":'), F.col("user_id").cast("string"), F.lit(',"'), nxt, F.lit('":1.5}}}}'))
    x = wh.table(spark, d, "events").select("event_id", text.alias("payload"))
    return en.daily_weather(x, "payload", ["event_id"]).select("event_id", "date", "rainfall_mm", "temperature_c")


@query("src09_rainfall_envelopes", "WITH " + EV + " SELECT CAST(event_id AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS position, event_type AS state, CAST(k AS BIGINT) AS rain FROM ev")
def _(spark, d):
    body = F.concat(F.lit('[{"state":"'), F.col("event_type"), F.lit('","rain":'), F.get_json_object("props", "$.k"), F.lit("}]"))
    text = body
    for i, key in enumerate(("data", "records", "result")):
        text = F.when(F.col("event_id") % 4 == i, F.concat(F.lit(f'{{"{key}":'), body, F.lit("}"))).otherwise(text)
    x = wh.table(spark, d, "events").select("event_id", text.alias("payload"))
    return en.rainfall_rows(x, "payload", "state string, rain int", ["event_id"])


@query("src06_jn02_canonical_chunk", o.select("""li AS (SELECT CAST(l_shipdate AS DATE) AS date, min(p_partkey) OVER (PARTITION BY p_type) AS cid, p_type, r_regionkey, r_name, n_nationkey, n_name,
      s_suppkey, s_name, l_extendedprice / l_quantity AS modal, l_quantity, l_returnflag
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  ids AS (SELECT p_type, min(p_partkey) AS cid FROM part GROUP BY ALL),
  p AS (SELECT date, ids.cid, li.p_type, r_name, n_name, s_suppkey, s_name, max(modal) AS modal_price FROM li JOIN ids ON li.p_type = ids.p_type GROUP BY ALL),
  q AS (SELECT date, ids.cid, s_suppkey, sum(l_quantity) AS qty FROM li JOIN ids ON li.p_type = ids.p_type WHERE l_returnflag <> 'N' GROUP BY ALL),
  r AS (SELECT p.date, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS state, n_name AS district,
      CASE WHEN p.s_suppkey % 3 = 0 THEN 'Market #' || p.s_suppkey ELSE s_name END AS market, p_type AS commodity, modal_price, qty AS arrivals, p.s_suppkey AS source_market_id
    FROM p LEFT JOIN q ON p.date = q.date AND p.cid = q.cid AND p.s_suppkey = q.s_suppkey)""",
    "date:d state:s district:s market:s commodity:s modal_price:f arrivals:f source_market_id:i", "r"))
def _(spark, d):
    part, sup = wh.table(spark, d, "part"), wh.table(spark, d, "supplier")
    geo = wh.table(spark, d, "nation").join(wh.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_regionkey").alias("census_state_id"), F.col("r_name").alias("census_state_name"),
        F.col("n_nationkey").alias("census_district_id"), F.col("n_name").alias("census_district_name"))
    com = part.groupBy(F.col("p_type").alias("commodity_name")).agg(F.min("p_partkey").alias("commodity_id"))
    li = (wh.table(spark, d, "lineitem").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
          .join(com, F.col("p_type") == F.col("commodity_name")).join(sup.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
          .join(geo, F.col("s_nationkey") == F.col("census_district_id")))
    li = li.select(F.to_date("l_shipdate").alias("date"), "commodity_id", "census_state_id", "census_district_id",
                   F.col("s_suppkey").cast("string").alias("market_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("modal"), "l_quantity", "l_returnflag")
    none = F.lit(None).cast("double")
    prices = li.groupBy(*en.JOIN_KEY).agg(F.max("modal").alias("modal_price")).withColumns({"min_price": none, "max_price": none})
    qty = li.where(F.col("l_returnflag") != "N").groupBy(*en.JOIN_KEY).agg(F.sum("l_quantity").alias("quantity"))
    names = sup.where(F.col("s_suppkey") % 3 != 0).select(F.col("s_suppkey").alias("market_id"), F.col("s_name").alias("market_name"))
    out = en.canonical_rows(prices, qty, names, com, geo)
    return out.select("date", "state", "district", "market", "commodity", "modal_price", "arrivals", "source_market_id")


@query("src11_export_headings", o.select(o.rows(True) + """, r AS (SELECT date, 'Punjab' AS state, district, market, commodity, modal_price, min_price, arrivals, '' AS variety, 'UNKNOWN' AS arrival_unit FROM price_rows)""",
    "date:d state:s district:s market:s commodity:s modal_price:f min_price:f arrivals:f variety:s arrival_unit:s", "r"))
def _(spark, d):
    x = wh.price_rows(spark, d, typed=True)
    raw = x.select(F.col("date").alias("Reported Date"), F.col("district").alias("District Name"), F.col("market").alias("Mandi"),
                   F.col("commodity").alias("Crop Name"), F.col("modal_price").alias("Modal Price (Rs/q)"), F.col("min_price").alias("Minimum Price"),
                   F.col("arrivals").alias("Arrival Qty"))
    out = im.canonicalize_export(raw, state="Punjab")
    return out.select("date", "state", "district", "market", "commodity", "modal_price", "min_price", "arrivals", "variety", "arrival_unit")


# ---------- planning ----------
CAT = """cat AS (SELECT min(p_partkey) AS commodity_id, p_type AS commodity_name FROM part GROUP BY p_type),
  dis AS (SELECT r_regionkey AS state_id, r_name AS state_name, n_nationkey AS district_id, n_name AS district_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
JOBS = CAT + """, lim AS (SELECT * FROM dis QUALIFY row_number() OVER (PARTITION BY state_id ORDER BY district_name, district_id) <= 2),
  yr AS (SELECT unnest(range(1995, 1999)) AS y), win AS (SELECT greatest(DATE '1995-03-05', make_date(y, 1, 1)) AS start_date, least(DATE '1998-02-10', make_date(y, 12, 31)) AS end_date FROM yr),
  jobs AS (SELECT * FROM cat, lim, win),
  keyed AS (SELECT *, regexp_replace(lower(commodity_name), '[^a-z0-9]+', '_', 'g') || '/' || regexp_replace(lower(state_name), '[^a-z0-9]+', '_', 'g') || '/' || district_id || '_' ||
    regexp_replace(lower(district_name), '[^a-z0-9]+', '_', 'g') || '_' || strftime(start_date, '%Y-%m-%d') || '_' || strftime(end_date, '%Y-%m-%d') AS job_key FROM jobs)"""


def _catalog(spark, d):
    com = wh.table(spark, d, "part").groupBy(F.col("p_type").alias("commodity_name")).agg(F.min("p_partkey").alias("commodity_id"))
    dis = wh.table(spark, d, "nation").join(wh.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_regionkey").alias("state_id"), F.col("r_name").alias("state_name"), F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("district_name"))
    return com, dis


def _jobs(spark, d):
    com, dis = _catalog(spark, d)
    return pl.job_plan(com, dis, "1995-03-05", "1998-02-10", district_limit=2).withColumn("job_key", pl.job_key())


def _ledger(spark, d):
    status = F.when(F.col("district_id") % 5 == 0, "failed").when(F.col("district_id") % 5 == 1, "empty").otherwise("fetched")
    return _jobs(spark, d).where(F.year("start_date") < 1997).select("job_key", status.alias("status"))


LEDGER = """, led AS (SELECT job_key, CASE district_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'fetched' END AS status, district_id FROM keyed WHERE year(start_date) < 1997),
  pend AS (SELECT * FROM keyed WHERE job_key NOT IN (SELECT job_key FROM led WHERE status IN ('fetched', 'empty')))"""


@query("pln01_year_windows", """WITH s AS (SELECT l_suppkey AS suppkey, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY ALL),
  w AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS y FROM s)
SELECT CAST(suppkey AS BIGINT) AS suppkey, strftime(greatest(a, make_date(y, 1, 1)), '%Y-%m-%d') AS start_date, strftime(least(b, make_date(y, 12, 31)), '%Y-%m-%d') AS end_date FROM w""")
def _(spark, d):
    x = wh.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    return pl.year_windows(x, "a", "b")


@query("pln02_pln04_job_plan", o.select(JOBS, "commodity_id:i commodity_name:s state_id:i state_name:s district_id:i district_name:s start_date:d end_date:d job_key:s", "keyed"))
def _(spark, d):
    return _jobs(spark, d)


@query("pln03_pending_jobs", o.select(JOBS + LEDGER, "job_key:s", "pend"))
def _(spark, d):
    return pl.pending_jobs(_jobs(spark, d), _ledger(spark, d)).select("job_key")


@query("snk09_run_counters", "WITH " + JOBS + LEDGER + """ SELECT CAST((SELECT count(*) FROM keyed) AS BIGINT) AS planned, CAST(count(*) FILTER (district_id % 5 <> 0) AS BIGINT) AS fetched,
  CAST((SELECT count(*) FROM led WHERE status <> 'failed') AS BIGINT) AS cached, CAST(count(*) FILTER (district_id % 5 = 1) AS BIGINT) AS empty,
  CAST(count(*) FILTER (district_id % 5 = 0) AS BIGINT) AS failed, CAST(coalesce(sum(CASE WHEN district_id % 5 > 1 THEN district_id * 10 ELSE 0 END), 0) AS BIGINT) AS rows FROM pend""")
def _(spark, d):
    jobs, ledger = _jobs(spark, d), _ledger(spark, d)
    m = F.col("district_id") % 5
    out = pl.pending_jobs(jobs, ledger).select(F.when(m == 0, "failed").when(m == 1, "empty").otherwise("fetched").alias("status"),
                                               F.when(m > 1, F.col("district_id") * 10).otherwise(0).alias("row_count"))
    return pl.run_counters(jobs, ledger, out)


@query("pln05_weather_plan", "WITH " + o.FINE_COORDS + """, c AS (SELECT DISTINCT round_even(lat / 0.5, 0) * 0.5 AS cell_lat, round(round_even(lon / 0.625, 0) * 0.625, 4) AS cell_lon FROM coords),
  w AS (SELECT *, unnest([2020, 2021, 2022]) AS y FROM c)
SELECT cell_lat, cell_lon, strftime(greatest(DATE '2020-06-01', make_date(y, 1, 1)), '%Y-%m-%d') AS start_date, strftime(least(DATE '2022-02-03', make_date(y, 12, 31)), '%Y-%m-%d') AS end_date,
  printf('%+07.3f', cell_lat) || '_' || printf('%+08.3f', cell_lon) || '_' || strftime(greatest(DATE '2020-06-01', make_date(y, 1, 1)), '%Y-%m-%d') || '_' ||
  strftime(least(DATE '2022-02-03', make_date(y, 12, 31)), '%Y-%m-%d') AS job_key FROM w""")
def _(spark, d):
    return pl.weather_plan(wh.coordinates(spark, d, fine=True), "2020-06-01", "2022-02-03").withColumn("job_key", pl.weather_job_key())


@query("pln06_resolve_names", "WITH " + CAT + """, req AS (SELECT DISTINCT name FROM (SELECT lower(p_type) AS name FROM part UNION ALL SELECT left(p_type, 3) FROM part UNION ALL SELECT 'N' FROM part UNION ALL SELECT p_type || '?' FROM part)),
  m AS (SELECT name, count(c.commodity_id) FILTER (lower(c.commodity_name) = lower(name)) AS e, count(c.commodity_id) FILTER (contains(lower(c.commodity_name), lower(name))) AS k,
    min(c.commodity_id) FILTER (lower(c.commodity_name) = lower(name)) AS ei, min(c.commodity_id) FILTER (contains(lower(c.commodity_name), lower(name))) AS ki FROM req, cat c GROUP BY ALL)
SELECT name, CAST(CASE WHEN e > 0 THEN ei WHEN k = 1 THEN ki END AS BIGINT) AS commodity_id, (SELECT commodity_name FROM cat WHERE commodity_id = CASE WHEN e > 0 THEN ei WHEN k = 1 THEN ki END) AS commodity_name,
  CASE WHEN e > 0 OR k = 1 THEN 'matched' WHEN k > 1 THEN 'ambiguous' ELSE 'unknown' END AS status FROM m""")
def _(spark, d):
    part = wh.table(spark, d, "part")
    t = F.col("p_type")
    req = part.select(F.explode(F.array(F.lower(t), F.substring(t, 1, 3), F.lit("N"), F.concat(t, F.lit("?")))).alias("name"))
    return pl.resolve_names(req, _catalog(spark, d)[0], "commodity_name", "commodity_id")


# ---------- readiness ----------
READY = o.panel(True) + o.COORDS + "," + o.SIGNAL_BODY + """, x AS (SELECT * FROM panel WHERE commodity IN ('ECONOMY', 'STANDARD') AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
  ids AS (SELECT DISTINCT market_id FROM x), s AS (SELECT count(*) AS observations, count(DISTINCT state) AS states, count(DISTINCT market_id) AS markets, max(date) - min(date) + 1 AS span_days,
    count(arrivals) / count(*) AS arrival_availability, (SELECT avg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM coords SEMI JOIN ids USING (market_id)) AS coordinate_coverage,
    (SELECT count(DISTINCT market_id) FROM signal SEMI JOIN ids USING (market_id) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') / count(DISTINCT market_id) AS weather_market_coverage FROM x)"""


def _summary(spark, d):
    return rd.readiness_summary(wh.stored_panel(spark, d, typed=True), wh.coordinates(spark, d), wh.daily_signal(spark, d), ["ECONOMY", "STANDARD"], "1996-01-01", "1999-12-31")


@query("rdy01_readiness_summary", o.select(READY + """, r AS (SELECT *, (SELECT string_agg(q || '=' || n, ',' ORDER BY q) FROM (SELECT coalesce(coordinate_quality, 'unknown') AS q, count(*) AS n
    FROM coords SEMI JOIN ids USING (market_id) GROUP BY ALL)) AS quality, 'REAL' AS modes, (SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM (SELECT unnest(string_split(source_tier, ',')) AS t FROM x)) AS tiers FROM s)""",
    "observations:i states:i markets:i span_days:i arrival_availability:f coordinate_coverage:f weather_market_coverage:f quality:s modes:s tiers:s", "r"))
def _(spark, d):
    s = _summary(spark, d)
    quality = F.array_join(F.transform(F.map_entries("coordinate_quality_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("observations", "states", "markets", "span_days", "arrival_availability", "coordinate_coverage", "weather_market_coverage",
                    quality.alias("quality"), F.array_join("data_modes", ",").alias("modes"), F.array_join("source_tiers", ",").alias("tiers"))


@query("rdy02_readiness_gates", "WITH " + READY + """ SELECT unnest(['real_data_only', 'nonempty_selected_scope', 'source_provenance_present', 'paper_acceptable_source_tier', 'temporal_span', 'state_breadth', 'market_breadth',
    'observation_volume', 'arrival_availability', 'coordinate_coverage', 'weather_market_coverage']) AS gate,
  unnest(['PASS', 'PASS', 'PASS', 'FAIL', CASE WHEN span_days >= 365 THEN 'PASS' ELSE 'WARN' END, CASE WHEN states >= 3 THEN 'PASS' ELSE 'WARN' END, CASE WHEN markets >= 8 THEN 'PASS' ELSE 'WARN' END,
    CASE WHEN observations >= 500 THEN 'PASS' ELSE 'WARN' END, CASE WHEN arrival_availability >= 0.2 THEN 'PASS' ELSE 'WARN' END, CASE WHEN coordinate_coverage >= 0.7 THEN 'PASS' ELSE 'WARN' END,
    CASE WHEN weather_market_coverage >= 0.6 THEN 'PASS' ELSE 'WARN' END]) AS status FROM s""")
def _(spark, d):
    return rd.readiness_gates(_summary(spark, d)).select("gate", "status")


@query("snk06_file_hashes")
def _(spark, d):
    return sinks.file_hashes(spark, d, "*.parquet")
