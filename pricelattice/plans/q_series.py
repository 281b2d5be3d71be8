"""Queries over return series, networks, pairs, weather and events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import numeric as num, ranks
from ..operators import events as ev, graph as gr, leadlag as ll, normalize as nrm, pairs as pr, returns as ret, weather as we
from ..session import cut_lineage
from ..sources import warehouse as wh
from ..spec import EventPolicy, LeadLagPolicy
from . import oracle as o
from .queries import query

ALL_PAIRS = LeadLagPolicy(min_abs_corr=0.0, fdr_alpha=1.0)
TYPED_PAIRS = LeadLagPolicy(min_abs_corr=0.0, fdr_alpha=1.0, min_overlap=10, max_markets=25)
YEARLY = LeadLagPolicy(min_abs_corr=0.0, fdr_alpha=1.0, min_overlap=20)
GATED = LeadLagPolicy(min_abs_corr=0.15, fdr_alpha=0.5)
DENSE_RET = o.panel() + o.RETURNS
TYPED_RET = o.panel(True) + o.RETURNS


def lead_lag_sql(by: str, min_overlap: int, k: int, calendar: bool = False, max_lag: int = 7) -> str:
    """CTEs from ``ret`` to ``edges_all`` (every candidate with p and q); ``by`` is a comma list."""
    cols = [c.strip() for c in by.split(",")]
    on = " AND ".join(f"l.{c} = f.{c}" for c in cols)
    lb = ", ".join(f"l.{c}" for c in cols)
    pos = "date - DATE '1970-01-01'" if calendar else f"dense_rank() OVER (PARTITION BY {by} ORDER BY date)"
    tail = o.t_tail("corr * sqrt((overlap - 2) / (1 - corr * corr))", "(overlap - 2)")
    return f""", cnt AS (SELECT {by}, market_id, count(*) AS n FROM ret GROUP BY ALL),
  kept AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, market_id) AS rk FROM cnt QUALIFY rk <= {k}),
  r2 AS (SELECT {", ".join("ret." + c for c in cols)}, ret.market_id, market, rk, date, ret FROM ret JOIN kept ON ret.market_id = kept.market_id
    AND {" AND ".join(f"ret.{c} = kept.{c}" for c in cols)}),
  ps AS (SELECT *, {pos} AS pos FROM r2),
  ld AS (SELECT *, pos + lag AS target FROM (SELECT *, unnest(range(1, {max_lag + 1})) AS lag FROM ps)),
  cd AS (SELECT {lb}, l.market_id AS leader_id, f.market_id AS follower_id, any_value(l.market) AS leader, any_value(f.market) AS follower,
      l.rk AS lr, f.rk AS fr, l.lag AS lag_days, count(*) AS overlap,
      CASE WHEN count(*) >= 2 AND stddev_samp(l.ret) > 0 AND stddev_samp(f.ret) > 0 THEN corr(l.ret, f.ret) END AS corr
    FROM ld l JOIN ps f ON {on} AND f.pos = l.target AND f.market_id <> l.market_id GROUP BY {lb}, l.market_id, f.market_id, l.rk, f.rk, l.lag),
  bst AS (SELECT * FROM cd WHERE overlap >= {min_overlap} AND corr IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {by}, least(lr, fr), greatest(lr, fr) ORDER BY abs(corr) DESC, CASE WHEN lr < fr THEN 0 ELSE 1 END, lag_days) = 1),
  pv AS (SELECT *, {tail} AS p_value FROM bst),
  bh AS (SELECT *, p_value * count(*) OVER (PARTITION BY {by}) / row_number() OVER (PARTITION BY {by} ORDER BY p_value, leader_id, follower_id) AS raw FROM pv),
  edges_all AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY {by} ORDER BY p_value DESC, leader_id DESC, follower_id DESC
    ROWS UNBOUNDED PRECEDING)) AS q_value FROM bh)"""


EDGE_COLS = "commodity:s leader_id:s follower_id:s leader:s follower:s lag_days:i corr:f p_value:f q_value:f overlap:i"
DENSE_EDGES = DENSE_RET + lead_lag_sql("commodity", 35, 40)


@query("win01_market_returns", o.select(DENSE_RET, "commodity:s date:d market_id:s market:s ret:f", "ret"))
def _(spark, d):
    return ret.market_returns(wh.panel(spark, d)).select("commodity", "date", "market_id", "market", "ret")


@query("win02_report_positions_whole", o.select(TYPED_RET + """,
  r AS (SELECT commodity, market_id, date, dense_rank() OVER (PARTITION BY commodity ORDER BY date) AS pos FROM ret)""",
    "commodity:s market_id:s date:d pos:i", "r"))
def _(spark, d):
    r = ret.market_returns(wh.panel(spark, d, typed=True))
    return ret.with_position(r, ["commodity"]).select("commodity", "market_id", "date", "pos")


@query("top01_jn11_top_markets", o.select(TYPED_RET + """, c AS (SELECT commodity, market_id, count(*) AS n_returns FROM ret GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY n_returns DESC, market_id) AS market_rank FROM c QUALIFY market_rank <= 10)""",
    "commodity:s market_id:s n_returns:i market_rank:i", "k"))
def _(spark, d):
    return ret.top_markets(ret.market_returns(wh.panel(spark, d, typed=True)), ["commodity"], 10).select("commodity", "market_id", "n_returns", "market_rank")


@query("cmp01_lead_lag_all_pairs", o.select(DENSE_EDGES, EDGE_COLS, "edges_all"))
def _(spark, d):
    return ll.lead_lag_edges(wh.panel(spark, d), ALL_PAIRS)


@query("cmp01_lead_lag_gated", o.select(DENSE_EDGES, EDGE_COLS, "edges_all WHERE abs(corr) >= 0.15 AND q_value <= 0.5"))
def _(spark, d):
    return ll.lead_lag_edges(wh.panel(spark, d), GATED)


# all rows stay: each year starts 40 days later than the calendar has it, so that reports have gaps between years
SHIFTED = (o.panel().replace("panel AS (", "panel_ AS (") + ", panel AS (SELECT * REPLACE (CAST(date + CAST(40 * (year(date) - 1992) AS INTEGER) AS DATE) AS date) FROM panel_)"
           + o.RETURNS)


def _shifted(spark, d):
    return wh.panel(spark, d).withColumn("date", F.date_add("date", (40 * (F.year("date") - 1992)).cast("int")))


@query("cmp01_lead_lag_year_gaps", o.select(SHIFTED + lead_lag_sql("commodity", 35, 40), EDGE_COLS, "edges_all"))
def _(spark, d):
    return ll.lead_lag_edges(_shifted(spark, d), ALL_PAIRS)


@query("cmp01_lead_lag_year_gaps_calendar", o.select(SHIFTED + lead_lag_sql("commodity", 35, 40, calendar=True), EDGE_COLS, "edges_all"))
def _(spark, d):
    return ll.lead_lag_edges(_shifted(spark, d), LeadLagPolicy(min_abs_corr=0.0, fdr_alpha=1.0, lag_mode="calendar"))


@query("cmp01_lead_lag_by_commodity", o.select(TYPED_RET + lead_lag_sql("commodity", 10, 25), EDGE_COLS, "edges_all"))
def _(spark, d):
    return ll.lead_lag_edges(wh.panel(spark, d, typed=True), TYPED_PAIRS)


YEAR_SQL = o.panel() + """, ev AS (SELECT commodity, yr AS year FROM (SELECT commodity, year(date) AS yr, market_id, count(*) AS n FROM panel GROUP BY ALL)
    GROUP BY ALL HAVING count(*) FILTER (n >= 21) >= 2),
  py AS (SELECT panel.*, year(date) AS year FROM panel),
  ret AS (SELECT * FROM (SELECT *, CASE WHEN date - lag(date) OVER w = 1 THEN ln(modal_price) - lag(ln(modal_price)) OVER w END AS ret
    FROM py SEMI JOIN ev USING (commodity, year) WINDOW w AS (PARTITION BY commodity, year, market_id ORDER BY date)) WHERE ret IS NOT NULL)""" + lead_lag_sql("commodity, year", 20, 40)


@query("cmp09_yearly_edges", o.select(YEAR_SQL, "commodity:s year:i leader_id:s follower_id:s lag_days:i corr:f p_value:f q_value:f overlap:i", "edges_all"))
def _(spark, d):
    return ll.yearly_edges(wh.stored_panel(spark, d), YEARLY).select("commodity", "year", "leader_id", "follower_id", "lag_days", "corr", "p_value", "q_value", "overlap")


@query("cmp09_edge_stability", o.select(YEAR_SQL + """, s AS (SELECT commodity, leader_id, follower_id, leader, follower, count(DISTINCT year) AS years_supported,
    quantile_cont(corr, 0.5) AS median_corr, quantile_cont(abs(corr), 0.5) AS median_abs_corr, quantile_cont(lag_days, 0.5) AS median_lag_days,
    quantile_cont(overlap, 0.5) AS median_overlap, (SELECT count(*) FROM ev) AS years_evaluated, count(DISTINCT year) / (SELECT count(*) FROM ev) AS persistence_ratio
    FROM edges_all GROUP BY ALL)""",
    "commodity:s leader_id:s follower_id:s leader:s follower:s years_supported:i median_corr:f median_abs_corr:f median_lag_days:f median_overlap:f years_evaluated:i persistence_ratio:f", "s"))
def _(spark, d):
    p = wh.stored_panel(spark, d)
    return ll.edge_stability(ll.yearly_edges(p, YEARLY), ll.evaluable_years(p, YEARLY.min_overlap))


@query("win13_leader_stability")
def _(spark, d):
    by = ["commodity", "year"]
    scores = gr.influence_scores(ll.yearly_edges(wh.stored_panel(spark, d), YEARLY), by)
    return ll.leader_stability(ll.leader_ranks(scores, by))


@query("gra00_graph_nodes", o.select(DENSE_EDGES + """, g AS (SELECT * FROM edges_all WHERE abs(corr) >= 0.15 AND q_value <= 0.5),
  n AS (SELECT commodity, market_id, min(m) AS market FROM (SELECT commodity, leader_id AS market_id, leader AS m FROM g
    UNION ALL SELECT commodity, follower_id, follower FROM g) GROUP BY ALL)""", "commodity:s market_id:s market:s", "n"))
def _(spark, d):
    return gr.graph_tables(ll.lead_lag_edges(wh.panel(spark, d), GATED), ["commodity"])[0]


PAGERANK_SQL = """, e AS (SELECT follower_id AS f, leader_id AS t, abs(corr) AS w FROM edges_all WHERE abs(corr) >= 0.15 AND q_value <= 0.5),
  nd AS (SELECT f AS id FROM e UNION SELECT t FROM e), sz AS (SELECT count(*) AS n FROM nd),
  m AS (SELECT a.id AS f, b.id AS t, coalesce(max(e.w) / nullif(max(s.sw), 0), CASE WHEN max(s.sw) IS NULL THEN 1.0 / max(n) ELSE 0 END) AS share
    FROM nd a CROSS JOIN nd b CROSS JOIN sz LEFT JOIN e ON e.f = a.id AND e.t = b.id LEFT JOIN (SELECT f, sum(w) AS sw FROM e GROUP BY f) s ON s.f = a.id GROUP BY ALL)"""


def _pagerank_sql() -> str:
    """Unrolled rounds past the stopping point of the iteration; compared at three decimals."""
    out, last = DENSE_EDGES + PAGERANK_SQL + ", pr0 AS (SELECT id, 1.0 / n AS r FROM nd, sz)", "pr0"
    for k in range(1, 25):
        out += f", pr{k} AS MATERIALIZED (SELECT t AS id, 0.85 * sum(share * r) + 0.15 / max(n) AS r FROM m JOIN {last} ON {last}.id = m.f, sz GROUP BY t)"
        last = f"pr{k}"
    return "WITH " + out + f" SELECT id AS market_id, CAST(floor(r * 1000 + 0.5) AS BIGINT) AS rank_millis FROM {last}"


@query("gra01_pagerank", _pagerank_sql())
def _(spark, d):
    edges = ll.lead_lag_edges(wh.panel(spark, d), GATED)
    x = gr.centrality(edges, ["commodity"])
    return x.select("market_id", F.floor(F.col("source_pagerank") * 1000 + 0.5).alias("rank_millis"))


@query("gra02_betweenness", o.select(DENSE_EDGES.replace("WITH ", "WITH ") + """, e AS (SELECT leader_id AS s, follower_id AS t FROM edges_all WHERE abs(corr) >= 0.15 AND q_value <= 0.5),
  nd AS (SELECT s AS id FROM e UNION SELECT t FROM e), sz AS (SELECT count(*) AS n FROM nd),
  d0 AS (SELECT id AS s, id AS v, 0 AS d, 1.0 AS sg FROM nd)""" + "".join(f"""{', '}n{k} AS MATERIALIZED (SELECT x.s, e.t AS v, {k} AS d, sum(sg) AS sg FROM d{k - 1} x JOIN e ON x.v = e.s
    WHERE x.d = {k - 1} AND NOT EXISTS (SELECT 1 FROM d{k - 1} y WHERE y.s = x.s AND y.v = e.t) GROUP BY x.s, e.t), d{k} AS MATERIALIZED (SELECT * FROM d{k - 1} UNION ALL SELECT * FROM n{k})""" for k in range(1, 9)) + """,
  bt AS (SELECT a.v AS id, sum(a.sg * b.sg / c.sg) AS b FROM d8 a JOIN d8 b ON a.v = b.s JOIN d8 c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d
    WHERE a.s <> a.v AND b.v <> b.s AND a.s <> b.v GROUP BY a.v),
  r AS (SELECT nd.id AS market_id, coalesce(b, 0) / ((n - 1) * (n - 2)) AS betweenness FROM nd CROSS JOIN sz LEFT JOIN bt ON nd.id = bt.id)""",
    "market_id:s betweenness:f", "r"))
def _(spark, d):
    return gr.centrality(ll.lead_lag_edges(wh.panel(spark, d), GATED), ["commodity"]).select("market_id", "betweenness")


@query("cmp02_influence_scores")
def _(spark, d):
    return gr.influence_scores(ll.lead_lag_edges(wh.panel(spark, d, typed=True), TYPED_PAIRS))


@query("top02_top_influence")
def _(spark, d):
    s = gr.influence_scores(ll.lead_lag_edges(wh.panel(spark, d), GATED))
    return ev.top_n(s, [F.desc("influence_score"), F.col("market_id")], 10)


@query("jn12_located_network", o.select(DENSE_EDGES + o.COORDS + """, r AS (SELECT leader_id, follower_id, lag_days, corr, a.lat AS leader_lat, a.lon AS leader_lon,
    b.lat AS follower_lat, b.lon AS follower_lon FROM edges_all JOIN coords a ON a.market_id = leader_id JOIN coords b ON b.market_id = follower_id
    WHERE abs(corr) >= 0.15 AND q_value <= 0.5)""",
    "leader_id:s follower_id:s lag_days:i corr:f leader_lat:f leader_lon:f follower_lat:f follower_lon:f", "r"))
def _(spark, d):
    x = ev.located_edges(ll.lead_lag_edges(wh.panel(spark, d), GATED), wh.coordinates(spark, d))
    return x.select("leader_id", "follower_id", "lag_days", "corr", "leader_lat", "leader_lon", "follower_lat", "follower_lon")


# ---------- pairs ----------
def pair_returns_sql(min_overlap: int) -> str:
    return f""", rr AS (SELECT a.commodity, a.market_id AS market_a_id, b.market_id AS market_b_id, count(*) AS overlap,
      CASE WHEN stddev_samp(a.ret) > 0 AND stddev_samp(b.ret) > 0 THEN corr(a.ret, b.ret) END AS return_corr
    FROM ret a JOIN ret b ON a.commodity = b.commodity AND a.date = b.date AND a.market_id < b.market_id
    GROUP BY a.commodity, a.market_id, b.market_id HAVING count(*) >= {min_overlap})"""


def integration_sql(min_overlap: int, edges: str | None) -> str:
    strength = f"""SELECT commodity, least(leader_id, follower_id) AS a, greatest(leader_id, follower_id) AS b, max(abs(corr)) AS s FROM {edges} GROUP BY ALL""" \
        if edges else "SELECT '' AS commodity, '' AS a, '' AS b, 0.0 AS s WHERE false"
    return pair_returns_sql(min_overlap) + f""", sh AS (SELECT a.commodity, a.market_id AS market_a_id, b.market_id AS market_b_id, count(*) AS shared,
      quantile_cont(abs(ln(a.modal_price / b.modal_price)), 0.5) AS gap FROM panel a JOIN panel b ON a.commodity = b.commodity AND a.date = b.date AND a.market_id < b.market_id
    GROUP BY a.commodity, a.market_id, b.market_id HAVING count(*) >= {min_overlap}),
  dn AS (SELECT commodity, market_id, count(*) AS n FROM panel GROUP BY ALL), st AS ({strength}),
  ig AS (SELECT rr.commodity, rr.market_a_id, rr.market_b_id, return_corr, gap AS median_abs_log_price_gap, least(1.0, shared / least(x.n, y.n)) AS shared_date_fraction,
      coalesce(s, 0) AS transmission_strength FROM rr JOIN sh USING (commodity, market_a_id, market_b_id)
    JOIN dn x ON x.commodity = rr.commodity AND x.market_id = rr.market_a_id JOIN dn y ON y.commodity = rr.commodity AND y.market_id = rr.market_b_id
    LEFT JOIN st ON st.commodity = rr.commodity AND st.a = rr.market_a_id AND st.b = rr.market_b_id),
  sc AS (SELECT *, 0.40 * greatest(0, least(1, (return_corr + 1) / 2)) + 0.30 * exp(-median_abs_log_price_gap / 0.25) + 0.20 * shared_date_fraction
      + 0.10 * transmission_strength AS integration_score FROM ig)"""


IG_COLS = "commodity:s market_a_id:s market_b_id:s return_corr:f median_abs_log_price_gap:f shared_date_fraction:f transmission_strength:f integration_score:f"


@query("cmp03_integration_pairs", o.select(DENSE_EDGES + integration_sql(35, "edges_all"), IG_COLS, "sc"))
def _(spark, d):
    p = wh.stored_panel(spark, d)
    return pr.integration_pairs(p, ll.lead_lag_edges(p, ALL_PAIRS)).drop("market_a", "market_b", "state_a", "state_b")


@query("cmp03_integration_by_commodity", o.select(TYPED_RET + integration_sql(10, None), IG_COLS, "sc"))
def _(spark, d):
    return pr.integration_pairs(wh.stored_panel(spark, d, typed=True), None, 10).drop("market_a", "market_b", "state_a", "state_b")


DISTANCE = o.COORDS + pair_returns_sql(10) + """, dp AS (SELECT rr.*, a.market AS market_a, b.market AS market_b, a.state AS state_a, b.state AS state_b,
    2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS distance_km
    FROM rr JOIN coords a ON a.market_id = market_a_id JOIN coords b ON b.market_id = market_b_id),
  db AS (SELECT *, CASE WHEN distance_km < 100 THEN '0–100' WHEN distance_km < 250 THEN '100–250' WHEN distance_km < 500 THEN '250–500'
    WHEN distance_km < 1000 THEN '500–1000' ELSE '>1000' END AS distance_bin FROM dp)"""


@query("cmp04_distance_pairs", o.select(TYPED_RET + DISTANCE,
       "commodity:s market_a_id:s market_b_id:s market_a:s market_b:s state_a:s state_b:s distance_km:f return_corr:f overlap:i distance_bin:s", "db"))
def _(spark, d):
    return pr.distance_pairs(wh.stored_panel(spark, d, typed=True), wh.coordinates(spark, d), 10, "id")


def rank_sql(c: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0)"


@query("sta03_distance_effect", o.select(TYPED_RET + DISTANCE + f""", rk AS (SELECT commodity, {rank_sql('distance_km', 'commodity')} AS rx, {rank_sql('return_corr', 'commodity')} AS ry
    FROM db WHERE return_corr IS NOT NULL),
  sp AS (SELECT commodity, count(*) AS pairs, corr(rx, ry) AS spearman_rho FROM rk GROUP BY ALL),
  r AS (SELECT *, {o.t_tail('spearman_rho * sqrt((pairs - 2) / (1 - spearman_rho * spearman_rho))', '(pairs - 2)')} AS p_value FROM sp)""",
    "commodity:s pairs:i spearman_rho:f p_value:f", "r"))
def _(spark, d):
    return pr.distance_effect(pr.distance_pairs(wh.stored_panel(spark, d, typed=True), wh.coordinates(spark, d), 10, "id"), permutations=0).drop("qap_p_value")


@query("cmp05_qap_permutation")
def _(spark, d):
    return pr.distance_effect(pr.distance_pairs(wh.stored_panel(spark, d), wh.coordinates(spark, d), match="id"), permutations=499)


@query("fn01_fn03_haversine_bins", o.select(o.FINE_COORDS + """, p AS (SELECT a.market_id AS market_id,
    2 * 6371.0088 * asin(sqrt(pow(sin(radians(20.0 - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(20.0)) * pow(sin(radians(77.0 - a.lon) / 2), 2))) AS km FROM coords a),
  r AS (SELECT *, CASE WHEN km < 100 THEN '0–100' WHEN km < 250 THEN '100–250' WHEN km < 500 THEN '250–500' WHEN km < 1000 THEN '500–1000' ELSE '>1000' END AS bin FROM p)""",
    "market_id:s km:f bin:s", "r"))
def _(spark, d):
    km = num.haversine_km(F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(77.0))
    return wh.coordinates(spark, d, fine=True).select("market_id", km.alias("km"), num.distance_bin(km).alias("bin"))


SUPPLY_BASE = f""", q AS (SELECT commodity, arrivals, modal_price FROM panel WHERE arrivals >= 0 AND modal_price > 0),
  rk AS (SELECT commodity, {rank_sql('arrivals', 'commodity')} AS rx, {rank_sql('modal_price', 'commodity')} AS ry, ln(1 + arrivals) AS lx, ln(modal_price) AS ly FROM q),
  s AS (SELECT commodity, count(*) AS n, corr(rx, ry) AS spearman_rho, regr_slope(ly, lx) AS loglog_beta, regr_r2(ly, lx) AS r_squared FROM rk GROUP BY ALL),
  r AS (SELECT *, {o.t_tail('spearman_rho * sqrt((n - 2) / (1 - spearman_rho * spearman_rho))', '(n - 2)')} AS spearman_p,
    {o.t_tail('sign(loglog_beta) * sqrt(r_squared) * sqrt((n - 2) / (1 - r_squared))', '(n - 2)')} AS beta_p FROM s)"""


@query("sta01_supply_price", o.select(o.panel(True) + SUPPLY_BASE, "commodity:s n:i spearman_rho:f spearman_p:f loglog_beta:f beta_p:f r_squared:f", "r"))
def _(spark, d):
    return pr.supply_price_stats(wh.stored_panel(spark, d, typed=True), ["commodity"])


@query("sta02_fnt_pearson", o.select(o.panel(True) + f""", s AS (SELECT state, count(*) AS n, corr(arrivals, modal_price) AS r FROM panel WHERE arrivals IS NOT NULL GROUP BY ALL),
  t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, {o.t_tail('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)')} AS p_value FROM s)""", "state:s n:i r:f t:f p_value:f", "t"))
def _(spark, d):
    return pr.pearson(wh.panel(spark, d, typed=True), ["state"], "arrivals", "modal_price")


@query("sta04_average_ranks", o.select(o.rows(True) + f""", r AS (SELECT DISTINCT commodity, arrivals, {rank_sql('arrivals', 'commodity')} AS avg_rank,
    count(*) OVER (PARTITION BY commodity, arrivals) AS ties FROM price_rows)""", "commodity:s arrivals:f avg_rank:f ties:i", "r"))
def _(spark, d):
    return ranks.average_ranks(wh.price_rows(spark, d, typed=True), ["commodity"], "arrivals").select("commodity", "arrivals", "avg_rank", "ties")


@query("sta05_benjamini_hochberg", o.select(DENSE_EDGES, "leader_id:s follower_id:s p_value:f q_value:f", "edges_all"))
def _(spark, d):
    # the correction reads its input several times
    c = cut_lineage(ll.lead_lag_candidates(wh.panel(spark, d), ALL_PAIRS))
    return ranks.benjamini_hochberg(c, ["commodity"], "p_value").select("leader_id", "follower_id", "p_value", "q_value")


# ---------- robust z, shocks, crunches ----------
@query("win03_robust_z", o.select(o.panel(True) + o.z_score("arrivals", "commodity, market_id", "z", "panel", "zz"), "commodity:s market_id:s date:d z:f", "zz"))
def _(spark, d):
    x = num.with_robust_z(wh.panel(spark, d, typed=True), "arrivals", "z", Window.partitionBy("commodity", "market_id"))
    return x.select("commodity", "market_id", "date", "z")


CRUNCH = o.panel() + o.z_score("arrivals", "commodity, market_id", "arrival_z", "panel", "z1") + o.z_score("modal_price", "commodity, market_id", "price_z", "z1", "z2") + """,
  cr AS (SELECT *, sqrt(pow(greatest(price_z, 0), 2) + pow(least(arrival_z, 0), 2)) AS crunch_severity FROM z2 WHERE arrival_z <= -1.5 AND price_z >= 1.5)"""
CRUNCH_COLS = "date:d market_id:s state:s district:s market:s commodity:s modal_price:f arrivals:f arrival_z:f price_z:f crunch_severity:f"


@query("cmp06_market_crunches", o.select(CRUNCH, CRUNCH_COLS, "cr"))
def _(spark, d):
    return ev.market_crunches(wh.panel(spark, d))


@query("top02_top_crunches", o.select(CRUNCH, CRUNCH_COLS, "(SELECT * FROM cr ORDER BY crunch_severity DESC, price_z DESC, market_id, date LIMIT 20)"))
def _(spark, d):
    return ev.top_n(ev.market_crunches(wh.panel(spark, d)), [F.desc("crunch_severity"), F.desc("price_z"), F.col("market_id"), F.col("date")], 20)


SHOCK = DENSE_RET + o.z_score("ret", "commodity, market_id", "return_z", "ret", "sz") + """,
  sh_ AS (SELECT *, (exp(ret) - 1) * 100 AS return_pct FROM sz WHERE abs(return_z) >= 2)"""


@query("cmp07_fn04_price_shocks", o.select(SHOCK, "commodity:s date:d market_id:s ret:f return_z:f return_pct:f", "sh_"))
def _(spark, d):
    return ev.price_shocks(wh.panel(spark, d)).select("commodity", "date", "market_id", "ret", "return_z", "return_pct")


LEADERS = SHOCK + lead_lag_sql("commodity", 35, 40) + """, ed AS (SELECT * FROM edges_all WHERE abs(corr) >= 0.15 AND q_value <= 0.5),
  evt AS (SELECT commodity, market_id AS leader_id, arg_max(date, struct_pack(a := abs(return_z), b := date)) AS event_date FROM sh_ GROUP BY ALL),
  pc AS (SELECT commodity, market_id, date, (exp(ret) - 1) * 100 AS pct FROM ret),
  rp AS (SELECT e.commodity, e.leader_id, e.follower_id, event_date, event_date + CAST(lag_days AS INTEGER) AS response_date, lag_days, corr AS edge_corr, q_value AS edge_q_value,
    l.pct AS leader_shock_pct, f.pct AS follower_response_pct FROM evt JOIN ed e ON evt.commodity = e.commodity AND evt.leader_id = e.leader_id
    LEFT JOIN pc l ON l.commodity = e.commodity AND l.market_id = e.leader_id AND l.date = event_date
    JOIN pc f ON f.commodity = e.commodity AND f.market_id = e.follower_id AND f.date = event_date + CAST(lag_days AS INTEGER))"""
RIPPLE_COLS = "commodity:s leader_id:s follower_id:s event_date:d response_date:d lag_days:i edge_corr:f edge_q_value:f leader_shock_pct:f follower_response_pct:f"


def _ripples(spark, d):
    p = wh.stored_panel(spark, d)
    shocks = ev.price_shocks(p)
    events = shocks.groupBy("commodity", F.col("market_id").alias("leader_id")).agg(
        F.max_by("date", F.struct(F.abs("return_z"), F.col("date"))).alias("event_date"))
    return ev.ripple(p, ll.lead_lag_edges(p, GATED), events, 7)


@query("jn10_ripple_snapshot", o.select(LEADERS, RIPPLE_COLS, "rp"))
def _(spark, d):
    return _ripples(spark, d).drop("leader", "follower")


@query("qnt01_response_scale", o.select(LEADERS + ", r AS (SELECT commodity, greatest(1, quantile_cont(abs(follower_response_pct), 0.95)) AS max_abs FROM rp GROUP BY ALL)", "commodity:s max_abs:f", "r"))
def _(spark, d):
    return ev.response_scale(_ripples(spark, d), ["commodity"])


@query("top03_default_ripple_event", o.select(SHOCK + """, ld_ AS (SELECT commodity, market_id AS leader_id FROM (SELECT commodity, market_id, count(*) AS n FROM ret GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY commodity ORDER BY n DESC, market_id) = 1),
  b AS (SELECT commodity, market_id AS leader_id, arg_max(date, struct_pack(a := abs(return_z), b := date)) AS sd FROM sh_ GROUP BY ALL),
  l AS (SELECT commodity, max(date) AS ld FROM panel GROUP BY ALL),
  r AS (SELECT ld_.commodity, ld_.leader_id, coalesce(sd, ld) AS event_date FROM ld_ JOIN l ON l.commodity = ld_.commodity LEFT JOIN b ON b.commodity = ld_.commodity AND b.leader_id = ld_.leader_id)""",
    "commodity:s leader_id:s event_date:d", "r"))
def _(spark, d):
    p = wh.stored_panel(spark, d)
    scores = ret.market_returns(p).groupBy("commodity", "market_id").agg(F.count(F.lit(1)).cast("double").alias("influence_score"))
    return ev.default_ripple_event(p, scores)


# ---------- weather ----------
ANOMALY = "," + o.SIGNAL_BODY + o.z_score("rainfall_mm", "market_id, month(date)", "rainfall_anomaly_z", "signal", "w1") + \
    o.z_score("temperature_c", "market_id, month(date)", "temperature_anomaly_z", "w1", "w2") + \
    ", wa AS (SELECT *, count(*) OVER (PARTITION BY market_id, month(date)) AS climatology_n FROM w2)"


@query("win04_weather_anomalies", o.select(o.GEO + ANOMALY, "date:d market_id:s rainfall_mm:f temperature_c:f rainfall_anomaly_z:f temperature_anomaly_z:f climatology_n:i", "wa"))
def _(spark, d):
    return we.weather_anomalies(wh.daily_signal(spark, d)).drop("state", "district", "market")


JOINED = o.panel() + ANOMALY + """, jw AS (SELECT panel.*, rainfall_mm, temperature_c, rainfall_anomaly_z, temperature_anomaly_z, climatology_n
    FROM panel LEFT JOIN wa ON panel.date = wa.date AND panel.market_id = wa.market_id)"""


@query("jn03_market_weather_join", o.select(JOINED, "date:d market_id:s commodity:s modal_price:f rainfall_mm:f temperature_c:f rainfall_anomaly_z:f temperature_anomaly_z:f climatology_n:i", "jw"))
def _(spark, d):
    x = we.join_market_weather(wh.stored_panel(spark, d), wh.daily_signal(spark, d))
    return x.select("date", "market_id", "commodity", "modal_price", "rainfall_mm", "temperature_c", "rainfall_anomaly_z", "temperature_anomaly_z", "climatology_n")


@query("set02_id_overlap", o.select(o.panel() + "," + o.SIGNAL_BODY + """, a AS (SELECT DISTINCT market_id FROM panel), b AS (SELECT DISTINCT market_id FROM signal),
  r AS (SELECT (SELECT count(*) FROM a) AS price_ids, (SELECT count(*) FROM b) AS weather_ids, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared_ids)""",
    "price_ids:i weather_ids:i shared_ids:i", "r"))
def _(spark, d):
    return we.id_overlap(wh.stored_panel(spark, d), wh.daily_signal(spark, d)).select("price_ids", "weather_ids", "shared_ids")


EVENT = JOINED + """, e0 AS (SELECT * FROM jw WHERE abs(rainfall_anomaly_z) >= 2),
  e1 AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY commodity, market_id ORDER BY date) <= 2 THEN 0 ELSE 1 END AS brk FROM e0),
  e2 AS (SELECT *, sum(brk) OVER (PARTITION BY commodity, market_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS isl FROM e1),
  e3 AS (SELECT * FROM e2 QUALIFY row_number() OVER (PARTITION BY commodity, market_id, isl ORDER BY abs(rainfall_anomaly_z) DESC, date) = 1),
  bs AS (SELECT e3.commodity, e3.market_id, e3.date AS event_date, any_value(e3.rainfall_anomaly_z) AS weather_z, any_value(e3.market) AS market, any_value(e3.state) AS state,
    max(p.date) AS baseline_date, arg_max(p.modal_price, p.date) AS bp, max_by(struct_pack(a := p.arrivals), p.date).a AS bq
    FROM e3 JOIN jw p ON p.commodity = e3.commodity AND p.market_id = e3.market_id AND p.date < e3.date GROUP BY e3.commodity, e3.market_id, e3.date),
  hz AS (SELECT *, unnest([1, 3, 7, 14]) AS horizon_days FROM bs),
  rs AS (SELECT hz.*, p.date AS response_date, p.modal_price AS fp, p.arrivals AS fq FROM hz JOIN jw p ON p.commodity = hz.commodity AND p.market_id = hz.market_id
    AND p.date BETWEEN event_date + CAST(horizon_days AS INTEGER) AND event_date + CAST(horizon_days + 2 AS INTEGER)
    QUALIFY row_number() OVER (PARTITION BY hz.commodity, hz.market_id, event_date, horizon_days ORDER BY p.date) = 1),
  es AS (SELECT *, CASE WHEN weather_z > 0 THEN 'positive' ELSE 'negative' END AS event_sign, (fp / bp - 1) * 100 AS price_change_pct,
    (fq / nullif(bq, 0) - 1) * 100 AS arrival_change_pct FROM rs)"""


def _study(spark, d):
    return we.event_study(we.join_market_weather(wh.panel(spark, d), wh.daily_signal(spark, d), "market_id"), policy=EventPolicy())


@query("cmp08_jn08_jn09_event_study", o.select(EVENT, "market_id:s market:s state:s commodity:s event_date:d baseline_date:d response_date:d horizon_days:i weather_z:f event_sign:s price_change_pct:f arrival_change_pct:f", "es"))
def _(spark, d):
    return _study(spark, d)


@query("win12_declustered_events", o.select(EVENT, "commodity:s market_id:s date:d rainfall_anomaly_z:f", "e3"))
def _(spark, d):
    x = we.join_market_weather(wh.panel(spark, d), wh.daily_signal(spark, d), "market_id").where(F.abs("rainfall_anomaly_z") >= 2)
    return we.decluster(x, ["commodity", "market_id"], "rainfall_anomaly_z", 2).select("commodity", "market_id", "date", "rainfall_anomaly_z")


@query("agg12_event_summary", o.select(EVENT + """, r AS (SELECT commodity, event_sign, horizon_days, count(price_change_pct) AS n, quantile_cont(price_change_pct, 0.5) AS median_price_change_pct,
    quantile_cont(arrival_change_pct, 0.5) AS median_arrival_change_pct FROM es GROUP BY ALL)""",
    "commodity:s event_sign:s horizon_days:i n:i median_price_change_pct:f median_arrival_change_pct:f", "r"))
def _(spark, d):
    return we.event_study_summary(_study(spark, d))


CELLS = o.FINE_COORDS + """, cells AS (SELECT *, CAST(round_even(lat / 0.5, 0) AS INTEGER) AS ci, CAST(round_even(lon / 0.625, 0) AS INTEGER) AS cj FROM coords)"""


@query("fn02_power_cells", o.select(CELLS + ", r AS (SELECT market_id, ci * 0.5 AS power_cell_lat, round(cj * 0.625, 4) AS power_cell_lon FROM cells)",
       "market_id:s power_cell_lat:f power_cell_lon:f", "r"))
def _(spark, d):
    return we.market_cells(wh.coordinates(spark, d, fine=True)).select("market_id", "power_cell_lat", "power_cell_lon")


@query("jn04_cell_weather", o.select(CELLS + "," + o.SIGNAL_BODY + o.COORDS.replace("coords AS", "nat AS") + """,
  ch AS (SELECT s.*, CAST(round_even(n.lat / 0.5, 0) AS INTEGER) AS ci, CAST(round_even(n.lon / 0.625, 0) AS INTEGER) AS cj FROM signal s JOIN nat n ON n.market_id = s.market_id
    QUALIFY row_number() OVER (PARTITION BY date, ci, cj ORDER BY s.market_id DESC) = 1),
  r AS (SELECT ch.date, cells.market_id, ch.rainfall_mm, ch.temperature_c FROM cells JOIN ch ON cells.ci = ch.ci AND cells.cj = ch.cj)""",
    "date:d market_id:s rainfall_mm:f temperature_c:f", "r"))
def _(spark, d):
    nat = we.market_cells(wh.coordinates(spark, d)).select("market_id", "power_cell_lat", "power_cell_lon")
    chunks = wh.daily_signal(spark, d).join(nat, "market_id").withColumnsRenamed({"market_id": "chunk"})
    return we.rebuild_weather(wh.coordinates(spark, d, fine=True), chunks, ["chunk"]).select("date", "market_id", "rainfall_mm", "temperature_c")


@query("agg19_run_summary")
def _(spark, d):
    from .batch import run_summary
    p = wh.stored_panel(spark, d)
    edges = ll.lead_lag_edges(p, GATED)
    yearly = ll.yearly_edges(p, YEARLY)
    by = ["commodity", "year"]
    leaders = ll.leader_stability(ll.leader_ranks(gr.influence_scores(yearly, by), by))
    return run_summary(p, edges, gr.influence_scores(edges), ll.edge_stability(yearly, ll.evaluable_years(p, 20)), leaders,
                       supply=pr.supply_price_stats(p, ["commodity"]))
