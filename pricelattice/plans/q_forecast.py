"""Forecasting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..session import shared_folder
from ..sources import warehouse as wh
from . import oracle as o
from .queries import query

FEATURES = o.panel() + """, n AS (SELECT *, count(*) OVER (PARTITION BY commodity, market_id) AS n_obs FROM panel),
  l AS (SELECT *, lag(modal_price, 1) OVER w AS lag_1, lag(modal_price, 2) OVER w AS lag_2, lag(modal_price, 3) OVER w AS lag_3, lag(modal_price, 7) OVER w AS lag_7,
    lag(modal_price, 14) OVER w AS lag_14, avg(modal_price) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_mean_3,
    avg(modal_price) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7, avg(modal_price) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS rolling_mean_14,
    stddev_pop(modal_price) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_std_7 FROM n WHERE n_obs >= 120 WINDOW w AS (PARTITION BY commodity, market_id ORDER BY date)),
  f AS (SELECT *, lag_1 - lag_2 AS previous_abs_change, (lag_1 - lag_2) / nullif(lag_2, 0) AS previous_pct_change FROM l WHERE lag_14 IS NOT NULL)"""
FEATURE_COLS = "date:d market_id:s modal_price:f " + " ".join(f"{c}:f" for c in fc.NUMERIC_FEATURES)
SPLIT = FEATURES + """, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM f)),
  bd AS (SELECT max(date) FILTER (k = greatest(1, floor(n * CAST(0.70 AS DOUBLE)))) AS train_end,
    max(date) FILTER (k = greatest(greatest(1, floor(n * CAST(0.70 AS DOUBLE))) + 1, floor(n * CAST(0.85 AS DOUBLE)))) AS validation_end FROM dd),
  sp AS (SELECT f.*, CASE WHEN date <= train_end THEN 'train' WHEN date <= validation_end THEN 'validation' ELSE 'test' END AS split FROM f, bd)"""


@query("win05_win08_features", o.select(FEATURES, FEATURE_COLS, "f"))
def _(spark, d):
    return fc.build_features(wh.panel(spark, d)).select("date", "market_id", "modal_price", *fc.NUMERIC_FEATURES)


@query("win09_cohort_audit", o.select(FEATURES + """, m AS (SELECT market_id, count(*) AS n FROM panel GROUP BY ALL),
  r AS (SELECT count(*) FILTER (n >= 120) AS eligible_market_count, count(*) FILTER (n < 120) AS excluded_market_count, coalesce(sum(n) FILTER (n >= 120), 0) AS eligible_rows,
    (SELECT count(*) FROM f) AS modeling_rows, coalesce(sum(n) FILTER (n >= 120), 0) - (SELECT count(*) FROM f) AS rows_removed_insufficient_lag_history FROM m)""",
    "eligible_market_count:i excluded_market_count:i eligible_rows:i modeling_rows:i rows_removed_insufficient_lag_history:i", "r"))
def _(spark, d):
    return fc.cohort_audit(wh.stored_panel(spark, d))


@query("nrm15_panel_audit", "WITH " + o.rows(True) + f""", m AS (SELECT *, {o.MID} AS market_id FROM price_rows WHERE lower(commodity) = 'economy')
SELECT CAST((SELECT count(*) FROM price_rows) AS BIGINT) AS initial_rows, CAST(count(*) AS BIGINT) AS commodity_rows, CAST(count(*) FILTER (NOT modal_price > 0) AS BIGINT) AS invalid_rows_removed,
  CAST(count(*) - count(DISTINCT (date, market_id, commodity)) AS BIGINT) AS duplicate_rows_removed FROM m""")
def _(spark, d):
    return fc.panel_audit(wh.price_rows(spark, d, typed=True), "economy")


@query("nrm15_validated_panel", o.select(o.rows(True) + f""", v AS (SELECT *, {o.MID} AS market_id FROM price_rows WHERE lower(commodity) = 'economy' AND modal_price > 0
    QUALIFY row_number() OVER (PARTITION BY date, market_id, commodity ORDER BY l_orderkey DESC, l_linenumber DESC, state DESC, district DESC, market DESC, variety DESC, grade DESC,
      min_price DESC, max_price DESC, modal_price DESC, arrivals DESC) = 1)""", "date:d market_id:s commodity:s modal_price:f l_orderkey:i l_linenumber:i", "v"))
def _(spark, d):
    x = fc.validate_panel(wh.price_rows(spark, d, typed=True), "economy", wh.INGEST_ORDER)
    return x.select("date", "market_id", "commodity", "modal_price", *wh.INGEST_ORDER)


LATEST = o.panel() + """, x AS (SELECT *, count(*) OVER (PARTITION BY commodity, market_id) AS n, lag(modal_price, 1) OVER w AS lag_2, lag(modal_price, 6) OVER w AS lag_7,
    avg(modal_price) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean_7, stddev_pop(modal_price) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_std_7
    FROM panel WINDOW w AS (PARTITION BY commodity, market_id ORDER BY date)),
  y AS (SELECT *, modal_price AS lag_1 FROM x WHERE n >= 120 QUALIFY row_number() OVER (PARTITION BY commodity, market_id ORDER BY date DESC) = 1)"""


@query("win10_latest_features", o.select(LATEST, "market_id:s date:d lag_1:f lag_2:f lag_7:f rolling_mean_7:f rolling_std_7:f", "y"))
def _(spark, d):
    return fc.latest_features(wh.panel(spark, d), min_market_observations=120).select("market_id", "date", "lag_1", "lag_2", "lag_7", "rolling_mean_7", "rolling_std_7")


@query("win11_temporal_split", o.select(SPLIT + ", r AS (SELECT split, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM sp GROUP BY ALL)", "split:s n:i first_date:d last_date:d", "r"))
def _(spark, d):
    x = fc.temporal_split(fc.build_features(wh.stored_panel(spark, d)))
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("fc01_fc07_baseline_metrics", o.select(SPLIT + """, pr AS (SELECT 'M0 Persistence' AS model, modal_price AS y, lag_1 AS p, lag_1 AS v FROM sp WHERE split = 'test'
    UNION ALL SELECT 'M1 Lag-7', modal_price, lag_7, lag_1 FROM sp WHERE split = 'test'),
  r AS (SELECT model, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, 1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)) AS r2,
    100 * avg(abs(p - y) / abs(y)) AS mape_pct, 100 * avg(2 * abs(p - y) / (abs(y) + abs(p))) AS smape_pct, 100 * sum(abs(p - y)) / sum(abs(y)) AS wape_pct,
    quantile_cont(abs(p - y), 0.5) AS median_absolute_error, avg(p - y) AS mean_bias_error,
    100 * avg(CASE WHEN sign(y - v) = sign(p - v) THEN 1.0 ELSE 0.0 END) AS directional_accuracy_pct FROM pr GROUP BY ALL)""",
    "model:s n:i mae:f rmse:f r2:f mape_pct:f smape_pct:f wape_pct:f median_absolute_error:f mean_bias_error:f directional_accuracy_pct:f", "r"))
def _(spark, d):
    x = fc.temporal_split(fc.build_features(wh.stored_panel(spark, d))).where(F.col("split") == "test")
    return fc.metrics(fc.baseline_predictions(x), ["model"]).drop("mse")


FORECASTS = (LATEST + ", r AS (SELECT market_id, date AS last_observed_date, modal_price AS last_observed_price, lag_7 AS predicted_next_report_price, (SELECT max(date) FROM panel) AS historical_data_through FROM y)",
             "market_id:s last_observed_date:d last_observed_price:f predicted_next_report_price:f historical_data_through:d", "r")
FORECAST_COLS = ["market_id", "last_observed_date", "last_observed_price", "predicted_next_report_price", "historical_data_through"]


@query("fc10_latest_forecast", o.select(*FORECASTS))
def _(spark, d):
    return fc.forecast_latest(wh.stored_panel(spark, d), fc.LAG7).select(*FORECAST_COLS)


@query("fc11_served_forecasts", o.select(*FORECASTS))
def _(spark, d):
    x, folder = wh.stored_panel(spark, d), shared_folder(spark, "forecasts")
    test = fc.baseline_predictions(fc.temporal_split(fc.build_features(x)).where(F.col("split") == "test"))
    scores = fc.metrics(test, ["model"])
    fc.save_artifacts(fc.TrainingResult(fc.LAG7, scores, scores, test, fc.forecast_latest(x, fc.LAG7), None), x, folder)
    assert fc.load_model(spark, folder) is None  # a baseline has no model to load
    return fc.serve_forecasts(spark, folder).select(*FORECAST_COLS)


@query("snk10_dataset_manifest", o.select(o.panel(True) + """, r AS (SELECT array_to_string(list_sort(list(DISTINCT state)), ',') AS states, count(DISTINCT market_id) AS market_count, count(*) AS processed_rows,
    min(date) AS date_min, max(date) AS date_max, count(*) - count(modal_price) AS missing_modal_price_rows FROM panel)""",
    "states:s market_count:i processed_rows:i date_min:d date_max:d missing_modal_price_rows:i", "r"))
def _(spark, d):
    m = fc.dataset_manifest(wh.panel(spark, d, typed=True))
    return m.select(F.array_join("states", ",").alias("states"), "market_count", "processed_rows", "date_min", "date_max", "missing_modal_price_rows")


def _split(spark, d):
    from ..session import cut_lineage
    return cut_lineage(fc.temporal_split(fc.build_features(wh.panel(spark, d))))


def _validated(spark, d, name):
    x = _split(spark, d)
    fitted = fc.fit(x.where(F.col("split") == "train"), [name])
    return fc.evaluate(x.where(F.col("split") == "validation"), fitted)[0]


@query("fc02_fc03_ridge")
def _(spark, d):
    return _validated(spark, d, fc.RIDGE)


@query("fc04_decision_tree")
def _(spark, d):
    return _validated(spark, d, fc.TREE)


@query("fc05_random_forest")
def _(spark, d):
    return _validated(spark, d, fc.FOREST)


@query("fc06_gradient_boosting")
def _(spark, d):
    return _validated(spark, d, fc.BOOSTING)


@query("fc08_fc09_jn13_selection")
def _(spark, d):
    return fc.train_and_compare(wh.stored_panel(spark, d)).comparison
