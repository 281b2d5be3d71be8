"""Next-observation forecasting: features that only look back, chronological split, models, metrics, latest forecasts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.joins import join_on
from ..functions.numeric import finite
from ..functions.ranks import exact_quantiles
from ..session import cut_lineage
from . import linear, trees
from .normalize import ensure_market_id, keep_last

# ---- fixed values ----
SEED = 42
LAGS = (1, 2, 3, 7, 14)
MEAN_WINDOWS = (3, 7, 14)
STD_WINDOW = 7
NUMERIC_FEATURES = ["lag_1", "lag_2", "lag_3", "lag_7", "lag_14", "rolling_mean_3", "rolling_mean_7", "rolling_mean_14",
                    "rolling_std_7", "previous_abs_change", "previous_pct_change"]
PERSISTENCE, LAG7, RIDGE, TREE, FOREST, BOOSTING = (
    "M0 Persistence", "M1 Lag-7", "M2 Ridge", "M3 Decision Tree", "M4 Random Forest", "M5 Hist Gradient Boosting")
BASELINES = {PERSISTENCE: "lag_1", LAG7: "lag_7"}
METRICS = ["mae", "mse", "rmse", "r2", "mape_pct", "smape_pct", "wape_pct", "median_absolute_error", "mean_bias_error",
           "directional_accuracy_pct"]
HORIZON = "next reported market observation"
RIDGE_ALPHA = 1.0
RULES = {TREE: trees.Rules(depth=8, min_leaf=5), FOREST: trees.Rules(depth=12, min_leaf=3),
         BOOSTING: trees.Rules(depth=1 << 20, min_leaf=20, leaves=15)}
BOOSTING_RATE = 0.05
# ---- end of fixed values ----
SERIES = ["commodity", "market_id"]


def _clean(df: DataFrame, commodity: str | None) -> DataFrame:
    x = ensure_market_id(df)
    return x.where(F.lower("commodity") == commodity.lower()) if commodity else x


def _usable() -> Column:
    return F.col("date").isNotNull() & F.col("market_id").isNotNull() & F.coalesce(F.col("modal_price") > 0, F.lit(False))


def validate_panel(df: DataFrame, commodity: str | None, order: list[str] | None = None) -> DataFrame:
    """Rows fit for modelling: one commodity (any case), positive price, last row per market-day."""
    missing = {"date", "state", "district", "market", "commodity", "modal_price"} - set(df.columns)
    if missing:
        raise ValueError(f"forecasting needs columns {sorted(missing)}")
    return keep_last(_clean(df, commodity).where(_usable()), ["date", "market_id", "commodity"], order or [])


def panel_audit(df: DataFrame, commodity: str | None) -> DataFrame:
    """One row: rows seen, rows of the commodity, invalid rows removed, duplicate rows removed."""
    x = _clean(df, commodity).withColumn("__ok", _usable())
    keys = x.where("__ok").groupBy("date", "market_id", "commodity").agg(F.count(F.lit(1)).alias("n"))
    out = x.agg(F.count(F.lit(1)).alias("commodity_rows"), F.count_if(~F.col("__ok")).alias("invalid_rows_removed"))
    return out.withColumns({
        "initial_rows": df.agg(F.count(F.lit(1))).scalar(),
        "duplicate_rows_removed": keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()})


def _feature_columns(price: Column, order, shift: int) -> dict[str, Column]:
    """Features over reports strictly before the row (shift=1), or up to and including it (shift=0)."""
    last = -1 if shift else 0

    def full(fn, w: int) -> Column:
        frame = order.rowsBetween(last - w + 1, last)
        return F.when(F.count(price).over(frame) == w, fn(price).over(frame))

    def back(k: int) -> Column:
        return F.lag(price, k - 1 + shift).over(order)

    cols = {f"lag_{k}": back(k) for k in LAGS}
    cols |= {f"rolling_mean_{w}": full(F.avg, w) for w in MEAN_WINDOWS}
    cols[f"rolling_std_{STD_WINDOW}"] = full(F.stddev_pop, STD_WINDOW)
    return cols


def _changes() -> dict[str, Column]:
    diff = F.col("lag_1") - F.col("lag_2")
    return {"previous_abs_change": diff, "previous_pct_change": F.try_divide(diff, F.col("lag_2"))}


def lag_features(df: DataFrame) -> DataFrame:
    """All features of every report; one sort per (commodity, market) serves every window."""
    order = Window.partitionBy(*SERIES).orderBy("date")
    return df.withColumns(_feature_columns(F.col("modal_price"), order, 1)).withColumns(_changes())


def build_features(df: DataFrame, commodity: str | None = None, min_market_observations: int = 120, order: list[str] | None = None) -> DataFrame:
    """Complete, finite feature rows of markets with enough history."""
    x = validate_panel(df, commodity, order)
    x = x.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*SERIES))).where(F.col("__n") >= min_market_observations).drop("__n")
    ok = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in NUMERIC_FEATURES])
    return lag_features(x).where(ok)


def cohort_audit(df: DataFrame, commodity: str | None = None, min_market_observations: int = 120) -> DataFrame:
    """One row with the audit counts behind a feature table."""
    per = validate_panel(df, commodity).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    enough = F.col("n") >= min_market_observations
    out = per.agg(F.count_if(enough).alias("eligible_market_count"), F.count_if(~enough).alias("excluded_market_count"),
                  F.coalesce(F.sum(F.when(enough, F.col("n"))), F.lit(0)).alias("eligible_rows"))
    out = out.withColumn("modeling_rows", build_features(df, commodity, min_market_observations).agg(F.count(F.lit(1))).scalar())
    return out.withColumn("rows_removed_insufficient_lag_history", F.col("eligible_rows") - F.col("modeling_rows"))


def excluded_markets(df: DataFrame, commodity: str | None = None, min_market_observations: int = 120) -> DataFrame:
    per = validate_panel(df, commodity).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("observations"))
    return per.where(F.col("observations") < min_market_observations)


def split_boundaries(frame: DataFrame, strict: bool = True) -> DataFrame:
    """Per commodity: last training and last validation date by position among the distinct dates (70 % / 85 %)."""
    days = frame.select("commodity", "date").distinct()
    days = days.withColumn("k", F.row_number().over(Window.partitionBy("commodity").orderBy("date")))
    days = days.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("commodity")))
    train = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.70)))
    valid = F.greatest(train + 1, F.floor(F.col("n") * F.lit(0.85)))
    out = days.groupBy("commodity").agg(
        F.max("n").alias("dates"), F.max(F.when(F.col("k") == train, F.col("date"))).alias("train_end"),
        F.max(F.when(F.col("k") == valid, F.col("date"))).alias("validation_end"))
    if strict:
        too_few = F.raise_error(F.lit("at least 20 distinct target dates are required"))
        out = out.withColumn("train_end", F.when(F.col("dates") < 20, too_few.cast("date")).otherwise(F.col("train_end")))
    return out


def temporal_split(frame: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``split``: train, validation or test, by the same dates for every market of a commodity."""
    b = split_boundaries(frame, strict).select("commodity", "train_end", "validation_end")
    label = F.when(F.col("date") <= F.col("train_end"), "train").when(F.col("date") <= F.col("validation_end"), "validation").otherwise("test")
    return frame.join(b, "commodity").withColumn("split", label).drop("train_end", "validation_end")


def metrics(predictions: DataFrame, by: list[str], actual: str = "modal_price", predicted: str = "predicted_price",
            previous: str = "lag_1") -> DataFrame:
    """Ten metrics per group over the rows where actual, predicted and previous price are all finite."""
    y, p, v = F.col(actual), F.col(predicted), F.col(previous)
    x = predictions.where(finite(y) & finite(p) & finite(v)).withColumn("__abs", F.abs(p - y))
    a = F.col("__abs")
    n, total = F.count(F.lit(1)), F.abs(y) + F.abs(p)
    sst = n * F.var_pop(y)
    out = x.groupBy(*by).agg(
        n.alias("n"), F.avg(a).alias("mae"), F.avg(a * a).alias("mse"), F.sqrt(F.avg(a * a)).alias("rmse"),
        F.when(n >= 2, 1 - F.try_divide(F.sum(a * a), sst)).alias("r2"),
        (100 * F.avg(F.try_divide(a, F.abs(y)))).alias("mape_pct"), (100 * F.avg(F.try_divide(2 * a, total))).alias("smape_pct"),
        (100 * F.try_divide(F.sum(a), F.sum(F.abs(y)))).alias("wape_pct"), F.avg(p - y).alias("mean_bias_error"),
        (100 * F.avg((F.signum(y - v) == F.signum(p - v)).cast("int"))).alias("directional_accuracy_pct"))
    return join_on(out, exact_quantiles(x, by, "__abs", {"median_absolute_error": 0.5}), by, "left").select(*by, "n", *METRICS)


def prediction_rows(df: DataFrame, model: str, predicted: Column) -> DataFrame:
    keep = ["date", "commodity", "market_id", "market", "district", "state", "modal_price", "lag_1"]
    x = df.select(*keep, F.lit(model).alias("model"), predicted.cast("double").alias("predicted_price"))
    return x.withColumn("residual", F.col("predicted_price") - F.col("modal_price"))


def baseline_predictions(df: DataFrame) -> DataFrame:
    """Both baselines in long form from one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).alias("p")) for m, c in BASELINES.items()]))
    x = df.withColumn("__e", each)
    return x.select(
        "date", "commodity", "market_id", "market", "district", "state", "modal_price", "lag_1", F.col("__e.m").alias("model"),
        F.col("__e.p").alias("predicted_price"), (F.col("__e.p") - F.col("modal_price")).alias("residual"))


@dataclass(frozen=True)
class ModelSizes:
    forest_trees: int = 200
    boosting_rounds: int = 150


def fit_ridge(train: DataFrame, alpha: float = RIDGE_ALPHA) -> linear.RidgeModel:
    """Scaled features and one column per market; an unseen market has none."""
    return linear.fit_ridge(train, NUMERIC_FEATURES, "market_id", "modal_price", alpha)


Fitted = linear.RidgeModel | trees.TreeModel
MODELS = (RIDGE, TREE, FOREST, BOOSTING)


def fit_parts(frame: DataFrame, part: str, fits: int, names: list[str] | None = None, sizes: ModelSizes = ModelSizes()) -> list[dict[str, Fitted]]:
    """Models of each fit; fit ``k`` learns from the rows whose ``part`` is at most ``k``. All tree models share one quantised table, and
    the models are fitted side by side."""
    names = [n for n in MODELS if n in (names or MODELS)]
    table = trees.packed(frame, NUMERIC_FEATURES, "market_id", "modal_price", part, [*SERIES, "date"], fits) if set(names) - {RIDGE} else None
    how = {
        RIDGE: lambda: [fit_ridge(frame.where(F.col(part) <= k)) for k in range(fits)],
        TREE: lambda: trees.single(table, RULES[TREE]),
        FOREST: lambda: trees.forest(table, RULES[FOREST], sizes.forest_trees, SEED),
        BOOSTING: lambda: trees.boosted(table, RULES[BOOSTING], sizes.boosting_rounds, BOOSTING_RATE),
    }
    with ThreadPoolExecutor(max(1, len(names))) as pool:
        running = {n: pool.submit(inheritable_thread_target(frame.sparkSession)(how[n])) for n in names}
        fitted = {n: r.result() for n, r in running.items()}
    return [{n: models[k] for n, models in fitted.items()} for k in range(fits)]


def fit(train: DataFrame, names: list[str] | None = None, sizes: ModelSizes = ModelSizes()) -> dict[str, Fitted]:
    return fit_parts(train.withColumn("__part", F.lit(0)), "__part", 1, names, sizes)[0]


def evaluate(partition: DataFrame, fitted: dict[str, Fitted]) -> tuple[DataFrame, DataFrame]:
    """(metrics, long predictions) of the baselines and all fitted models on the same rows."""
    long = baseline_predictions(partition)
    for name, model in fitted.items():
        long = long.unionByName(prediction_rows(model.transform(partition), name, F.col("prediction")))
    return metrics(long, ["model"]), long


@dataclass(frozen=True)
class TrainingResult:
    selected: str
    comparison: DataFrame
    validation: DataFrame
    predictions: DataFrame
    latest: DataFrame
    model: Fitted | None


def select_model(validation: DataFrame) -> str:
    """Lowest validation MAE, then RMSE, then name: one row to the driver."""
    return validation.orderBy("mae", "rmse", "model").first()["model"]


def train_and_compare(df: DataFrame, commodity: str | None = None, min_market_observations: int = 120,
                      sizes: ModelSizes = ModelSizes(), names: list[str] | None = None) -> TrainingResult:
    """Fit on train and on train with validation, select on validation, compare the second fit on test, forecast the next report."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    frame = cut_lineage(temporal_split(build_features(df, commodity, min_market_observations)).withColumn("__part", order))
    part = {s: frame.where(F.col("split") == s) for s in ("validation", "test")}
    first, final = fit_parts(frame, "__part", 2, names, sizes)
    val_metrics = cut_lineage(evaluate(part["validation"], first)[0])
    chosen = select_model(val_metrics)
    test_rows = cut_lineage(evaluate(part["test"], final)[1])
    test_metrics = metrics(test_rows, ["model"])
    comparison = compare_models(test_metrics, val_metrics, chosen)
    latest = forecast_latest(df, chosen, final.get(chosen), commodity, min_market_observations)
    return TrainingResult(chosen, comparison, val_metrics, test_rows, latest, final.get(chosen))


def compare_models(test: DataFrame, validation: DataFrame, chosen: str) -> DataFrame:
    """Test metrics beside validation MAE/RMSE, the selected flag and the MAE improvement over persistence."""
    v = validation.select("model", F.col("mae").alias("validation_mae"), F.col("rmse").alias("validation_rmse"))
    base = test.where(F.col("model") == PERSISTENCE).agg(F.max("mae")).scalar()
    return test.join(v, "model", "left").withColumns({
        "selected_on_validation": F.col("model") == chosen,
        "mae_improvement_vs_persistence_pct": 100 * F.try_divide(base - F.col("mae"), base)})


def latest_features(df: DataFrame, commodity: str | None = None, min_market_observations: int = 14) -> DataFrame:
    """Feature row that includes each market's newest report."""
    x = validate_panel(df, commodity)
    part = Window.partitionBy(*SERIES)
    order = part.orderBy("date")
    x = x.withColumns(_feature_columns(F.col("modal_price"), order, 0)).withColumns(_changes())
    x = x.withColumns({"__n": F.count(F.lit(1)).over(part), "__last": F.max("date").over(part)})
    return x.where((F.col("date") == F.col("__last")) & (F.col("__n") >= max(14, min_market_observations))).drop("__n", "__last")


def forecast_latest(df: DataFrame, model_name: str, model: Fitted | None = None, commodity: str | None = None,
                    min_market_observations: int = 120) -> DataFrame:
    """One forecast per eligible market, all markets in a single pass."""
    x = latest_features(df, commodity, min_market_observations)
    if model_name in BASELINES:
        x = x.withColumn("prediction", F.col(BASELINES[model_name]))
    elif model is not None:
        x = model.transform(x)
    else:
        raise ValueError("a fitted model is required for " + model_name)
    through = validate_panel(df, commodity).agg(F.max("date")).scalar()
    return x.select("commodity", "market_id", "market", "district", "state", F.col("date").alias("last_observed_date"),
                    F.col("modal_price").alias("last_observed_price"), F.col("prediction").alias("predicted_next_report_price"),
                    F.lit(model_name).alias("model"), F.lit(HORIZON).alias("forecast_horizon"), through.alias("historical_data_through"))


def dataset_manifest(df: DataFrame) -> DataFrame:
    """One row describing the training input."""
    def labels(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    return df.agg(
        labels("source").alias("source"), labels("source_tier").alias("source_tier"), labels("data_mode").alias("data_mode"),
        F.array_sort(F.collect_set("state")).alias("states"), F.array_sort(F.collect_set("district")).alias("districts"),
        F.countDistinct("market_id").alias("market_count"), F.count(F.lit(1)).alias("processed_rows"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.count_if(F.col("modal_price").isNull()).alias("missing_modal_price_rows"))


def save_artifacts(result: TrainingResult, df: DataFrame, folder: str) -> None:
    """Comparison, validation, predictions, latest forecasts, manifest and, for a fitted model, the model itself."""
    for name, table in (("model_comparison", result.comparison), ("validation_metrics", result.validation),
                        ("test_predictions", result.predictions), ("latest_forecasts", result.latest), ("dataset_manifest", dataset_manifest(df))):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    kind = "none" if result.model is None else "trees" if isinstance(result.model, trees.TreeModel) else "ridge"
    df.sparkSession.createDataFrame([(kind, result.selected)], "kind string, model string").write.mode("overwrite").parquet(f"{folder}/model_kind")
    if result.model is not None:
        result.model.save(df.sparkSession, f"{folder}/model")


def serve_forecasts(spark, folder: str, market_ids: list[str] | None = None) -> DataFrame:
    """Saved forecasts, optionally of some markets; the predicate reaches the Parquet scan."""
    x = spark.read.parquet(f"{folder}/latest_forecasts")
    return x.where(F.col("market_id").isin(market_ids)) if market_ids else x


def load_model(spark: SparkSession, folder: str) -> Fitted | None:
    """The saved model; None where a baseline was selected."""
    kind = spark.read.parquet(f"{folder}/model_kind").first()["kind"]
    if kind == "none":
        return None
    return (trees.TreeModel if kind == "trees" else linear.RidgeModel).load(spark, f"{folder}/model")
