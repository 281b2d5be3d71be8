"""Coverage, quality, dispersion and selection reports over a market-day panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import median
from ..functions.ranks import exact_quantiles
from ..functions.text import canonical_state, split_tiers
from ..spec import SelectionPolicy


def _span_days() -> Column:
    return F.datediff("last_date", "first_date") + 1


def coverage_audit(df: DataFrame) -> DataFrame:
    out = df.groupBy("state", "commodity").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("market_id").alias("markets"),
        F.countDistinct("date").alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("arrivals").alias("__with_q"))
    possible = F.greatest(_span_days(), F.lit(1)) * F.greatest(F.col("markets"), F.lit(1))
    return out.select(
        "state", "commodity", "observations", "markets", "active_days", "first_date", "last_date",
        F.least(F.lit(1.0), F.col("observations") / possible).alias("reporting_density"),
        (F.col("__with_q") / F.col("observations")).alias("arrival_availability"))


def commodity_coverage_score(audit: DataFrame) -> DataFrame:
    c = audit.groupBy("commodity").agg(
        F.countDistinct("state").alias("states"), F.sum("markets").alias("markets"), F.sum("observations").alias("observations"),
        F.avg("reporting_density").alias("density"), F.avg("arrival_availability").alias("arrival_availability"))
    # maxima as one-row scalar subqueries: no window over the whole table, no join
    top = {x: c.agg(F.max(x)).scalar() for x in ("states", "markets", "observations")}

    def share(x: str) -> Column:
        return F.coalesce(F.try_divide(F.col(x).cast("double"), top[x].cast("double")), F.lit(0.0))

    score = (0.35 * share("states") + 0.20 * share("markets") + 0.20 * share("observations")
             + 0.15 * F.col("density") + 0.10 * F.col("arrival_availability"))
    return c.withColumn("coverage_score", score)


def price_dispersion(df: DataFrame) -> DataFrame:
    """Spread of prices over markets per date and commodity; fewer than two markets give NULL statistics.

    A group has one row per market. The deviation from the median joins back on (date, commodity).
    """
    one = df.groupBy("date", "commodity", "market_id").agg(F.min("modal_price").alias("price"))
    qs = F.percentile("price", F.array(*[F.lit(q) for q in (0.10, 0.25, 0.5, 0.75, 0.90)]))
    stats = one.groupBy("date", "commodity").agg(
        F.count("price").alias("markets"), qs.alias("q"), F.stddev_samp("price").alias("sd"), F.avg("price").alias("mean"))
    dev = one.join(stats.select("date", "commodity", F.col("q")[2].alias("med")), ["date", "commodity"]).groupBy("date", "commodity").agg(
        median(F.abs(F.col("price") - F.col("med"))).alias("mad"))
    many = F.col("markets") >= 2
    med = F.col("q")[2]
    return stats.join(dev, ["date", "commodity"], "left").select(
        "date", "commodity", "markets", med.alias("median_price"),
        F.when(many, F.col("q")[3] - F.col("q")[1]).alias("iqr"), F.when(many, F.col("mad")).alias("mad"),
        F.when(many, F.try_divide(F.col("sd"), F.col("mean"))).alias("cv"),
        F.when(many, F.try_divide(F.col("q")[4] - F.col("q")[0], med)).alias("relative_gap"))


def bad_price_order() -> Column:
    return F.coalesce((F.col("min_price") > F.col("modal_price")) | (F.col("modal_price") > F.col("max_price")), F.lit(False))


def duplicates_beyond_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def tier_set(df: DataFrame) -> DataFrame:
    """One row: sorted distinct tiers of the whole table. Labels are grouped before they are split."""
    labels = df.groupBy("source_tier").agg(F.lit(1).alias("one"))
    return labels.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(split_tiers(F.col("source_tier")))))).alias("tiers"))


def quality_summary(df: DataFrame) -> DataFrame:
    keys = [c for c in ("date", "market", "commodity", "variety", "grade") if c in df.columns]
    n = F.count(F.lit(1))
    out = df.agg(
        n.alias("rows"), F.countDistinct("state").alias("states"), F.countDistinct("market_id").alias("markets"),
        F.countDistinct("commodity").alias("commodities"),
        F.round(F.coalesce(F.try_divide((n - F.count("arrivals")) * 100.0, n), F.lit(0.0)), 2).alias("missing_arrivals_pct"),
        F.count_if(bad_price_order()).alias("invalid_price_order_rows"))
    return out.withColumns({
        "duplicate_key_rows": duplicates_beyond_first(df, keys).scalar(),
        "source_tiers": F.array_join(tier_set(df).scalar(), ",")})


def state_coverage_report(df: DataFrame) -> DataFrame:
    out = df.groupBy("state", "commodity").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("market_id").alias("markets"),
        F.countDistinct("district").alias("districts"), F.countDistinct("date").alias("active_days"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.count("arrivals") / F.count(F.lit(1))).alias("arrival_coverage"))
    return out.withColumn("reporting_density", F.col("observations") / (_span_days() * F.greatest(F.col("markets"), F.lit(1))))


def market_coverage_report(df: DataFrame) -> DataFrame:
    return df.groupBy("state", "district", "market", "market_id").agg(
        F.count(F.lit(1)).alias("observations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.count("arrivals") / F.count(F.lit(1))).alias("arrival_coverage"))


def month_label(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def monthly_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(month_label("date").alias("month"), "commodity").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("market_id").alias("markets"))


def missingness(df: DataFrame, fields: tuple[str, ...] = ("min_price", "modal_price", "max_price", "arrivals", "arrival_unit")) -> DataFrame:
    n = F.count(F.lit(1))
    one = df.agg(n.alias("n"), *[(n - F.count(f)).alias(f) for f in fields])
    return one.unpivot("n", list(fields), "field", "missing_rows").select(
        "field", "missing_rows", F.round(F.col("missing_rows") * 100.0 / F.col("n"), 4).alias("missing_pct"))


def _quality_metrics(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    n = F.count(F.lit(1))
    one = df.agg(n.alias("rows"), (n - F.count("modal_price")).alias("missing_modal_price"),
                 (n - F.count("arrivals")).alias("missing_arrivals"), F.count_if(bad_price_order()).alias("invalid_price_order"))
    one = one.withColumn("duplicate_keys", duplicates_beyond_first(df, keys).scalar())
    return one.unpivot([], one.columns, "metric", name)


def quality_before_after(raw: DataFrame, processed: DataFrame, raw_keys: list[str], processed_keys: list[str]) -> DataFrame:
    return _quality_metrics(raw, raw_keys, "raw").join(_quality_metrics(processed, processed_keys, "processed"), "metric")


def dataset_statistics(raw: DataFrame, panel: DataFrame, markets: DataFrame, raw_files: int | None = None) -> DataFrame:
    """(metric, value) with every value as text."""
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    one = panel.agg(
        F.count(F.lit(1)).alias("processed_market_day_rows"), F.countDistinct("state").alias("states"),
        F.countDistinct("district").alias("districts"), F.countDistinct("market_id").alias("markets"),
        F.countDistinct("commodity").alias("commodities"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.round(F.count("arrivals") / F.count(F.lit(1)), 6).alias("arrival_coverage"))
    one = one.withColumns({
        "raw_rows": raw.agg(F.count(F.lit(1))).scalar(),
        "coordinate_coverage": markets.agg(F.round(F.avg(has.cast("int")), 6)).scalar()})
    if raw_files is not None:
        one = one.withColumn("raw_checkpoint_files", F.lit(raw_files))
    one = one.select(*[F.col(c).cast("string").alias(c) for c in one.columns])
    return one.unpivot([], one.columns, "metric", "value")


def price_trend(df: DataFrame) -> DataFrame:
    """Median price by commodity and date; the group is one day's markets."""
    return df.groupBy("commodity", "date").agg(median(F.col("modal_price")).alias("modal_price"))


def state_map_frame(df: DataFrame, markets: DataFrame | None = None) -> DataFrame:
    """Median price, markets and rows by canonical state; with markets, joins each state's mean coordinates.

    A state may hold any share of the panel, so its median is taken by bucketed selection.
    """
    x = df.withColumn("state", canonical_state(F.col("state")))
    med = exact_quantiles(x, ["commodity", "state"], "modal_price", {"modal_price": 0.5})
    out = x.groupBy("commodity", "state").agg(F.countDistinct("market_id").alias("markets"), F.count(F.lit(1)).alias("observations"))
    out = out.join(med, ["commodity", "state"], "left")
    if markets is None:
        return out
    xy = markets.groupBy(canonical_state(F.col("state")).alias("state")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return out.join(xy, "state", "left").where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def density_pivot(audit: DataFrame, commodities: list[str] | None = None) -> DataFrame:
    """State by commodity matrix of mean reporting density, of all commodities without a list; a list spares the distinct-value job."""
    return audit.groupBy("state").pivot("commodity", commodities).agg(F.avg("reporting_density"))


def kpis(df: DataFrame) -> DataFrame:
    """One row: observations, markets, median price, first and last date of any scope."""
    med = exact_quantiles(df, [], "modal_price", {"median_price": 0.5})
    return df.agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("market_id").alias("markets"),
                  F.min("date").alias("date_min"), F.max("date").alias("date_max")).withColumn("median_price", med.scalar())


def data_mode(df: DataFrame) -> DataFrame:
    """One row: DEMO when every observation is a demo row, otherwise REAL."""
    m = F.upper(F.coalesce(F.col("data_mode"), F.lit("")))
    return df.agg(F.when(F.coalesce(F.bool_and(m == "DEMO"), F.lit(False)), "DEMO").otherwise("REAL").alias("data_mode"))


def panel_status(panel: DataFrame, markets: DataFrame | None = None, weather: DataFrame | None = None) -> DataFrame:
    """One row describing the data in place."""
    out = panel.agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("state").alias("states"), F.countDistinct("market_id").alias("markets"),
        F.countDistinct("commodity").alias("commodities"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    extra = {"data_mode": data_mode(panel).scalar(), "source_tiers": F.array_join(tier_set(panel).scalar(), ",")}
    if markets is not None:
        has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        extra["coordinate_coverage"] = markets.agg(F.round(F.coalesce(F.avg(has.cast("int")), F.lit(0.0)), 6)).scalar()
    if weather is not None:
        extra["weather_rows"] = weather.agg(F.count(F.lit(1))).scalar()
        extra["weather_markets"] = weather.agg(F.countDistinct("market_id")).scalar()
    return out.withColumns(extra)


def commodity_scope_table(df: DataFrame, policy: SelectionPolicy = SelectionPolicy()) -> DataFrame:
    """Coverage components, score, eligibility and the top recommendations per commodity."""
    per_state = df.groupBy("commodity", "state").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("market_id").alias("markets"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("arrivals").alias("with_q"))
    possible = F.greatest(_span_days(), F.lit(1)) * F.greatest(F.col("markets"), F.lit(1))
    per_state = per_state.withColumn("density", F.least(F.lit(1.0), F.col("observations") / possible))
    total_states = df.agg(F.greatest(F.countDistinct("state"), F.lit(1))).scalar()
    c = per_state.groupBy("commodity").agg(
        F.countDistinct("state").alias("states"), F.sum("markets").alias("markets"), F.sum("observations").alias("observations"),
        (F.datediff(F.max("last_date"), F.min("first_date")) + 1).alias("span_days"),
        median(F.col("density")).alias("median_state_density"), (F.sum("with_q") / F.sum("observations")).alias("arrival_availability"))
    c = c.withColumn("state_coverage_ratio", F.col("states") / total_states)
    top_m = c.agg(F.greatest(F.log1p(F.max("markets")), F.lit(1.0))).scalar()
    top_o = c.agg(F.greatest(F.log1p(F.max("observations")), F.lit(1.0))).scalar()

    def unit(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    score = (0.30 * unit(F.col("state_coverage_ratio")) + 0.18 * F.log1p("markets") / top_m + 0.16 * F.log1p("observations") / top_o
             + 0.12 * F.least(F.lit(1.0), F.col("span_days") / max(policy.min_span_days * 3, 1))
             + 0.14 * unit(F.col("median_state_density")) + 0.10 * unit(F.col("arrival_availability")))
    eligible = ((F.col("states") >= policy.min_states) & (F.col("markets") >= policy.min_markets)
                & (F.col("observations") >= policy.min_observations)
                & (F.col("median_state_density") >= policy.min_median_state_density)
                & (F.col("arrival_availability") >= policy.min_arrival_availability)
                & (F.col("span_days") >= policy.min_span_days))
    c = c.withColumn("coverage_score", score).withColumn("eligible", eligible)
    ranked = c.where("eligible").orderBy(
        F.desc("coverage_score"), F.desc("states"), F.desc("observations"), "commodity").limit(policy.target_count)
    picks = ranked.select("commodity", F.lit(True).alias("recommended"))
    return c.join(picks, "commodity", "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))


def recommended_commodities(table: DataFrame) -> DataFrame:
    return table.where("recommended")


def scope_choice(df: DataFrame, explicit: list[str], policy: SelectionPolicy = SelectionPolicy()) -> DataFrame:
    """Explicit names with a found/missing status, or the recommended set when none are given."""
    if not explicit:
        return recommended_commodities(commodity_scope_table(df, policy)).select("commodity", F.lit("recommended").alias("status"))
    asked = df.sparkSession.createDataFrame([(x,) for x in explicit], "commodity STRING")
    have = df.select(F.col("commodity"), F.lit(True).alias("have")).distinct()
    return asked.join(have, "commodity", "left").select(
        "commodity", F.when(F.col("have"), "found").otherwise("missing").alias("status"))


def market_options(df: DataFrame) -> DataFrame:
    """Distinct markets in display order."""
    one = df.groupBy("market_id").agg(F.min(F.struct("state", "district", "market")).alias("m")).select("market_id", "m.*")
    return one.orderBy("state", "district", "market")


def busiest_market(df: DataFrame) -> DataFrame:
    return df.groupBy("market_id").agg(F.count(F.lit(1)).alias("observations")).orderBy(F.desc("observations"), "market_id").limit(1)


def seeded_sample(df: DataFrame, keys: list[str], n: int = 2500, seed: int = 24) -> DataFrame:
    """At most ``n`` rows, the same ones on every run: the smallest seeded key hashes (a top-k, not a full sort)."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), *keys)).orderBy("__h", *keys).limit(n).drop("__h")
