"""Weather, events, planning, readiness, snapshots, sources, streaming and forecasting."""

import datetime as dt
import glob
import os

import numpy as np
import pandas as pd
import pytest
from conftest import walk_panel
from pyspark.sql import functions as F

from pricelattice.operators import events as ev, forecast as fc, panel as pan, planning as pl, readiness as rd, weather as we
from pricelattice.operators.normalize import normalize_prices
from pricelattice.plans import batch
from pricelattice.sources import envelopes as en, imports as im, readers, sinks, versions
from pricelattice.spec import EventPolicy, LeadLagPolicy, MARKETS_SCHEMA, RAW_SCHEMA, ReadinessPolicy, WEATHER_SCHEMA
from pricelattice.streaming.ingest import ingest_folder

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def series(spark, rows):
    return spark.createDataFrame(rows, "date date, state string, market string, market_id string, commodity string, modal_price double, arrivals double")


def test_crunch_day_is_found(spark):
    prices = {33: 3900.0}
    supply = {33: 2.5}
    x = series(spark, [(day(i), "S", "M", "m", "Wheat", prices.get(i, 1200.0 + 3 * (i % 11)), supply.get(i, 60.0 + 2 * (i % 7))) for i in range(55)])
    assert ev.market_crunches(x).orderBy(F.desc("crunch_severity")).first().date == day(33)


def test_robust_z_of_all_missing_and_constant(spark):
    x = series(spark, [(day(i), "S", "M", "m", "Onion", 100.0, None) for i in range(4)])
    assert ev.market_crunches(x, 1.0, -1.0).count() == 0
    w = spark.createDataFrame([(day(i), "m", 3.0) for i in range(4)] + [(day(5), "m", None)], "date date, market_id string, rainfall_mm double")
    assert {r.rainfall_anomaly_z for r in we.weather_anomalies(w).collect()} == {0.0}


def test_adjacent_extremes_are_one_event(spark):
    x = series(spark, [(day(i), "S", "M", "m", "Onion", 100.0 + i, 100.0) for i in range(30)]).withColumn(
        "rainfall_anomaly_z", F.when(F.dayofmonth("date").isin(11, 12, 13), 3.0).otherwise(0.0))
    got = we.event_study(x, policy=EventPolicy(horizons=(1,))).collect()
    assert len(got) == 1 and got[0].event_date == day(10) and got[0].baseline_date == day(9) and got[0].response_date == day(11)
    assert got[0].price_change_pct == pytest.approx((111 / 109 - 1) * 100)


def test_response_waits_for_the_first_report_within_tolerance(spark):
    keep = [0, 1, 2, 5, 9]
    x = series(spark, [(day(i), "S", "M", "m", "Onion", 100.0 + i, None) for i in keep]).withColumn(
        "rainfall_anomaly_z", F.when(F.col("date") == F.lit(day(1)), -4.0).otherwise(0.0))
    got = {r.horizon_days: str(r.response_date) for r in we.event_study(x, policy=EventPolicy(horizons=(1, 2, 5))).collect()}
    assert got == {1: "2024-01-03", 2: "2024-01-06"}


def test_weather_join_falls_back_to_names(spark, small_panel):
    w = spark.createDataFrame([(day(i), m, "elsewhere", 50.0 if i == 40 else 2.0 + i % 5, 25.0 + i % 7) for m in "ABC" for i in range(80)],
                              "date date, market string, state string, rainfall_mm double, temperature_c double")
    j = we.join_market_weather(small_panel, w)
    assert j.count() == 240 and j.where("rainfall_mm is null or rainfall_anomaly_z is null").count() == 0


def test_power_cells_and_cell_weather(spark):
    m = spark.createDataFrame([("a", 20.11, 74.10), ("b", 20.14, 74.12)], "market_id string, lat double, lon double")
    assert we.market_cells(m).select("power_cell_lat", "power_cell_lon").distinct().count() == 1
    chunks = spark.createDataFrame([(day(0), 20.0, 74.375, 1.0, "f1"), (day(0), 20.0, 74.375, 2.0, "f2")],
                                   "date date, power_cell_lat double, power_cell_lon double, rainfall_mm double, chunk string")
    assert {(r.market_id, r.rainfall_mm) for r in we.rebuild_weather(m, chunks, ["chunk"]).collect()} <= {("a", 2.0), ("b", 2.0)}


def test_ripple_uses_calendar_days(spark):
    x = series(spark, [(day(i), "S", m, m, "Onion", p * 1.1 ** (i % 2), None) for m, p in (("a", 100.0), ("b", 50.0)) for i in range(10)])
    edges = spark.createDataFrame([("Onion", "a", "b", "A", "B", 2, .5, .01)], "commodity string, leader_id string, follower_id string, leader string, follower string, lag_days int, corr double, q_value double")
    events = spark.createDataFrame([("Onion", "a", day(3))], "commodity string, leader_id string, event_date date")
    r = ev.ripple(x, edges, events, 3).first()
    assert r.response_date == day(5) and r.follower_response_pct == pytest.approx(10.0) and r.leader_shock_pct == pytest.approx(10.0)
    assert ev.ripple(x, edges, events, 1).count() == 0


def test_year_windows_and_inverted_range(spark):
    x = spark.createDataFrame([("2023-12-30", "2025-01-02")], "a string, b string")
    assert [(str(r[0]), str(r[1])) for r in pl.year_windows(x, "a", "b").collect()] == [
        ("2023-12-30", "2023-12-31"), ("2024-01-01", "2024-12-31"), ("2025-01-01", "2025-01-02")]
    with pytest.raises(Exception, match="end_date"):
        pl.year_windows(spark.createDataFrame([("2024-01-02", "2024-01-01")], "a string, b string"), "a", "b").collect()


def test_resume_counts(spark):
    jobs = spark.createDataFrame([("j1",), ("j2",)], "job_key string")
    none = spark.createDataFrame([], "job_key string, status string")
    first = spark.createDataFrame([("j1", "fetched", 1), ("j2", "empty", 0)], "job_key string, status string, row_count int")
    assert pl.run_counters(jobs, none, first).first().asDict() == dict(planned=2, fetched=2, cached=0, empty=1, failed=0, rows=1)
    pending = pl.pending_jobs(jobs, first)
    assert pending.count() == 0 and pl.pending_jobs(jobs, first, force=True).count() == 2
    assert pl.run_counters(jobs, first, first.limit(0)).first().cached == 2


def readiness_inputs(spark, mode="REAL", tier="PRIMARY_OFFICIAL"):
    raw = spark.createDataFrame(walk_panel(120, mode=mode), RAW_SCHEMA).withColumn("source_tier", F.lit(tier))
    p = pan.aggregate_market_daily(normalize_prices(raw))
    ids = p.select("market_id", "state", "district", "market").distinct()
    m = ids.withColumns({"lat": F.lit(20.0), "lon": F.lit(75.0), "coordinate_quality": F.lit("reviewed"), "coordinate_source": F.lit("x")})
    w = p.select("date", "market_id", "state", "district", "market", *[F.lit(1.0 * i).alias(c) for i, c in enumerate(
        ["lat", "lon", "power_cell_lat", "power_cell_lon", "rainfall_mm", "temperature_c", "temperature_max_c", "temperature_min_c"])],
        F.lit("NASA_POWER").alias("source"), F.lit("REAL").alias("data_mode"))
    return p, m.select(*[c.split()[0] for c in MARKETS_SCHEMA.split(", ")]), w.select(*[c.split()[0] for c in WEATHER_SCHEMA.split(", ")])


POLICY = ReadinessPolicy(min_span_days=100, min_states=2, min_markets=3, min_observations=300)
SCOPE = (["Onion"], "2024-01-01", "2024-12-31")


def test_readiness_gates(spark):
    p, m, w = readiness_inputs(spark)
    gates = rd.readiness_gates(rd.readiness_summary(p, m, w, *SCOPE), POLICY)
    assert gates.count() == 11 and rd.readiness_status(gates).first().readiness == "READY"
    p2, _, _ = readiness_inputs(spark, tier="USER_SUPPLIED")
    st = rd.readiness_status(rd.readiness_gates(rd.readiness_summary(p2, None, None, *SCOPE), POLICY)).first()
    assert st.readiness == "BLOCKED" and "paper_acceptable_source_tier" in st.failed_gates
    empty = rd.readiness_summary(p, m, w, ["Nothing"], "2024-01-01", "2024-01-02").first()
    assert (empty.observations, empty.span_days, empty.weather_market_coverage) == (0, 0, 0.0)


def test_snapshot_verify_tamper_and_analysis(spark, folder):
    p, m, w = readiness_inputs(spark)
    target = f"{folder}/snap"
    sinks.freeze_scope(spark, p, m, w, *SCOPE, target, POLICY)
    check = sinks.verify_snapshot(spark, target)
    assert sinks.snapshot_ok(check) and check.count() > 4
    with pytest.raises(FileExistsError):
        sinks.freeze_scope(spark, p, m, w, *SCOPE, target, POLICY)
    summary = batch.analyze_snapshot(spark, target, LeadLagPolicy(3, 30, 0.0, 1.0)).first()
    assert summary.observations == 360 and summary.lead_lag_edges == 3 and summary.evaluable_years == 1
    assert {"lead_lag", "influence", "edge_stability", "distance_summary", "run_summary"} <= set(os.listdir(f"{target}/results"))
    part = glob.glob(f"{target}/data/readiness/*.json")[0]
    with open(part, "a") as fh:
        fh.write("\n")
    # a local disk refuses the file by its sidecar checksum; without the sidecar our own hash must notice
    assert not sinks.snapshot_ok(sinks.verify_snapshot(spark, target))
    os.remove(os.path.join(os.path.dirname(part), "." + os.path.basename(part) + ".crc"))
    bad = {r.status for r in sinks.verify_snapshot(spark, target).collect()}
    assert "mismatch" in bad
    with pytest.raises(ValueError, match="mismatch"):
        batch.analyze_snapshot(spark, target)


def test_demo_scope_is_refused(spark, folder):
    p, m, w = readiness_inputs(spark, "DEMO", "DEMO")
    with pytest.raises(ValueError, match="real_data_only"):
        sinks.freeze_scope(spark, p, m, w, *SCOPE, f"{folder}/snap", POLICY)


def test_panel_upsert_touches_only_its_partitions(spark, folder, small_panel):
    path = f"{folder}/panel"
    sinks.upsert_panel(spark, small_panel, path)
    first = versions.current(spark, path)[1]
    newer = small_panel.where("market = 'A'").withColumn("modal_price", F.lit(7.0))
    out = sinks.upsert_panel(spark, newer, path)
    assert out.count() == 240 and out.where("modal_price = 7.0").count() == 80
    other = small_panel.where("market = 'B'").withColumn("commodity", F.lit("Tomato = 1/2"))
    assert sinks.upsert_panel(spark, other, path).count() == 320
    number, manifest = versions.current(spark, path)
    assert number == 3 and set(manifest) == {("Onion", 2024), ("Tomato = 1/2", 2024)} and first.items().isdisjoint(manifest.items())
    unknown = small_panel.where("market = 'C'").withColumns({"commodity": F.lit(None).cast("string"), "date": F.add_months("date", 12)})
    merged = sinks.upsert_panel(spark, unknown, path)
    assert merged.count() == 400 and merged.where("commodity is null").count() == 80 and sorted(merged.columns) == sorted(small_panel.columns)
    assert readers.load_panel(spark, path).count() == 400 and sinks.upsert_panel(spark, small_panel.limit(0), path).count() == 400
    assert versions.vacuum(spark, path) == 1 and readers.load_panel(spark, path).count() == 400


def test_upsert_scans_the_touched_pairs_only(spark, folder, small_panel):
    path = f"{folder}/panel"
    many = small_panel.unionByName(small_panel.withColumn("commodity", F.lit("Tomato"))).unionByName(small_panel.withColumn("date", F.add_months("date", 24)))
    sinks.upsert_panel(spark, many, path)
    old = versions.read(spark, path, [("Tomato", 2024)])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        scan = next(x for x in old._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "2024=Tomato" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")] and old.count() == 240
    assert versions.read(spark, path, [("Potato", 2024)]) is None


def test_killed_upsert_leaves_the_old_panel(spark, folder, small_panel, monkeypatch):
    path = f"{folder}/panel"
    sinks.upsert_panel(spark, small_panel, path)
    before = sorted(map(tuple, readers.load_panel(spark, path).select("date", "market_id", "modal_price").collect()))

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            sinks.upsert_panel(spark, small_panel.withColumn("modal_price", F.lit(9.0)), path)
    assert sorted(map(tuple, readers.load_panel(spark, path).select("date", "market_id", "modal_price").collect())) == before
    assert sinks.upsert_panel(spark, small_panel.withColumn("modal_price", F.lit(9.0)), path).where("modal_price = 9.0").count() == 240
    number, manifest = versions.current(spark, path)
    with pytest.raises(RuntimeError, match="another run"):
        versions.publish(spark, path, number, manifest)


def test_streamed_files_merge_once(spark, folder):
    rows = walk_panel(5)
    land = f"{folder}/landing"
    spark.createDataFrame(rows, RAW_SCHEMA).coalesce(1).write.option("header", True).csv(land)
    q = ingest_folder(spark, land, f"{folder}/panel", f"{folder}/ckpt")
    q.awaitTermination()
    ingest_folder(spark, land, f"{folder}/panel", f"{folder}/ckpt").awaitTermination()
    assert readers.load_panel(spark, f"{folder}/panel").count() == 15


def test_side_tables_never_mix_modes(spark, folder, small_panel):
    demo, real = {k: f"{folder}/demo_{k}" for k in ("markets", "weather")}, {k: f"{folder}/real_{k}" for k in ("markets", "weather")}
    _, m, w = readiness_inputs(spark)
    m.write.parquet(demo["markets"])
    w.write.parquet(demo["weather"])
    assert readers.side_tables(spark, small_panel, real, demo)["markets"].count() == 3
    real_panel = small_panel.withColumn("data_mode", F.lit("REAL"))
    got = readers.side_tables(spark, real_panel, real, demo)
    assert got["markets"].count() == 0 and got["weather"].columns == w.columns


def test_envelopes(spark):
    x = spark.createDataFrame([(1, '{"output":{"type":"success","data":[{"k":1},{"k":2}]}}'), (2, '{"data":[{"k":3}]}'),
                               (3, '{"output":{"type":"error","message":"no"}}'), (4, "[1]"), (5, '{"output":{"data":null}}')], "id int, t string")
    rows, rejects = en.unwrap(x, "t", "k int", ["id"])
    assert sorted(r.k for r in rows.collect()) == [1, 2, 3]
    assert {r.id: r.reason.split(":")[0] for r in rejects.collect()} == {3: "source error", 4: "payload is not a JSON object"}


def test_portal_headings_and_routes(spark):
    raw = spark.createDataFrame([("2024-01-01", "10", "12", "11", "5"), ("2024-01-02", "10", "12", "13", "")],
                                "`Reported Date` string, `Min Price (Rs/q)` string, `Max Price (Rs/q)` string, `Modal Price (Rs/q)` string, `Arrival Qty` string")
    got = im.import_export(raw, None, "curated_portal", state="Maharashtra", market="Pune", commodity="Onion").orderBy("date").collect()
    assert [(r.modal_price, r.arrivals, r.min_price, r.source_tier) for r in got] == [
        (11.0, 5.0, 10.0, "CURATED_OFFICIAL_DERIVED"), (13.0, None, None, "CURATED_OFFICIAL_DERIVED")]
    with pytest.raises(ValueError, match="market"):
        im.canonicalize_export(raw, state="M", commodity="Onion")
    with pytest.raises(ValueError):
        im.import_generic(raw, None, "PRIMARY_OFFICIAL")


def test_catalog_needs_its_columns(spark, folder):
    spark.createDataFrame([(1,)], "commodity_id int").write.parquet(f"{folder}/c")
    with pytest.raises(ValueError, match="commodity_name"):
        readers.load_catalog(spark, f"{folder}/c", "commodities")


def forecast_panel(spark, days=180, short=0):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in (("a", days), ("b", days), ("c", days), ("z", short)):
        price = 1000 + 50 * np.cumsum(rng.normal(0, .2, n)) if n else []
        rows += [(day(i), "S", "D", k, k, "Onion", float(p)) for i, p in enumerate(price)]
    return spark.createDataFrame(rows, "date date, state string, district string, market string, market_id string, commodity string, modal_price double")


def test_features_look_back_only(spark):
    x = forecast_panel(spark, short=40)
    pdf = fc.build_features(x, "onion").toPandas().sort_values(["market_id", "date"])
    raw = x.toPandas().sort_values(["market_id", "date"])
    g = raw.groupby("market_id")["modal_price"]
    raw["l1"], raw["l7"], raw["m3"] = g.shift(1), g.shift(7), g.transform(lambda s: s.shift(1).rolling(3).mean())
    both = pdf.merge(raw, on=["market_id", "date"])
    assert len(both) == 3 * (180 - 14) and set(pdf.market_id) == {"a", "b", "c"}
    assert np.allclose(both.lag_1, both.l1) and np.allclose(both.lag_7, both.l7) and np.allclose(both.rolling_mean_3, both.m3)
    assert [r.market_id for r in fc.excluded_markets(x, "Onion").collect()] == ["z"]


def test_split_shares_boundaries(spark):
    x = fc.temporal_split(fc.build_features(forecast_panel(spark), "Onion"))
    r = {s.split: (s.a, s.b) for s in x.groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert r["train"][1] < r["validation"][0] and r["validation"][1] < r["test"][0]
    with pytest.raises(Exception, match="20 distinct"):
        fc.temporal_split(fc.build_features(forecast_panel(spark, 30), "Onion", 10)).collect()


def test_metric_values(spark):
    x = spark.createDataFrame([("m", 100.0, 110.0, 90.0), ("m", 200.0, 190.0, 210.0), ("m", 300.0, 330.0, 290.0), ("z", 0.0, 0.0, 0.0), ("z", 0.0, 1.0, 0.0)],
                              "model string, y double, p double, v double")
    got = {r.model: r for r in fc.metrics(x, ["model"], "y", "p", "v").collect()}
    m, z = got["m"], got["z"]
    assert (m.mae, m.mse, m.median_absolute_error, m.mean_bias_error, m.directional_accuracy_pct) == pytest.approx((50 / 3, 1100 / 3, 10, 10, 100))
    assert z.mape_pct is None and z.wape_pct is None and z.smape_pct == pytest.approx(200) and z.r2 is None


def test_latest_persistence_forecast(spark):
    x = forecast_panel(spark)
    got = {r.market_id: r for r in fc.forecast_latest(x, fc.PERSISTENCE, None, "Onion").collect()}
    last = {r.market_id: r.modal_price for r in x.where(F.col("date") == F.lit(day(179))).collect()}
    assert {k: r.predicted_next_report_price for k, r in got.items()} == last


def test_training_selects_saves_and_serves(spark, folder):
    x = forecast_panel(spark).withColumns({"source": F.lit("s"), "source_tier": F.lit("t"), "data_mode": F.lit("REAL")})
    res = fc.train_and_compare(x, "Onion", sizes=fc.ModelSizes(5, 5), names=[fc.RIDGE, fc.TREE])
    c = {r.model: r for r in res.comparison.collect()}
    assert len(c) == 4 and sum(r.selected_on_validation for r in c.values()) == 1 and len({r.n for r in c.values()}) == 1
    fc.save_artifacts(res, x, f"{folder}/f")
    assert fc.serve_forecasts(spark, f"{folder}/f", ["a"]).count() == 1
    ridge = fc.fit(fc.build_features(x, "Onion"), [fc.RIDGE])[fc.RIDGE]
    assert ridge.transform(fc.latest_features(x.withColumn("market_id", F.concat("market_id", F.lit("new"))), "Onion")).count() == 3


def test_file_hashes_of_files_beyond_one_value(spark, folder, monkeypatch):
    import hashlib

    from pricelattice.sources import sinks
    monkeypatch.setattr(sinks, "WHOLE_FILE", 4)
    draw = np.random.default_rng(1)
    files = {"a.parquet": draw.bytes(300_000), "b.parquet": draw.bytes(70_000) + b"\n", "sub/c d.parquet": b"\xef\xbb\xbfone\ntwo", "sub/e.parquet": b"\xef\xbb\xbfone\r\n",
             "f.parquet": b"\n" * 9, "g.parquet": b"no line feed", "small.parquet": b"abc", "h.json.gz": b"not packed\n", "bare": draw.bytes(9_000)}
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        open(f"{folder}/{name}", "wb").write(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)  # no file may be split
    try:
        got = {r.path: (r.sha256, r.bytes) for r in sinks.file_hashes(spark, folder).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: (hashlib.sha256(data).hexdigest(), len(data)) for name, data in files.items()}
    assert [r.path for r in sinks.file_hashes(spark, folder, "*.gz").collect()] == ["h.json.gz"]
