"""Normalisation, aggregation, merge, coverage, selection."""

import pytest
from pyspark.sql import functions as F

from pricelattice.functions import text
from pricelattice.functions.ranks import average_ranks, exact_quantiles, spearman
from pricelattice.operators import coverage as cov, normalize as nrm, panel as pan
from pricelattice.spec import RAW_SCHEMA, SelectionPolicy


def raw(spark, *rows):
    base = dict(date="2024-01-01", state="X", district="D", market="M", commodity="Onion", variety="v", grade="g", min_price=None,
                max_price=None, modal_price="100", arrivals=None, arrival_unit="tonne", source="TEST", source_tier="", data_mode="REAL")
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], RAW_SCHEMA)


def test_invalid_price_order_is_blanked(spark):
    r = nrm.normalize_prices(raw(spark, dict(state=" X ", min_price="2500", modal_price="2000", max_price="2300"))).first()
    assert (r.state, r.min_price, r.max_price, r.modal_price) == ("X", None, None, 2000.0)


def test_bounds_bad_numbers_and_negative_quantity(spark):
    x = raw(spark, dict(modal_price="0"), dict(modal_price="1000000", variety="b"), dict(modal_price="abc", variety="c"),
            dict(modal_price="5", variety="d", arrivals="-3"), dict(modal_price="6", variety="e", date="31/02/2024"))
    got = nrm.normalize_prices(x).collect()
    assert [(r.modal_price, r.arrivals) for r in got] == [(5.0, None)]


def test_day_first_and_alias(spark):
    r = nrm.normalize_prices(raw(spark, dict(date="23/09/2026", state="NCT of Delhi"))).first()
    assert str(r.date) == "2026-09-23" and r.state == "Delhi"


def test_timezone_dates_share_a_day(spark):
    x = raw(spark, dict(date="2024-01-01T00:00:00+00:00", variety="a"), dict(date="2024-01-01", variety="b"))
    assert pan.aggregate_market_daily(nrm.normalize_prices(x)).count() == 1


def test_blank_identity_is_kept(spark):
    assert nrm.normalize_prices(raw(spark, dict(state="", market=""))).first().market_id == "unknown__d__unknown"


@pytest.mark.parametrize("unbounded", [False, True])
def test_market_day_rules(spark, unbounded):
    x = raw(spark, dict(variety="a", modal_price="100", arrivals="10"), dict(variety="b", modal_price="200", arrivals="20"),
            dict(market="R", variety="a", arrivals="25"), dict(market="R", variety="b", arrivals="25"),
            dict(market="U", variety="a", arrivals="25"), dict(market="U", variety="b", arrivals="2", arrival_unit="quintal"))
    got = {r.market: r for r in pan.aggregate_market_daily(nrm.normalize_prices(x), unbounded).collect()}
    assert (got["M"].modal_price, got["M"].arrivals, got["M"].varieties) == (150.0, 30.0, 2)
    assert (got["R"].arrivals, got["R"].arrival_unit) == (25.0, "tonne")
    assert got["U"].arrivals is None and got["U"].arrival_unit == "MIXED:quintal|tonne"


def test_authority_merge(spark):
    def daily(tier, rows):
        return pan.aggregate_market_daily(nrm.normalize_prices(raw(spark, *[dict(date=d, modal_price=p, source_tier=tier) for d, p in rows])))
    old = daily("PRIMARY_OFFICIAL", [("2024-01-01", "100"), ("2024-01-02", "110")])
    new = daily("USER_SUPPLIED", [("2024-01-01", "999"), ("2024-01-03", "120")])
    got = {str(r.date): r.modal_price for r in pan.merge_market_daily(old, new).collect()}
    assert got == {"2024-01-01": 100.0, "2024-01-02": 110.0, "2024-01-03": 120.0}
    assert pan.merge_market_daily(None, new) is new and pan.merge_market_daily(old, None) is old
    again = {str(r.date): r.modal_price for r in pan.merge_market_daily(new, daily("USER_SUPPLIED", [("2024-01-01", "5")])).collect()}
    assert again["2024-01-01"] == 5.0


def test_names_and_slugs(spark):
    x = spark.createDataFrame([("Mahārāshtra",), ("TAMIL NĀDU",), ("x-y o'neil a1b",), ("  jammu  &  kashmir ",), (None,)], "s string")
    got = [r[0] for r in x.select(text.canonical_state(F.col("s"))).collect()]
    assert got == ["Maharashtra", "Tamil Nadu", "X-Y O'Neil A1B", "Jammu and Kashmir", ""]
    ids = x.select(text.slug(F.col("s"))).collect()
    assert [r[0] for r in ids] == ["maharashtra", "tamil_nadu", "x_y_o_neil_a1b", "jammu_kashmir", "unknown"]


def test_source_tiers(spark):
    x = spark.createDataFrame([("DATA_GOV_IN_AGMARKNET", "REAL"), ("CEDA_AGMARKNET", "REAL"), ("my file", "REAL"), ("x", "DEMO"), ("old mirror", "REAL")], "s string, m string")
    got = [r[0] for r in x.select(text.infer_source_tier(F.col("s"), F.col("m"))).collect()]
    assert got == ["PRIMARY_OFFICIAL", "CURATED_OFFICIAL_DERIVED", "USER_SUPPLIED", "DEMO", "SECONDARY_MIRROR"]


def test_reports_on_random_walk(spark, small_panel):
    assert cov.coverage_audit(small_panel).count() == 2
    disp = cov.price_dispersion(small_panel)
    assert disp.count() == 80 and disp.where("markets < 3 or cv is null").count() == 0
    q = cov.quality_summary(small_panel).first()
    assert (q["rows"], q["markets"], q["source_tiers"]) == (240, 3, "DEMO")
    assert cov.data_mode(small_panel).first()[0] == "DEMO"


def test_single_market_dispersion_is_null(spark, small_panel):
    r = cov.price_dispersion(small_panel.where("market = 'A'")).first()
    assert r.markets == 1 and r.cv is None and r.iqr is None and r.median_price is not None


def test_scope_selection(spark):
    rows = [dict(date=f"2024-01-{d:02d}", state=f"S{s}", market=f"M{m}", commodity="Onion", arrivals="5") for d in range(1, 31) for s in range(3) for m in range(3)]
    rows += [dict(date=f"2024-01-{d:02d}", state="S0", market="M0", commodity="Rare", arrivals="5") for d in range(1, 31)]
    p = pan.aggregate_market_daily(nrm.normalize_prices(raw(spark, *rows)))
    policy = SelectionPolicy(1, 3, 9, 100, 0.5, 0.5, 20)
    got = {r.commodity: r for r in cov.commodity_scope_table(p, policy).collect()}
    assert got["Onion"].eligible and got["Onion"].recommended and not got["Rare"].eligible
    assert got["Onion"].coverage_score > got["Rare"].coverage_score


def test_same_name_in_two_states_stays_apart(spark):
    x = raw(spark, dict(state="A", district="D1", market="Central Market"), dict(state="B", district="D2", market="Central Market"))
    assert pan.aggregate_market_daily(nrm.normalize_prices(x)).select("market_id").distinct().count() == 2


def test_ordered_statistics_match_plain_definitions(spark):
    """Bucketed ranks and quantiles against window ranks and percentile, with one key holding most rows."""
    x = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(997)) / 10.0 - 20).alias("v"), (F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(50)) / 5.0).alias("w"))
    plain = {r.k: (r.a, r.b, r.c) for r in x.groupBy("k").agg(
        F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b"), F.percentile("v", F.lit(0.0)).alias("c")).collect()}
    mine = {r.k: (r.a, r.b, r.c) for r in exact_quantiles(x, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}).collect()}
    assert plain.keys() == mine.keys()
    for k in plain:
        assert mine[k] == pytest.approx(plain[k], abs=1e-9)
    pdf = x.toPandas()
    pdf["r"] = pdf.groupby("k")["v"].rank()
    want = {(r.k, r.v): r.r for r in pdf.itertuples()}
    got = {(r.k, r.v): r.avg_rank for r in average_ranks(x, ["k"], "v").collect()}
    assert got == want
    pdf["q"] = pdf.groupby("k")["w"].rank()
    rho = {k: g["r"].corr(g["q"]) for k, g in pdf.groupby("k")}
    for r in spearman(x, ["k"], "v", "w").collect():
        assert r.rho == pytest.approx(rho[r.k], abs=1e-9)


def test_row_order_and_partitions_do_not_matter(spark, small_panel):
    a = sorted(map(tuple, cov.price_dispersion(small_panel).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = sorted(map(tuple, cov.price_dispersion(small_panel.orderBy(F.rand(3)).repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b):
        assert x[3:] == pytest.approx(y[3:], rel=1e-12)


def test_portal_date_forms(spark):
    forms = ["05 Jan 2024", "05-Jan-2024", "05/01/24", "05/01/2024 10:30", "2024/01/05", "2024-01-05", "5/1/2024", "05-01-2024", "2024-01-05T23:30:00+00:00", "soon"]
    x = spark.createDataFrame([(f,) for f in forms], "d string").select(nrm.parse_date(F.col("d")).cast("string").alias("d"))
    assert [r.d for r in x.collect()] == ["2024-01-05"] * 9 + [None]


def test_folding_keeps_vowel_signs(spark):
    from pricelattice.functions.text import canonical_state, fold_marks
    cases = {"गुजरात": "गुजरात", "ગુજરાત": "ગુજરાત", "தமிழ்நாடு": "தமிழநாடு", "Mahārāshtra": "Maharashtra", "क़लम": "कलम", "plain": "plain"}
    x = spark.createDataFrame(list(cases.items()), "c string, want string").select("c", "want", fold_marks(F.col("c")).alias("got"))
    assert [(r.c, r.got) for r in x.collect()] == list(cases.items())
    assert spark.range(1).select(canonical_state(F.lit("गुजरात"))).first()[0] == "गुजरात"


def test_folding_equals_full_decomposition(spark):
    import unicodedata
    from pricelattice.functions.text import fold_marks, slug
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and (unicodedata.decomposition(chr(c)) or 0xAC00 <= c < 0xD7A4 and c % 7 == 0 or c % 997 == 0)]
    # runs of characters, as names have them
    texts = ["".join(chars[k:k + 5]) for k in range(0, len(chars), 5)] + ["ﬁne ½ Ǆ 한국", "plain", "", "ﷺ x", "क़लम ㍿", None]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = x.select("t", fold_marks(F.col("t")).alias("folded"), slug(F.col("t")).alias("slug")).collect()
    for r in rows:
        full = unicodedata.normalize("NFKD", r.t or "")
        assert r.folded == (None if r.t is None else "".join(c for c in full if not unicodedata.combining(c))), r.t
    assert {r.t: r.slug for r in rows}["ﬁne ½ Ǆ 한국"] == "fine_12_dz"


def test_chunks_are_read_by_heading_and_in_order(spark, folder):
    import os
    os.makedirs(f"{folder}/a")
    open(f"{folder}/a/1.csv", "w").write("state,date,market,commodity,modal_price,min_price\nNorth,2024-01-02,M,Onion,200,100\nNorth,2024-01-02,M,Onion,210,50\n")
    open(f"{folder}/a/2.csv", "w").write("modal_price,commodity,market,arrival_date,state\n300,Onion,N,03/01/2024,Coast\n")
    open(f"{folder}/a/3.csv", "w").write("")
    from pricelattice.sources.readers import INGEST_ORDER, read_chunks
    rows = read_chunks(spark, folder)
    assert rows.count() == 3
    got = {r.market: r for r in nrm.normalize_prices(rows, INGEST_ORDER).collect()}
    assert (str(got["M"].date), got["M"].state, got["M"].modal_price, got["M"].min_price) == ("2024-01-02", "North", 210.0, 50.0)
    assert got["N"].modal_price == 300.0 and got["N"].state == "Coast"
    open(f"{folder}/a/4.csv", "w").write("x,y\n1,2\n")
    with pytest.raises(ValueError):
        read_chunks(spark, folder)


def test_many_headings_take_one_branch(spark, folder):
    import os
    import random
    from pricelattice.sources.readers import read_chunks
    draw, names = random.Random(1), ["state", "date", "market", "commodity", "modal_price", "min_price", "variety", "extra one", "extra two"]
    os.makedirs(f"{folder}/in")
    want = set()
    for k in range(60):
        heading = draw.sample(names, len(names) - k % 3)
        values = {n: f'"a, {n} ""{k}"""' if n == "variety" else f"{n}{k}" for n in names}
        rows = [",".join(values[h] for h in heading), "", ",".join("" if h == "market" else values[h] for h in heading)]
        open(f"{folder}/in/{k}.csv", "w").write(("﻿" if k % 7 == 0 else "") + ("\n" if k % 5 == 0 else "") + ",".join(f'"{h}"' if k % 2 else h for h in heading) + "\n" + "\n".join(rows) + "\n")
        for blank in (False, True):
            want.add(tuple(None if n not in heading or (blank and n == "market") else f'a, variety "{k}"' if n == "variety" else f"{n}{k}" for n in names[:7]))
    rows = read_chunks(spark, f"{folder}/in")
    assert {tuple(r[n] for n in names[:7]) for r in rows.collect()} == want and rows.count() == 120
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "Union" not in plan and rows.filter("arrivals is not null").count() == 0


def test_only_local_sessions_do_without_a_shared_folder():
    from pricelattice.session import shared_root
    assert shared_root("s3a://b/c/", "/w", "yarn") == "s3a://b/c" and shared_root("", "/w/", "local[4]") == "/w"
    for master in ("yarn", "spark://h:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_root(None, "/w", master)


def test_dispersion_moves_numbers_instead_of_names(spark):
    from pricelattice.operators import coverage as cov
    from pricelattice.sources import warehouse as wh
    folder = "/root/testdata/sf0.001"
    days, names = wh.daily_prices(spark, folder, typed=True, fine=True)
    assert "string" not in dict(days.dtypes).values()
    name = {r.number: r["name"] for r in names.collect()}

    def rows(df, told):
        return {(r.date, told(r.commodity)): tuple(-1 if x is None else x for x in r[2:]) for r in df.collect()}
    got = rows(cov.price_dispersion(days), name.get)
    want = rows(cov.price_dispersion(wh.panel(spark, folder, typed=True, fine=True)), str)
    assert got.keys() == want.keys() and len(set(name.values())) > 1
    assert all(x == pytest.approx(want[k], rel=1e-9) for k, x in got.items())
