"""Steps whose cost grew faster than their input, or that ran outside compiled code."""

import os

import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@tables
def test_false_discovery_query_works_its_candidates_out_once(spark):
    plan = plan_of(entry_module.queries()["sta05_benjamini_hochberg"](spark, FOLDER))
    assert "FlatMapGroupsInPandas" not in plan and "lineitem" not in plan


def test_ascii_fold_is_the_ascii_part_of_the_whole_folding(spark):
    from pyspark.sql import functions as F

    from pricelattice.functions import text
    chars = spark.range(1, 0x30000).where("id < 55296 or id > 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    pair = chars.select(F.concat(F.lit("a"), "c", F.lit("b"), "c").alias("s"))
    wrong = pair.where(~text.ascii_fold(F.col("s")).eqNullSafe(F.regexp_replace(text.fold_marks(F.col("s")), r"[^\x00-\x7F]", "")))
    assert pair.count() > 190_000 and wrong.isEmpty()


def test_market_ids_are_small_in_plans(spark):
    from pyspark.sql import functions as F

    from pricelattice.functions.text import make_market_id
    x = spark.createDataFrame([("Bihar", "Gayā", "½ Mandi")], "s string, d string, m string")
    out = x.select(make_market_id(F.col("s"), F.col("d"), F.col("m")).alias("id"))
    assert out.first()[0] == "bihar__gaya__12_mandi"
    assert len(plan_of(out)) < 150_000


def test_titles_and_states(spark):
    from pyspark.sql import functions as F

    from pricelattice.functions import text
    rows = [("ASIA", "Asia"), ("tamil  nadu", "Tamil  Nadu"), ("o'neil-west x1y", "O'Neil-West X1Y"), ("MIDDLE EAST", "Middle East"), ("ÉTÉ d", "Été D"), ("", "")]
    x = spark.createDataFrame(rows, "s string, want string")
    assert [r[0] for r in x.select(text.title_case(F.col("s"))).collect()] == [w for _, w in rows]
    states = [(" NCT\tof  delhi ", "Delhi"), ("\tOrissa", "Odisha"), ("Mahārāshtra", "Maharashtra"), ("west  bengal", "West  Bengal"), (None, "")]
    x = spark.createDataFrame(states, "s string, want string")
    assert [r[0] for r in x.select(text.canonical_state(F.col("s"))).collect()] == [w for _, w in states]


@tables
@pytest.mark.parametrize("name", ["nrm01_normalize_prices", "nrm05_nrm07_row_rules", "src01_panel_scan"])
def test_normaliser_parses_once_in_compiled_code(spark, name):
    df = entry_module.queries()[name](spark, FOLDER)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in optimized.splitlines() if line.strip(" :+-|").startswith("Filter")]
    assert conditions and not any("gettimestamp" in line for line in conditions)
    methods = df._jdf.queryExecution().debug().codegenToSeq()
    for k in range(methods.size()):
        # HotSpot leaves methods of more than 8,000 bytes to the interpreter
        assert methods.apply(k)._3().maxMethodCodeSize() < 8_000


def test_only_large_market_days_take_their_medians_by_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pricelattice.operators import panel
    rows = spark.range(900).select(
        F.lit("2024-01-01").cast("date").alias("date"), F.lit("S").alias("state"), F.lit("D").alias("district"),
        F.when(F.col("id") % 3 > 0, "Big").when(F.col("id") % 2 == 0, "Small").alias("market"), F.lit("Onion").alias("commodity"), F.lit("REAL").alias("data_mode"),
        F.concat(F.lit("v"), F.col("id") % 7).alias("variety"), (F.pmod(F.hash("id"), F.lit(997)) + 0.25).alias("modal_price"),
        F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("min_price"), F.lit(None).cast("double").alias("max_price"),
        (F.col("id") % 11).cast("double").alias("arrivals"), F.lit("unit").alias("arrival_unit"), F.lit("X").alias("source"), F.lit("Y").alias("source_tier"))
    want = sorted(map(str, panel.aggregate_market_daily(rows).collect()))
    assert len(want) == 3
    few = panel.aggregate_market_daily(rows, unbounded_groups=True)
    assert "Window" not in plan_of(few) and sorted(map(str, few.collect())) == want
    for limit in (500, 149, 0):
        monkeypatch.setattr(panel, "LARGE_GROUP", limit)
        split = panel.aggregate_market_daily(rows, unbounded_groups=True)
        assert "Window" in plan_of(split) and sorted(map(str, split.collect())) == want
