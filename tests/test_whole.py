"""Queries that read all rows of their tables, beside those whose SQL leaves some out."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


def against_sql(spark, name):
    got = compare(name, entry_module.queries()[name](spark, FOLDER), connect(FOLDER), entry_module.oracle_sql()[name])
    assert got.startswith("ok"), got


def test_positions_of_all_markets(spark):
    against_sql(spark, "win02_report_positions_whole")
    whole = entry_module.queries()["win02_report_positions_whole"](spark, FOLDER)
    returns = entry_module.queries()["top01_jn11_top_markets"](spark, FOLDER)
    assert whole.select("commodity", "market_id").distinct().count() > returns.count()


def test_lead_lag_with_gaps_reads_every_month(spark):
    from pricelattice.plans.q_series import _shifted
    from pricelattice.sources import warehouse as wh
    x = wh.panel(spark, FOLDER)
    assert _shifted(spark, FOLDER).count() == x.count() > x.where("month(date) != 12").count()
    for name in ("cmp01_lead_lag_year_gaps", "cmp01_lead_lag_year_gaps_calendar"):
        against_sql(spark, name)


@pytest.mark.parametrize("name", ["agg11_dataset_statistics_whole", "agg15_density_pivot_whole"])
def test_all_metrics_and_commodities(spark, name):
    against_sql(spark, name)
