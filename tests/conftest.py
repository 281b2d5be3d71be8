import os
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricelattice.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def walk_panel(days=80, markets=(("A", "North"), ("B", "North"), ("C", "Coast")), commodity="Onion", start="2024-01-01", mode="DEMO"):
    """Raw rows of a few markets whose prices swing on waves of their own length, with a drift; no random numbers."""
    out = []
    for k, (market, state) in enumerate(markets):
        for n, day in enumerate(pd.date_range(start, periods=days)):
            price = 1500 + 40 * k + 2.5 * n + (60 + 15 * k) * np.sin(n / (2.3 + k)) + 11 * ((7 * n + 3 * k) % 5)
            out.append((str(day.date()), state, "D", market, commodity, "General", "FAQ", f"{price - 80:.2f}", f"{price + 90:.2f}", f"{price:.2f}",
                        str(40 + (13 * n + 5 * k) % 37), "tonne", "TEST", "", mode))
    return out


@pytest.fixture
def small_panel(spark):
    from pricelattice.operators.normalize import normalize_prices
    from pricelattice.operators.panel import aggregate_market_daily
    from pricelattice.spec import RAW_SCHEMA
    return aggregate_market_daily(normalize_prices(spark.createDataFrame(walk_panel(), RAW_SCHEMA)))
