"""Registered queries: each is an operator over the star-schema tables, paired with its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .report import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: report(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


from . import q_forecast, q_ingest, q_panel, q_series  # noqa: E402,F401
